"""LM scoring by logistic context mixing, beside a unigram base score.

A text is a stream of bytes: its words, A-Z lower-cased, each with a space after it, then an end byte. Each byte is eight binary
decisions. Predictors by the 1 to 4 bytes before it and by the whole of its word so far, kept as exact tables of counts, each give
a log-odds for a decision; weights gated by the place in the word and by the counts mix them, and an adaptive table refines the
mix. Weights and refining table are learned in rounds over all bytes of all training documents: a decision depends on its byte and
context alone, so each distinct event counts as often as it occurs. The sum over all decisions is the text's log probability,
hence its bits per byte. The tables hold counts of all training documents; they grow with the distinct events, are partitioned by
the two nearest bytes of the context and are compared by the whole context. Rows are dealt to groups of some GROUP bytes; a group
asks for its distinct events and tokens once, and what comes back to it are their scores and counts in the order asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FANIN, Hashed, bitmap, buffers, chunks, distinct, in_bitmap, mix, per_row, release, stash, text_column, tidy, words

#: Nearest bytes of a context; predictors: one for each number of nearest bytes, and one for the word so far; slots of each
#: predictor's table of a mixer that is used alone; rounds over all events that weights are learned in.
NEAR, ORDERS, SLOT_BITS, ROUNDS = 4, 5, 20, 4
SLOTS = 1 << SLOT_BITS
#: What each predictor sees of a context: the nearest bytes, then a hash of what is before them in the word.
SEEN = [np.uint64((1 << 8 * k) - 1) for k in range(1, NEAR + 1)] + [np.uint64((1 << 56) - 1)]
#: Training tokens of a word from which on its beginnings are contexts.
OFTEN = 1
#: Bytes of text, about, of a group of rows, and for each bucket of events and of tokens; entries that are merged at a time.
GROUP, DEAL, MERGED = 1 << 24, 1 << 22, 1 << 22
#: Events of a partition, about, and of a part of it that is handled at a time; contexts with the same two nearest bytes stay together.
DEALT, PART = 1 << 17, 1 << 15
#: Added to both counts of a decision; bounds of the counts that gate the weights; steps of the refining table.
PRIOR, GATES, CELLS = 0.4, (1, 4, 32), 24
#: Pull of the weights towards their first values, in decisions; largest change of a gate's weights in a round.
PULL, STRIDE = 4.0, 1.0
END = 10
#: The end token's place in the vocabulary; no word hashes to it but by a chance of 2**-64.
END_HASH = 0x5BD1E9955BD1E995
OUT = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def stream(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the normalised texts."""
    rows = len(first) - 1
    size = end - start
    row = np.repeat(np.arange(rows), np.diff(first))
    out = np.full(int(size.sum()) + len(size) + rows, 32, np.uint8)
    begin = np.cumsum(size + 1) - (size + 1) + row
    inside = np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)
    source = np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)
    got = data[source]
    out[inside] = np.where((got >= 65) & (got <= 90), got + 32, got)
    off = np.concatenate([[0], np.cumsum(per_row(size + 1, first) + 1)])
    out[off[1:] - 1] = END
    return out, off


def packed(text: np.ndarray, off: np.ndarray, often: np.ndarray | None = None) -> np.ndarray:
    """Each byte with its context as one integer: the byte, the NEAR bytes before it (the end byte before a text), 24 bits of the word.

    The word's bits are 0 where the word begins within the nearest bytes, which tell it whole, or where what there is of it
    isn't in the bitmap `often`; else a hash of its bytes before the nearest.
    """
    at = np.arange(len(text))
    planes = np.zeros((len(text), 8), np.uint8)  # the bytes of the integers, the least first
    planes[:, 0] = text
    for back in range(1, NEAR + 1):
        planes[back:, back] = text[: max(0, len(text) - back)]
        for k in range(back):
            edge = off[:-1][off[1:] - off[:-1] > k] + k
            planes[edge, back] = END
    key = planes.view("<u8").ravel()
    begin = np.maximum.accumulate(np.where(np.r_[True, (text[:-1] == 32) | (text[:-1] == END)], at, 0)) if len(text) else at
    far = np.flatnonzero(at - begin >= NEAR)
    hashed = Hashed(text)
    if often is not None:
        far = far[in_bitmap(often, hashed.of(begin[far], far))]
    head = hashed.of(begin[far], far - NEAR)
    key[far] |= (np.uint64(1) + head % np.uint64((1 << 24) - 1)) << np.uint64(8 * (NEAR + 1))
    return key


def place_in_word(key: np.ndarray) -> np.ndarray:
    """How many bytes of its word are before each byte; NEAR for that many or more."""
    out = np.full(len(key), NEAR, np.int64)
    for back in range(NEAR, 0, -1):
        byte = key >> np.uint64(8 * back) & np.uint64(255)
        out[(byte == 32) | (byte == END)] = back - 1
    return out


def vocabulary(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    start, end, first = words(data, off)
    return Hashed(data, fold=True).of(start, end), start, end, first


def counted_tokens(docs: DataFrame) -> DataFrame:
    """(h, w, c): the training tokens of docs (text, held_out) by hash, with their lower-cased bytes, null for the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        for batch in batches:
            column = batch.column(0).filter(pc.invert(batch.column(1)))
            for i, j, data, off in chunks(column):
                h, start, end, _ = vocabulary(data, off)
                h, at, c = np.unique(h, return_index=True, return_counts=True)
                size = end[at] - start[at]
                place = np.concatenate([[0], np.cumsum(size)])
                letters = data[np.arange(place[-1]) + np.repeat(start[at] - place[:-1], size)]
                letters = np.where((letters >= 65) & (letters <= 90), letters + 32, letters).astype(np.uint8)
                w = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(place.astype(np.int64)), pa.py_buffer(letters)])
                kept += [(h, c, w), (np.array([END_HASH], np.uint64), np.array([j - i]), pa.array([None], pa.large_binary()))]
                if len(kept) > 32:
                    kept = [_merged_words(kept)]
        if kept:
            h, c, w = _merged_words(kept)
            for s in range(0, len(h), 1 << 18):
                part = slice(s, s + (1 << 18))
                yield pa.RecordBatch.from_arrays([pa.array(h[part].view(np.int64)), w.slice(s, len(h[part])).cast(pa.binary()), pa.array(c[part])], ["h", "w", "c"])

    return docs.select("text", "held_out").mapInArrow(tidy(run), "h long, w binary, c long").groupBy("h", "w").agg(F.sum("c").alias("c"))


def _merged_words(parts: list) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    h = np.concatenate([p[0] for p in parts])
    order = np.argsort(h, kind="stable")
    at = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
    words_ = pa.chunked_array([p[2] for p in parts]).take(pa.array(order[at])).combine_chunks()
    return h[order][at], np.add.reduceat(np.concatenate([p[1] for p in parts])[order], at), words_


def beginnings(tokens: DataFrame, least: int = OFTEN) -> np.ndarray:
    """The bitmap of the beginnings, NEAR bytes or longer, of the words among tokens (w, c) that are seen `least` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column(0))
            size = np.maximum(np.diff(off) - NEAR + 1, 0)
            start = np.repeat(off[:-1], size)
            end = start + NEAR + np.arange(len(start)) - np.repeat(np.cumsum(size) - size, size)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(Hashed(data).of(start, end)).view(np.int64))], ["p"])

    often = tokens.where((F.col("c") >= least) & F.col("w").isNotNull())
    return bitmap(often.select("w").mapInArrow(tidy(run), "p long"))


def counted_events(docs: DataFrame, often) -> DataFrame:
    """(h, c): the bytes of docs (text, held_out) with their contexts; those of held-out documents are listed too, and count 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        for batch in batches:
            for out in (False, True):
                for _, _, data, off in chunks(batch.column(0).filter(pc.equal(batch.column(1), out))):
                    _, start, end, first = vocabulary(data, off)
                    key, c = np.unique(packed(*stream(data, start, end, first), often.value), return_counts=True)
                    kept.append((key, c * (not out)))
                    if len(kept) > 16:
                        kept = [_merged(kept)]
        if kept:
            h, c = _merged(kept)
            for s in range(0, len(h), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(h[s : s + (1 << 18)].view(np.int64)), pa.array(c[s : s + (1 << 18)])], ["h", "c"])

    return docs.select("text", "held_out").mapInArrow(tidy(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    h = np.concatenate([p[0] for p in parts])
    c = np.concatenate([p[1] for p in parts])
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    return h[at], np.add.reduceat(c, at).astype(np.int64) if len(h) else c.astype(np.int64)


def decisions(key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of the eight decisions of a byte: (slots by order x key, the bit)."""
    symbol = key & np.uint64(255)
    contexts = [mix((key >> np.uint64(8)) & seen ^ np.uint64(k << 56)) for k, seen in enumerate(SEEN, 1)]
    for depth in range(8):
        node = (np.uint64(1) << np.uint64(depth)) | (symbol >> np.uint64(8 - depth))
        slots = np.stack([(mix(c + node * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64) for c in contexts])
        yield slots, ((symbol >> np.uint64(7 - depth)) & np.uint64(1)).astype(np.int64)


def nearest_counts(events: DataFrame) -> np.ndarray:
    """contexts x nodes x 2 of order 1: a byte after a byte, so its size is fixed and no two contexts share a place."""
    out = np.zeros((256, 256, 2))
    for g, c in events.where("c > 0").groupBy(F.col("h").bitwiseAND(0xFFFF)).agg(F.sum("c")).collect():  # 65,536 rows at most
        for depth in range(8):
            out[g >> 8, (1 << depth) | (g & 255) >> 8 - depth, g >> 7 - depth & 1] += c
    return out


def nearest_of_parts(parts: DataFrame) -> np.ndarray:
    """The same from parts (h binary, c binary)."""

    def add(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros(1 << 16)
        for key, c in parts_of(batch):
            total += np.bincount((key & np.uint64(0xFFFF)).astype(np.int64), c, 1 << 16)
        return total

    out, got = np.zeros((256, 256, 2)), totalled(parts.select("h", "c"), add, (1 << 16,))
    at = np.flatnonzero(got)
    for depth in range(8):
        np.add.at(out, (at >> 8, (1 << depth) | (at & 255) >> 8 - depth, at >> 7 - depth & 1), got[at])
    return out


def grouped(events: DataFrame, count: int) -> DataFrame:
    """(h binary, c binary): the events (h, c) in parts, each with all events of the two nearest bytes that it holds."""
    near = F.shiftright("h", 8).bitwiseAND(0xFFFF)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()) for b in batches]
        if not got:
            return
        h, c = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        order = np.lexsort((h, h >> np.uint64(8) & np.uint64(0xFFFF)))
        h, c = h[order], c[order]
        group = h >> np.uint64(8) & np.uint64(0xFFFF)
        edge = np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(h)]
        s = 0
        while s < len(h):
            e = int(edge[np.searchsorted(edge, min(s + PART, len(h)))])
            yield pa.RecordBatch.from_arrays([pa.array([x[s:e].tobytes()], pa.binary()) for x in (h, c)], ["h", "c"])
            s = e

    return events.select("h", "c").repartition(max(1, -(-count // DEALT)), near).mapInArrow(tidy(run), "h binary, c binary")


def parts_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for h, c in zip(batch.column(0), batch.column(1), strict=True):
        yield np.frombuffer(h.as_buffer(), np.uint64), np.frombuffer(c.as_buffer(), np.int64).astype(float)


def ranks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of one of each distinct value, number of each value among them), the distinct values in order."""
    order = np.argsort(values)
    by = values[order]
    new = np.r_[True, by[1:] != by[:-1]][: len(by)]
    number = np.empty(len(by), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def shares(code: np.ndarray, c: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """How often a 0 and a 1 follow the first `depth` bits of the last byte of sorted codes."""
    node = code >> np.uint64(8 - depth)
    at = np.flatnonzero(np.r_[True, node[1:] != node[:-1]][: len(node)])
    size = np.diff(np.r_[at, len(code)])
    one, both = np.add.reduceat(c * (code >> np.uint64(7 - depth) & np.uint64(1)), at), np.add.reduceat(c, at)
    return np.repeat(both - one, size), np.repeat(one, size)


def kinds_of(key: np.ndarray, c: np.ndarray, nearest: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each of the eight decisions of the events of a part: (counts by order x kind x bit, the bit, an event of each kind, each event's kind).

    Events are of a kind if they agree in their nearest bytes, their own bits so far and the counts of the longest context: all that a
    decision goes by.
    """
    if not len(key):
        return
    near, byte = np.uint64((1 << 32) - 1), np.uint64(255)
    longest = (key >> np.uint64(8) & near) << np.uint64(32) | key >> np.uint64(40) << np.uint64(8) | key & byte
    order = np.argsort(longest)
    longest, c = longest[order], c[order]
    code, codes = longest >> np.uint64(32) << np.uint64(8) | longest & byte, []  # of 4, 3 and 2 nearest bytes, each from those of one more
    weight, back = c, None
    for seen in SEEN[NEAR - 1 : 0 : -1]:
        code = code & (seen << np.uint64(8) | byte)
        first, number = ranks(code)
        code, weight = code[first], np.bincount(number, weight)
        back = number if back is None else number[back]
        codes.append((code, weight, back))
    four, _, to_four = codes[0]
    for depth in range(8):
        step = np.r_[True, four[1:] >> np.uint64(7 - depth) != four[:-1] >> np.uint64(7 - depth)]
        values, size = [(np.cumsum(step) - 1)[to_four]], []
        zero, one = shares(longest, c, depth)
        values += [zero.astype(np.int64), one.astype(np.int64)]
        size = [int(x.max()).bit_length() for x in values]
        if sum(size) > 63:
            values[1:] = [ranks(x)[1] for x in values[1:]]
            size = [int(x.max()).bit_length() for x in values]
        first, number = ranks((values[0] << size[1] | values[1]) << size[2] | values[2])
        n = np.empty((ORDERS, len(first), 2))
        symbol = (longest[first] & byte).astype(np.int64)
        n[0] = nearest[(longest[first] >> np.uint64(32) & byte).astype(np.int64), (1 << depth) | symbol >> (8 - depth)]
        for k, (code, weight, back) in enumerate(reversed(codes), 1):
            at = back[first]
            for b, x in enumerate(shares(code, weight, depth)):
                n[k, :, b] = x[at]
        n[-1, :, 0], n[-1, :, 1] = zero[first], one[first]
        kind = np.empty(len(key), np.int64)
        kind[order] = number
        yield n, symbol >> (7 - depth) & 1, order[first], kind


def counts_of(key: np.ndarray, c: np.ndarray, nearest: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same event by event: (counts by order x key x bit, the bit)."""
    for n, bit, _, kind in kinds_of(key, c, nearest):
        yield n[:, kind], bit[kind]


def squash(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -20, 20)))


class Mixer:
    """The gated weights and the refining table; alone, for small streams, with hashed tables of counts too."""

    def __init__(self, counts: np.ndarray | None = None):
        self.counts = None if counts is None else counts.astype(np.float32)
        self.weights = np.full((4**2 * (NEAR + 1), ORDERS + 1), 0.28)
        self.weights[:, ORDERS] = 0.0
        self.first = self.weights.copy()
        self.hits = np.zeros((len(self.weights), CELLS, 2))
        centre = squash((np.arange(CELLS) - CELLS / 2 + 0.5) / CELLS * 16)
        self.hits[:, :, 1], self.hits[:, :, 0] = 8 * centre, 8 * (1 - centre)

    def found(self, slots: np.ndarray) -> np.ndarray:
        """orders x decisions x 2: the tables' counts."""
        return np.stack([self.counts[k, slots[k]] for k in range(ORDERS)])

    def inputs(self, n: np.ndarray, place: np.ndarray, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(log-odds by order, gate) of decisions from their counts and places in words; leave: the bit whose own count is left out, while learning."""
        if leave is not None:
            n[:, np.arange(n.shape[1]), leave] = np.maximum(0, n[:, np.arange(n.shape[1]), leave] - 1)
        x = np.log((n[:, :, 1] + PRIOR) / (n[:, :, 0] + PRIOR))
        gate = place * 16 + np.searchsorted(GATES, n[-1].sum(1), "right") * 4 + np.searchsorted(GATES, n[-2].sum(1), "right")
        return np.vstack([x, np.ones(x.shape[1])]), gate

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dot = np.einsum("ki,ik->i", x, self.weights[gate])
        return squash(dot), np.clip((np.clip(dot, -8, 8) / 16 * CELLS + CELLS / 2).astype(np.int64), 0, CELLS - 1)

    def refined(self, p: np.ndarray, gate: np.ndarray, cell: np.ndarray) -> np.ndarray:
        hits = self.hits[gate, cell]
        return np.clip((p + hits[:, 1] / hits.sum(1)) / 2, 1e-7, 1 - 1e-7)

    def learn(self, key: np.ndarray, rate: float = 0.02, batch: int = 1024) -> None:
        """One online pass over a stream of events, a small batch at a time."""
        for s in range(0, len(key), batch):
            for slots, bit in decisions(key[s : s + batch]):
                x, gate = self.inputs(self.found(slots), place_in_word(key[s : s + batch]), bit)
                p, cell = self.mixed(x, gate)
                step = rate * (bit - p) * x
                size = np.bincount(gate, minlength=len(self.weights))
                for k in range(ORDERS + 1):
                    self.weights[:, k] += np.bincount(gate, weights=step[k], minlength=len(self.weights)) / np.sqrt(np.maximum(1, size))
                np.add.at(self.hits, (gate, cell, bit), 1.0)

    def gradients(self, n: np.ndarray, place: np.ndarray, bit: np.ndarray, c: np.ndarray) -> np.ndarray:
        """gates x (gradient, curvature): sums over decisions of the log likelihood's derivatives by the weights."""
        x, gate = self.inputs(n, place, bit)
        p, _ = self.mixed(x, gate)
        rise, bend = c * (bit - p), c * p * (1 - p)
        size, k = len(self.weights), ORDERS + 1
        out = np.zeros((size, k + k * k))
        order = np.argsort(gate.astype(np.uint8), kind="stable")
        edge = np.r_[0, np.cumsum(np.bincount(gate, minlength=size))]
        x, bent, rise = x[:, order], (x * bend)[:, order], rise[order]
        for g in np.flatnonzero(edge[1:] > edge[:-1]).tolist():
            own = slice(edge[g], edge[g + 1])
            out[g, :k] = x[:, own] @ rise[own]
            out[g, k:] = (bent[:, own] @ x[:, own].T).ravel()
        return out

    def stepped(self, sums: np.ndarray) -> None:
        """A Newton step of each gate's weights by the sums of `gradients` over all events, at most STRIDE long."""
        k = ORDERS + 1
        rise = sums[:, :k] - PULL * (self.weights - self.first)
        step = np.linalg.solve(sums[:, k:].reshape(-1, k, k) + PULL * np.eye(k), rise[:, :, None])[:, :, 0]
        self.weights += step * np.minimum(1.0, STRIDE / np.maximum(np.abs(step).max(1, keepdims=True), 1e-12))

    def refinements(self, n: np.ndarray, place: np.ndarray, bit: np.ndarray, c: np.ndarray) -> np.ndarray:
        """gates x cells x 2: how often each bit followed where the mix fell into a cell."""
        x, gate = self.inputs(n, place, bit)
        _, cell = self.mixed(x, gate)
        return np.bincount((gate * CELLS + cell) * 2 + bit, c, self.hits.size).reshape(self.hits.shape)

    def log_probability(self, key: np.ndarray) -> np.ndarray:
        """log10 of each byte's probability in its context."""
        every = np.arange(len(key))
        return self.log_probability_of(((self.found(slots), bit, every, every) for slots, bit in decisions(key)), place_in_word(key))

    def log_probability_of(self, kinds: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], place: np.ndarray) -> np.ndarray:
        """The same for events whose eight decisions are of these kinds (see `kinds_of`)."""
        total = np.zeros(len(place))
        for n, bit, first, kind in kinds:
            x, gate = self.inputs(n, place[first])
            p, cell = self.mixed(x, gate)
            q = self.refined(p, gate, cell)
            total += np.log10(np.where(bit == 1, q, 1 - q))[kind]
        return total


def totalled(rows: DataFrame, add, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all Arrow batches of add(batch), an array of fixed shape; a task sends one array, many tasks' are added in two rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            total += add(batch)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total.tobytes()], pa.binary())], ["task", "data"])

    def added(tasks: pa.Table) -> pa.Table:
        tasks = tasks.sort_by("task")
        total = sum(np.frombuffer(x.as_buffer()) for x in tasks["data"])
        return pa.table([tasks["task"].slice(0, 1), pa.array([total.tobytes()], pa.binary())], ["task", "data"])

    found = rows.mapInArrow(tidy(run), "task long, data binary")
    if rows.rdd.getNumPartitions() > FANIN:
        found = found.groupBy(F.pmod("task", F.lit(FANIN))).applyInArrow(added, "task long, data binary")
    total = np.zeros(shape)
    for r in sorted(found.collect(), key=lambda r: r["task"]):  # FANIN small arrays
        total += np.frombuffer(r["data"]).reshape(shape)
    return total


def learned(events: DataFrame, nearest: np.ndarray) -> Mixer:
    """The weights and refining table learned from all events (h binary, c binary) of `grouped`."""
    spark, mixer = events.sparkSession, Mixer()
    for i in range(ROUNDS + 1):
        last = i == ROUNDS
        shared = spark.sparkContext.broadcast((mixer, nearest))  # bounded by ORDERS, CELLS and the bytes

        def add(batch: pa.RecordBatch, shared=shared, last=last):
            m, near = shared.value
            total = 0.0
            for key, c in parts_of(batch):
                key, c = key[c > 0], c[c > 0]
                place = place_in_word(key)
                for n, bit, first, kind in kinds_of(key, c, near):
                    total = total + (m.refinements if last else m.gradients)(n, place[first], bit, np.bincount(kind, c))
            return total

        sums = totalled(events, add, mixer.hits.shape if last else (len(mixer.weights), (ORDERS + 1) * (ORDERS + 2)))
        if last:
            mixer.hits += sums
        else:
            mixer.stepped(sums)
        shared.unpersist()
    return mixer


def part_scores(parts: DataFrame, mixer: Mixer, nearest: np.ndarray) -> DataFrame:
    """(bucket, n, lp): log10 of the probability of each event of the parts (h, c, bucket, n), in their order."""
    shared = parts.sparkSession.sparkContext.broadcast((mixer, nearest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, near = shared.value
        for batch in batches:
            lp = [m.log_probability_of(kinds_of(key, c, near), place_in_word(key)).astype(np.float32).tobytes() for key, c in parts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array(lp, pa.binary())], ["bucket", "n", "lp"])

    return parts.select("h", "c", "bucket", "n").mapInArrow(tidy(run), "bucket int, n long, lp binary")


def gathered(rows: DataFrame, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, values) of rows (h, value), gathered partition by partition as plain bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(i).to_numpy().tobytes()], pa.binary()) for i in (0, 1)], ["h", "v"])

    h, v = [np.zeros(0, np.uint64)], [np.zeros(0, kind)]
    for r in rows.mapInArrow(tidy(run), "h binary, v binary").toLocalIterator():
        h.append(np.frombuffer(r["h"], np.uint64))
        v.append(np.frombuffer(r["v"], kind))
    known = np.concatenate(h)
    order = np.argsort(known)
    return known[order], np.concatenate(v)[order]


def looked_up(known: np.ndarray, values: np.ndarray, want: np.ndarray) -> np.ndarray:
    """The value of each wanted hash; 0 for one that the table lacks."""
    if not len(known):
        return np.zeros(len(want), values.dtype)
    at = np.minimum(np.searchsorted(known, want), len(known) - 1)
    return np.where(known[at] == want, values[at], values.dtype.type(0))


class Order:
    """The order in which events and tokens are listed: by bucket. Events of the same two nearest bytes share a bucket; the tokens' buckets follow."""

    def __init__(self, buckets: int):
        bucket = (mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64)) % np.uint64(buckets)).astype(np.int64)
        self.buckets, self.near = buckets, np.argsort(bucket, kind="stable").astype(np.uint64)
        self.rank = np.empty(1 << 16, np.uint64)
        self.rank[self.near.astype(np.int64)] = np.arange(1 << 16, dtype=np.uint64)
        self.first = np.searchsorted(bucket[self.near.astype(np.int64)], np.arange(buckets))
        self.tokens = np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)

    def sortable(self, key: np.ndarray) -> np.ndarray:
        near = (key >> np.uint64(8)).astype(np.uint16)
        return self.rank[near] << np.uint64(48) | (key >> np.uint64(24)) << np.uint64(8) | key & np.uint64(255)

    def key(self, value: np.ndarray) -> np.ndarray:
        near = self.near[(value >> np.uint64(48)).astype(np.int64)]
        return (value >> np.uint64(8) & np.uint64((1 << 40) - 1)) << np.uint64(24) | near << np.uint64(8) | value & np.uint64(255)

    def cuts(self, events: np.ndarray, tokens: np.ndarray) -> Iterator[tuple[int, np.ndarray, int, int]]:
        """(bucket, its list, begin, end) of the sorted events and tokens that each bucket holds."""
        edges = np.searchsorted(events, self.first.astype(np.uint64) << np.uint64(48)), np.searchsorted(tokens, self.tokens)
        for k, (values, edge) in enumerate(zip((events, tokens), edges, strict=True)):
            edge = np.r_[edge, len(values)]
            for b in np.flatnonzero(edge[1:] > edge[:-1]).tolist():
                yield k * self.buckets + b, k, int(edge[b]), int(edge[b + 1])


def packed_bytes(x: np.ndarray, kind: type, rising: bool = False) -> bytes:
    """x in compressed planes of bytes; rising values by their differences."""
    x = np.diff(x, prepend=x.dtype.type(0)) if rising else x
    x = np.ascontiguousarray(x.astype(kind))
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T), codec="zstd", asbytes=True)


def unpacked(data: pa.Scalar, n: int, kind: type, rising: bool = False) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data.as_buffer(), n * size, codec="zstd"), np.uint8).reshape(size, n)
    x = np.ascontiguousarray(planes.T).view(kind).ravel()
    return np.cumsum(x, dtype=kind) if rising else x


def listed(rows: DataFrame, order, group: int) -> DataFrame:
    """Rows (doc_id, text, held_out) with the number of their group, and for each group and bucket a row of what it asks for:
    its n sorted distinct events or tokens, and how often each occurs in its training rows."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, begun, now, kept = TaskContext.get().partitionId() << 32, 0, -1, ([], [])

        def asked() -> pa.RecordBatch:
            (h, c), (t, tc) = _merged(kept[0]), _merged(kept[1])
            out: list[tuple] = []
            for bucket, which, a, b in order.value.cuts(h, t):
                values, counts = ((h, c), (t, tc))[which]
                out.append((bucket, b - a, packed_bytes(values[a:b], np.uint64, True), packed_bytes(counts[a:b], np.uint32)))
            bucket, n, values, counts = zip(*out, strict=True)
            none = [pa.nulls(len(out), batch.schema.field(k).type) for k in range(3)]
            columns = [pa.array([now] * len(out)), *none, pa.array(bucket, pa.int32()), pa.array(n), pa.array(values, pa.binary()), pa.array(counts, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, NAMES)

        for batch in batches:
            size = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            number = (begun + np.cumsum(size) - size) // group
            begun += int(size.sum())
            none = [pa.nulls(len(size), t) for t in (pa.int32(), pa.int64(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(task + number), *batch.columns, *none], NAMES)
            cut = np.r_[np.flatnonzero(np.r_[True, number[1:] != number[:-1]]), len(number)] if len(number) else np.zeros(0, int)
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if now != task + int(number[a]):
                    if kept[0]:
                        yield asked()
                    now, kept = task + int(number[a]), ([], [])
                texts, out = batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a)
                for held in (False, True):
                    for i, j, data, off in chunks(texts.filter(pc.equal(out, held))):
                        h, start, end, first = vocabulary(data, off)
                        key, c = np.unique(order.value.sortable(packed(*stream(data, start, end, first))), return_counts=True)
                        h, n = np.unique(h, return_counts=True)
                        kept[0].append((key, c * (not held)))
                        kept[1].extend([(h, n * (not held)), (np.array([END_HASH], np.uint64), np.array([(j - i) * (not held)]))])
                for k in kept:
                    if len(k) > 16:
                        k[:] = [_merged(k)]
        if kept[0]:
            yield asked()

    return rows.select("doc_id", "text", "held_out").mapInArrow(tidy(run), f"p long, doc_id {kind}, text string, held_out boolean, bucket int, n long, h binary, c binary")


NAMES = ["p", "doc_id", "text", "held_out", "bucket", "n", "h", "c"]


def met(asked: DataFrame, order) -> DataFrame:
    """What all groups ask of a bucket, met in one place.

    Of events (kind 0) the parts of the bucket's table, numbered n, and (kind 1) the places in the table of each group's n events; of
    tokens (kind 2) the counts of each group's n tokens, and (kind 3) the bucket's n distinct training tokens and their total p.
    """

    def meet(rows: pa.Table) -> pa.Table:
        bucket = rows["bucket"][0].as_py()
        p, n, h, c = (rows[k] for k in ("p", "n", "h", "c"))
        sizes = n.to_pylist()
        known, some, held = np.zeros(0, np.uint64), [], 0
        for k, x in enumerate(h):
            some.append(unpacked(x, sizes[k], np.uint64, True))
            held += sizes[k]
            if held > MERGED or k == len(sizes) - 1:
                known, some, held = distinct(np.concatenate([known, *some])), [], 0
        total, kinds = np.zeros(len(known), np.int64), []
        tokens = bucket >= order.value.buckets
        places = (np.searchsorted(known, unpacked(x, sizes[k], np.uint64, True)) for k, x in enumerate(h))
        for k, at in enumerate(places):
            total[at] += unpacked(c[k], sizes[k], np.uint32)
            kinds.append(packed_bytes(at, np.uint32, True))
        groups = p.to_pylist()
        if tokens:
            out = [(2, g, s, packed_bytes(total[unpacked(pa.scalar(x, pa.binary()), s, np.uint32, True)], np.uint64), None) for g, s, x in zip(groups, sizes, kinds, strict=True)]
            out.append((3, int(total.sum()), int((total > 0).sum()), None, None))
        else:
            out = [(1, g, s, x, None) for g, s, x in zip(groups, sizes, kinds, strict=True)]
            edge = np.r_[np.flatnonzero(np.r_[True, known[1:] >> np.uint64(48) != known[:-1] >> np.uint64(48)]), len(known)]
            s = i = 0
            while s < len(known):
                e = int(edge[np.searchsorted(edge, min(s + PART, len(known)))])
                out.append((0, None, i, order.value.key(known[s:e]).tobytes(), total[s:e].tobytes()))
                s, i = e, i + 1
        columns = list(zip(*out, strict=True))
        return pa.table([pa.array([bucket] * len(out), pa.int32()), *(pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True))], ["bucket", "kind", "p", "n", "h", "c"])

    return asked.groupBy("bucket").applyInArrow(meet, "bucket int, kind int, p long, n long, h binary, c binary")


def answered(scores: DataFrame, asked: DataFrame) -> DataFrame:
    """(p, bucket, n, h): the scores (bucket, n, lp) of the events at the places that each group asked for (bucket, p, n, h)."""

    def answer(scores: pa.Table, asked: pa.Table) -> pa.Table:
        lp = np.concatenate([np.frombuffer(x.as_buffer(), np.float32) for x in scores.sort_by("n")["lp"]])
        out = [lp[unpacked(x, n, np.uint32, True)].tobytes() for n, x in zip(asked["n"].to_pylist(), asked["h"], strict=True)]
        return pa.table([asked["p"], asked["bucket"], asked["n"], pa.array(out, pa.binary())], ["p", "bucket", "n", "h"])

    return scores.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(answer, "p long, bucket int, n long, h binary")


def in_order_of(passes: list[pa.Array], values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(values in the order of a dictionary that all passes share, each pass's places in it); values: one for each distinct entry, by its size."""
    one = pa.chunked_array(passes).unify_dictionaries()
    out = np.empty_like(values)
    out[np.argsort(one.chunk(0).dictionary.to_numpy())] = values
    return out, [x.indices.to_numpy() for x in one.chunks]


def held_out():
    """crc32 of the id as text, modulo 7, is 2; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def mixing_scores(docs: DataFrame, held: int = GROUP) -> DataFrame:
    """Per row of docs (doc_id, text): the contract's columns and bits_per_byte. held: bytes of text of a group, about.

    A null or empty text is its end alone. Null ids and repeated rows give a row each; all rows but those held out are
    learned from; without training rows every decision is even; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].alias("doc_id"), text_column(docs).alias("text"), held_out().alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + size // DEAL
    order = spark.sparkContext.broadcast(Order(buckets))
    asked = stash(listed(rows, order, held), "asked")
    of_bucket = asked.where("bucket IS NOT NULL").select("bucket", "p", "n", "h", "c").repartition(2 * buckets, "bucket")
    found = stash(met(of_bucket, order), "events")
    total, kinds = found.where("kind = 3").agg(F.coalesce(F.sum("p"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts = found.where("kind = 0").select("h", "c", "bucket", "n")
    nearest = nearest_of_parts(parts)
    scores = part_scores(parts, learned(parts.select("h", "c"), nearest), nearest)
    answers = answered(scores, found.where("kind = 1").select("bucket", "p", "n", "h")).union(found.where("kind = 2").select("p", "bucket", "n", "h"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        rows, answers = rows.combine_chunks(), answers.sort_by("bucket")
        lp, count = [], []
        for bucket, n, x in zip(answers["bucket"].to_pylist(), answers["n"].to_pylist(), answers["h"], strict=True):
            if bucket < buckets:
                lp.append(np.frombuffer(x.as_buffer(), np.float32))
            else:
                count.append(unpacked(x, n, np.uint64).astype(np.int64))
        lp, count = (np.concatenate(x) if x else np.zeros(0) for x in (lp, count))
        passes, events, tokens = [], [], []
        for i, j, data, off in chunks(rows["text"]):
            h, start, end, first = vocabulary(data, off)
            text, s_off = stream(data, start, end, first)
            passes.append((i, j, first, s_off))
            events.append(pa.array(order.value.sortable(packed(text, s_off))).dictionary_encode())
            tokens.append(pa.array(np.r_[h, np.uint64(END_HASH)]).dictionary_encode())
        lp, at = in_order_of(events, lp)
        count, word_at = in_order_of(tokens, count)
        n = len(rows)
        n_tokens, size, known = np.ones(n, np.int64), np.ones(n, np.int64), np.zeros(n, np.int64)
        logs, score = np.zeros(n), np.zeros(n)
        for (i, j, first, s_off), back, word_back in zip(passes, at, word_at, strict=True):
            c = count[word_back]
            up = np.concatenate([[0.0], np.cumsum(np.log10(c[:-1] + 1.0))])
            known[i:j] = per_row(c[:-1] > 0, first) + (c[-1] > 0)
            logs[i:j] = up[first[1:]] - up[first[:-1]] + np.log10(c[-1] + 1.0)
            n_tokens[i:j] += np.diff(first)
            down = np.concatenate([[0.0], np.cumsum(lp[back], dtype=np.float64)])
            score[i:j] = down[s_off[1:]] - down[s_off[:-1]]
            size[i:j] = np.diff(s_off)
        base = logs - n_tokens * np.log10(total + kinds + 1.0)
        bits = -score / np.log10(2.0) / size
        columns = [rows["doc_id"], rows["held_out"], pa.array(n_tokens), pa.array(known), pa.array(np.full(n, total)), pa.array(base), pa.array(score), pa.array(bits)]
        release()
        return pa.table(columns, ["doc_id", *(x.split()[0] for x in OUT.split(", "))])

    texts = asked.where("bucket IS NULL").select("p", "doc_id", "text", "held_out")
    return texts.groupBy("p").cogroup(answers.groupBy("p")).applyInArrow(run, f"doc_id {kind}, {OUT}")
