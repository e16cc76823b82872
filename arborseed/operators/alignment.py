"""Reads aligned on the nodes they are assigned to: seeds joined, chained, and extended with affine gaps to a CIGAR.

Seeds of reads meet seeds of their nodes in a join; the hits of a (read, node) pair are chained; the part of the node that the best
chain spans is cut out where the node's sequence is read, so only windows travel; windows and reads are aligned in a band about the
chain, a batch of pairs at once. Ends that don't pay are clipped.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions import sequence as S
from ..functions.sketch import _CODE
from .placement import seeds_of


@dataclass(frozen=True)
class Preset:
    """How reads of a kind are aligned: seeds of k bases chosen by their s-mers, chaining limits, scores, and what counts as aligned."""

    k: int
    s: int
    match: int
    mismatch: int
    opens: int
    extends: int
    end_bonus: int
    band: int
    max_gap: int
    least_hits: int
    least_score: int
    whole: bool = False


#: Seed length, match, mismatch, gap costs, end bonus, band, largest gap, least hits and score of the published presets
#: for short, long noisy and long accurate reads; "old" has the edit costs of whole-read alignment of damaged reads.
PRESETS = {
    "short": Preset(21, 11, 2, 8, 12, 2, 10, 100, 100, 2, 40),
    "long": Preset(15, 8, 2, 4, 4, 2, 0, 500, 5000, 3, 40),
    "accurate": Preset(19, 10, 1, 4, 6, 2, 0, 500, 10_000, 3, 40),
    "old": Preset(12, 6, 1, 3, 11, 4, 0, 8, 50, 1, 1, True),
}
#: The error rate of a base, the share of reads that may have more edits, and the most gaps of an old read.
OLD_ERROR, OLD_MISSED, OLD_GAPS = 0.02, 0.01, 2
#: Earlier hits that a hit may follow in its chain; cells of the band that one pass keeps, 3 bytes each.
LOOK_BACK, CELLS = 64, 1 << 24
LOW = -(1 << 28)


def preset_of(mean_length: float) -> str:
    """The preset for reads of this mean length."""
    return "short" if mean_length < 500 else "long" if mean_length < 5000 else "accurate"


@functools.cache
def allowed_edits(length: int, error: float = OLD_ERROR, missed: float = OLD_MISSED) -> int:
    """The least number of edits that all but a share of reads of this length stay within, if edits are Poisson."""
    mean, left, k = length * error, 1.0, 0
    term = math.exp(-mean)
    while True:
        left -= term
        if left < missed or k > length:
            return k
        k += 1
        term *= mean / k


# ---------------------------------------------------------------- seed hits


def hits(pairs: DataFrame, reads: DataFrame, references: DataFrame, p: Preset) -> DataFrame:
    """(node, read_id, n, rev, g, r): seeds of k bases that a read of n bases shares with a node of its, each a place on both.

    r is the place in the read as it lies along the node, so a reverse read's places are counted from its end.
    """
    sizes = reads.select("read_id", F.length("seq").alias("n"))
    own = seeds_of(reads, "read_id", "seq", p.k, p.s).join(sizes, "read_id").join(pairs.select("read_id", "node"), "read_id")
    there = seeds_of(references, "node", "reference", p.k, p.s).select(F.col("node").alias("g_node"), F.col("seed").alias("g_seed"), F.col("at").alias("g"), F.col("rev").alias("g_rev"))
    met = own.join(there, (F.col("node") == F.col("g_node")) & (F.col("seed") == F.col("g_seed")))
    rev = F.col("rev") != F.col("g_rev")
    return met.select("node", "read_id", "n", rev.alias("turned"), F.col("g").cast("int").alias("g"), F.when(rev, F.col("n") - p.k - F.col("at")).otherwise(F.col("at")).cast("int").alias("r"))


# ---------------------------------------------------------------- chains


def chained(g: np.ndarray, r: np.ndarray, own: np.ndarray, p: Preset) -> tuple[np.ndarray, ...]:
    """(best end's index, score, hits, first g, first r, least and greatest diagonal) of each row's best chain.

    Rows hold hits sorted by g and r, `own` says which places are hits. A hit may follow any of the LOOK_BACK before it that lies
    before it in both, within the largest gap and band; what it adds is its new bases less a cost of the change of diagonal.
    """
    rows, size = g.shape
    diagonal = g - r
    score = np.where(own, float(p.k), -1.0)
    count = own.astype(np.int64)
    first, low, high = np.tile(np.arange(size), (rows, 1)), diagonal.copy(), diagonal.copy()
    at = np.arange(rows)
    for i in range(1, size):
        a = max(0, i - LOOK_BACK)
        dg, dr = g[:, i : i + 1] - g[:, a:i], r[:, i : i + 1] - r[:, a:i]
        shift = np.abs(dg - dr)
        fits = own[:, a:i] & own[:, i : i + 1] & (dg > 0) & (dr > 0) & (np.maximum(dg, dr) <= p.max_gap + p.k) & (shift <= p.band)
        gain = score[:, a:i] + np.minimum(np.minimum(dg, dr), p.k) - (0.01 * p.k * shift + 0.5 * np.log2(shift + 1.0))
        gain = np.where(fits, gain, -1.0)
        j = gain.argmax(axis=1)
        best = gain[at, j]
        j = j + a
        join = best > score[:, i]
        score[:, i] = np.where(join, best, score[:, i])
        count[:, i] += np.where(join, count[at, j], 0)
        first[:, i] = np.where(join, first[at, j], first[:, i])
        low[:, i] = np.where(join, np.minimum(low[at, j], low[:, i]), low[:, i])
        high[:, i] = np.where(join, np.maximum(high[at, j], high[:, i]), high[:, i])
    end = score.argmax(axis=1)
    start = first[at, end]
    # the next best chain that begins elsewhere, for the mapping quality
    other = np.where(own & (first != start[:, None]), score, 0.0).max(axis=1)
    return end, score[at, end], count[at, end], g[at, start], r[at, start], low[at, end], high[at, end], other


def chains(found: DataFrame, p: Preset) -> DataFrame:
    """(node, read_id, turned, low, high, quality): of each pair the strand, the diagonals and the mapping quality of its best chain.

    Pairs whose best chain has too few hits are left out. Of equal chains the forward one counts, then the first.
    """
    strand = found.groupBy("node", "read_id", "turned").agg(F.array_sort(F.collect_list(F.struct("g", "r"))).alias("hits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            off = lists.offsets.to_numpy().astype(np.int64)
            size = np.diff(off)
            g, r = (lists.flatten().field(i).to_numpy().astype(np.int64) for i in range(2))
            off = off - off[0]
            out = np.zeros((batch.num_rows, 5))
            order = np.argsort(size, kind="stable")
            for part in np.array_split(order, max(1, -(-len(order) // 256))):  # rows of like size
                if not len(part):
                    continue
                places = off[part][:, None] + np.arange(size[part].max())
                own = np.arange(size[part].max()) < size[part][:, None]
                places = np.where(own, places, off[part][:, None])
                _, score, count, _, _, low, high, other = chained(g[places], r[places], own, p)
                out[part] = np.c_[score, count, low, high, other]
            kept = [*batch.columns[:3], *(pa.array(out[:, i]) for i in (0, 4)), *(pa.array(out[:, i].astype(np.int64)) for i in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays(kept, ["node", "read_id", "turned", "score", "other", "hits", "low", "high"])

    kinds = [StructField(c, found.schema[c].dataType) for c in ("node", "read_id", "turned")]
    scored = strand.mapInArrow(run, StructType([*kinds, *(StructField(c, t) for c, t in (("score", DoubleType()), ("other", DoubleType()), ("hits", LongType()), ("low", LongType()), ("high", LongType())))]))
    best = F.min(F.struct((-F.col("score")).alias("less"), "turned", "low", "high", "hits", "other")).alias("b")
    # the other strand's best chain counts as another place, too
    both = scored.groupBy("node", "read_id").agg(best, F.sort_array(F.collect_list("score"), asc=False).alias("scores"))
    one, two = -F.col("b.less"), F.greatest(F.col("b.other"), F.coalesce(F.get("scores", F.lit(1)), F.lit(0.0)))
    quality = F.least(F.lit(60), F.floor(40 * (1 - two / one) * F.least(F.lit(1.0), F.col("b.hits") / 10) * F.log(one))).cast("int")
    return both.where(F.col("b.hits") >= p.least_hits).select("node", "read_id", "b.turned", "b.low", "b.high", F.greatest(F.lit(0), quality).alias("quality"))


# ---------------------------------------------------------------- extension


def banded(reads: np.ndarray, length: np.ndarray, windows: np.ndarray, size: np.ndarray, left: np.ndarray, width: int, p: Preset) -> list[tuple[int, int, list[tuple[int, str]]]]:
    """(score, start in the window, [(length, operation)]) of each row's best alignment within a band; an empty list without one.

    reads and windows hold base codes, 4 and more for none. Cell (i, c) stands for i bases of the read and i + left + c of the
    window. A gap of n costs opens + n * extends. A row's deletions begin at the place to the left from which the score less the
    extension is highest, so a row of all pairs is computed at once.
    """
    rows, most = reads.shape
    at, c = np.arange(rows), np.arange(width)
    choice, jump = np.zeros((most + 1, rows, width), np.int8), np.zeros((most + 1, rows, width), np.int16)
    spot = left[:, None] + c
    inside = (spot >= 0) & (spot <= size[:, None])
    score = np.where(inside, p.end_bonus, LOW)
    gap = np.full((rows, width), LOW)
    best, best_i, best_c = np.full(rows, 0), np.zeros(rows, int), np.zeros(rows, int)
    padded = np.pad(windows, ((0, 0), (0, 1)), constant_values=9)
    step = p.extends * c
    for i in range(1, most + 1):
        spot = i + left[:, None] + c
        inside = (spot >= 0) & (spot <= size[:, None])
        base = padded[at[:, None], np.clip(spot - 1, 0, windows.shape[1])]
        mine = reads[:, i - 1 : i]
        over = score + np.where((base == mine) & (mine < 4), p.match, -p.mismatch)
        over[spot < 1] = LOW
        opened, longer = np.full((rows, width), LOW), np.full((rows, width), LOW)
        opened[:, :-1], longer[:, :-1] = score[:, 1:] - p.opens - p.extends, gap[:, 1:] - p.extends
        gap = np.maximum(opened, longer)
        here = np.maximum(over, gap)
        code = np.where(over >= gap, 1, 2)
        if not p.whole:
            code = np.where(here < 0, 0, code)
            here = np.maximum(here, 0)
        here = np.where(inside, here, LOW)
        level = here + step
        top = np.maximum.accumulate(level, axis=1)
        origin = np.maximum.accumulate(np.where(level >= top, c, 0), axis=1)
        origin = np.hstack([np.zeros((rows, 1), int), origin[:, :-1]])
        gone = np.hstack([np.full((rows, 1), LOW), top[:, :-1]]) - step - p.opens
        use = inside & (gone > here)
        code = np.where(use, 3, code)
        choice[i] = code + 4 * (longer > opened)
        jump[i] = np.where(use, c - origin, 0)
        score = np.where(use, gone, here)
        gap = np.where(inside, gap, LOW)
        last = (length == i)[:, None]
        ends = np.where(last, score + p.end_bonus, LOW if p.whole else score)
        ends = np.where((length >= i)[:, None], ends, LOW)
        j = ends.argmax(axis=1)
        value = ends[at, j]
        new = value > best if not p.whole else (length == i) & (value > LOW // 2)
        best, best_i, best_c = np.where(new, value, best), np.where(new, i, best_i), np.where(new, j, best_c)
    return _traced(choice, jump, best, best_i, best_c, length, left, p)


def _traced(choice, jump, best, i, c, length, left, p) -> list[tuple[int, int, list[tuple[int, str]]]]:
    """Follows the choices of all rows back at once; operations come out in the order of the read, with clips."""
    rows = len(best)
    found, steps = i > 0, []
    i, c, end, inserting = i.copy(), c.copy(), i.copy(), np.zeros(rows, bool)
    live = found.copy()
    at = np.arange(rows)
    while live.any():
        code = np.where(live, choice[i, at, c], 0).astype(np.int64)
        kind = np.where(inserting, 2, code & 3)
        live &= (i > 0) & (inserting | (kind > 0))
        kind = np.where(live, kind, 0)
        n = np.where(kind == 3, jump[i, at, c].astype(np.int64), 1)
        steps.append(np.where(kind > 0, kind * (1 << 16) + n, 0))
        longer = (code & 4) > 0
        ins = kind == 2
        i, c = i - ((kind == 1) | ins), np.where(ins, c + 1, np.where(kind == 3, c - n, c))
        inserting = ins & longer
    flat = np.array(steps[::-1]).reshape(len(steps), rows)
    out = []
    for row in range(rows):
        if not found[row]:
            out.append((0, 0, []))
            continue
        ops: list[tuple[int, str]] = [(int(i[row]), "S")] if i[row] else []
        for x in flat[:, row][flat[:, row] > 0].tolist():
            kind, n = " MID"[x >> 16], x & 0xFFFF
            if ops and ops[-1][1] == kind:
                ops[-1] = (ops[-1][0] + n, kind)
            else:
                ops.append((n, kind))
        if end[row] < length[row]:
            ops.append((int(length[row] - end[row]), "S"))
        bonus = p.end_bonus * (int(i[row] == 0) + int(end[row] == length[row]))
        out.append((int(best[row]) - bonus, int(i[row] + left[row] + c[row]), ops))
    return out


def spelled(ops: list[tuple[int, str]], read: np.ndarray, window: np.ndarray, start: int) -> tuple[int, int, str]:
    """(edits, end in the window, MD): matches' lengths with the bases of the reference where the read has others or none."""
    letters, edits, md, run, i, j = "ACGTN", 0, [], 0, 0, start
    for n, kind in ops:
        if kind == "M":
            wrong = np.flatnonzero((read[i : i + n] != window[j : j + n]) | (read[i : i + n] > 3))
            before = 0
            for w in wrong.tolist():
                md.append(f"{run + w - before}{letters[min(4, window[j + w])]}")
                run, before = 0, w + 1
            run += n - before
            edits, i, j = edits + len(wrong), i + n, j + n
        elif kind == "D":
            md.append(f"{run}^{''.join(letters[min(4, x)] for x in window[j : j + n])}")
            run, edits, j = 0, edits + n, j + n
        else:
            edits, i = edits + n * (kind == "I"), i + n
    return edits, j, "".join(md) + str(run)


def extended(windows: DataFrame, p: Preset) -> DataFrame:
    """(node, read_id, turned, quality, start, end, score, edits, cigar, md) of windows(node, read_id, turned, quality, at, low, high, seq, window).

    seq lies along the node; window begins at `at`; low and high are the chain's diagonals on the node. Pairs of like size go
    through together, in passes of CELLS cells.
    """

    def coded(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
        texts = [_CODE[np.frombuffer(x.as_buffer(), np.uint8)] for x in column.cast(pa.binary())]
        return texts, np.array([len(x) for x in texts], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, low, high = (batch.column(i).to_numpy().astype(np.int64) for i in (4, 5, 6))
            reads, n = coded(batch.column(7))
            windows_, m = coded(batch.column(8))
            left, width = low - p.band - at, high - low + 2 * p.band + 1
            order = np.lexsort((width, n))
            out: list = [None] * len(order)
            begin = 0
            while begin < len(order):
                stop, wide = begin + 1, width[order[begin]]
                while stop < len(order):
                    wider = max(wide, width[order[stop]])
                    if (stop + 1 - begin) * wider * (n[order[stop]] + 1) > CELLS or wider > 2 * wide:
                        break
                    stop, wide = stop + 1, wider
                part = order[begin:stop]
                own, there = np.full((len(part), max(1, n[part].max())), 5, np.int64), np.full((len(part), max(1, m[part].max())), 9, np.int64)
                for k, row in enumerate(part):
                    own[k, : n[row]], there[k, : m[row]] = reads[row], windows_[row]
                for row, (score, start, ops) in zip(part, banded(own, n[part], there, m[part], left[part], int(wide), p), strict=True):
                    if not ops or score < p.least_score and not p.whole:
                        continue
                    edits, end, md = spelled(ops, reads[row], windows_[row], start)
                    if not p.whole or edits <= allowed_edits(len(reads[row])) and sum(x[1] in "ID" for x in ops) <= OLD_GAPS:
                        out[row] = (start + at[row], end + at[row], score, edits, "".join(f"{a}{b}" for a, b in ops), md)
                begin = stop
            keep = np.array([i for i, x in enumerate(out) if x is not None], np.int64)
            rest = list(zip(*(out[i] for i in keep), strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            kept = [batch.column(i).take(pa.array(keep)) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(list(x), t) for x, t in zip(rest, kinds, strict=True))], NAMES)

    kinds = [StructField(c, windows.schema[c].dataType) for c in ("node", "read_id")]
    schema = StructType([*kinds, StructField("turned", BooleanType()), StructField("quality", IntegerType()), *(StructField(c, LongType()) for c in NAMES[4:8]), *(StructField(c, StringType()) for c in NAMES[8:])])
    return windows.select("node", "read_id", "turned", "quality", "at", "low", "high", "seq", "window").mapInArrow(run, schema)


NAMES = ["node", "read_id", "turned", "quality", "start", "end", "score", "edits", "cigar", "md"]


def aligned_pairs(pairs: DataFrame, reads: DataFrame, references: DataFrame, preset: str | None = None) -> DataFrame:
    """(node, read_id, rev, start, end, score, edits, cigar, md, quality) of each pair (read_id, node) that aligns.

    reads(read_id, seq), references(node, reference). start is from 0, end exclusive; cigar and md are in the node's direction. Without
    a preset the reads' mean length chooses one; old reads are aligned whole, within the edits and gaps that their length allows.
    """
    if preset is None:
        preset = preset_of(reads.agg(F.avg(F.length("seq")).alias("m")).first()["m"] or 0.0)
    p = PRESETS[preset]
    best = chains(hits(pairs, reads, references, p), p)
    held = best.join(reads.select(F.col("read_id").alias("own_id"), "seq"), F.col("read_id") == F.col("own_id"))
    seq = F.when(F.col("turned"), S.reverse_complement("seq")).otherwise(F.col("seq"))
    held = held.select("node", "read_id", "turned", "quality", "low", "high", seq.alias("seq"))
    at = F.greatest(F.lit(0), F.col("low") - p.band)
    stop = F.col("high") + p.band + F.length("seq")
    cut = F.substring(F.col("reference"), (at + 1).cast("int"), (stop - at).cast("int"))
    met = held.join(references.select(F.col("node").alias("g_node"), "reference"), F.col("node") == F.col("g_node"))
    found = extended(met.select("node", "read_id", "turned", "quality", at.alias("at"), "low", "high", "seq", cut.alias("window")), p)
    return found.select("node", "read_id", F.col("turned").alias("rev"), "start", "end", "score", "edits", "cigar", "md", "quality")


def read_length(cigar: Column | str) -> Column:
    """Bases of the read that a CIGAR spells, clips included."""
    return _spent(cigar, "MIS=X")


def reference_length(cigar: Column | str) -> Column:
    return _spent(cigar, "MDN=X")


def _spent(cigar: Column | str, kinds: str) -> Column:
    parts = F.regexp_extract_all(S.col(cigar), F.lit(f"([0-9]+)[{kinds}]"), F.lit(1))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
