"""Hashed sketches of sequences: syncmers and k-min-mers by 64-bit rolling hashes, DUST; Arrow UDFs over whole batches."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import give_back, small_batches

M = (1 << 64) - 1
#: The published ntHash constants of A, C, G, T.
NT = {"A": 0x3C8BFBB395C60474, "C": 0x3193C18562A02B4C, "G": 0x20323ED082572324, "T": 0x295549F54BE24456}
SEEDS = "array<struct<hash:bigint,rev:boolean,pos:int,end:int>>"
_CODE = np.full(256, 4, np.int64)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i
_VALUE = np.array([*(NT[c] for c in "ACGT"), 0], np.uint64)
_OTHER = np.array([3, 2, 1, 0, 4])


def rol(x: np.ndarray, r: int) -> np.ndarray:
    r %= 64
    return x if r == 0 else (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def window_hashes(code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(forward, reverse-complement) hashes of all windows of n bases, each as the xor of rotated base values.

    A window of n + m bases is a window of n, rotated, and the one of m behind it, so windows double up to n.
    """
    out = []
    for turned, values in ((False, _VALUE[code]), (True, _VALUE[_OTHER[code]])):
        have, size, whole, done = values, 1, None, 0
        for bit in range(n.bit_length()):
            if n >> bit & 1:
                count = max(0, len(code) - done - size + 1)
                if whole is None:
                    whole = have[:count]
                elif turned:
                    whole = whole[:count] ^ rol(have[done : done + count], done)
                else:
                    whole = rol(whole[:count], size) ^ have[done : done + count]
                done += size
            if n >> (bit + 1):
                count = max(0, len(code) - 2 * size + 1)
                have = have[:count] ^ rol(have[size : size + count], size) if turned else rol(have[:count], size) ^ have[size : size + count]
                size *= 2
        out.append(whole)
    return out[0], out[1]


def sliding_least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values in a row."""
    size, count = 1, len(h) - w + 1
    if count <= 0:
        return h[:0]
    while 2 * size <= w:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[:count], h[w - size : w - size + count])


def syncmers_of(code: np.ndarray, k: int, s: int, t: int = 0, opened: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(canonical hash, whether the reverse strand's was smaller, position) of the syncmers of base codes; 4 is no base.

    A window is one if on either strand its least s-mer hash (ties count) is at offset t of that strand, or at k-s-t unless
    opened. Windows with another letter than a base and palindromes are dropped.
    """
    count = len(code) - k + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int64)
    fwd, rev = window_hashes(code, k)
    small_f, small_r = window_hashes(code, s)
    w = k - s + 1
    least_f, least_r = sliding_least(small_f, w), sliding_least(small_r, w)
    hit = (small_f[t : t + count] == least_f) | (small_r[w - 1 - t : w - 1 - t + count] == least_r)  # each strand from its own end
    if not opened:
        hit |= (small_f[w - 1 - t : w - 1 - t + count] == least_f) | (small_r[t : t + count] == least_r)
    bad = np.concatenate([[0], np.cumsum(code == 4)])
    hit &= (bad[k:] == bad[:-k]) & (fwd != rev)
    at = np.flatnonzero(hit)
    return np.minimum(fwd, rev)[at], (rev < fwd)[at], at


def codes(seq: str) -> np.ndarray:
    return _CODE[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]


def syncmers(seq: str, k: int, s: int, t: int = 0, opened: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """syncmers_of a sequence."""
    return syncmers_of(codes(seq), k, s, t, opened)


def folded(h: np.ndarray, rev: np.ndarray, pos: np.ndarray, row: np.ndarray, k: int, l: int) -> tuple[np.ndarray, ...]:  # noqa: E741
    """(hash, rev, begin, end, row) over l consecutive syncmers of a row; the smaller of both reading orders, equal ones are dropped."""
    if l <= 1:
        return h, rev, pos, pos + k - 1, row
    n = max(0, len(h) - l + 1)
    f, r = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for j in range(l):
        f = rol(f, k) ^ h[j : j + n]
        r = rol(r, k) ^ h[l - 1 - j : l - 1 - j + n]
    ok = (f != r) & (row[:n] == row[l - 1 : l - 1 + n])
    return np.minimum(f, r)[ok], (r < f)[ok], pos[:n][ok], (pos[l - 1 : l - 1 + n] + k - 1)[ok], row[:n][ok]


def kminmers(seq: str, k: int, s: int, t: int = 0, l: int = 3, opened: bool = False) -> list[tuple[int, bool, int, int]]:  # noqa: E741
    """(hash, rev, begin, end) over l consecutive syncmers; l of 0 or 1: the syncmers."""
    h, rev, pos = syncmers(seq, k, s, t, opened)
    return [(int(a), bool(b), int(c), int(d)) for a, b, c, d, _ in zip(*folded(h, rev, pos, np.zeros(len(h), np.int64), k, l), strict=True)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def checked(k: int, s: int, t: int, l: int) -> None:  # noqa: E741
    if not (0 < s <= k and 0 <= t <= k - s and l >= 0):
        raise ValueError("needs 0 < s <= k, 0 <= t <= k - s and l >= 0")


#: Bases that one pass over a batch handles; a longer sequence is a pass of its own.
PASS = 1 << 18


def sketched(column: pa.Array, k: int, s: int, t: int, l: int, opened: bool) -> Iterator[tuple[int, int, np.ndarray, tuple[np.ndarray, ...]]]:  # noqa: E741
    """(first row, end row, offsets, k-min-mers with positions in their rows) of runs of an Arrow string column, a run at a time."""
    column = column.fill_null("").cast(pa.large_string())
    raw, n, first = column.buffers(), len(column), column.offset
    off = np.frombuffer(raw[1], np.int64, count=first + n + 1)[first:] if n else np.zeros(1, np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + PASS, "right")) - 1)
        here = off[i : j + 1] - off[i] + np.arange(j - i + 1)  # a letter that is no base stands behind each sequence
        code = np.full(here[-1], 4, np.int64)
        inside = np.ones(len(code), bool)
        inside[here[1:] - 1] = False
        code[inside] = _CODE[data[off[i] : off[j]]]
        h, rev, pos = syncmers_of(code, k, s, t, opened)
        row = np.searchsorted(here, pos, "right") - 1
        h, rev, begin, end, row = folded(h, rev, pos, row, k, l)
        yield i, j, row, (h, rev, begin - here[row], end - here[row])
        i = j


def sketch(column, k: int = 19, s: int = 8, t: int = 0, l: int = 3, opened: bool = False):  # noqa: E741
    """An Arrow UDF: the k-min-mers of each sequence."""
    checked(k, s, t, l)

    @F.arrow_udf(SEEDS)
    def run(seqs: pa.Array) -> pa.Array:
        parts, sizes = [[], [], [], []], [np.zeros(1, np.int32)]
        for i, j, row, found in sketched(seqs, k, s, t, l, opened):
            sizes.append(np.bincount(row, minlength=j - i))
            for part, x in zip(parts, found, strict=True):
                part.append(x)
        h, rev, begin, end = (np.concatenate([*p, np.zeros(0, np.int64)]) if i != 0 else np.concatenate([*p, np.zeros(0, np.uint64)]) for i, p in enumerate(parts))
        columns = [pa.array(h.view(np.int64)), pa.array(rev.astype(bool)), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))]
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32)), pa.StructArray.from_arrays(columns, ["hash", "rev", "pos", "end"]))

    return run(column)


def _mapped(rows: DataFrame, key: str, seq: str, run, schema: str) -> DataFrame:
    """What run makes of the batches (key, seq) of the rows, which are kept small; a task's memory is given back at its end."""
    small_batches(rows)

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return rows.select(key, F.col(seq).cast("string")).mapInArrow(tidied, schema)


def seed_rows(rows: DataFrame, key: str, seq: str, k: int, s: int, t: int = 0, l: int = 1, opened: bool = False, numbered: bool = False) -> DataFrame:  # noqa: E741
    """(key, at, seed, rev): the k-min-mers of the sequences of rows (l of 1: the syncmers), as signed 64-bit hashes; numbered: and i, their number."""
    checked(k, s, t, l)
    more = ["i"] if numbered else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, row, (h, rev, begin, _) in sketched(batch.column(1), k, s, t, l, opened):
                number = [pa.array(np.arange(len(row)) - np.searchsorted(row, row))] if numbered else []
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i + row)), pa.array(begin), pa.array(h.view(np.int64)), pa.array(rev), *number], [key, "at", "seed", "rev", *more])

    kind = rows.schema[key].dataType.simpleString()
    return _mapped(rows, key, seq, run, f"`{key}` {kind}, at long, seed long, rev boolean" + (", i long" if numbered else ""))


def seed_totals(rows: DataFrame, key: str, seq: str, k: int, s: int, t: int = 0, l: int = 1, opened: bool = False) -> DataFrame:  # noqa: E741
    """(node, seed, n, n_fwd, n_rev) of each row by its key: what `seed_rows` grouped by key and seed gives if keys don't repeat."""
    checked(k, s, t, l)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, row, (h, rev, *_) in sketched(batch.column(1), k, s, t, l, opened):
                order = np.lexsort((h, row))
                h, row, rev = h[order], row[order], rev[order].astype(np.int64)
                at = np.flatnonzero(np.r_[np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
                n = np.diff(np.r_[at, len(h)])
                back = np.add.reduceat(rev, at) if len(at) else n
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i + row[at])), pa.array(h[at].view(np.int64)), pa.array(n), pa.array(n - back), pa.array(back)], ["node", "seed", "n", "n_fwd", "n_rev"])

    kind = rows.schema[key].dataType.simpleString()
    return _mapped(rows, key, seq, run, f"node {kind}, seed long, n long, n_fwd long, n_rev long")


def seed_lists(rows: DataFrame, key: str, seq: str, k: int, s: int, t: int = 0, opened: bool = False, counted: bool = True, every: bool = False) -> DataFrame:
    """(node, seeds) of each row that has a seed (every: of the others too): the (seed, n, n_fwd, n_rev) of `seed_totals` in a fixed order, or else the (at, seed, rev) in place order.

    What a row has is listed where it is read, so what compares whole rows moves no seeds.
    """
    checked(k, s, t, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, row, (h, rev, begin, _) in sketched(batch.column(1), k, s, t, 1, opened):
                if counted:
                    order = np.lexsort((h, row))
                    h, row, rev = h[order], row[order], rev[order].astype(np.int64)
                    at = np.flatnonzero(np.r_[np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
                    n = np.diff(np.r_[at, len(h)])
                    back = np.add.reduceat(rev, at) if len(at) else n
                    row, fields = row[at], {"seed": h[at].view(np.int64), "n": n, "n_fwd": n - back, "n_rev": back}
                else:
                    fields = {"at": begin, "seed": h.view(np.int64), "rev": rev}
                size = np.bincount(row, minlength=j - i)
                some = np.arange(j - i) if every else np.flatnonzero(size)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size[some])].astype(np.int32)), pa.StructArray.from_arrays([pa.array(x) for x in fields.values()], list(fields)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i + some)), lists], ["node", "seeds"])

    kind = rows.schema[key].dataType.simpleString()
    listed = "seed:bigint,n:bigint,n_fwd:bigint,n_rev:bigint" if counted else "at:bigint,seed:bigint,rev:boolean"
    return _mapped(rows, key, seq, run, f"node {kind}, seeds array<struct<{listed}>>")


def seed_pairs(rows: DataFrame, key: str, seq: str, k: int, s: int, t: int = 0, opened: bool = False) -> DataFrame:
    """(read, s, t, n) of each row: the pairs of seeds that follow each other in it, smaller first, and how often, counted where it is read."""
    checked(k, s, t, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, row, (h, *_) in sketched(batch.column(1), k, s, t, 1, opened):
                h = h.view(np.int64)
                both = row[1:] == row[:-1]
                own, low, high = row[1:][both], np.minimum(h[1:], h[:-1])[both], np.maximum(h[1:], h[:-1])[both]
                order = np.lexsort((high, low, own))
                own, low, high = own[order], low[order], high[order]
                at = np.flatnonzero(np.r_[np.ones(min(1, len(own)), bool), (high[1:] != high[:-1]) | (low[1:] != low[:-1]) | (own[1:] != own[:-1])])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i + own[at])), pa.array(low[at]), pa.array(high[at]), pa.array(np.diff(np.r_[at, len(own)]))], ["read", "s", "t", "n"])

    kind = rows.schema[key].dataType.simpleString()
    return _mapped(rows, key, seq, run, f"read {kind}, s long, t long, n long")


def homopolymer_hashes(k: int) -> list[int]:
    """Canonical hashes of the four runs of k equal bases."""
    out = []
    for c in "ACGT":
        f, r = window_hashes(_CODE[np.frombuffer((c * k).encode(), np.uint8)], k)
        out.append(signed(int(min(f[0], r[0]))))
    return out


def compressed(seq: str) -> tuple[str, list[int]]:
    """Homopolymer compression with the position each kept base had."""
    starts, at = [], 0
    for _, run in groupby(seq, key=str.upper):
        starts.append(at)
        at += len(list(run))
    return "".join(seq[i] for i in starts), starts


def dust_of(code: np.ndarray, row: np.ndarray, rows: int, window: int = 64) -> np.ndarray:
    """DUST complexity of each row of base codes: of all of it up to `window` three-mers, else the largest of the full windows but the first.

    A place meets the window - 1 places before it, a distance at a time for all rows; what a window gains at its end and loses at its
    beginning sums up to its pairs of equal three-mers.
    """
    row, code = row[code < 4], code[code < 4]
    whole = row[2:] == row[:-2]
    three, own = (16 * code[:-2] + 4 * code[1:-1] + code[2:])[whole], row[:-2][whole]
    behind, ahead = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
    for k in range(1, min(window, len(own))):
        same = (three[k:] == three[:-k]) & (own[k:] == own[:-k])
        behind[k:] += same
        ahead[:-k] += same
    size = np.bincount(own, minlength=rows)
    first = np.cumsum(size) - size
    place = np.arange(len(own)) - first[own]
    far = place >= window
    behind[far] -= ahead[np.flatnonzero(far) - window]
    pairs = np.cumsum(behind)
    pairs -= (pairs - behind)[first[own]] if len(own) else 0
    most = np.zeros(rows, np.int64)
    last = size <= window
    some = last & (size > 0)
    most[some] = pairs[(first + size - 1)[some]]
    np.maximum.at(most, own[far], pairs[far])
    n = np.minimum(size, window)
    return np.where(n < 2, 0.0, 200.0 * most / np.maximum(1, n * (n - 1)))


def dust(seq: str, window: int = 64) -> float:
    """DUST complexity of a sequence."""
    code = codes(seq or "")
    return float(dust_of(code, np.zeros(len(code), np.int64), 1, window)[0])


def dust_score(column):
    """An Arrow UDF: the DUST complexity of each sequence; null is empty."""

    @F.arrow_udf("double")
    def run(seqs: pa.Array) -> pa.Array:
        seqs = seqs.fill_null("").cast(pa.large_string())
        raw, n, first = seqs.buffers(), len(seqs), seqs.offset
        off = np.frombuffer(raw[1], np.int64, count=first + n + 1)[first:] if n else np.zeros(1, np.int64)
        data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
        out, i = [np.zeros(0)], 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + PASS, "right")) - 1)
            out.append(dust_of(_CODE[data[off[i] : off[j]]], np.repeat(np.arange(j - i), np.diff(off[i : j + 1])), j - i))
            i = j
        return pa.array(np.concatenate(out))

    return run(column)
