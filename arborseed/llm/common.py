"""Helpers of the training-data operators: the shared folder, Arrow text views and vectorised word hashes."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..storage import BATCH, drop_stash, fresh, give_back, shared_dir, small_batches, stash, stash_path  # noqa: F401

#: Bytes of text that one numpy pass handles; a longer single text is a pass of its own.
CHUNK = 1 << 20
MASK = (1 << 64) - 1
#: The odd base of the polynomial hash, congruent to 3 modulo 4, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C17
INVERSE = pow(BASE, -1, 1 << 64)


#: Tables that an operator keeps between the tasks of a Python worker, by the operator's name.
CACHES: dict[str, dict] = {}


def release(keeps: str = "") -> None:
    """Drops other operators' tables and gives memory that numpy freed back to the system, so that idle workers stay small."""
    for name, kept in CACHES.items():
        if name != keeps:
            kept.clear()
    give_back()


def tidy(run, keeps: str = ""):
    """run, a function of an iterator of batches, with its memory given back at the end of a task; keeps: the table that stays."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release(keeps)

    return wrapped


def text_column(docs: DataFrame, name: str = "text"):
    """The texts, null as empty; batches of them are kept small."""
    from pyspark.sql import functions as F

    small_batches(docs)
    return F.coalesce(docs[name].cast("string"), F.lit(""))


# --------------------------------------------------------------------------- numpy views of Arrow strings


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    n, first = len(column), column.offset
    raw = column.buffers()
    off = np.frombuffer(raw[1], np.int64, count=first + n + 1)[first:] if n else np.zeros(1, np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `most` bytes; together they hold every row and byte."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    end = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    n, i, begin = len(end), 0, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(end, begin + most, "right")))
        yield i, j, *buffers(column.slice(i, j - i))
        i, begin = j, int(end[j - 1])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


def _letters(fold: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    if fold:
        values[65:91] = values[97:123]
    return values


LETTERS = {fold: _letters(fold) for fold in (False, True)}
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i <= n; kept for the usual pass size only."""
    for size, kept in _powers.items():
        if size >= n:
            return kept
    size = max(n, CHUNK) + 1
    up, down = np.full(size, BASE, np.uint64), np.full(size, INVERSE, np.uint64)
    up[0] = down[0] = 1
    made = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    if size == CHUNK + 1:
        _powers[size] = made
    return made


#: Bytes from which on a range's hash also holds a second one, modulo a prime: long ranges of a regular form (the Thue-Morse word and
#: its complement) have equal polynomials modulo 2**64, whatever the base and the letters' values.
LONG, PRIME, PRIME_BASE = 256, (1 << 31) - 1, 0x4F1BBCDD


@functools.lru_cache(maxsize=1)
def prime_powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """PRIME_BASE**i and its inverse modulo PRIME for i <= size."""
    made = []
    for base in (PRIME_BASE, pow(PRIME_BASE, -1, PRIME)):
        out, known = np.ones(size + 1, np.uint64), 1
        while known <= size:
            step = np.uint64(pow(base, known, PRIME))
            out[known : 2 * known] = out[: min(known, size + 1 - known)] * step % np.uint64(PRIME)
            known *= 2
        made.append(out)
    return made[0], made[1]


class Hashed:
    """Prefix sums from which the hash of any byte range of a chunk follows in constant time."""

    def __init__(self, data: np.ndarray, fold: bool = False):
        up, self.down = powers(len(data))
        self.data, self.fold, self.second = data, fold, None
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(LETTERS[fold][data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
        far = np.flatnonzero(end - start >= LONG)
        if len(far):
            out[far] = mix(out[far] ^ mix(self.prime(start[far], end[far])))
        return out

    def prime(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The second hash of ranges; its sums are made when the first long range asks for them."""
        p, n = np.uint64(PRIME), max(len(self.data), CHUNK)
        up, down = prime_powers(n) if n == CHUNK else prime_powers.__wrapped__(n)
        if self.second is None:
            self.second = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((LETTERS[self.fold] >> np.uint64(34))[self.data] * up[: len(self.data)] % p, out=self.second[1:])
        return (self.second[end] - self.second[start]) % p * down[start] % p


def words(data: np.ndarray, off: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, index of the first word of each row and of the end) of the words, [^\\x20\\x09-\\x0D]+ unless told otherwise."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~separator[data]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begins[edge] |= inside[1:-1][edge]
    ends[edge - 1] |= inside[1:-1][edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, off)


def grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the n-word windows, index of each window's first word); windows stay within their row."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    room = np.zeros(len(h), np.int64)
    last = first[1:][np.diff(first) > 0]
    begin = first[:-1][np.diff(first) > 0]
    room = np.repeat(last, last - begin) - np.arange(len(h))
    at = np.flatnonzero(room >= n)
    total = np.zeros(len(at), np.uint64)
    for i in range(n):
        total += h[at + i] * np.uint64(pow(0xC2B2AE3D27D4EB4F, 2 * i + 1, 1 << 64))
    return mix(total + np.uint64(n)), at


def per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive indices."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values; sorting takes a fraction of the time of np.unique, which hashes where nothing else is asked for."""
    x = np.sort(values)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


# --------------------------------------------------------------------------- dense counts summed over all tasks

BLOCK, FANIN = 1 << 13, 64
BLOCKS = "block int, salt int, data binary"


def summed(rows: DataFrame, count, size: int, few: bool = False) -> np.ndarray:
    """The sum over all Arrow batches of what count(batch, total) adds to an int64 array of fixed size.

    Each task adds up its own array and sends it in compressed blocks; blocks of a place are added in two rounds, the first
    dealt by a salt, so no task reads more than a share of the tasks' blocks. The result's size is a parameter. few: rows has a
    few partitions, by a parameter; their blocks come to the driver without a shuffle.
    """
    import zlib

    import pandas as pd

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            count(batch, total)
        at = np.flatnonzero(np.add.reduceat(total != 0, np.arange(0, size, BLOCK)))
        data = [zlib.compress(total[b * BLOCK : (b + 1) * BLOCK].tobytes(), 1) for b in at]
        salt = np.full(len(at), int(uuid.uuid4().int % FANIN), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(salt), pa.array(data, pa.binary())], ["block", "salt", "data"])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in part["data"])
        return pd.DataFrame({"block": part["block"][:1], "salt": part["salt"][:1], "data": [zlib.compress(total.tobytes(), 1)]})

    found = rows.mapInArrow(tidy(run), BLOCKS)
    if not few:
        found = found.groupBy("block", "salt").applyInPandas(add, BLOCKS).groupBy("block").applyInPandas(add, BLOCKS)
    total = np.zeros(size, np.int64)
    for r in found.toLocalIterator(prefetchPartitions=True):
        got = np.frombuffer(zlib.decompress(r["data"]), np.int64)
        total[r["block"] * BLOCK : r["block"] * BLOCK + len(got)] += got
    return total


# --------------------------------------------------------------------------- bitmaps of hash values

#: Bits of a bitmap: its size is fixed, 8 MB.
BITMAP = 1 << 26


def bitmap(values: DataFrame) -> np.ndarray:
    """Packed bits that say which low bits the hash values of the first column have: a filter of fixed size before an exact join."""
    from pyspark.sql import functions as F

    slot = F.col(values.columns[0]).bitwiseAND(BITMAP - 1)
    parts = values.select(slot.alias("s")).groupBy(F.shiftright("s", 15).alias("b")).agg(F.bitmap_construct_agg(F.col("s").bitwiseAND((1 << 15) - 1)).alias("bits"))
    out = np.zeros(BITMAP >> 3, np.uint8)
    for r in parts.toLocalIterator(prefetchPartitions=True):
        out[r["b"] << 12 : (r["b"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    return out


def in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    slot = values.view(np.int64) & (BITMAP - 1)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
