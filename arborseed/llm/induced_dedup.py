"""Exact repeats of 400 bytes and more by external induced suffix sorting.

Every window of a text belongs to its minimiser, a gram chosen by its content alone, and to the side of the minimiser on which it
has more bytes; with the nearest bytes on that side these make its key. Equal windows have equal keys wherever they are. Windows
whose key occurs once are unique; runs of windows whose key has one content only are repeats as they stand. The bytes of the
other runs form segments, equal segments once, dealt to shards by their key. A shard's suffixes are sorted by recursive
induction through disk-backed queues whose tuples carry common prefixes; neighbours that share a window's bytes are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hashed, bitmap, buffers, chunks, drop_stash, in_bitmap, mix, stash, text_column, tidy
from .induced_sort import IN_MEMORY, suffixes

#: Bytes of a repeat, bytes of a minimiser, bytes of segments in a shard, bytes of a text that are looked at in one piece.
LENGTH, GRAM, SHARD, PIECE = 400, 32, 1 << 21, 1 << 26
POSITION = (1 << 27) - 1


def repeated_windows(segments: list[bytes], length: int = LENGTH, most: int = IN_MEMORY) -> list[np.ndarray]:
    """For each segment which of its windows start again elsewhere in the segments."""
    m, size = len(segments), np.array([len(s) for s in segments], np.int64)
    where = np.cumsum(size + 1) - (size + 1)
    text = np.zeros(int(size.sum()) + m, np.int32)
    inside = np.ones(len(text), bool)
    inside[where + size] = False
    text[inside] = np.frombuffer(b"".join(segments), np.uint8).astype(np.int32) + m
    text[where + size] = np.arange(m - 1, -1, -1)  # separators differ and are less than any byte; the last is least
    order, common = suffixes(text, most)
    fits = np.zeros(len(text), bool)
    for w, s in zip(where.tolist(), size.tolist(), strict=True):
        fits[w : w + max(0, s - length + 1)] = True
    near = common >= length  # no common prefix reaches beyond a separator
    hit = np.zeros(len(text), bool)
    hit[order[near]] = True
    hit[order[np.flatnonzero(near) - 1]] = True
    hit &= fits
    return [hit[w : w + max(0, s - length + 1)] for w, s in zip(where.tolist(), size.tolist(), strict=True)]


def least_in_windows(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` keys in a row, by blocks."""
    pad = np.full(-len(key) % width, np.iinfo(np.uint64).max, np.uint64)
    blocks = np.concatenate([key, pad]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(key) - width + 1
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def runs(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(first window, window after the last, row, key, whether it repeats within itself) of the runs of windows of one key.

    They are those of the texts of a chunk; runs that follow each other at once join, and only such may repeat within themselves.

    A window with the minimiser's gram at p goes by the `half` bytes before p if it has them, else by those behind the gram.
    """
    width, half = length - gram + 1, (length - gram + 1) // 2
    none = np.zeros(0, np.int64)
    count = np.maximum(np.diff(off) - length + 1, 0)
    if not count.sum():
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, bool)
    hashed = Hashed(data)
    start = np.arange(len(data) - gram + 1)
    g = hashed.of(start, start + gram)
    at = least_in_windows((g & ~np.uint64(POSITION)) | start.astype(np.uint64), width)
    row = np.repeat(np.arange(len(count)), count)
    window = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(off[:-1], count)
    p = (at[window] & np.uint64(POSITION)).astype(np.int64)
    before = p - window >= half
    new = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (before[1:] != before[:-1]) | (row[1:] != row[:-1])])
    p, before = p[new], before[new]
    low = np.where(before, p - half, p + gram)
    key = mix(g[p] ^ mix(hashed.of(low, low + half) + before.astype(np.uint64)))
    begin, end, owner = window[new], window[np.r_[new[1:], len(row)] - 1] + 1, row[new]
    joins = np.r_[False, (key[1:] == key[:-1]) & (owner[1:] == owner[:-1]) & (begin[1:] == end[:-1])]  # a gram that repeats at once
    first = np.flatnonzero(~joins)
    after = np.r_[first[1:], len(end)]
    return begin[first], end[after - 1], owner[first], key[first], after - first > 1


def pieces(column: pa.Array, length: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, position of the first byte, bytes, offsets): chunks, a text beyond PIECE in overlapping pieces."""
    for i, j, data, off in chunks(column):
        if len(data) <= PIECE:
            yield i, j, 0, data, off
            continue
        for s in range(0, len(data), PIECE):
            part = data[s : s + PIECE + length - 1]
            yield i, j, s, part, np.array([0, len(part)])


def gathered(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """The byte ranges as a binary array."""
    off = np.concatenate([[0], np.cumsum(size)])
    source = np.arange(off[-1]) + np.repeat(begin - off[:-1], size)
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[source]))]).cast(pa.binary())


COUNTED = "key long, content long, c long"
FOUND = "k1 long, k2 long, at long, n long, key long, bytes binary"


def dedup_repeats(docs: DataFrame, length: int = LENGTH, shard: int = SHARD, most: int = IN_MEMORY) -> DataFrame:
    """Per row of docs (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a string of `length` bytes that covers it starts anywhere else, in the same document or another. Null
    texts are empty; repeated rows and rows of one id are documents of their own and so repeat each other; null ids are as good as
    any; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    gram = min(GRAM, length // 2)
    text = text_column(docs)
    rows = docs.select(docs["doc_id"].alias("doc_id"), text.alias("text"), F.xxhash64(docs["doc_id"], text).alias("k1"), F.xxhash64(F.lit(9), text, docs["doc_id"]).alias("k2"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, data, off in pieces(batch.column(0), length):
                begin, end, _, key, again = runs(data, off, length, gram)
                content = Hashed(data).of(begin, end - 1 + length)
                key, content = np.concatenate([key, key[again]]), np.concatenate([content, ~content[again]])  # these are to be sorted
                order = np.lexsort((content, key))
                key, content = key[order], content[order]
                at = np.flatnonzero(np.r_[np.ones(min(1, len(key)), bool), (key[1:] != key[:-1]) | (content[1:] != content[:-1])])
                columns = [pa.array(x[at].view(np.int64)) for x in (key, content)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(np.r_[at, len(key)]))], ["key", "content", "c"])

    counted = rows.select("text").mapInArrow(tidy(count), COUNTED).groupBy("key", "content").agg(F.sum("c").alias("c"))
    kinds = counted.groupBy("key").agg(F.sum("c").alias("c"), F.count("*").alias("contents")).where("c > 1")
    kinds = stash(kinds.select(F.col("key").alias("k_key"), (F.col("contents") > 1).alias("mixed")), "kinds")
    shared = spark.sparkContext.broadcast([bitmap(kinds.where(f"mixed = {x}").select("k_key")) for x in ("false", "true")])  # 8 MB each

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, s, data, off in pieces(batch.column(2), length):
                begin, end, row, key, _ = runs(data, off, length, gram)
                whole, mixed = (in_bitmap(x, key) for x in shared.value)
                at = np.flatnonzero(whole | mixed)
                begin, n, row, key, mixed = begin[at], (end - begin)[at], row[at], key[at], mixed[at]
                held = gathered(data, begin, np.where(mixed, n - 1 + length, 0))
                place = pa.array(i + row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(place), batch.column(1).take(place), pa.array(s + begin - off[row]), pa.array(n), pa.array(key.view(np.int64)), held], ["k1", "k2", "at", "n", "key", "bytes"])

    found = rows.select("k1", "k2", "text").mapInArrow(tidy(find), FOUND).join(kinds, F.col("key") == F.col("k_key"))
    name = F.when(F.col("mixed"), F.unhex(F.md5("bytes")))
    parts = stash(found.select("k1", "k2", "at", "n", "key", "mixed", name.alias("name"), F.when(F.col("mixed"), F.col("bytes")).alias("bytes")), "parts")
    drop_stash(kinds)
    mixed = parts.where("mixed")
    once = mixed.groupBy("key", "name").agg(F.count("*").alias("copies"), F.first("bytes").alias("bytes"))
    size = once.agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0))).first()[0]
    shards = max(1, -(-size // shard))

    def sort(group: pd.DataFrame) -> pd.DataFrame:
        hits = repeated_windows(group["bytes"].tolist(), length, most)
        out = []
        for name, copies, hit in zip(group["name"], group["copies"], hits, strict=True):
            hit = hit | (copies > 1)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
            out += [(name, int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)]
        return pd.DataFrame(out, columns=["h_name", "a", "b"])

    hits = once.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").applyInPandas(sort, "h_name binary, a long, b long")
    hits = stash(hits.distinct(), "hits")
    sorted_ = mixed.drop("bytes").join(hits, F.col("name") == F.col("h_name")).select("k1", "k2", (F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("b") - 1 + length).alias("b"))
    plain = parts.where("not mixed").select("k1", "k2", F.col("at").alias("a"), (F.col("at") + F.col("n") - 1 + length).alias("b"))
    spans = plain.union(sorted_).distinct().groupBy(F.col("k1").alias("s1"), F.col("k2").alias("s2")).agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    spans = stash(spans, "spans")
    drop_stash(parts, hits)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column(1))
            places, out = batch.column(2), []
            first, ab = places.offsets.to_numpy(), places.flatten()
            a, b = (ab.field(x).to_numpy() for x in (0, 1))
            first = first - first[0]
            for k in range(batch.num_rows):
                d = data[off[k] : off[k + 1]]
                gone = np.zeros(len(d) + 1, np.int32)
                np.add.at(gone, a[first[k] : first[k + 1]], 1)
                np.add.at(gone, b[first[k] : first[k + 1]], -1)
                lost = np.cumsum(gone[:-1]) > 0
                out.append((len(d), int(lost.sum()), int((lost & ~np.r_[False, lost[:-1]]).sum()), hashlib.sha256(d[~lost].tobytes()).hexdigest()))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = (pa.int64(),) * 3 + (pa.string(),)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    held = spark.sparkContext.broadcast(bitmap(spans.select("s1")))  # 8 MB: rows that surely have no spans aren't shuffled

    @F.pandas_udf("boolean")
    def reached(x: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(held.value, x.to_numpy()))

    maybe = rows.where(reached("k1")).join(spans, (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")), "left")
    done = maybe.where(F.col("s1").isNotNull()).select("doc_id", "text", "spans").mapInArrow(tidy(cut), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    zero = F.lit(0).cast("long")
    untouched = lambda x: x.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    return done.union(untouched(maybe.where(F.col("s1").isNull()))).union(untouched(rows.where(~reached("k1"))))
