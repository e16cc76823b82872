"""Importance resampling towards a target text by hashed word n-grams, found in suffix arrays of word ids.

A task numbers the words of a shard of its texts, sorts the suffixes of the word ids and takes common prefixes of neighbours:
a run of suffixes that share k words is one n-gram, which is hashed once; its bucket goes back to every place of the run.
Counts of buckets have a fixed size; gains of the buckets score the documents in a second pass.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.tree import row_numbers
from .common import BATCH, chunks, stash, summed, text_column, tidy, words

#: Words of the longest n-gram; buckets; words that a drawn document has at least; per cent that are drawn; the noise's seed.
GRAMS, BUCKETS, MIN_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Bytes of text of a shard: the suffix array of one is in memory, some 60 bytes a word.
SHARD = BATCH

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes between words once A-Z is lowered: ASCII but digits and letters.
BETWEEN = np.zeros(256, bool)
BETWEEN[:128] = [not (chr(i).isalnum()) for i in range(128)]


def _cut(data: np.ndarray, at: int, between: bool) -> int:
    """The first place from `at` on that lies between words, or doesn't; the end if there is none."""
    step = 1 << 12
    while at < len(data):
        hit = np.flatnonzero(BETWEEN[data[at : at + step]] == between)
        if len(hit):
            return at + int(hit[0])
        at, step = at + step, 2 * step
    return len(data)


def shards(column: pa.Array, grams: int, most: int = SHARD) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(rows, bytes, offsets, end): runs of rows of about `most` bytes, and the parts of longer texts.

    A part is cut between words and is followed by the words that n-grams from before `end` need.
    """
    for i, j, data, off in chunks(column, most):
        if len(data) <= most or j - i > 1:
            yield np.arange(i, j), data, off, len(data)
            continue
        begin = 0
        while begin < len(data):
            cut = end = _cut(data, begin + most, True)
            for _ in range(grams - 1):
                end = _cut(data, _cut(data, end, False), True)
            yield np.array([i]), data[begin:end], np.array([0, end - begin]), cut - begin
            begin = cut


def word_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The number of each word among the distinct ones, and these; compared by their bytes, not by hashes."""
    size = end - start
    edges = np.zeros(len(data) + 1, np.int32)
    np.add.at(edges, start, 1)
    np.add.at(edges, end, -1)
    letters = LOWER[data[np.cumsum(edges[:-1]) > 0]]
    offsets = np.r_[0, np.cumsum(size)].astype(np.int64)
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(letters.tobytes())])
    coded = column.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


def suffix_array(ids: np.ndarray, room: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in the order of their suffixes, words that each shares with the one before it), both to `depth` words.

    room: words from each place to its row's end; no prefix goes beyond it. Sorted ranks double the words they stand for.
    """
    n = len(ids)
    rank, known = ids + 1, 1
    while known < depth:
        behind = np.zeros(n, np.int64)
        behind[: n - known] = rank[known:]
        behind[room <= known] = 0
        order = np.lexsort((behind, rank))
        one, two = rank[order], behind[order]
        fresh_ = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])] if n else np.zeros(0, bool)
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(fresh_)
        rank, known = new, 2 * known
    order = np.argsort(rank, kind="stable")
    shared, same = np.zeros(n, np.int64), np.ones(max(0, n - 1), bool)
    for k in range(depth):
        a = order + k
        inside = room[order] > k
        word = np.where(inside, ids[np.minimum(a, n - 1)], -1) if n else ids
        same = same & inside[1:] & inside[:-1] & (word[1:] == word[:-1])
        shared[1:] += same
    return order, shared


def buckets_of(column: pa.Array, grams: int = GRAMS, buckets: int = BUCKETS, most: int = SHARD) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of the features, their buckets, rows of a shard, words of each) for shard after shard; together all features of 1 to `grams` words."""
    for rows, data, off, end in shards(column, grams, most):
        start, stop, first = words(data, off, BETWEEN)
        count = np.diff(first)
        own = np.add.reduceat(np.r_[start < end, False], first[:-1]) * (count > 0) if len(rows) else count
        if not len(start):
            yield np.zeros(0, np.int64), np.zeros(0, np.int64), rows, own
            continue
        row = np.repeat(np.arange(len(rows)), count)
        room = np.repeat(first[1:], count) - np.arange(len(start))
        ids, known = word_ids(data, start, stop)
        order, shared = suffix_array(ids, room, grams)
        places, found = [], []
        for k in range(1, grams + 1):
            whole = room[order] >= k
            head = whole & (shared < k)
            run = np.cumsum(head) - 1
            at = order[head]
            told = [b" ".join([known[w] for w in ids[i : i + k]]) for i in at] if k > 1 else [known[w] for w in ids[at]]
            bucket = np.fromiter((zlib.crc32(x) % buckets for x in told), np.int64, len(told))
            place = order[whole]
            places.append(place)
            found.append(bucket[run[whole]])
        place, bucket = np.concatenate(places), np.concatenate(found)
        mine = start[place] < end
        yield rows[row[place[mine]]], bucket[mine], rows, own


def bucket_counts(texts: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts (the first column) fall into each bucket."""

    def count(batch: pa.RecordBatch, total: np.ndarray) -> None:
        for _, bucket, _, _ in buckets_of(batch.column(0), grams, buckets):
            total += np.bincount(bucket, minlength=buckets)

    return summed(texts, count, buckets)


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket floor(1000 ln of the ratio of its smoothed shares in target and raw text), in doubles."""
    s, t, n = raw.astype(float), target.astype(float), float(len(raw))
    ratio = (t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, grams: int = GRAMS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row; weight: the floored mean of its features' gains, 0 without any."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # 8 bytes a bucket

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, n, n_words = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for row, bucket, rows, own in buckets_of(batch.column(0), grams, len(shared.value)):
                n_words[rows] += own
                n += np.bincount(row, minlength=batch.num_rows)
                np.add.at(total, row, shared.value[bucket])
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n_words), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *(StructField(c, LongType()) for c in ("n_words", "n_features", "weight"))])
    return docs.select(text_column(docs).alias("text"), docs["doc_id"].alias("doc_id")).mapInArrow(tidy(score), schema)


def noise(seed: int = SEED):
    """Gumbel noise in thousandths, from a hash of the seed and the id."""
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(told, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Every row of docs: doc_id, n_features, weight, score, rank, and rank is null where a row isn't drawn.

    Of the rows with `min_words` words or more `percent` per cent (floored) are drawn, by the largest weight plus noise, ties to the
    lesser doc_id. A null text has no words; a null id counts as an empty text in the noise and stands behind all ids in ties;
    repeated rows are drawn on their own, in any order among themselves; an empty table gives no rows, an empty target text has no
    features; very long texts go through in shards; other columns are ignored.
    """
    gain = gains(*(bucket_counts(x.select(text_column(x)), grams, buckets) for x in (docs, target)))
    scored = stash(weighed(docs, gain, grams).withColumn("score", F.col("weight") + noise(seed)), "scored")
    fit = F.col("n_words") >= min_words
    # scores are integers between logarithms of doubles, so there are some 100,000 different ones at most
    counts = sorted(((r["score"], r["n"]) for r in scored.where(fit).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    left = k = percent * sum(n for _, n in counts) // 100
    cut = None
    for cut, n in counts if k else []:  # noqa: B007
        left -= n
        if left <= 0:
            break
    may = fit & (F.col("score") >= cut) if k else F.lit(False)
    none = F.lit(None).cast("long")
    tied = scored.where(may).select("*", (-F.col("score")).alias("down"), F.col("doc_id").isNull().alias("last"), F.monotonically_increasing_id().alias("any"))
    ranked = row_numbers(tied, ["down", "last", "doc_id", "any"], "place")  # rows alike in id and score can be parted by `any`
    columns = ["doc_id", "n_features", "weight", "score"]
    drawn = ranked.select(*columns, F.when(F.col("place") < k, F.col("place") + 1).cast("long").alias("rank"))
    return drawn.unionAll(scored.where(~may).select(*columns, none.alias("rank"))) if k else scored.select(*columns, none.alias("rank"))


def crc32_sql(hexed: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of bytes given as upper-case hexadecimal digits; the rows are joined with `crc`, the one row of crc_table_sql."""
    byte = f"instr('0123456789ABCDEF', substr({hexed}, 2 * i + 1, 1)) * 16 + instr('0123456789ABCDEF', substr({hexed}, 2 * i + 2, 1)) - 17"
    steps = f"list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length({hexed}) // 2), lambda i: ({byte})::BIGINT)), lambda c, b: xor(c >> 8, crc_t[(xor(c, b) & 255) + 1]))"
    return f"xor({steps}, 4294967295)"


def crc_table_sql() -> str:
    step = "lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"SELECT list_transform(range(0, 256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], {step})) AS crc_t"


def oracle(docs: str = "documents", target: str = "benchmark") -> str:
    """DuckDB SQL for resampled with its defaults: n-grams of one word."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    found = f"regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH crc AS ({crc_table_sql()}),
    w AS (SELECT doc_id, unnest({found}) AS word FROM {docs}), v AS (SELECT unnest({found}) AS word FROM {target}),
    known AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM w UNION SELECT word FROM v)),
    b AS (SELECT word, {crc32_sql("x")} % {BUCKETS} AS bucket FROM known, crc),
    s AS (SELECT bucket, count(*)::DOUBLE AS s FROM w JOIN b USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*)::DOUBLE AS t FROM v JOIN b USING (word) GROUP BY bucket),
    n AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS}.0::DOUBLE AS sn, (SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS}.0::DOUBLE AS tn),
    g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * sn / ((s + 1) * tn))) AS gain FROM s LEFT JOIN t USING (bucket), n),
    f AS (SELECT doc_id, count(*)::BIGINT AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM w JOIN b USING (word) JOIN g USING (bucket) GROUP BY doc_id),
    h AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, upper(substr(sha256('{SEED}:' || doc_id), 1, 8)) AS x FROM {docs} LEFT JOIN f USING (doc_id)),
    u AS (SELECT doc_id, n_features, weight, list_reduce(list_transform(range(1, 9), lambda i: (instr('0123456789ABCDEF', substr(x, i, 1)) - 1)::BIGINT), lambda a, d: a * 16 + d) AS h FROM h),
    z AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM u),
    r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM z WHERE n_features >= {MIN_WORDS})
    SELECT z.doc_id, n_features, weight, score, CASE WHEN r <= ({PERCENT} * n) // 100 THEN r END::BIGINT AS rank FROM z LEFT JOIN r ON z.doc_id = r.doc_id"""
