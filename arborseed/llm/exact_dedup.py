"""Exact dedup by progressive refinement, in DataFrame functions only.

Rows are grouped by length, those of a length that occurs twice by a hash of their beginning, and only those whose beginning
occurs twice too are hashed whole. What a level leaves is told to the next by a filter of fixed size, so no text leaves its
task to be compared; a filter's collisions let a row through to the next level, and the last one is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, fresh, stash, text_column

#: Code points that the prefix hash covers; the base-2 logarithm of a filter's bits (at most 2^20 rows of 64 bits are broadcast).
PREFIX, BITS = 256, 26


def normalised(text: Column) -> Column:
    """The text with each run of [\\x20\\x09-\\x0D] as one space; single spaces need no change."""
    return F.regexp_replace(text, "[ \\t-\\r]{2,}|[\\t-\\r]", " ")


def bits_of(keys: DataFrame, column: str, bits: int) -> DataFrame:
    """(word, mask): the set of the keys' low bits, in words of 64; 2^(bits - 6) rows at most, whatever the keys."""
    slot = keys.select(F.col(column).bitwiseAND((1 << bits) - 1).alias("slot"))
    return slot.select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))


def marked(rows: DataFrame, column: Column, keys: DataFrame, bits: int, name: str) -> DataFrame:
    """rows with a column that says whether their key may be among the keys of bits_of, whose size is bounded by `bits`."""
    slot, word, mask = (fresh(f"_{c}", rows.columns) for c in ("slot", "word", "mask"))
    found = rows.withColumn(slot, column.bitwiseAND((1 << bits) - 1)).join(F.broadcast(keys.toDF(word, mask)), F.shiftright(slot, 6) == F.col(word), "left")
    hit = F.expr(f"coalesce(shiftright(`{mask}`, cast(`{slot}` & 63 as int)) & 1L, 0L) = 1L")
    return found.withColumn(name, hit).drop(slot, word, mask)


def survivors(docs: DataFrame, text: str = "text", prefix: int = PREFIX, bits: int = BITS) -> DataFrame:
    """The filter (of `rough`'s values) that holds each length and beginning that two rows share.

    The scan that measures a text also hashes its beginning; the second level takes only rows that pass the first.
    """
    sized = stash(docs.select(*rough(normalised(text_column(docs, text)), prefix)), "sized")
    twice = sized.groupBy("size").agg(F.count("*").alias("n")).where("n > 1").select(F.xxhash64("size").alias("key"))
    lengths = stash(bits_of(twice, "key", bits), "lengths")
    left = marked(sized, F.xxhash64("size"), lengths, bits, "may").where("may")
    begins = left.groupBy("size", "begin").agg(F.count("*").alias("n")).where("n > 1")
    found = stash(bits_of(begins.select(F.xxhash64("size", "begin").alias("key")), "key", bits), "begins")
    drop_stash(sized, lengths)
    return found


def rough(text: Column, prefix: int = PREFIX) -> tuple[Column, Column]:
    """(size, begin) of a normalised text: its code points and a hash of the first of them."""
    return F.length(text).alias("size"), F.xxhash64(F.substring(text, 1, prefix)).alias("begin")


def hashed(docs: DataFrame, keys: DataFrame, text: str, prefix: int, bits: int, sha: str, may: str) -> DataFrame:
    """docs with the full hash of the rows that the filter lets through, null for those that are surely alone."""
    norm, size, begin = (fresh(f"_{c}", [*docs.columns, sha, may]) for c in ("norm", "size", "begin"))
    x = docs.withColumn(norm, normalised(text_column(docs, text)))
    a, b = rough(F.col(norm), prefix)
    x = marked(x.withColumns({size: a, begin: b}), F.xxhash64(size, begin), keys, bits, may)
    return x.withColumn(sha, F.when(F.col(may), F.sha2(F.col(norm).cast("binary"), 256))).drop(size, begin)


def groups_of(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(sha, keep, n) of the texts that two rows or more hold: the least id, the number of rows."""
    some = rows.where(F.col("sha").isNotNull()).groupBy("sha").agg(F.min(key).alias("keep"), F.count("*").alias("n"))
    return some.where("n > 1").withColumnRenamed("sha", "copied")


def exact_groups(docs: DataFrame, text: str = "text", prefix: int = PREFIX, bits: int = BITS, digest: bool = False) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, keep_id, group_size, kept; with `digest` also text_sha256, of every row.

    Texts are equal when they are after normalising; a null text is empty, and the empty texts are a group like any other. Of
    equal texts the least doc_id is kept. Null ids come after all others: a row without id is kept only if no row of its group
    has an id. Rows that repeat the kept id and text all say kept (dedup_documents leaves one). Very long texts are compared
    whole, by SHA-256; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    keys = survivors(docs, text, prefix, bits)
    own = docs.select(docs["doc_id"].alias("doc_id"), text_column(docs, text).alias("text"))
    found = hashed(own, keys, "text", prefix, bits, "sha", "may")
    # the norm is there already; a digest of a lone row is no part of the grouping
    columns = ["doc_id", "sha", *([F.coalesce("sha", F.sha2(F.col("_norm").cast("binary"), 256)).alias("text_sha256")] if digest else [])]
    rows = stash(found.select(*columns), "hashed")
    drop_stash(keys)
    groups = stash(groups_of(rows), "groups")
    # lone rows are dealt by their id: they meet no group
    meets = F.coalesce("sha", F.concat(F.lit("alone "), F.xxhash64("doc_id").cast("string")))
    x = rows.withColumn("meets", meets).join(groups, F.col("meets") == F.col("copied"), "left")
    keep = F.when(F.col("copied").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return x.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), *(["text_sha256"] if digest else []))


def dedup_documents(docs: DataFrame, text: str = "text", prefix: int = PREFIX, bits: int = BITS) -> DataFrame:
    """The rows and columns of docs, whatever their names, without copies: one row of each group, of the least doc_id, stays.

    Rows that are surely alone are passed on where they lie. Nulls, empty texts and an empty table as in exact_groups; of rows that
    repeat the kept id and text one stays.
    """
    keys = survivors(docs, text, prefix, bits)
    sha, may = fresh("_sha", docs.columns), fresh("_may", docs.columns)
    found = hashed(docs, keys, text, prefix, bits, sha, may)
    groups = stash(groups_of(found.where(may).select(docs["doc_id"].alias("doc_id"), F.col(sha).alias("sha"))), "groups")
    copied, keep = fresh("_copied", docs.columns), fresh("_keep", docs.columns)
    met = found.where(may).join(groups.select(F.col("copied").alias(copied), F.col("keep").alias(keep)), F.col(sha) == F.col(copied), "left")
    first = met.where(F.col(copied).isNull() | F.col("doc_id").eqNullSafe(F.col(keep))).dropDuplicates([sha])
    return found.where(~F.col(may)).select(*docs.columns).unionAll(first.select(*docs.columns))


def oracle(docs: str = "documents") -> str:
    """DuckDB SQL for exact_groups with the digest."""
    return f"""WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM {docs}),
    g AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
    SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM g"""
