"""Importance resampling: documents are drawn in proportion to the ratio of two hashed n-gram generative models.

The raw model counts the word unigrams and bigrams of all documents in hashed slots; the target model counts those of
documents labelled good. A document's log weight is the sum over its n-grams of the log ratio of the two probabilities;
Gumbel noise is added and the k largest keys are kept, which draws k documents without replacement.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import Hashed, chunks, drop_stash, fresh, grams, mix, stash, summed, text_column, tidy, words

#: Slots of each n-gram length; labelled rows that the target model and the cut are fitted on at most; see importance_weights.
SLOTS, MAX_LABELS = 1 << 20, 20_000
#: Count added to both sides of a ratio; by n-gram length, how far a log ratio must go beyond 0, in itself and in standard errors.
PRIOR, MARGIN = 1.0, ((1.0, 2.0), (2.0, 3.0))


def slots(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot of each n-gram of a chunk: words first, then word pairs; index of its row), with A-Z lower-cased."""
    start, end, first = words(data, off)
    h = Hashed(data, fold=True).of(start, end)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    pairs, at = grams(h, first, 2)
    one, two = (mix(h) >> np.uint64(44)).astype(np.int64), (pairs >> np.uint64(44)).astype(np.int64) + SLOTS
    return np.concatenate([one, two]), np.concatenate([row, row[at]])


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p_target / p_raw of each slot, drawn towards 0 by a margin and by its standard errors.

    The target model is the raw model times (count + prior) / (expected count + prior). A slot for which the labelled
    sample shows no clear difference keeps the raw probability, so it adds no noise however long a document is.
    """
    out = np.zeros(2 * SLOTS)
    for part, (margin, errors) in zip((slice(0, SLOTS), slice(SLOTS, None)), MARGIN, strict=True):
        r, t = raw[part].astype(float), target[part].astype(float)
        expected = r * (t.sum() / max(r.sum(), 1.0))
        ratio = np.log((t + PRIOR) / (expected + PRIOR))
        out[part] = np.sign(ratio) * np.maximum(0, np.abs(ratio) - margin - errors / np.sqrt(expected + PRIOR))
    return out.astype(np.float32)


def labelled(labels: DataFrame, most: int = MAX_LABELS) -> DataFrame:
    """(label_id, good): at most `most` labelled documents, drawn by a hash of their id; good unless any row says otherwise."""
    good = (F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    known = labels.where(F.col("doc_id").isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull()))
    rows = known.groupBy("doc_id").agg(F.min(good.cast("int")).alias("good"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("label_id"), "good")


def cut_of(weights: np.ndarray, good: np.ndarray) -> float:
    """The log weight from which on a labelled document passes: the least sum of both shares of errors; -inf without both kinds."""
    if not good.any() or good.all():
        return float("-inf")
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
    lost = np.r_[0, np.cumsum(g)][first] / g.sum()
    passed = ((~g).sum() - np.r_[0, np.cumsum(~g)][first]) / (~g).sum()
    return float(w[first[np.argmin(lost + passed)]])


def kth_largest(keys: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The exact k-th largest value: histograms narrow its range until a bin holds one value or few."""
    value = F.col(column)
    low, high = keys.agg(F.min(value), F.max(value)).first()
    while low < high:
        width = (high - low) / bins
        bin_of = F.least(F.lit(bins - 1), F.floor((value - F.lit(low)) / F.lit(width)).cast("int"))
        inside = keys.where(value.between(low, high))
        counts = inside.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).collect()
        for r in sorted(counts, key=lambda r: -r["bin"]):
            if k <= r["n"]:
                break
            k -= r["n"]
        if (r["low"], r["high"]) == (low, high) and len(counts) == 1:
            return low
        low, high = r["low"], r["high"]
    return low


def fitted(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELS) -> np.ndarray:
    """log_ratios of all documents' counts and those of the documents labelled good."""
    sample = F.broadcast(labelled(labels, most))  # bounded by `most`
    tagged = docs.select(docs["doc_id"].alias("doc_id"), text_column(docs).alias("text")).join(sample, F.col("doc_id") == F.col("label_id"), "left")

    def count(batch: pa.RecordBatch, total: np.ndarray) -> None:
        good = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False) == 1
        for i, j, data, off in chunks(batch.column(0)):
            slot, row = slots(data, off)
            total[: 2 * SLOTS] += np.bincount(slot, minlength=2 * SLOTS)
            total[2 * SLOTS :] += np.bincount(slot[good[i:j][row]], minlength=2 * SLOTS)

    counts = summed(tagged.select("text", "good"), count, 4 * SLOTS)
    return log_ratios(counts[: 2 * SLOTS], counts[2 * SLOTS :])


def scored(docs: DataFrame, ratios: np.ndarray, columns: list[str], weight: str = "log_weight") -> DataFrame:
    """The given columns of every row of docs, and its log weight."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # 8 MB by SLOTS
    names = [f"c{i}" for i in range(len(columns))]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, j, data, off in chunks(batch.column(0)):
                slot, row = slots(data, off)
                out[i:j] = np.bincount(row, weights=shared.value[slot], minlength=j - i)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.round(out, 9))], [*names, "w"])

    schema = StructType([*(StructField(n, docs.schema[c].dataType) for n, c in zip(names, columns, strict=True)), StructField("w", DoubleType())])
    rows = docs.select(text_column(docs).alias("t"), *(docs[c].alias(n) for n, c in zip(names, columns, strict=True)))
    return rows.mapInArrow(tidy(score), schema).toDF(*columns, weight)


def gumbel_key(rows: DataFrame, seed: int, weight: str = "log_weight"):
    unit = (F.pmod(F.xxhash64(F.lit(seed), rows["doc_id"]), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return rows[weight] - F.log(-F.log(unit))


def drawn(docs: DataFrame, labels: DataFrame, ratios: np.ndarray, most: int, k: int | None, seed: int) -> tuple[DataFrame, float]:
    """(doc_id, log_weight, gumbel_key of all rows; the k-th largest key)."""
    weighed = scored(docs, ratios, ["doc_id"])
    keyed = stash(weighed.withColumn("gumbel_key", gumbel_key(weighed, seed)), "weights")
    if k is None:
        sample = F.broadcast(labelled(labels, most))  # bounded by `most`
        known = keyed.join(sample, F.col("doc_id") == F.col("label_id")).dropDuplicates(["doc_id"]).select("log_weight", "good").toPandas()
        cut = cut_of(known["log_weight"].to_numpy(float), known["good"].to_numpy() == 1)
        k = keyed.where(F.col("log_weight") >= cut).count()
    least = kth_largest(keyed, "gumbel_key", k) if k else float("inf")
    return keyed, float("-inf") if least is None else least


def importance_sample(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELS, k: int | None = None, seed: int = 20) -> DataFrame:
    """The k documents of the largest log weight plus Gumbel noise: doc_id, log_weight, gumbel_key, kept (true).

    Without k, as many are drawn as pass the cut that tells the labelled documents apart best. Noise comes from a hash of
    the id and the seed, so repeated rows share their fate; keys equal to the k-th are all kept. Null and empty texts weigh
    0; a null id draws as any other; without labels of both kinds all rows are kept; an empty table gives no rows.
    """
    keyed, least = drawn(docs, labels, fitted(docs, labels, most), most, k, seed)
    return keyed.where(F.col("gumbel_key") >= least).withColumn("kept", F.lit(True))


def sampled_documents(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELS, seed: int = 20) -> DataFrame:
    """The rows and columns of docs, whatever their names, that importance_sample keeps; they are scored again rather than shuffled."""
    ratios, weight = fitted(docs, labels, most), fresh("log_weight", docs.columns)
    keyed, least = drawn(docs, labels, ratios, most, None, seed)
    drop_stash(keyed)
    rows = scored(docs, ratios, docs.columns, weight)
    return rows.where(gumbel_key(rows, seed, weight) >= least).drop(weight)
