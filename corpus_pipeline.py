"""The training-data pipeline: documents in, packed sequences out; every stage is written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborseed.llm import importance, jaccard_join, line_spread, lsi_decontam, packing
from arborseed.llm.queries import table, tokenizer_json
from arborseed.storage import drop_stash, fresh, stash

#: Words of a shingle and per cent of overlap of near duplicates.
WORDS, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that the importance sample does not draw go."""
    return importance.sampled_documents(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: cross-site boilerplate lines go from all documents but the first; every document stays."""
    out = line_spread.dedup_lines(docs)
    return out.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of each component of near duplicates the document with the least id stays, and so does any row without id."""
    found = jaccard_join.jaccard_components(docs, WORDS, PERCENT)
    name = fresh("gone_id", docs.columns)
    gone = found.where(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that hold a benchmark item go."""
    return lsi_decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the pieces of all documents that are left, in sequences."""
    return packing.pack(docs, tokenizer_json())


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("pack", pack)]

#: The quality, decontamination and packing stages are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = stash(stage(spark, docs, sf_dir), name)
        drop_stash(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
