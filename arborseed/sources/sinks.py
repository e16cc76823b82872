"""Sinks: placement, abundance, breadth and assignment tables, FASTA, FASTQ, VCF, SAM and jplace text, stored indexes."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators.placement import METRICS
from ..operators.tree import newick, orientation_changes
from ..operators.tours import jplace_tokens
from ..storage import drop_stash, stash
from .readers import FORMAT_VERSION


def write_lines(lines: DataFrame, path: str, header: str | None = None) -> None:
    """A text column as files of lines, in the order of the partitions."""
    if header is not None:
        lines = lines.sparkSession.createDataFrame([(header,)], "value string").union(lines)
        lines = lines.coalesce(1)
    lines.write.mode("overwrite").text(path)


def placement_lines(placed: DataFrame) -> DataFrame:
    """metric TAB score (6 places) TAB nodes, in the metrics' fixed order."""
    order = F.array_position(F.array(*(F.lit(m) for m in METRICS)), F.col("metric"))
    return placed.orderBy(order).select(F.concat_ws("\t", "metric", S.decimals("score"), F.array_join("ties", ",")).alias("value"))


def abundance_lines(found: DataFrame) -> DataFrame:
    return found.orderBy(F.col("prop").desc(), "nodes").select(F.concat_ws("\t", "nodes", S.decimals("prop", 5)).alias("value"))


def breadth_lines(b: DataFrame) -> DataFrame:
    return b.orderBy("node").select(F.concat_ws("\t", *(F.col(c).cast("string") for c in b.columns)).alias("value"))


def assignment_lines(assigned: DataFrame, taxa: DataFrame) -> DataFrame:
    """node TAB taxa or . TAB count TAB sorted read ids."""
    named = taxa.groupBy("node").agg(F.array_join(F.array_sort(F.collect_set("taxon")), ",").alias("taxa"))
    x = assigned.groupBy("node").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("read_id")), ",").alias("ids"))
    return x.join(named, "node", "left").orderBy("node").select(F.concat_ws("\t", F.col("node").cast("string"), F.coalesce("taxa", F.lit(".")), F.col("n").cast("string"), "ids").alias("value"))


def fasta_lines(rows: DataFrame, name: str, seq: str, width: int = 80) -> DataFrame:
    return rows.select(F.concat(F.lit(">"), F.col(name).cast("string"), F.lit("\n"), S.wrapped(seq, width)).alias("value"))


def fastq_lines(reads: DataFrame) -> DataFrame:
    return reads.select(F.concat_ws("\n", F.concat(F.lit("@"), "name"), "seq", F.lit("+"), "qual").alias("value"))


def vcf_lines(calls: DataFrame, chrom: str) -> DataFrame:
    return calls.orderBy("pos").select(F.concat_ws("\t", F.lit(chrom), F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), F.lit("1")).alias("value"))


def sam_lines(alignments: DataFrame, reference: str) -> DataFrame:
    """Mapped records by position: name without mate suffix, flag, 1-based position, whole-read match."""
    flag = F.when(F.col("rev"), 16).otherwise(0)
    rows = alignments.where("start >= 0").orderBy("start")
    return rows.select(F.concat_ws("\t", S.without_mate("name"), flag.cast("string"), F.lit(reference), (F.col("start") + 1).cast("string"), F.lit("60"), F.concat(F.length("seq").cast("string"), F.lit("M")), F.lit("*"), F.lit("0"), F.lit("0"), "seq", "qual").alias("value"))


def jplace(nodes: list[tuple[str, str | None]], assigned: DataFrame) -> str:
    """A version 3 document; `assigned` is what its report lists: one entry per node with the reads' names."""
    number = {n: i for i, (n, _) in enumerate(nodes)}
    per_node = assigned.groupBy("node").agg(F.array_sort(F.collect_list(F.col("read_id").cast("string"))).alias("ids")).orderBy("node").toLocalIterator()
    placed = [{"p": [[number[str(r["node"])], str(r["node"])]], "n": r["ids"]} for r in per_node]
    return json.dumps({"version": 3, "tree": newick(nodes), "fields": ["edge_num", "node_id"], "placements": placed, "metadata": {}})


def write_jplace(tree: DataFrame, assigned: DataFrame, path: str) -> None:
    """tours.jplace_tokens as text files that follow each other, with a space between pieces; nothing is collected."""
    order = ["section", "place", "part"]
    jplace_tokens(tree, assigned).repartitionByRange(*order).sortWithinPartitions(*order).select("text").write.mode("overwrite").option("lineSep", " ").text(path)


def write_index(nodes: DataFrame, changes: DataFrame, path: str, **parameters) -> None:
    """nodes and seed_changes, clustered by seed so that a query's seeds read few files, and the parameters they depend on."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    changes.repartitionByRange("seed").sortWithinPartitions("seed", "node").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/seed_changes")
    row = {"format_version": FORMAT_VERSION, **parameters}
    changes.sparkSession.createDataFrame([tuple(row.values())], list(row)).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def top_lines(counts: DataFrame, total: int) -> DataFrame:
    """Seed TAB count TAB fraction, most frequent first."""
    return counts.orderBy(F.col("r").desc(), "seed").select(F.concat_ws("\t", F.col("seed").cast("string"), F.col("r").cast("string"), (F.col("r") / total).cast("string")).alias("value"))


def write_mixture_index(nodes: DataFrame, parents: DataFrame, path: str, taxa: DataFrame | None = None, **parameters) -> None:
    """An index for mixtures: a dictionary of seeds, the changes of their counts by orientation against the parent, the tree, taxa.

    nodes(node, seed, n_fwd, n_rev), parents(node, parent); the root's changes are its counts. Files are replaced as a whole.
    """
    children = parents.where(F.col("parent").isNotNull())
    roots = nodes.join(parents.where(F.col("parent").isNull()).select("node"), "node", "left_semi").select("node", "seed", F.col("n_fwd").alias("d_fwd"), F.col("n_rev").alias("d_rev"))
    write_mixture_changes(orientation_changes(children, nodes).union(roots), parents, path, taxa, **parameters)


#: Bits of a seed by which changes are dealt; seeds are hashes, so parts are alike.
PART = 12


def _numbered_seeds(changes: DataFrame) -> DataFrame:
    """Changes sorted by seed with their part, the seed's first PART bits, their seed's number in it, and whether it is the seed's first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, part, before = None, 0, None, 0  # of the rows so far: the last seed, distinct ones, the last part and those ahead of it
        for batch in batches:
            if batch.num_rows:
                seed = batch.column(1).to_numpy(zero_copy_only=False)
                first = np.r_[count == 0 or seed[0] != last, seed[1:] != seed[:-1]]
                upto, parts = count + np.cumsum(first), seed >> (64 - PART)
                begins = np.r_[parts[0] != part, parts[1:] != parts[:-1]]
                ahead = np.maximum.accumulate(np.where(begins, upto - 1, before))
                local = upto - 1 - ahead
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts), pa.array(local), pa.array(first)], ["node", "seed", "d_fwd", "d_rev", "part", "local", "first"])
                last, count, part, before = seed[-1], int(upto[-1]), parts[-1], int(ahead[-1])

    kinds = ", ".join(f"{c} {changes.schema[c].dataType.simpleString()}" for c in ("node", "seed", "d_fwd", "d_rev"))
    return changes.mapInArrow(run, kinds + ", part long, local long, first boolean")


def write_mixture_changes(changes: DataFrame, parents: DataFrame, path: str, taxa: DataFrame | None = None, **parameters) -> None:
    """`write_mixture_index` of changes(node, seed, d_fwd, d_rev), those of a root being its counts, where they are known already.

    Every seed of a node is in a change on its path, so the dictionary comes from the changes: they are dealt by the seeds' first bits in one
    shuffle, which needs no pass ahead of it, sorted by seed once and numbered as they lie; numbers are in the order of seeds.
    """
    put = lambda x, name: x.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
    sorted_ = changes.select("node", "seed", "d_fwd", "d_rev").repartition(F.shiftright("seed", 64 - PART)).sortWithinPartitions("seed")
    placed = stash(_numbered_seeds(sorted_), "placed")
    sizes = placed.groupBy("part").agg((F.max("local") + 1).alias("size"))  # a row per part
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ids = placed.join(F.broadcast(offsets), "part").withColumn("seed_id", F.col("before") + F.col("local"))
    put(ids.where("first").select("seed", "seed_id"), "dictionary")
    put(ids.select("node", "seed_id", "d_fwd", "d_rev"), "changes")
    drop_stash(placed)
    put(parents, "tree")
    if taxa is not None:
        put(taxa, "taxa")
    row = {"format_version": FORMAT_VERSION, "kind": "mixture", **parameters}
    changes.sparkSession.createDataFrame([tuple(row.values())], list(row)).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
