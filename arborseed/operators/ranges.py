"""Positions and intervals: primer joins, islands, prefix coordinates, interval unions and differences, flank masks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Shares that the nodes below a node are dealt to.
SALTS = 32


def primers_of_reads(reads: DataFrame, primers: DataFrame, width: int) -> DataFrame:
    """(read_id, primer_id): the primer that holds the read's 5' end x: of the reverse ones the least start, else the largest end.

    reads(read_id, x, strand), primers(primer_id, start, stop, strand; 0 fits any). Both sides are cut into bins of `width`,
    so the join is an equi-join.
    """
    binned = primers.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width)))).withColumnRenamed("strand", "p_strand")
    x = reads.withColumn("bin", F.floor(F.col("x") / width)).join(binned, "bin")
    x = x.where(F.col("x").between(F.col("start"), F.col("stop")) & ((F.col("p_strand") == "0") | (F.col("p_strand") == F.col("strand"))))
    order = F.when(F.col("strand") == "-", F.col("start")).otherwise(-F.col("stop"))
    return x.groupBy("read_id").agg(F.min(F.struct(order.alias("o"), "primer_id")).alias("b")).select("read_id", F.col("b.primer_id").alias("primer_id"))


def islands(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, value, first, length) of the runs of equal values."""
    w = W.partitionBy(key).orderBy(*order)
    begins = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.lag(order[-1]).over(w).isNull()).cast("int")
    x = rows.withColumn("_begin", begins)
    x = x.withColumn("_run", F.sum("_begin").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return x.groupBy(key, "_run", value).agg(F.min(order[-1]).alias("first"), F.count("*").alias("length")).drop("_run")


def prefix_coordinates(rows: DataFrame, key: str, order: str, size: str) -> DataFrame:
    """rows with the scalar coordinate at which each begins."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("scalar", F.coalesce(F.sum(size).over(w), F.lit(0)))


def merged(runs: DataFrame, key: str) -> DataFrame:
    """Union of the inclusive intervals (key, beg, stop); touching ones join."""
    w = W.partitionBy(key).orderBy("beg", "stop")
    reach = F.max("stop").over(w.rowsBetween(W.unboundedPreceding, -1))
    x = runs.withColumn("_new", (reach.isNull() | (F.col("beg") > reach + 1)).cast("int"))
    x = x.withColumn("_g", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return x.groupBy(key, "_g").agg(F.min("beg").alias("beg"), F.max("stop").alias("stop")).drop("_g")


def degapped(points: DataFrame, gaps: DataFrame, key: str) -> DataFrame:
    """points(key, x) with the number of gap places before x taken off; inside a gap null. gaps(key, beg, stop) are disjoint."""
    marks = gaps.select(key, F.col("beg").alias("x"), F.col("beg"), "stop", F.lit(None).cast("long").alias("p"))
    rows = points.select(key, "x", F.lit(None).cast("long").alias("beg"), F.lit(None).cast("long").alias("stop"), F.col("x").alias("p")).unionByName(marks)
    w = W.partitionBy(key).orderBy("x", F.col("p").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    lost = F.sum(F.when(F.col("p").isNull(), F.col("stop") - F.col("beg") + 1).otherwise(0)).over(w)
    inside = F.last("stop", ignorenulls=True).over(w)
    y = rows.withColumn("lost", lost).withColumn("open_to", inside).where("p is not null")
    return y.select(key, "x", F.when(F.col("open_to").isNull() | (F.col("x") > F.col("open_to")), F.col("x") - F.col("lost")).alias("degapped"))


def flank_masked(bases: DataFrame, key: str, flank: int) -> DataFrame:
    """bases(key, pos, base) without the first and last `flank` of each genome that aren't gaps."""
    real = (F.col("base") != "-").cast("int")
    x = bases.withColumn("_l", F.sum(real).over(W.partitionBy(key).orderBy("pos"))).withColumn("_r", F.sum(real).over(W.partitionBy(key).orderBy(F.col("pos").desc())))
    return x.where((F.col("_l") > flank) & (F.col("_r") > flank)).drop("_l", "_r")


def kept_extent(bases: DataFrame, key: str, flank: int = 0) -> DataFrame:
    """(key, low, high): the places between which a genome of bases(key, pos, base) counts: behind its first `flank` bases that aren't gaps, and before its last.

    Of a genome without so many bases nothing counts: it has no row.
    """
    real = bases.where(F.col("base") != "-").select(key, "pos")
    ahead = real.withColumn("_l", F.row_number().over(W.partitionBy(key).orderBy("pos"))).withColumn("_n", F.count("*").over(W.partitionBy(key)))
    inside = ahead.where((F.col("_l") > flank) & (F.col("_l") <= F.col("_n") - flank))
    return inside.groupBy(key).agg(F.min("pos").alias("low"), F.max("pos").alias("high"))


def placed_extent(genomes: DataFrame, places, flank: int = 0) -> DataFrame:
    """The same of genomes(key, n) that are a row each; nothing is shuffled. places(key, n) gives the ascending places of a genome's
    n bases that aren't gaps, as an array."""
    key, kind = genomes.columns[0], genomes.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, low, high = [], [], []
            for i, (k, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                p = places(k, n) if n else ()
                if len(p) > 2 * flank:
                    at.append(i)
                    low.append(int(p[flank]))
                    high.append(int(p[len(p) - 1 - flank]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(low, pa.int64()), pa.array(high, pa.int64())], [key, "low", "high"])

    return genomes.mapInArrow(run, f"`{key}` {kind}, low long, high long")


def inherited_seeds(own: DataFrame, bounds: DataFrame, up: DataFrame) -> DataFrame:
    """(node, pos, seed, keeper): the seeds that hold at each node where masked places take what holds at the parent.

    own(node, pos, seed) are the seeds of the nodes' genomes, bounds(node, low, high) the places that count there (none without a row),
    up(node_id, ancestor, ancestor_depth) each node's path, itself included. A place is kept by the nearest node on the path where it
    counts; if that has no seed there, none holds. A node's nearer bounds are gathered along its path, so no place meets another. The
    seeds of a node that others are under are repeated by SALTS, and those below are dealt to them: all nodes are under the root.
    """
    path = up.join(bounds.select(F.col("node").alias("_b"), "low", "high"), F.col("ancestor") == F.col("_b"))
    nearer = W.partitionBy("node_id").orderBy(F.col("ancestor_depth").desc()).rowsBetween(W.unboundedPreceding, -1)
    path = path.select("node_id", "ancestor", "low", "high", F.collect_list(F.struct("low", "high")).over(nearer).alias("before"))
    # bounds within nearer ones keep nothing
    path = path.where(~F.exists("before", lambda x: (x["low"] <= F.col("low")) & (x["high"] >= F.col("high"))))
    path = path.withColumn("_salt", F.when(F.col("ancestor") == F.col("node_id"), 0).otherwise(F.pmod(F.xxhash64("node_id"), F.lit(SALTS)).cast("int")))
    inner = up.where(F.col("ancestor") != F.col("node_id")).select(F.col("ancestor").alias("_i")).distinct()
    seeds = own.select(F.col("node").alias("_n"), "pos", "seed").join(inner, F.col("_n") == F.col("_i"), "left")
    seeds = seeds.withColumn("_s", F.explode(F.when(F.col("_i").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    held = path.join(seeds, (F.col("ancestor") == F.col("_n")) & (F.col("_salt") == F.col("_s")) & F.col("pos").between(F.col("low"), F.col("high")))
    held = held.where(~F.exists("before", lambda x: F.col("pos").between(x["low"], x["high"])))
    return held.select(F.col("node_id").alias("node"), "pos", "seed", F.col("ancestor").alias("keeper"))
