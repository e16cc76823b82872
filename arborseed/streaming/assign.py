"""Filter-and-assign as a stream: micro-batches of reads are sketched, scored and assigned against a fixed node relation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import mixture as M
from ..operators import placement as P
from ..storage import shared_dir


def assign_batch(batch: DataFrame, nodes: DataFrame, discard: float, k: int, small: int) -> DataFrame:
    """(read_id, node, score) of a batch of reads (read_id, s): the best nodes of the reads that reach the threshold."""
    seeds = P.seeds_of(batch, "read_id", "s", k, small)
    scores = M.read_node_scores(seeds, nodes)
    totals = seeds.groupBy("read_id").agg(F.count("*").alias("seeds"))
    best = M.kept_reads(M.max_scores(scores), totals, discard).select("read_id", "max_score")
    return M.near_best(scores, best).select("read_id", "node", "score")


def assign_files(spark: SparkSession, path: str, nodes: DataFrame, discard: float = 0.0, k: int = 15, small: int = 8) -> DataFrame:
    """Reads (item_id, text) arriving as Parquet files, a few files a batch; decisions are made per batch.

    Each batch overwrites its own folder, so a batch that is run again after a failure leaves no rows twice.
    """
    out = f"{shared_dir(spark)}/assigned-{uuid.uuid4().hex}"
    reads = _stream(spark, path).select(F.col("item_id").alias("read_id"), S.dna("text").alias("s"))

    def put(batch: DataFrame, epoch: int) -> None:
        assign_batch(batch, nodes, discard, k, small).write.mode("overwrite").parquet(f"{out}/rows/epoch={epoch}")

    query = reads.writeStream.foreachBatch(put).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("read_id long, node long, score long, epoch int").parquet(f"{out}/rows")


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def _stream(spark: SparkSession, path: str) -> DataFrame:
    """A file, or a folder of files, as a stream of its rows."""
    files = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 4)
    if _is_folder(spark, path):
        return files.option("pathGlobFilter", "*.parquet").parquet(path)
    folder, _, name = path.rpartition("/")
    return files.option("pathGlobFilter", name).parquet(folder)


def running_totals(spark: SparkSession, path: str, keys: list[str], *totals) -> DataFrame:
    """Totals by key as they stand when the stream's files are read: state is kept by Spark, a row per key, and written as a whole each time."""
    out = f"{shared_dir(spark)}/totals-{uuid.uuid4().hex}"
    counts = _stream(spark, path).groupBy(*keys).agg(*totals)
    written = counts.writeStream.outputMode("complete").foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{out}/rows"))
    written.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{out}/rows")


def windowed_counts(spark: SparkSession, path: str, time: str, size: str, late: str, *keys: str) -> DataFrame:
    """(begins, keys, n) of the time windows that the watermark has closed; rows later than `late` are left out, and state is dropped behind it."""
    out = f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}"
    rows = _stream(spark, path).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, size).alias("w"), *keys).agg(F.count("*").alias("n"))
    rows = rows.select(F.col("w.start").alias("begins"), *keys, "n")
    written = rows.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state")
    written.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/rows")


def cancellable(spark: SparkSession, group: str, run):
    """run() in a job group of its own; an interrupt cancels the group's jobs, and tasks with them, before it goes on."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group, interruptOnCancel=True)
    try:
        return run()
    except KeyboardInterrupt:
        sc.cancelJobGroup(group)
        raise
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
