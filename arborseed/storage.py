"""The folder that all executors share, tables written there to cut lineages, and bounds of what Python workers hold."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch, but for a single larger row.
BATCH = 1 << 23


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a new temporary one where that is unset and there is one machine (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all executors share")
        made = tempfile.mkdtemp(prefix="arborseed-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        at = "file://" + made
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def stash_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and returns a reader of it; this cuts the lineage and survives lost executors."""
    spark, at = df.sparkSession, stash_path(df.sparkSession, name)
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._stash_path = at
    return out


def drop_stash(*stashes: DataFrame) -> None:
    """Deletes the files of stashes that no later step reads."""
    for df in stashes:
        at = getattr(df, "_stash_path", None)
        if at:
            jvm = df.sparkSession.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(name: str, taken) -> str:
    """`name`, with as many underscores behind it as it takes not to clash with the columns in `taken`, in any case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def small_batches(df: DataFrame) -> None:
    """Bounds the Arrow batches that go to Python workers by BATCH bytes, however long the texts are, unless the session has a smaller bound."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name, None)
    if now is None or now.rstrip("b").isdigit() and int(now.rstrip("b")) > BATCH:
        conf.set(name, str(BATCH))


def give_back() -> None:
    """Gives memory that numpy and Arrow freed back to the system, so that idle workers stay small."""
    import ctypes
    import gc

    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)
