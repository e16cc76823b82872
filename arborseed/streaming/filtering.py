"""Filter-and-assign over an endless supply of reads: batches are deduplicated, scored, filtered by taxonomy and numbered; what a
node has been given so far is kept as state. A stopped run goes on where it was; a batch that is run again leaves nothing twice."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import mixture as M
from ..operators.tours import lowest_common
from ..operators.tree import row_numbers
from ..storage import drop_stash, stash
from .assign import assign_batch

READ = "read_id long, name string, seq string, qual string"
ROWS = "record long, read_id long, node string, score long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Appended(StatefulProcessor):
    """Gives each record of a node its place among all that the node was given before; the state is one number a node."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.given = handle.getValueState("given", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n = self.given.get()[0] if self.given.exists() else 0
        for part in rows:
            part = part.sort_values("record")
            yield pd.DataFrame({"node": key[0], "place": range(n, n + len(part)), "record": part["record"].to_numpy()})
            n += len(part)
        self.given.update((n,))

    def close(self) -> None:
        pass


@dataclass
class FilterAssign:
    """A filter-and-assign run whose state and results are in the folder `path`, shared by all executors.

    nodes(node, seed, n, n_fwd, n_rev) is the index, with node as a string; taxa(node, taxon) and most_taxa leave out reads whose best
    nodes have more taxa; tree (a numbered tree) gives each read the common ancestor of its nodes.
    """

    spark: SparkSession
    path: str
    nodes: DataFrame
    taxa: DataFrame | None = None
    most_taxa: int = 1
    tree: DataFrame | None = None
    discard: float = 0.0
    k: int = 15
    small: int = 8
    files: int = 4

    def run(self, source: str) -> None:
        """Takes the read files (Parquet, READ's columns) that have come to the folder `source` since the last run, then stops."""
        reads = self.spark.readStream.schema(READ).option("maxFilesPerTrigger", self.files).parquet(source)
        query = reads.writeStream.foreachBatch(self.take).option("checkpointLocation", f"{self.path}/taken").trigger(availableNow=True).start()
        query.awaitTermination()
        if self._epochs("rows"):
            self._append()

    # ------------------------------------------------------------ a batch

    def take(self, batch: DataFrame, epoch: int) -> None:
        """Writes what a batch gives under its number; equal reads are scored once, and every one of them is a record."""
        reads = stash(batch.select("read_id", "name", "seq", "qual"), "reads")
        unique = stash(reads.groupBy("seq").agg(F.min("read_id").alias("one")), "unique")
        found = stash(assign_batch(unique.select(F.col("one").alias("read_id"), F.col("seq").alias("s")), self.nodes, self.discard, self.k, self.small), "found")
        kept = found if self.taxa is None else M.within_taxa(found, self.taxa, self.most_taxa)
        kept = stash(kept.select(F.col("read_id").alias("one"), "node", "score"), "kept")
        # every copy of a read has its nodes
        copies = reads.join(unique.withColumnRenamed("seq", "u_seq"), F.col("seq").eqNullSafe(F.col("u_seq"))).drop("u_seq")
        given = copies.join(kept.select("one").distinct(), "one", "left_semi")
        before = self._before(epoch)
        records = stash(row_numbers(given, ["read_id"], "at").select((F.col("at") + before).alias("record"), "read_id", "name", "seq", "qual", "one"), "records")
        held = records.select("record", "read_id", "one")
        self._put(held.join(kept, "one").select("record", "read_id", "node", "score"), "rows", epoch)
        if self.tree is not None:
            above = lowest_common(kept.select(F.col("one").alias("key"), F.col("node").alias("node_id")), self.tree)
            self._put(held.join(above, F.col("one") == F.col("key")).select("record", "read_id", "lca"), "lca", epoch)
        self._put(records.drop("one"), "records", epoch)
        totals = [(reads.count(), records.count())]
        self._put(self.spark.createDataFrame(totals, "reads long, records long"), "totals", epoch)  # last: it says that the batch is done
        drop_stash(reads, unique, found, kept, records)

    def _put(self, rows: DataFrame, name: str, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/epoch={epoch}")

    def _epochs(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _before(self, epoch: int) -> int:
        """Records of all earlier batches: the number of the batch's first one."""
        if not self._epochs("totals"):
            return 0
        done = self.spark.read.schema("reads long, records long, epoch int").parquet(f"{self.path}/totals").where(F.col("epoch") < epoch)
        return done.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]

    # ------------------------------------------------------------ results

    def _append(self) -> None:
        """Passes the batches' rows on to the nodes' lists, each row once."""
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
        rows = self.spark.readStream.schema(ROWS).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{self.path}/rows")
        lists = rows.groupBy("node").transformWithStateInPandas(Appended(), "node string, place long, record long", "append", "none")
        written = lists.writeStream.format("parquet").option("path", f"{self.path}/lists").option("checkpointLocation", f"{self.path}/appended").outputMode("append")
        written.trigger(availableNow=True).start().awaitTermination()

    def lists(self) -> DataFrame:
        """(node, place, record): the records that each node was given, in the order of the batches."""
        return self.spark.read.schema("node string, place long, record long").parquet(f"{self.path}/lists")

    def records(self) -> DataFrame:
        return self.spark.read.schema("record long, read_id long, name string, seq string, qual string, epoch int").parquet(f"{self.path}/records")

    def ancestors(self) -> DataFrame:
        return self.spark.read.schema("record long, read_id long, lca string, epoch int").parquet(f"{self.path}/lca")

    def totals(self) -> DataFrame:
        return self.spark.read.schema("reads long, records long, epoch int").parquet(f"{self.path}/totals")
