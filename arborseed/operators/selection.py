"""Weights of nodes by the reads that fit them best, and a greedy choice of nodes in which chosen nodes' reads no longer count."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import drop_stash, stash

#: Weights are whole numbers of this part of 1, so sums don't depend on their order.
UNIT = 10**9
#: Nodes that are chosen at most; nodes whose bounds the driver holds, and of which gains are computed at a time.
MOST, HELD, AT_ONCE = 300, 1024, 32
#: Nodes whose overlaps are told at a time: the driver gets a row for each set of them that has reads, 2**MET at most.
MET = 12
#: Pairs of a read and a node among which the driver chooses by itself, 48 MB.
PAIRS = 1 << 21


def read_weights(pairs: DataFrame, totals: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """(read_id, node, w) of pairs(read_id, node, max_score), the nodes at which each read has its best score.

    A read's weight is shared by its nodes and is the smaller the more of its seeds, totals(read_id, seeds), they miss; copies(read_id, n)
    says how many equal reads it stands for.
    """
    epp = pairs.groupBy(F.col("read_id").alias("e_id")).agg(F.count("*").alias("epp"))
    x = pairs.join(epp, F.col("read_id") == F.col("e_id")).join(totals.select(F.col("read_id").alias("t_id"), "seeds"), F.col("read_id") == F.col("t_id"))
    n = F.lit(1)
    if copies is not None:
        x = x.join(copies.select(F.col("read_id").alias("c_id"), F.col("n").alias("copies")), F.col("read_id") == F.col("c_id"), "left")
        n = F.coalesce("copies", F.lit(1))
    share = n / ((F.col("seeds") - F.col("max_score") + 1) * F.col("epp"))
    return x.select("read_id", "node", F.round(share * UNIT).cast("long").alias("w"))


def node_weights(weighed: DataFrame) -> DataFrame:
    """(node, weight): the sum of the weights of its reads."""
    return weighed.groupBy("node").agg((F.sum("w") / UNIT).alias("weight"))


def without_copies(weighed: DataFrame) -> DataFrame:
    """weighed(read_id, node, w) without nodes that have the reads and weights of a lesser node: when that is chosen, nothing is left for them.

    Reads and weights are compared by their number and two sums of 64-bit hashes.
    """
    sums = [F.sum(F.xxhash64(F.lit(i), "read_id", "w").cast("decimal(20,0)")).alias(f"h{i}") for i in range(2)]
    alike = weighed.groupBy("node").agg(F.count("*").alias("n"), *sums)
    first = alike.groupBy("n", "h0", "h1").agg(F.min("node").alias("f_node")).select("f_node")
    return weighed.join(first, F.col("node") == F.col("f_node"), "left_semi")


def _chosen_here(pairs: DataFrame, most: int) -> list[tuple]:
    """The choices of `greedy_nodes` among pairs that the driver holds: a read's pairs are taken off its nodes' gains once."""
    got = pairs.select("read_id", "node", "w").toArrow().combine_chunks()
    if not got.num_rows:
        return []
    order = pc.sort_indices(got, [("node", "ascending")])
    node, w = got["node"].take(order), got["w"].take(order).to_numpy()
    read = got["read_id"].take(order).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    kinds = node.combine_chunks().dictionary_encode()  # in order, for nodes are sorted
    own = kinds.indices.to_numpy(zero_copy_only=False)
    gain, reads = np.zeros(len(kinds.dictionary), np.int64), np.bincount(own)
    np.add.at(gain, own, w)
    by_read, first = np.argsort(read, kind="stable"), np.r_[0, np.cumsum(np.bincount(read))]
    begin, left, out = np.r_[0, np.cumsum(reads)], np.ones(len(first) - 1, bool), []
    while len(out) < most and reads.any():
        best = int(np.argmax(np.where(reads > 0, gain, -1)))  # the first of equal ones
        out.append((len(out), kinds.dictionary[best].as_py(), int(gain[best]) / UNIT, int(reads[best])))
        for r in np.unique(read[begin[best] : begin[best + 1]]):
            if left[r]:
                left[r] = False
                at = by_read[first[r] : first[r + 1]]
                np.subtract.at(gain, own[at], w[at])
                np.subtract.at(reads, own[at], 1)
    return out


def greedy_nodes(weighed: DataFrame, most: int = MOST, held: int = HELD, at_once: int = AT_ONCE, driven: int = PAIRS) -> DataFrame:
    """(place, node, gain, reads): nodes in the order in which each adds most, and the reads it adds; ties to the least node.

    Nodes of the same reads are one. Up to `driven` pairs go to the driver, which chooses by itself; more stay where they are. Then a node's gain only falls as others are chosen, so an old gain bounds it from above: only the nodes of the highest bounds are summed
    again, by the sets of them that reads fit, so the driver can choose among them until another node's bound is better. The driver
    holds `held` bounds; gains of all nodes are summed again when these no longer suffice. Ends when no read is left or `most` nodes
    are chosen.
    """
    spark = weighed.sparkSession
    kind = weighed.schema["node"].dataType.simpleString()
    kinds = f"place long, node {kind}, gain double, reads long"
    few = stash(without_copies(weighed), "unlike")
    if few.count() <= driven:
        chosen = _chosen_here(few, most)
        drop_stash(few)
        return spark.createDataFrame(chosen, kinds)
    pairs = stash(few.repartitionByRange("node").sortWithinPartitions("node"), "weighed")  # nodes that are asked for lie together
    drop_stash(few)
    gone = stash(weighed.select("read_id").limit(0), "gone")
    chosen: list[tuple] = []

    def left(rows: DataFrame) -> DataFrame:
        return rows.join(gone.select(F.col("read_id").alias("g_id")), F.col("read_id") == F.col("g_id"), "left_anti")

    def sets(some: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(set of `some` as bits, weight by node, reads by node) of the reads that are left."""
        own = [F.col("node") == n for n in some]
        bit = F.coalesce(*(F.when(x, F.lit(1 << i)) for i, x in enumerate(own)))
        each = [F.sum(F.when(x, F.col("w"))).alias(f"w{i}") for i, x in enumerate(own)] + [F.count_if(x).alias(f"n{i}") for i, x in enumerate(own)]
        by_read = left(pairs.where(F.col("node").isin(some))).groupBy("read_id").agg(F.bit_or(bit).alias("met"), *each)
        total = by_read.groupBy("met").agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for k in "wn" for x in (f"{k}{i}" for i in range(len(some)))))
        got = np.array(total.collect(), np.int64).reshape(-1, 1 + 2 * len(some))
        return got[:, 0], got[:, 1 : 1 + len(some)], got[:, 1 + len(some) :]

    bounds: dict = {}
    beyond = None  # the order of the first node that the driver doesn't hold
    while len(chosen) < most:
        open_ = sorted((-g, n) for n, g in bounds.items())
        if not open_ or beyond is not None and beyond < open_[0]:
            taken = [c[1] for c in chosen]
            rows = left(pairs.where(~F.col("node").isin(taken)) if taken else pairs)
            top = rows.groupBy("node").agg(F.sum("w").alias("gain")).orderBy(F.col("gain").desc(), "node").limit(held + 1).collect()
            bounds = {r["node"]: r["gain"] for r in top[:held]}
            beyond = (-top[held]["gain"], top[held]["node"]) if len(top) > held else None
            open_ = sorted((-g, n) for n, g in bounds.items())
        if not open_:
            break
        most_at_once = min(at_once, MET)
        some = [n for _, n in open_[:most_at_once]]
        others = min((x for x in (*open_[most_at_once : most_at_once + 1], beyond) if x is not None), default=None)
        met, w, n = sets(some)
        new: list = []
        while True:
            gain, reads = w.sum(0), n.sum(0)
            bounds |= {node: int(g) for node, g in zip(some, gain, strict=True) if node in bounds}
            for node, r in zip(some, reads, strict=True):
                if not r:  # a node without reads is no choice
                    bounds.pop(node, None)
            best = min(((-bounds[node], node) for node in some if node in bounds), default=None)
            if best is None or len(chosen) == most or others is not None and others < best:
                break
            at = some.index(best[1])
            chosen.append((len(chosen), best[1], -best[0] / UNIT, int(reads[at])))
            new.append(best[1])
            del bounds[best[1]]
            still = met >> at & 1 == 0
            met, w, n = met[still], w[still], n[still]
        if new and len(chosen) < most:
            more = stash(gone.unionAll(pairs.where(F.col("node").isin(new)).select("read_id")).distinct(), "gone")
            drop_stash(gone)
            gone = more
    drop_stash(pairs, gone)
    return spark.createDataFrame(chosen, kinds)
