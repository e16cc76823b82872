"""Trees as relations: depth-first numbers, intervals, ancestors, common ancestors, delta relations along the branches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import drop_stash, stash


def paths(nodes: DataFrame, sep: str = "/") -> DataFrame:
    """nodes(node_id, parent_id) with path, depth, by pointer jumping: each round doubles the part of the path that is known.

    Rounds are as many as the logarithm of the depth; each is written, so none is computed twice. A node whose chain of parents
    doesn't end in a root is left out.
    """
    at = stash(nodes.select("node_id", "parent_id", F.col("parent_id").alias("top"), F.col("node_id").alias("path"), F.lit(0).alias("depth")), "paths")
    rounds, most = 0, at.count().bit_length() + 1  # no path is longer than there are nodes; what is left then goes in circles
    while at.where(F.col("top").isNotNull()).limit(1).count() and rounds < most:
        up = at.select(F.col("node_id").alias("up_id"), F.col("path").alias("up_path"), F.col("depth").alias("up_depth"), F.col("top").alias("up_top"))
        both = at.where(F.col("top").isNotNull()).join(up, F.col("top") == F.col("up_id"))
        further = both.select("node_id", "parent_id", F.col("up_top").alias("top"), F.concat_ws(sep, "up_path", "path").alias("path"), (F.col("depth") + F.col("up_depth") + 1).alias("depth"))
        new = stash(at.where(F.col("top").isNull()).union(further), "paths")
        drop_stash(at)
        at, rounds = new, rounds + 1
    return at.where(F.col("top").isNull()).drop("top")


def row_numbers(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their place in the order, from 0: a range sort deals them out, and an offset per partition makes places global."""
    placed = stash(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_m", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))  # a row per partition
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    numbered_ = placed.join(F.broadcast(offsets), part == F.col("_part"))
    return numbered_.withColumn(name, F.col("_before") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m", "_part", "_before")


def numbered(pathed: DataFrame) -> DataFrame:
    """dfs_index by sorted path and subtree_end: descendants have dfs_index in [dfs_index, subtree_end). All in the JVM, in no single task."""
    flat = row_numbers(pathed, ["path"], "dfs_index")
    sizes = pathed.select(F.explode(F.split("path", "/")).alias("a_id")).groupBy("a_id").agg(F.count("*").alias("size"))
    out = flat.join(sizes, F.col("node_id") == F.col("a_id"))
    return out.withColumn("subtree_end", F.col("dfs_index") + F.col("size")).withColumn("is_leaf", F.col("size") == 1).drop("a_id")


def ancestors(pathed: DataFrame) -> DataFrame:
    """(node_id, ancestor, ancestor_depth), each node its own ancestor too."""
    parts = F.split("path", "/")
    return pathed.select("node_id", F.posexplode(parts).alias("ancestor_depth", "ancestor"))


def common_ancestors(members: DataFrame, up: DataFrame) -> DataFrame:
    """members(key, node_id): the deepest ancestor that all members of a key share."""
    size = members.groupBy("key").agg(F.countDistinct("node_id").alias("members"))
    held = members.distinct().join(up, "node_id").groupBy("key", "ancestor", "ancestor_depth").agg(F.count("*").alias("c"))
    whole = held.join(size, "key").where("c = members")
    return whole.groupBy("key").agg(F.max(F.struct("ancestor_depth", "ancestor")).alias("x")).select("key", F.col("x.ancestor").alias("lca"), F.col("x.ancestor_depth").alias("lca_depth"))


def within_radius(nodes: DataFrame, start: DataFrame, radius: int) -> DataFrame:
    """(source, node_id, distance) of the nodes within `radius` edges of start(source, node_id)."""
    edges = nodes.where(F.col("parent_id").isNotNull()).select(F.col("node_id").alias("x"), F.col("parent_id").alias("y"))
    edges = edges.union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
    seen = start.select("source", "node_id", F.lit(0).alias("distance"))
    front = seen
    for step in range(1, radius + 1):
        front = front.join(edges, F.col("node_id") == F.col("x")).select("source", F.col("y").alias("node_id"), F.lit(step).alias("distance")).distinct()
        seen = seen.union(front)
    return seen.groupBy("source", "node_id").agg(F.min("distance").alias("distance"))


def capped(neighbours: DataFrame, most: int) -> DataFrame:
    """The first `most` neighbours by distance, then id: a limit that is the feature."""
    w = W.partitionBy("source").orderBy("distance", "node_id")
    return neighbours.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("rank")


def seed_changes(parent_child: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, seed, parent_count, child_count) where the counts differ; parent_child(node, parent), nodes(node, seed, n)."""
    child = parent_child.join(nodes, "node").select("node", "seed", F.col("n").alias("c"))
    up = nodes.select(F.col("node").alias("parent"), "seed", F.col("n").alias("p"))
    above = parent_child.join(up, "parent").select("node", "seed", "p")
    both = child.join(above, ["node", "seed"], "full_outer")
    counts = both.select("node", "seed", F.coalesce("p", F.lit(0)).alias("parent_count"), F.coalesce("c", F.lit(0)).alias("child_count"))
    return counts.where("parent_count <> child_count")


def reconstructed(changes: DataFrame, up: DataFrame) -> DataFrame:
    """(node, seed, n): along each root path the deepest change of a seed holds. up(node, ancestor, ancestor_depth)."""
    along = up.join(changes.withColumnRenamed("node", "ancestor"), "ancestor")
    last = along.groupBy("node", "seed").agg(F.max_by("child_count", "ancestor_depth").alias("n"))
    return last.where("n > 0")


def nearest_kept(up: DataFrame, kept: DataFrame) -> DataFrame:
    """(node_id, keeper): the nearest ancestor, itself included, that is in kept(ancestor); the collapse of identical nodes."""
    return up.join(kept, "ancestor", "left_semi").groupBy("node_id").agg(F.max_by("ancestor", "ancestor_depth").alias("keeper"))


def newick(rows: list[tuple[str, str | None]]) -> str:
    """Newick text with edge numbers of (node_id, parent_id) rows, children in order."""
    children: dict[str | None, list[str]] = {}
    for node, parent in rows:
        children.setdefault(parent, []).append(node)
    number = {node: i for i, (node, _) in enumerate(rows)}
    done: dict[str, str] = {}
    stack = [(r, False) for r in children.get(None, [])]
    while stack:
        node, ready = stack.pop()
        below = children.get(node, [])
        if ready or not below:
            done[node] = ("(" + ",".join(done[c] for c in below) + ")" if below else "") + f"{node}:1.0{{{number[node]}}}"
        else:
            stack += [(node, True), *((c, False) for c in below)]
    return ",".join(done[r] for r in children.get(None, [])) + ";"


def subtree_taxa(up: DataFrame, taxa: DataFrame, most: int) -> DataFrame:
    """(node, taxa, over): the distinct taxa at and below each node of up(node_id, ancestor); more than `most` set the flag and clear the set.

    Sets are collected only where they have `most` taxa or fewer.
    """
    below = up.join(taxa.select(F.col("node").alias("node_id"), "taxon"), "node_id").select(F.col("ancestor").alias("node"), "taxon").distinct()
    size = below.groupBy("node").agg(F.count("*").alias("c"))
    few = below.join(size.where(F.col("c") <= most).select("node"), "node").groupBy("node").agg(F.array_sort(F.collect_list("taxon")).alias("taxa"))
    empty = F.array().cast("array<string>")
    return size.join(few, "node", "left").select("node", F.coalesce("taxa", empty).alias("taxa"), (F.col("c") > most).alias("over"))


def collapsed(parents: DataFrame, changed: DataFrame) -> DataFrame:
    """(node_id, keeper): each node's nearest ancestor, itself included, that is a root or in changed(node_id); parents(node_id, parent_id, path)."""
    kept = parents.join(changed.select("node_id").distinct().withColumn("_c", F.lit(1)), "node_id", "left").where(F.col("_c").isNotNull() | F.col("parent_id").isNull())
    return nearest_kept(ancestors(parents), kept.select(F.col("node_id").alias("ancestor")))


def orientation_changes(parent_child: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, seed, d_fwd, d_rev): by how much a node's seed counts differ from its parent's in each orientation; nodes(node, seed, n_fwd, n_rev)."""
    child = parent_child.join(nodes, "node").select("node", "seed", F.col("n_fwd").alias("cf"), F.col("n_rev").alias("cr"))
    up = nodes.select(F.col("node").alias("parent"), "seed", F.col("n_fwd").alias("pf"), F.col("n_rev").alias("pr"))
    both = child.join(parent_child.join(up, "parent").select("node", "seed", "pf", "pr"), ["node", "seed"], "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = both.select("node", "seed", (zero("cf") - zero("pf")).alias("d_fwd"), (zero("cr") - zero("pr")).alias("d_rev"))
    return out.where((F.col("d_fwd") != 0) | (F.col("d_rev") != 0))


def orientation_differences(pairs: DataFrame) -> DataFrame:
    """(node, seed, d_fwd, d_rev) as `orientation_changes` gives it, of pairs(node, seeds, above): a node's list of seed counts and its parent's, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for i, sign in ((1, 1), (2, -1)):
                lists = batch.column(i)
                row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
                flat = lists.flatten()
                seed, fwd, rev = (flat.field(c).to_numpy() for c in ("seed", "n_fwd", "n_rev"))
                parts.append((row, seed, sign * fwd, sign * rev))
            row, seed, fwd, rev = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((seed, row))
            row, seed = row[order], seed[order]
            at = np.flatnonzero(np.r_[np.ones(min(1, len(row)), bool), (seed[1:] != seed[:-1]) | (row[1:] != row[:-1])])
            if len(at):
                fwd, rev = np.add.reduceat(fwd[order], at), np.add.reduceat(rev[order], at)
                kept = (fwd != 0) | (rev != 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[at][kept])), pa.array(seed[at][kept]), pa.array(fwd[kept]), pa.array(rev[kept])], ["node", "seed", "d_fwd", "d_rev"])

    return pairs.select("node", "seeds", "above").mapInArrow(run, f"node {pairs.schema['node'].dataType.simpleString()}, seed long, d_fwd long, d_rev long")


def _flat(lists: pa.Array, *fields: str) -> tuple[np.ndarray, ...]:
    """(row, fields) of all elements of a column of lists; a null is an empty list."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    flat = lists.flatten()
    return np.repeat(np.arange(len(lists)), size), *(flat.field(c).to_numpy() for c in fields)


def listed_changes(rows: DataFrame) -> DataFrame:
    """(node, parent, changes) of rows(node, parent, seeds, above): `seed_changes` of a node's list of seed counts against its parent's, row by row.

    changes holds (seed, parent_count, child_count); every row stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (r, s, c), (q, t, p) = _flat(batch.column(2), "seed", "n"), _flat(batch.column(3), "seed", "n")
            row, seed = np.r_[r, q], np.r_[s, t]
            order = np.lexsort((seed, row))
            row, seed = row[order], seed[order]
            at = np.flatnonzero(np.r_[np.ones(min(1, len(row)), bool), (seed[1:] != seed[:-1]) | (row[1:] != row[:-1])])
            child, parent = (np.add.reduceat(x[order], at) if len(at) else x for x in (np.r_[c, np.zeros_like(p)], np.r_[np.zeros_like(c), p]))
            kept = child != parent
            off = np.r_[0, np.cumsum(np.bincount(row[at][kept], minlength=batch.num_rows))].astype(np.int32)
            found = pa.StructArray.from_arrays([pa.array(seed[at][kept]), pa.array(parent[kept]), pa.array(child[kept])], ["seed", "parent_count", "child_count"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(off), found)], ["node", "parent", "changes"])

    kind = {c: rows.schema[c].dataType.simpleString() for c in ("node", "parent")}
    return rows.select("node", "parent", "seeds", "above").mapInArrow(run, f"node {kind['node']}, parent {kind['parent']}, changes array<struct<seed:bigint,parent_count:bigint,child_count:bigint>>")


def listed_counts(rows: DataFrame, summed: bool = False) -> DataFrame:
    """(node, seed, n) of rows(node, changes, above): `reconstructed` from the counts that hold at a node's parent and its own changes, row by row.

    summed: (node, seeds, total) instead, the number of seeds and the sum of their counts, of each row that has any.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (r, s, c), (q, t, p) = _flat(batch.column(1), "seed", "child_count"), _flat(batch.column(2), "seed", "n")
            row, seed, n, own = np.r_[r, q], np.r_[s, t], np.r_[c, p], np.r_[np.ones(len(r)), np.zeros(len(q))]
            order = np.lexsort((own, seed, row))
            row, seed, n = row[order], seed[order], n[order]
            last = np.flatnonzero(np.r_[(seed[1:] != seed[:-1]) | (row[1:] != row[:-1]), np.ones(min(1, len(row)), bool)])
            last = last[n[last] > 0]
            if summed:
                seeds = np.bincount(row[last], minlength=batch.num_rows)
                held = np.flatnonzero(seeds)
                total = np.zeros(batch.num_rows, np.int64)
                np.add.at(total, row[last], n[last])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(held)), pa.array(seeds[held]), pa.array(total[held])], ["node", "seeds", "total"])
                continue
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[last])), pa.array(seed[last]), pa.array(n[last])], ["node", "seed", "n"])

    return rows.select("node", "changes", "above").mapInArrow(run, f"node {rows.schema['node'].dataType.simpleString()}, " + ("seeds long, total long" if summed else "seed long, n long"))


def orientations_at(changes: DataFrame, up: DataFrame) -> DataFrame:
    """(node, seed, n_fwd, n_rev): the sums of the changes along each root path. up(node, ancestor)."""
    along = up.join(changes.withColumnRenamed("node", "ancestor"), "ancestor").groupBy("node", "seed").agg(F.sum("d_fwd").alias("n_fwd"), F.sum("d_rev").alias("n_rev"))
    return along.where((F.col("n_fwd") > 0) | (F.col("n_rev") > 0))


def orientations_below(changes: DataFrame, parents: DataFrame) -> DataFrame:
    """`orientations_at` in a tree of roots and their children, parents(node, parent): changes are gathered by node once, and a root's list meets its children's."""
    item = lambda sign: F.collect_list(F.struct("seed", (sign * F.col("d_fwd")).alias("n_fwd"), (sign * F.col("d_rev")).alias("n_rev")))
    roots, children = parents.where(F.col("parent").isNull()).select("node"), parents.where(F.col("parent").isNotNull())
    at_roots = stash(changes.join(stash(roots, "roots"), "node", "left_semi"), "at_roots")  # read twice
    above = stash(at_roots.groupBy(F.col("node").alias("parent")).agg(item(-1).alias("above")), "above")
    listed = changes.groupBy(F.col("node").alias("c_node")).agg(item(1).alias("seeds"))
    both = children.join(listed, F.col("node") == F.col("c_node"), "left").join(above, "parent", "left")
    empty = F.array().cast("array<struct<seed:bigint,n_fwd:bigint,n_rev:bigint>>")
    sums = orientation_differences(both.select("node", *(F.coalesce(c, empty).alias(c) for c in ("seeds", "above")))).withColumnsRenamed({"d_fwd": "n_fwd", "d_rev": "n_rev"})
    return sums.unionAll(at_roots.select("node", "seed", F.col("d_fwd").alias("n_fwd"), F.col("d_rev").alias("n_rev"))).where((F.col("n_fwd") > 0) | (F.col("n_rev") > 0))
