"""Seed relations and the placement of a sample on the nodes of a collection.

Relations: node_seeds(node, seed, n, n_fwd, n_rev), read_seeds(read_id, at, seed, rev), counts(seed, r).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sketch as K
from ..storage import stash
from . import tree as T


def seeds_of(rows: DataFrame, key: str, s: str, k: int = 15, small: int = 8, t: int = 0, opened: bool = False) -> DataFrame:
    """(key, at, seed, rev): canonical hashes of the syncmers of each sequence; palindromes are dropped."""
    return K.seed_rows(rows, key, s, k, small, t, 1, opened)


def kminmers_of(rows: DataFrame, key: str, s: str, k: int = 15, small: int = 8, t: int = 0, l: int = 3, opened: bool = False) -> DataFrame:  # noqa: E741
    """(key, at, seed, rev): hashes folded over l consecutive syncmers in the smaller of both orders; equal orders are dropped."""
    return K.seed_rows(rows, key, s, k, small, t, l, opened)


def trimmed(seeds: DataFrame, length: Column, start: int, end: int, k: int) -> DataFrame:
    """Seeds whose k-mer begins at `start` or later and at length - end - k at most."""
    return seeds.where(F.col("at").between(F.lit(start), length - end - k))


def quality_kept(seeds: DataFrame, reads: DataFrame, k: int, least: float) -> DataFrame:
    """Seeds whose k bases have a mean Phred value of `least` or more; reads(read_id, qual). Sums along the read are taken once per read."""
    sums = reads.select(F.col("read_id").alias("q_id"), F.transform(F.split("qual", ""), lambda c: F.ascii(c) - 33).alias("q"))
    span = F.aggregate(F.slice("q", F.col("at").cast("int") + 1, F.lit(k)), F.lit(0), lambda a, x: a + x)
    whole = (F.col("at") >= 0) & (F.col("at") + k <= F.size("q"))
    return seeds.join(sums, F.col("read_id") == F.col("q_id")).where(whole & (span >= least * k)).drop("q_id", "q")


def sample_scores(nodes: DataFrame, kept: DataFrame, root: DataFrame) -> DataFrame:
    """The five scores of each sample on each node that shares a seed with it, for any number of samples in one job: kept(sample, seed, r)."""
    lr, lg = F.log1p(F.col("r").cast("double")), F.log1p(F.col("n").cast("double"))
    stats = kept.groupBy("sample").agg(F.sum(lr * lr).alias("squares"), F.sum(lr).alias("logs"), F.count("*").alias("kept"))
    inverse = kept.join(root, "seed").groupBy("sample").agg(F.sum(1 / F.col("n")).alias("root_inverse"))
    genome = nodes.groupBy("node").agg(F.sum(lg * lg).alias("genome"))
    hit = nodes.join(kept, "seed").groupBy("sample", "node").agg(
        F.sum(lr / F.col("n")).alias("raw"), F.sum(lr * lg).alias("dot"), F.count("*").alias("shared"), F.sum(1 / F.col("n")).alias("inverse"), F.sum(lr).alias("logs_hit"))
    y = hit.join(genome, "node").join(stats, "sample").join(inverse, "sample", "left")
    share = F.coalesce(F.when(F.col("root_inverse") > 0, F.col("inverse") / F.col("root_inverse")), F.lit(0.0))
    return y.select(
        "sample", "node", (F.col("raw") / F.sqrt("squares")).alias("log_raw"), F.least(F.lit(1.0), F.col("dot") / (F.sqrt("squares") * F.sqrt("genome"))).alias("log_cosine"),
        (F.col("shared") / F.col("kept")).alias("containment"), share.alias("weighted_containment"), (F.col("logs_hit") / F.col("logs")).alias("log_containment"))


def node_seeds(seeds: DataFrame, key: str) -> DataFrame:
    one = F.col("rev").cast("long")
    return seeds.groupBy(F.col(key).alias("node"), "seed").agg(F.count("*").alias("n"), F.sum(1 - one).alias("n_fwd"), F.sum(one).alias("n_rev"))


def seed_counts(read_seeds: DataFrame) -> DataFrame:
    """(seed, r): occurrences over all reads; repeated reads count as often as they come."""
    return read_seeds.groupBy("seed").agg(F.count("*").alias("r"))


def without_homopolymers(counts: DataFrame, k: int) -> DataFrame:
    return counts.where(~F.col("seed").isin(K.homopolymer_hashes(k)))


def mask_top(counts: DataFrame, fraction: float) -> DataFrame:
    """Without the first int(fraction * n) seeds by count, then seed. The bound is found on the distribution of counts."""
    counts = stash(counts, "counts")  # read four times
    total = counts.agg(F.count("*").alias("n"))
    by_count = counts.groupBy("r").agg(F.count("*").alias("kinds"))
    above = by_count.withColumn("upto", F.sum("kinds").over(W.orderBy(F.col("r").desc())))
    need = F.floor(F.col("n") * F.lit(fraction)).cast("long")
    edge = above.crossJoin(F.broadcast(total)).where((F.col("upto") > need)).agg(F.max("r").alias("edge"), F.first(need).alias("need"))  # one row
    held = counts.crossJoin(F.broadcast(edge))
    at_edge = T.row_numbers(held.where("r = edge").select("seed", "r", "need"), ["seed"], "rank")  # most seeds may have the edge's count
    before = above.crossJoin(F.broadcast(edge)).where("r > edge").agg(F.coalesce(F.sum("kinds"), F.lit(0)).alias("before"))
    kept_edge = at_edge.crossJoin(F.broadcast(before)).where(F.col("rank") + F.col("before") >= F.col("need"))
    return held.where("r < edge").select("seed", "r").union(kept_edge.select("seed", "r"))


def min_support(counts: DataFrame, least: int = -1) -> DataFrame:
    """Seeds seen `least` times; -1: twice if the mean of counts of 2 and more is over 3, else once."""
    if least >= 0:
        return counts.where(F.col("r") >= least)
    bound = counts.agg(F.when(F.avg(F.when(F.col("r") >= 2, F.col("r"))) > 3.0, 2).otherwise(1).alias("bound"))
    return counts.crossJoin(F.broadcast(bound)).where("r >= bound").select("seed", "r")


def seed_stats(kept: DataFrame) -> DataFrame:
    lg = F.log1p(F.col("r").cast("double"))
    return kept.agg(F.sum(lg * lg).alias("squares"), F.sum(lg).alias("logs"), F.count("*").alias("kept"))


def node_scores(nodes: DataFrame, kept: DataFrame, root: DataFrame) -> DataFrame:
    """Five scores of every node. kept(seed, r): the sample's seeds; root(seed, n): the seeds of the root's genome.

    The genome's magnitude needs all its seeds, so the sample's side is joined from the left; it is small against the nodes.
    """
    stats = seed_stats(kept)
    inverse = kept.join(root, "seed").agg(F.coalesce(F.sum(1 / F.col("n")), F.lit(0.0)).alias("root_inverse"))
    x = nodes.join(kept, "seed", "left")
    hit = F.col("r").isNotNull()
    lr, lg = F.log1p(F.col("r").cast("double")), F.log1p(F.col("n").cast("double"))
    sums = x.groupBy("node").agg(
        F.sum(F.when(hit, lr / F.col("n"))).alias("raw"), F.sum(F.when(hit, lr * lg)).alias("dot"), F.sum(lg * lg).alias("genome"),
        F.sum(hit.cast("long")).alias("shared"), F.sum(F.when(hit, 1 / F.col("n"))).alias("inverse"), F.sum(F.when(hit, lr)).alias("logs_hit"),
    )
    y = sums.crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(inverse))  # one row each
    ratio = lambda a, b: F.coalesce(F.when(b > 0, a / b), F.lit(0.0))
    return y.select(
        "node",
        ratio(F.col("raw"), F.sqrt("squares")).alias("log_raw"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio(F.col("dot"), F.sqrt("squares") * F.sqrt("genome")))).alias("log_cosine"),
        ratio(F.col("shared").cast("double"), F.col("kept").cast("double")).alias("containment"),
        ratio(F.col("inverse"), F.col("root_inverse")).alias("weighted_containment"),
        ratio(F.col("logs_hit"), F.col("logs")).alias("log_containment"),
    )


METRICS = ("log_raw", "log_cosine", "containment", "weighted_containment", "log_containment")


def placements(scores: DataFrame) -> DataFrame:
    """(metric, score, best, ties): the best score, its first node, all nodes within 1e-4 of it (1e-9 at least)."""
    long = scores.select("node", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("score")) for m in METRICS))).alias("x")).select("node", "x.*")
    best = long.groupBy("metric").agg(F.max("score").alias("best_score"))
    near = long.join(F.broadcast(best), "metric").where((F.col("score") > 0) & (F.col("score") >= F.col("best_score") - F.greatest(F.lit(1e-9), 1e-4 * F.col("best_score"))))
    return near.groupBy("metric").agg(F.max("best_score").alias("score"), F.min("node").alias("best"), F.array_sort(F.collect_list("node")).alias("ties"))


def forced_placement(scores: DataFrame, node) -> DataFrame:
    """(metric, score, best, ties) of a node that is given, whatever the others' scores."""
    x = scores.where(F.col("node") == F.lit(node))
    return x.select("node", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("score")) for m in METRICS))).alias("x")).select("x.metric", "x.score", F.col("node").alias("best"), F.array("node").alias("ties"))


def top_by_metric(scores: DataFrame, share: float = 0.01, most: int = 150) -> DataFrame:
    """(metric, node): the best max(1, min(int(n share), most)) nodes with a positive score, ties by larger node."""
    total = scores.agg(F.greatest(F.lit(1), F.least(F.floor(F.count("*") * share), F.lit(most))).alias("top"))
    out = None
    for m in METRICS:
        best = scores.where(F.col(m) > 0).select("node", m).orderBy(F.col(m).desc(), F.col("node").desc()).limit(most)  # each task sends `most` rows
        ranked = best.withColumn("rank", F.row_number().over(W.orderBy(F.col(m).desc(), F.col("node").desc())))
        got = ranked.crossJoin(F.broadcast(total)).where(F.col("rank") <= F.col("top")).select(F.lit(m).alias("metric"), "node")
        out = got if out is None else out.union(got)
    return out


def top_candidates(scores: DataFrame, share: float = 0.01, most: int = 150) -> DataFrame:
    """Union over the metrics of `top_by_metric`."""
    return top_by_metric(scores, share, most).select("node").distinct()


def refinement_candidates(scores: DataFrame, tree: DataFrame, share: float = 0.01, most: int = 150, radius: int = 2, most_near: int = 150) -> DataFrame:
    """(metric, node, seed_score): the best nodes of each metric, its first best one, and their neighbours in tree(node_id, parent_id).

    Neighbours without a score, such as inner nodes, take no part.
    """
    chosen = top_by_metric(scores, share, most).union(placements(scores).select("metric", F.col("best").alias("node"))).distinct()
    start = chosen.select(F.col("node").alias("source"), F.col("node").cast("string").alias("node_id")).distinct()
    near = T.capped(T.within_radius(tree, start, radius).where("distance > 0"), most_near).select(F.col("source").alias("node"), F.col("node_id").alias("other"))
    wide = chosen.join(near, "node").select("metric", F.col("other").alias("name"))
    wide = wide.union(chosen.select("metric", F.col("node").cast("string").alias("name"))).distinct()
    long = scores.select("node", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("seed_score")) for m in METRICS))).alias("x")).select("node", "x.*")
    return wide.join(long.withColumn("name", F.col("node").cast("string")), ["metric", "name"]).select("metric", "node", "seed_score")


def refined(candidates: DataFrame) -> DataFrame:
    """The winner of each metric's (metric, node, align_score, seed_score): best alignment, then seed score, then lowest node."""
    w = W.partitionBy("metric").orderBy(F.col("align_score").desc(), F.col("seed_score").desc(), F.col("node"))
    return candidates.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")
