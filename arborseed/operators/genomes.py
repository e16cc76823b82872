"""Genomes of tree nodes from mutations along their paths, coordinates with gaps, and simulated changes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sequence as S

#: What the sixteen 4-bit codes of a base or an ambiguity stand for.
NIBBLES = "-ACMGRSVTWYHKDBN"


def decoded(value: Column | str, count: int = 6) -> Column:
    """The bases of `count` 4-bit codes, the highest first."""
    one = lambda i: F.substring(F.lit(NIBBLES), F.shiftright(S.col(value), 4 * (count - 1 - i)).bitwiseAND(15).cast("int") + 1, F.lit(1))
    return F.concat(*(one(i) for i in range(count)))


def imputed(mutations: DataFrame) -> DataFrame:
    """mutations(base_from, base_to, ...) without those that turn a base into an ambiguity."""
    return mutations.where(~(F.col("base_from").rlike("^[ACGT]$") & ~F.col("base_to").rlike("^[ACGT-]$")))


def node_genomes(up: DataFrame, blocks: DataFrame, block_changes: DataFrame, base_changes: DataFrame) -> DataFrame:
    """(node, genome) of every node: along its path the deepest change of a block, and of a place in it, holds.

    up(node, ancestor, ancestor_depth); blocks(block, seq): the consensus, which the root has as it is unless changed;
    block_changes(node, block, present, inverted); base_changes(node, block, pos, slot, base): slot 0 is the place itself, slots
    from 1 on are inserted before it, `-` is no base. Blocks are joined in order; an inverted one is turned round.
    """
    state = up.join(block_changes.withColumnRenamed("node", "ancestor"), "ancestor").groupBy("node", "block").agg(F.max_by(F.struct("present", "inverted"), "ancestor_depth").alias("b"))
    last = up.join(base_changes.withColumnRenamed("node", "ancestor"), "ancestor").groupBy("node", "block", "pos", "slot").agg(F.max_by("base", "ancestor_depth").alias("base"))
    changes = last.groupBy("node", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "slot", "base"))).alias("changes"))  # as many as a block has places
    every = up.select("node").distinct().join(blocks.select("block", "seq"), F.lit(True))  # the result holds each block of each node
    x = every.join(state, ["node", "block"], "left").join(changes, ["node", "block"], "left")
    x = x.where(F.coalesce("b.present", F.lit(True)))

    @F.pandas_udf("string")
    def spliced(seq: pd.Series, changes: pd.Series) -> pd.Series:
        return pd.Series([splice(s, c) for s, c in zip(seq, changes, strict=True)])

    genome = spliced("seq", "changes")
    x = x.withColumn("s", F.when(F.coalesce("b.inverted", F.lit(False)), S.reverse_complement(genome)).otherwise(genome))
    listed = F.array_sort(F.collect_list(F.struct("block", "s")))
    found = x.groupBy("node").agg(F.array_join(F.transform(listed, lambda b: b["s"]), "").alias("genome"))
    return up.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("genome", F.lit("")).alias("genome"))


def splice(seq: str, changes) -> str:
    """seq with (pos, slot, base) changes, in order of place and slot."""
    if changes is None or not len(changes):
        return seq
    out, at = [], 0
    placed: dict[int, list[tuple[int, str]]] = {}
    for c in changes:
        placed.setdefault(c["pos"], []).append((c["slot"], c["base"]))
    for pos, found in sorted(placed.items()):
        out.append(seq[at:pos])
        out += [base for slot, base in sorted(found) if slot and base != "-"]
        here = [base for slot, base in found if not slot]
        out.append((here[0] if here else seq[pos : pos + 1]).replace("-", ""))
        at = pos + 1
    return "".join(out) + seq[at:]


def mirrored(x: Column | str, start: Column | str, end: Column | str, inverted: Column | str) -> Column:
    """A place in a block as it lies in the genome: counted from the other end if the block is inverted."""
    return F.when(S.col(inverted), S.col(start) + S.col(end) - S.col(x)).otherwise(S.col(x))


def inverted_runs(runs: DataFrame) -> DataFrame:
    """runs(beg, stop) of blocks(start, end) that turn round."""
    return runs.withColumns({"beg": F.col("start") + F.col("end") - F.col("stop"), "stop": F.col("start") + F.col("end") - F.col("beg")})


def regapped(points: DataFrame, gaps: DataFrame, key: str) -> DataFrame:
    """points(key, x), counted without gaps, with their global place: x and all gap places before it. gaps(key, beg, stop) are disjoint."""
    w = W.partitionBy(key).orderBy("beg")
    size = F.col("stop") - F.col("beg") + 1
    before = F.coalesce(F.sum(size).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    marks = gaps.withColumn("x", F.col("beg") - before).select(key, "x", (before + size).alias("shift"), F.lit(0).alias("kind"))
    rows = marks.unionByName(points.select(key, "x", F.lit(None).cast("long").alias("shift"), F.lit(1).alias("kind")))
    held = F.last("shift", ignorenulls=True).over(W.partitionBy(key).orderBy("x", "kind", "shift").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("held", held).where("kind = 1").select(key, "x", (F.col("x") + F.coalesce("held", F.lit(0))).alias("regapped"))


def subtracted(runs: DataFrame, cuts: DataFrame, key: str) -> DataFrame:
    """(key, beg, stop): the places of runs(key, beg, stop) that no cut covers, as inclusive intervals that don't touch."""
    edge = lambda x, c, v: x.select(key, F.col(c).alias("x") if c == "beg" else (F.col(c) + 1).alias("x"), *(F.lit(v if n == which else 0).alias(n) for n in ("a", "b")))
    parts = []
    for which, x in (("a", runs), ("b", cuts)):
        parts += [edge(x, "beg", 1), edge(x, "stop", -1)]
    steps = parts[0].union(parts[1]).union(parts[2]).union(parts[3]).groupBy(key, "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w = W.partitionBy(key).orderBy("x")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    held = steps.withColumn("on", (F.sum("a").over(upto) > 0) & (F.sum("b").over(upto) == 0))
    turns = held.withColumn("was", F.lag("on", 1, False).over(w)).where(F.col("on") != F.col("was"))
    return turns.withColumn("end", F.lead("x").over(w)).where("on").select(key, F.col("x").alias("beg"), (F.col("end") - 1).alias("stop"))


def simulated_changes(genomes: DataFrame, key: str, seq: str, count: int, seed: int = 1, tries: int = 4) -> DataFrame:
    """(key, pos, ref, alt): `count` substitutions at distinct 0-based places of each genome, fewer where it has fewer places.

    Places are drawn by a hash of the seed, the key and the try; genomes over 2000 bases keep their first and last 1000.
    """
    flank = F.when(F.length(seq) > 2000, 1000).otherwise(0)
    room = F.length(seq) - 2 * flank
    draw = _drawn(key, seed, "try")
    rows = genomes.where(F.length(seq) > 0).withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(tries * count - 1))))
    placed = rows.withColumn("draw", draw).select(key, (flank + F.col("draw") % room).alias("pos"), "try", "draw", seq)
    # the base is taken here: the aggregation sorts its rows, and a genome must not be in each of them
    based = placed.select(key, "pos", F.struct("try", "draw", F.expr(f"substring({seq}, cast(pos + 1 as int), 1)").alias("ref")).alias("x"))
    first = based.groupBy(key, "pos").agg(F.min("x").alias("f"))
    kept = first.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy("f.try"))).where(F.col("rank") <= count)
    at = F.instr(F.lit("ACGT"), F.col("f.ref")) - 1
    alt = F.substring(F.lit("ACGT"), ((at + 1 + F.col("f.draw") % 3) % 4 + 1).cast("int"), F.lit(1))
    return kept.where(F.col("f.ref").rlike("^[ACGT]$")).select(key, "pos", F.col("f.ref").alias("ref"), alt.alias("alt"))


def sampled_leaves(leaves: DataFrame, key: str, count: int, seed: int = 1) -> DataFrame:
    """`count` leaves in the order of a hash of the seed and their names: a limit that is the feature."""
    return leaves.select(key, F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))).alias("h")).orderBy("h", key).limit(count).select(key)


def scaled_rates(rates: list[list[float]], mean: float) -> list[list[float]]:
    """A 4 x 4 matrix of substitution probabilities scaled so that the mean chance of a change is `mean`; each row sums to 1."""
    m = np.array(rates, float)
    off = m - np.diag(np.diag(m))
    total = off.sum() / 4
    off = off * (mean / total) if total > 0 else off
    return (off + np.diag(1 - off.sum(1))).tolist()


def consensus_summary(consensus: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, length, unknown): bases of each consensus and how many of them are N."""
    return consensus.select(key, F.length(seq).cast("long").alias("length"), F.regexp_count(seq, F.lit("[Nn]")).cast("long").alias("unknown"))


def _drawn(key: str, seed: int, *more) -> Column:
    """A non-negative number below 2**28 from a hash of the seed, the key and further columns."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"), *(S.col(m).cast("string") for m in more))), 1, 7), 16, 10).cast("long")


def simulated_reads(genomes: DataFrame, key: str, seq: str, length: int, count: int, seed: int = 1) -> DataFrame:
    """(key, i, at, rev, seq): `count` reads of each genome at places and strands drawn by a hash; a genome shorter than a read gives one read of itself."""
    rows = genomes.where(F.length(seq) > 0).withColumn("i", F.explode(F.sequence(F.lit(0), F.when(F.length(seq) < length, 0).otherwise(count - 1))))
    draw = rows.withColumn("draw", _drawn(key, seed, F.lit("read"), "i"))
    at = F.col("draw") % F.greatest(F.lit(1), F.length(seq) - length + 1)
    placed = draw.select(key, "i", at.alias("at"), (F.floor(F.col("draw") / 4096) % 2 == 1).alias("rev"), F.col(seq).alias("_s"))
    read = F.substring(F.col("_s"), (F.col("at") + 1).cast("int"), F.lit(length))
    return placed.select(key, "i", "at", "rev", F.when(F.col("rev"), S.reverse_complement(read)).otherwise(read).alias("seq"))


def dumped(genomes: DataFrame, changes: DataFrame, key: str, seq: str) -> DataFrame:
    """(value): FASTA lines of genomes with simulated changes applied; the header lists them as place:base>base, from 1."""
    from .variants import consensus

    made = consensus(genomes, changes.select(key, (F.col("pos") + 1).alias("pos"), "alt"), key, seq)
    listed = changes.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(F.struct("pos", "ref", "alt"))).alias("_c"))
    said = F.coalesce(F.array_join(F.transform("_c", lambda c: F.concat((c["pos"] + 1).cast("string"), F.lit(":"), c["ref"], F.lit(">"), c["alt"])), ","), F.lit(""))
    x = made.join(listed, F.col(key) == F.col("_key"), "left")
    return x.select(F.concat(F.lit(">"), F.col(key).cast("string"), F.when(said != "", F.concat(F.lit(" changes="), said)).otherwise(""), F.lit("\n"), S.wrapped("consensus")).alias("value"))


def read_place(cigar: Column | str, start: Column | str, target: Column | str) -> Column:
    """How many letters of a read lie before a place of the reference, for an alignment that begins at `start`; soft clips count, deletions don't."""
    ops = F.arrays_zip(
        F.transform(F.regexp_extract_all(S.col(cigar), F.lit("([0-9]+)([MIDNS=X])"), F.lit(1)), lambda x: x.cast("long")).alias("n"),
        F.regexp_extract_all(S.col(cigar), F.lit("([0-9]+)([MIDNS=X])"), F.lit(2)).alias("op"),
    )
    state = F.struct(S.col(start).cast("long").alias("ref"), F.lit(0).cast("long").alias("read"), F.lit(False).alias("done"))

    def step(a, x):
        on_ref, on_read = x["op"].isin("M", "=", "X", "D", "N"), x["op"].isin("M", "=", "X", "I", "S")
        left = F.greatest(F.lit(0).cast("long"), S.col(target).cast("long") - a["ref"])
        inside = ~a["done"] & on_ref & (left < x["n"])  # the target lies in this part
        read = F.when(a["done"], a["read"]).when(inside, a["read"] + F.when(on_read, left).otherwise(0)).when(on_read, a["read"] + x["n"]).otherwise(a["read"])
        return F.struct(F.when(on_ref, a["ref"] + x["n"]).otherwise(a["ref"]).alias("ref"), read.alias("read"), (a["done"] | inside).alias("done"))

    return F.aggregate(ops, state, step, lambda a: a["read"])


def primer_trimmed(alignments: DataFrame) -> DataFrame:
    """alignments(start, cigar, seq, qual, keep_from, keep_to) with seq and qual cut to the reference's places from keep_from up to before keep_to."""
    a, b = read_place("cigar", "start", "keep_from"), read_place("cigar", "start", "keep_to")
    cut = lambda c: F.substring(F.col(c), (F.col("_a") + 1).cast("int"), F.greatest(F.lit(0), F.col("_b") - F.col("_a")).cast("int"))
    return alignments.withColumns({"_a": a, "_b": b}).withColumns({"seq": cut("seq"), "qual": cut("qual")}).drop("_a", "_b")
