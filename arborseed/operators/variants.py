"""Substitution spectra, pileups, haploid genotypes, VCF post-filters, consensus, and a banded local aligner."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions.sketch import _CODE


def positions(rows: DataFrame, key: str, s: Column) -> DataFrame:
    """(key, pos, base): 1-based positions of each sequence."""
    return rows.select(key, F.posexplode(F.split(s, "")).alias("at", "base")).where("base <> ''").select(key, (F.col("at") + 1).alias("pos"), "base")


def substitutions(pairs: DataFrame, parent: str = "parent", child: str = "child") -> DataFrame:
    """(base_from, base_to, n) over the places of aligned sequences where both bases are canonical and differ. A batch is compared at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(25, np.int64)
        for batch in batches:
            for one, two in zip(batch.column(0), batch.column(1), strict=True):
                if one.is_valid and two.is_valid:
                    x, y = (_CODE[np.frombuffer(s.as_buffer(), np.uint8)] for s in (one, two))
                    n = min(len(x), len(y))
                    total += np.bincount(5 * x[:n] + y[:n], minlength=25)
        at = [i for i in range(25) if total[i] and i // 5 < 4 and i % 5 < 4 and i // 5 != i % 5]
        yield pa.RecordBatch.from_arrays([pa.array(["ACGT"[i // 5] for i in at], pa.string()), pa.array(["ACGT"[i % 5] for i in at], pa.string()), pa.array(total[at])], ["base_from", "base_to", "n"])

    return pairs.select(parent, child).mapInArrow(run, "base_from string, base_to string, n long").groupBy("base_from", "base_to").agg(F.sum("n").alias("n"))


def spectrum(counts: DataFrame, branches: Column, genome_length: Column) -> DataFrame:
    """(base_from, base_to, rate, phred), all 16: off the diagonal n / (branches * length / 4), on it what is left to 1."""
    bases = counts.sparkSession.createDataFrame([(a, b) for a in "ACGT" for b in "ACGT"], "base_from string, base_to string")
    x = bases.join(F.broadcast(counts), ["base_from", "base_to"], "left")  # 12 rows at most
    off = F.when(F.col("base_from") == F.col("base_to"), 0.0).otherwise(F.coalesce("n", F.lit(0)) / (branches * (genome_length / 4.0)))
    x = x.withColumn("off", off)
    left = 1 - F.sum("off").over(W.partitionBy("base_from"))
    x = x.withColumn("rate", F.when(F.col("base_from") == F.col("base_to"), left).otherwise(F.col("off")))
    return x.select("base_from", "base_to", "rate", S.phred_of("rate").alias("phred"))


def substitution_prior(rates: DataFrame) -> DataFrame:
    """(base_from, base_to, phred) of rates (base_from, base_to, rate); no rows where no base ever changes, so there is no prior to apply."""
    any_ = rates.where("base_from <> base_to").agg(F.coalesce(F.max("rate"), F.lit(0.0)).alias("most"))
    return rates.crossJoin(F.broadcast(any_)).where("most > 0").select("base_from", "base_to", S.phred_of("rate").alias("phred"))  # one row


def upper_median(rows: DataFrame, value: str) -> DataFrame:
    """The element n // 2 of the sorted values, of a few rows."""
    return rows.agg(F.element_at(F.array_sort(F.collect_list(value)), F.floor(F.count(value) / 2).cast("int") + 1).alias("median"))


def with_prior(vcf: DataFrame, priors: DataFrame, min_qual: float = 30.0) -> DataFrame:
    """Haploid records re-ranked under a substitution prior.

    vcf(site, ref, alts array, pl array): the alternative with the least PL + prior; dropped if REF is best or the winner's
    margin, QUAL, is below min_qual. priors(base_from, base_to, phred).
    """
    alleles = vcf.select("site", "ref", F.posexplode(F.concat(F.array("ref"), "alts")).alias("allele", "base"), "pl").withColumn("pl", F.get("pl", F.col("allele")))
    x = alleles.join(F.broadcast(priors), (F.col("ref") == F.col("base_from")) & (F.col("base") == F.col("base_to")))  # 16 rows
    x = x.withColumn("score", F.col("pl") + F.col("phred"))
    best = x.groupBy("site", "ref").agg(F.min(F.struct("score", "allele", "base")).alias("b"), F.max(F.when(F.col("allele") == 0, F.col("score"))).alias("ref_score"))
    kept = best.where("b.allele > 0").select("site", "ref", F.col("b.base").alias("alt"), (F.col("ref_score") - F.col("b.score")).alias("qual"))
    return kept.where(F.col("qual") >= min_qual)


def single_ploid(pl: Column, alts: Column) -> Column:
    """PL values of the haploid genotypes: every second one where more are given."""
    return F.when(F.size(pl) == F.size(alts) + 1, pl).otherwise(F.filter(pl, lambda x, i: i % 2 == 0))


def passes_gate(called: Column, ad: Column, min_depth: int = 1) -> Column:
    """Whether the called allele is not REF, the depth suffices and over half of it is the call's; without AD it passes."""
    depth = F.aggregate(ad, F.lit(0).cast("long"), lambda a, x: a + x)
    return (called > 0) & (ad.isNull() | (depth >= min_depth) & (F.get(ad, called) * 2 > depth))


def pileup(alignments: DataFrame, least_quality: int = 0) -> DataFrame:
    """(pos, base, n, quality) over ungapped alignments (pos 1-based, seq, qual)."""
    x = alignments.select("pos", F.posexplode(F.arrays_zip(F.split("seq", ""), F.transform(F.split("qual", ""), lambda c: F.ascii(c) - 33))).alias("at", "x"))
    x = x.select((F.col("pos") + F.col("at")).alias("pos"), F.col("x.0").alias("base"), F.col("x.1").alias("q")).where(F.col("base") != "")
    return x.where(F.col("q") >= least_quality).groupBy("pos", "base").agg(F.count("*").alias("n"), F.sum("q").alias("quality"))


def haploid_likelihoods(alignments: DataFrame, least_quality: int = 0) -> DataFrame:
    """(pos, depth, ad, pl): of each covered place the depths of A, C, G, T and the Phred-scaled likelihoods of a genome that has each.

    An observation of quality q is wrong by 10^(-q/10), then any of the other three bases alike; the likeliest base has 0. Qualities
    of 0 count as 1, for their observations say nothing either way. alignments as for `pileup`.
    """
    x = alignments.select("pos", F.posexplode(F.arrays_zip(F.split("seq", ""), F.transform(F.split("qual", ""), lambda c: F.ascii(c) - 33))).alias("at", "x"))
    x = x.select((F.col("pos") + F.col("at")).alias("pos"), F.col("x.0").alias("base"), F.col("x.1").alias("q")).where(F.col("base").rlike("^[ACGT]$") & (F.col("q") >= least_quality))
    wrong = F.pow(F.lit(10.0), -F.greatest(F.lit(1), F.col("q")) / 10)
    is_, isnt = -10 * F.log10(1 - wrong), -10 * F.log10(wrong / 3)
    sums = x.groupBy("pos").agg(F.count("*").alias("depth"), *(F.count(F.when(F.col("base") == b, 1)).alias(f"n{b}") for b in "ACGT"), *(F.sum(F.when(F.col("base") == b, is_).otherwise(isnt)).alias(f"l{b}") for b in "ACGT"))
    best = F.least(*(F.col(f"l{b}") for b in "ACGT"))
    return sums.select("pos", "depth", F.array(*(F.col(f"n{b}") for b in "ACGT")).alias("ad"), F.array(*(F.col(f"l{b}") - best for b in "ACGT")).alias("pl"))


def haploid_calls(piled: DataFrame, reference: DataFrame, min_depth: int = 1) -> DataFrame:
    """(pos, ref, alt, depth, support): positions where over half of the depth is one base other than the reference's; by node if it has nodes."""
    best = piled.groupBy("pos").agg(F.sum("n").alias("depth"), F.max(F.struct("n", "quality", "base")).alias("b"))
    x = best.join(reference, "pos").select(*(["node"] if "node" in reference.columns else []), "pos", F.col("base").alias("ref"), F.col("b.base").alias("alt"), "depth", F.col("b.n").alias("support"))
    return x.where((F.col("ref") != F.col("alt")) & (F.col("depth") >= min_depth) & (F.col("support") * 2 > F.col("depth")))


def consensus(genomes: DataFrame, calls: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, consensus): each genome (key, seq) with its calls (key, pos from 1, alt, and ref for insertions and deletions).

    Only the calls are gathered by genome. A call that overlaps the one before it, or lies outside, is left out.
    """
    size = F.length("ref") if "ref" in calls.columns else F.lit(1)
    own = calls.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(F.struct((F.col("pos") - 1).alias("pos"), F.col("alt").alias("base"), size.alias("size")))).alias("_calls"))

    @F.arrow_udf("string")
    def called(seqs: pa.Array, found: pa.Array) -> pa.Array:
        size, flat = pc.fill_null(pc.list_value_length(found), 0).to_numpy(), found.flatten()
        end, columns = np.cumsum(size), [flat.field(i).to_pylist() for i in range(3)]
        parts = ((c[e - n : e] for c in columns) for n, e in zip(size.tolist(), end.tolist(), strict=True))
        return pa.array([None if s is None else _called(s, *p) for s, p in zip(seqs.to_pylist(), parts, strict=True)], pa.string())

    return genomes.join(own, F.col(key) == F.col("_key"), "left").select(key, called(seq, "_calls").alias("consensus"))


def _called(seq: str, places: list[int], bases: list[str], sizes: list[int]) -> str:
    out, at = [], 0
    for pos, base, size in zip(places, bases, sizes, strict=True):
        if at <= pos and pos + size <= len(seq):
            out += [seq[at:pos], base]
            at = pos + size
    return "".join(out) + seq[at:]


#: Parameters of `align` by the kind of reads: band, match, mismatch, gap. Short accurate, long, long accurate, and damaged old reads.
PRESETS = {"short": (16, 1, -2, -3), "long": (64, 2, -4, -4), "accurate": (64, 1, -4, -6), "old": (8, 1, -1, -4)}


def preset_of(mean_length: float) -> str:
    """The preset for reads of this mean length."""
    return "short" if mean_length < 500 else "long" if mean_length < 5000 else "accurate"


def kmer_places(reference: str, k: int = 11) -> dict[str, list[int]]:
    where: dict[str, list[int]] = {}
    for i in range(len(reference) - k + 1):
        where.setdefault(reference[i : i + k], []).append(i)
    return where


def align(read: str, reference: str, k: int = 11, band: int = 16, match: int = 1, mismatch: int = -2, gap: int = -3, where: dict[str, list[int]] | None = None) -> tuple[int, int, int]:
    """(start, score, edits) of a read's best banded placement near its most frequent k-mer diagonal; start -1 without one.

    where: the reference's `kmer_places`, for callers that align several reads with it. A row is computed at once: a gap in the
    read begins at the last place to its left from which the score, less the gap's cost, is highest.
    """
    where = kmer_places(reference, k) if where is None else where
    votes: dict[int, int] = {}
    for j in range(len(read) - k + 1):
        for i in where.get(read[j : j + k], ()):
            votes[i - j] = votes.get(i - j, 0) + 1
    if not votes:
        return -1, 0, len(read)
    diagonal = max(sorted(votes), key=votes.get)
    low = max(0, diagonal - band)
    target = reference[low : max(0, diagonal) + len(read) + band]
    m = len(target)
    score, edits, start = np.zeros(m + 1, int), np.zeros(m + 1, int), np.arange(m + 1)
    letters, at = np.frombuffer(target.encode(), np.uint8), np.arange(m + 1)
    for i, letter in enumerate(read.encode(), 1):
        same = letters == letter
        over, down = score[:-1] + np.where(same, match, mismatch), score[1:] + gap
        turn = over >= down
        new = np.r_[i * gap, np.where(turn, over, down)]
        cost = np.r_[i, np.where(turn, edits[:-1] + ~same, edits[1:] + 1)]
        origin = np.r_[0, np.where(turn, start[:-1], start[1:])]
        level = new - gap * at
        left = np.maximum.accumulate(np.where(level >= np.maximum.accumulate(level), at, 0))
        score, edits, start = new[left] + gap * (at - left), cost[left] + at - left, origin[left]
    j = int(score.argmax())
    return low + int(start[j]), int(score[j]), int(edits[j])


def best_strand(read: str, reference: str, where: dict[str, list[int]] | None = None) -> tuple[int, int, int, bool]:
    """(start, score, edits, rev) of the better strand."""
    other = read[::-1].translate(str.maketrans("ACGT", "TGCA"))
    one, two = align(read, reference, where=where), align(other, reference, where=where)
    return (*two, True) if two[1] > one[1] else (*one, False)


def align_all(reads: list[str], reference: str, where: dict[str, list[int]], k: int = 11, band: int = 16, match: int = 1, mismatch: int = -2, gap: int = -3) -> list[tuple[int, int, int]]:
    """`align` of each read with one reference, all reads a row at a time."""
    diagonals = []
    for read in reads:
        votes: dict[int, int] = {}
        for j in range(len(read) - k + 1):
            for i in where.get(read[j : j + k], ()):
                votes[i - j] = votes.get(i - j, 0) + 1
        diagonals.append(max(sorted(votes), key=votes.get) if votes else None)
    out = [(-1, 0, len(r)) for r in reads]
    some = [j for j, d in enumerate(diagonals) if d is not None]
    if not some:
        return out
    low = [max(0, diagonals[j] - band) for j in some]
    targets = [reference[b : max(0, diagonals[j]) + len(reads[j]) + band] for j, b in zip(some, low, strict=True)]
    size, length = np.array([len(x) for x in targets]), np.array([len(reads[j]) for j in some])
    padded = lambda texts, n: np.frombuffer("".join(x.ljust(n, "\0") for x in texts).encode("latin-1", "replace"), np.uint8).reshape(len(texts), n)
    letters, own = padded(targets, int(size.max())), padded([reads[j] for j in some], int(length.max()))
    at = np.arange(letters.shape[1] + 1)
    # a cell is a number: its level, its place, its edits and its start, so that a row's running maximum carries all of them
    wide, deep = len(at), own.shape[1]
    s_bits, e_bits = wide.bit_length(), (deep + 2 * wide + 1).bit_length()
    low_bits = s_bits + e_bits
    bits = low_bits + s_bits
    if bits + ((deep + wide) * max(abs(match), abs(mismatch), abs(gap)) * 2).bit_length() > 62:
        return [align(r, reference, k, band, match, mismatch, gap, where) for r in reads]
    one, mask, behind = 1 << s_bits, (1 << low_bits) - 1, (wide - at) << s_bits
    ahead, slope = (at << low_bits) + behind, gap * at
    score, held = np.zeros((len(some), wide), np.int64), np.tile(at, (len(some), 1))
    cell = np.empty_like(score)
    for i in range(1, deep + 1):
        same = letters == own[:, i - 1 : i]
        over, down = score[:, :-1] + np.where(same, match, mismatch), score[:, 1:] + gap
        turn = over >= down
        cell[:, 0] = (i * gap << bits) + i * one
        np.maximum(over, down, out=over)
        over -= slope[1:]
        over <<= bits
        over += np.where(turn, held[:, :-1] + np.where(same, 0, one), held[:, 1:] + one)
        cell[:, 1:] = over
        cell += ahead
        best = np.maximum.accumulate(cell, axis=1)
        score = (best >> bits) + slope
        held = (best & mask) - behind
        for j in np.flatnonzero(length == i):
            top = int(score[j, : size[j] + 1].argmax())
            out[some[j]] = low[j] + int(held[j, top]) % one, int(score[j, top]), int(held[j, top]) >> s_bits
    return out


def alignment_scores(references: DataFrame, reads: DataFrame, group: int = 32) -> DataFrame:
    """(node, align_score): less the edits of all reads (read_id, seq) on each of references (node, reference).

    A read that cannot be placed counts its length. Reads go in groups of about `group`, aligned together in both strands, so a
    reference is indexed once for each group, and any number of tasks share a node. Reads are joined by group, which
    each reference lists: the pairs are what is asked for, candidates times reads.
    """
    groups = max(1, -(-reads.count() // group))
    dealt = reads.groupBy(F.pmod(F.xxhash64("read_id"), F.lit(groups)).cast("int").alias("g")).agg(F.collect_list("seq").alias("seqs"))
    turn = str.maketrans("ACGT", "TGCA")

    def run(batches):
        for b in batches:
            out = []
            for reference, seqs in zip(b["reference"], b["seqs"], strict=True):
                seqs = list(seqs)
                found = align_all(seqs + [s[::-1].translate(turn) for s in seqs], reference, kmer_places(reference))
                out.append(-sum(two[2] if two[1] > one[1] else one[2] for one, two in zip(found[: len(seqs)], found[len(seqs) :], strict=True)))
            yield pd.DataFrame({"node": b["node"], "score": np.array(out, np.int64)})

    listed = references.select("node", "reference", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("r_g"))
    pairs = listed.join(dealt, F.col("r_g") == F.col("g")).select("node", "reference", "seqs")
    pairs = pairs.repartition(4 * references.sparkSession.sparkContext.defaultParallelism)
    found = pairs.mapInPandas(run, f"node {references.schema['node'].dataType.simpleString()}, score long")
    return found.groupBy("node").agg(F.sum("score").alias("align_score"))


def aligned(pairs: DataFrame) -> DataFrame:
    """pairs(read_id, node, seq, reference) with start, score, edits of the better strand and rev."""

    def run(batches):
        for b in batches:
            rows = [best_strand(read, ref) for read, ref in zip(b["seq"], b["reference"], strict=True)]
            yield pd.concat([b[["read_id", "node"]].reset_index(drop=True), pd.DataFrame(rows, columns=["start", "score", "edits", "rev"])], axis=1)

    kinds = {c: pairs.schema[c].dataType.simpleString() for c in ("read_id", "node")}
    return pairs.mapInPandas(run, f"read_id {kinds['read_id']}, node {kinds['node']}, start long, score long, edits long, rev boolean")


def node_alignments(assigned: DataFrame, reads: DataFrame, references: DataFrame, least: int = 1, most: int = 64) -> DataFrame:
    """(node, read_id, start, score, edits, rev) of the reads assigned to each node that has `least` or more, on its genome.

    assigned(read_id, node), reads(read_id, seq), references(node, reference). A node's reads are dealt to groups of about `most`
    by a hash, so a node with very many is shared by many tasks; those of a group are aligned together.
    """
    counts = assigned.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    groups = F.ceil(F.col("n") / most).cast("int")
    x = assigned.join(counts, "node").join(reads.select("read_id", "seq"), "read_id").withColumn("g", F.pmod(F.xxhash64("read_id"), groups))
    dealt = x.groupBy("node", "g").agg(F.collect_list(F.struct("read_id", "seq")).alias("reads")).join(references.select("node", "reference"), "node").select("node", "reference", "reads")
    turn = str.maketrans("ACGT", "TGCA")

    def run(batches):
        for b in batches:
            out = []
            for node, reference, held in zip(b["node"], b["reference"], b["reads"], strict=True):
                seqs = [r["seq"] for r in held]
                found = align_all(seqs + [s[::-1].translate(turn) for s in seqs], reference, kmer_places(reference))
                for r, one, two in zip(held, found[: len(seqs)], found[len(seqs) :], strict=True):
                    rev = two[1] > one[1]
                    out.append((node, r["read_id"], *(two if rev else one), rev))
            yield pd.DataFrame(out, columns=["node", "read_id", "start", "score", "edits", "rev"])

    kinds = {c: assigned.schema[c].dataType.simpleString() for c in ("read_id", "node")}
    return dealt.mapInPandas(run, f"node {kinds['node']}, read_id {kinds['read_id']}, start long, score long, edits long, rev boolean")
