"""Samples from reads to consensus: placed on a collection of genomes, aligned, genotyped and written out, all samples in each job.

A run stops behind the stage that its parameters name; what later stages would give is None.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import sequence as S
from .functions.sketch import seed_totals
from .operators import alignment as A
from .operators import pileups as U
from .operators import placement as P
from .operators import records as T
from .operators import variants as V
from .parameters import STAGES, Parameters
from .sources import bam, readers
from .storage import stash

#: The metric whose best node a sample is aligned with.
CHOSEN = "log_containment"
VCF_HEADER = (
    "##fileformat=VCFv4.2", '##FILTER=<ID=PASS,Description="All filters passed">', '##INFO=<ID=INDEL,Number=0,Type=Flag,Description="An insertion or deletion">', '##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', '##FORMAT=<ID=PL,Number=G,Type=Integer,Description="Phred-scaled likelihoods">', '##FORMAT=<ID=AD,Number=R,Type=Integer,Description="Depths of the alleles">',
)


@dataclass
class Results:
    """placements(sample, metric, score, best, ties), chosen(sample, node[, length]), records (as sam_records, the reference is the
    sample's genome), calls (as pileups.calls, node is the sample), genomes(sample, node, consensus)."""

    placements: DataFrame | None = None
    chosen: DataFrame | None = None
    records: DataFrame | None = None
    calls: DataFrame | None = None
    genomes: DataFrame | None = None


def index(genomes: DataFrame, p: Parameters, path: str) -> None:
    """Writes what placement needs of genomes(node, reference): seed counts in the order of seeds, and the parameters."""
    if p.l > 1:
        raise ValueError("a placement index holds single seeds: l is 0 or 1")
    spark = genomes.sparkSession
    seeds = seed_totals(genomes, "node", "reference", p.k, p.s).select("node", "seed", "n")
    seeds.repartitionByRange("seed").sortWithinPartitions("seed", "node").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/seeds")
    spark.createDataFrame([(readers.FORMAT_VERSION, p.k, p.s)], "format_version int, k int, s int").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str, p: Parameters) -> DataFrame:
    """(node, seed, n) of an index; another version, or one of other parameters, is an error."""
    meta = spark.read.parquet(f"{path}/meta").first()
    if (meta["format_version"], meta["k"], meta["s"]) != (readers.FORMAT_VERSION, p.k, p.s):
        raise ValueError(f"the index has format {meta['format_version']}, k {meta['k']} and s {meta['s']}")
    return spark.read.parquet(f"{path}/seeds")


def placements(scores: DataFrame) -> DataFrame:
    """(sample, metric, score, best, ties) of P.sample_scores' rows: as P.placements, for each sample."""
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("score")) for m in P.METRICS))
    long = scores.select("sample", "node", F.explode(each).alias("x")).select("sample", "node", "x.*").where("score > 0")
    best = long.groupBy(F.col("sample").alias("b_sample"), F.col("metric").alias("b_metric")).agg(F.max("score").alias("top"))
    near = long.join(best, (F.col("sample") == F.col("b_sample")) & (F.col("metric") == F.col("b_metric"))).where(F.col("score") >= F.col("top") - F.greatest(F.lit(1e-9), 1e-4 * F.col("top")))
    return near.groupBy("sample", "metric").agg(F.max("top").alias("score"), F.min("node").alias("best"), F.array_sort(F.collect_list("node")).alias("ties"))


def run(reads: DataFrame, genomes: DataFrame, p: Parameters, seeds: DataFrame | None = None, root=None, paired: bool = False, min_depth: int = 1, min_qual: float = 0.0) -> Results:
    """Takes reads(sample, read_id, name, seq, qual), ids unique within a sample, as far as p.stop.

    genomes(node, reference) is the collection; seeds an index of it, else it is sketched; root the node whose seeds weigh the weighted
    containment, the least one by default. A sample without a seed of the collection is placed nowhere and has no further results;
    p.forced is the node of every sample, whatever its scores.
    """
    last = STAGES.index(p.stop)
    seeds = seed_totals(genomes, "node", "reference", p.k, p.s).select("node", "seed", "n") if seeds is None else seeds
    out = Results()
    if last < STAGES.index("place"):
        return out
    own = reads.select("sample", F.col("seq").alias("seq"), F.concat_ws("\t", "sample", F.col("read_id").cast("string")).alias("id"))
    kept = stash(P.seeds_of(own.select("id", "seq"), "id", "seq", p.k, p.s).withColumn("sample", F.substring_index("id", "\t", 1)).groupBy("sample", "seed").agg(F.count("*").alias("r")), "kept")
    root = genomes.agg(F.min("node")).first()[0] if root is None else root
    scores = P.sample_scores(seeds, kept, seeds.where(F.col("node") == F.lit(root)).select("seed", "n"))
    out.placements = stash(placements(scores), "placements")
    if p.forced is None:
        out.chosen = out.placements.where(F.col("metric") == CHOSEN).select("sample", F.col("best").alias("node"))
    else:
        out.chosen = reads.select("sample").distinct().withColumn("node", F.lit(p.forced).cast(genomes.schema["node"].dataType))
    if last < STAGES.index("align"):
        return out
    # a sample has one genome, so the sample is what its reads are aligned with
    there = genomes.select(F.col("node").alias("g_node"), "reference")
    refs = stash(out.chosen.join(there, F.col("node") == F.col("g_node")).select("sample", "node", "reference"), "references")
    named = reads.withColumn("id", F.concat_ws("\t", "sample", F.col("read_id").cast("string")))
    targets = refs.select(F.col("sample").alias("node"), "reference")
    found = A.aligned_pairs(named.select(F.col("id").alias("read_id"), F.col("sample").alias("node")), named.select(F.col("id").alias("read_id"), "seq"), targets, "old" if p.aligner == "old" else None)
    found = stash(found, "alignments")
    out.chosen = refs.select("sample", "node", F.length("reference").cast("long").alias("length"))
    mates = found.withColumn("read_id", F.substring_index("read_id", "\t", -1).cast("long"))
    out.records = stash(T.sam_records(mates, named.select(F.col("sample").alias("node"), F.col("read_id").cast("long").alias("read_id"), "name", "seq", "qual"), paired), "records")
    if last < STAGES.index("genotype"):
        return out
    bases = U.aligned_bases(found, named.select(F.col("id").alias("read_id"), "seq", "qual"), targets)
    out.calls = stash(U.calls(U.genotypes(U.pileup(U.observations(bases))), min_depth, min_qual), "calls")
    if last < STAGES.index("consensus"):
        return out
    made = V.consensus(refs, out.calls.withColumnRenamed("node", "sample"), "sample", "reference")
    out.genomes = made.join(refs.select(F.col("sample").alias("r_sample"), "node"), F.col("sample") == F.col("r_sample")).select("sample", "node", "consensus")
    return out


def write(results: Results, path: str) -> None:
    """Placement tables, VCF and FASTA text, a folder for each sample, and one BAM folder whose references are the samples' genomes."""
    put = lambda rows, name: rows.select("sample", "value").write.mode("overwrite").partitionBy("sample").text(f"{path}/{name}")
    if results.placements is not None:
        order = F.array_position(F.array(*(F.lit(m) for m in P.METRICS)), F.col("metric"))
        lines = F.concat_ws("\t", "metric", S.decimals("score"), F.array_join(F.transform("ties", lambda x: x.cast("string")), ","))
        put(results.placements.repartition("sample").sortWithinPartitions("sample", order).select("sample", lines.alias("value")), "placement")
    if results.records is not None:
        chosen = results.chosen.orderBy("sample").collect()  # the header: a line for each sample of the run
        bam.write_bam(results.records, [(r["sample"], r["length"]) for r in chosen], f"{path}/bam")
    if results.calls is not None:
        put(vcf_lines(results.calls, results.chosen).repartition("sample").sortWithinPartitions("sample", "part", "pos"), "vcf")
    if results.genomes is not None:
        text = F.concat(T.consensus_header("sample", F.col("node").cast("string")), F.lit("\n"), S.wrapped("consensus", 80))
        put(results.genomes.select("sample", text.alias("value")), "consensus")


def vcf_lines(calls: DataFrame, chosen: DataFrame) -> DataFrame:
    """(sample, part, pos, value): header and records of each sample's calls on its node, with quality, depth, likelihoods and depths of alleles."""
    heads = F.array(*(F.struct(F.lit(i).alias("part"), F.lit(x).alias("value")) for i, x in enumerate(VCF_HEADER)))
    header = chosen.select("sample", F.explode(heads).alias("h")).select("sample", "h.part", F.lit(0).cast("long").alias("pos"), "h.value")
    columns = chosen.select("sample", F.lit(len(VCF_HEADER)).alias("part"), F.lit(0).cast("long").alias("pos"), F.concat(F.lit("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"), "sample").alias("value"))
    x = calls.join(chosen.select("sample", F.col("node").alias("chrom")), F.col("node") == F.col("sample"))
    info = F.concat(F.when(F.length("ref") != F.length("alt"), "INDEL;").otherwise(""), F.lit("DP="), "depth")
    value = F.concat(F.lit("1:"), F.round("ref_pl").cast("long"), F.lit(",0:"), F.coalesce("ref_n", F.lit(0)), F.lit(","), "support")
    line = F.concat_ws("\t", F.col("chrom").cast("string"), F.col("pos").cast("string"), F.lit("."), "ref", "alt", S.decimals("qual", 4), F.lit("."), info, F.lit("GT:PL:AD"), value)
    return header.unionAll(columns).unionAll(x.select("sample", F.lit(len(VCF_HEADER) + 1).alias("part"), "pos", line.alias("value")))
