"""Sources: FASTQ and FASTA reads, pairs, taxonomy, batch manifests, primers, mutation matrices, stored indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sequence as S
from . import fastq

READ = "read_id long, name string, seq string, qual string"
#: The version of the stored index that load_index accepts.
FORMAT_VERSION = 4
RANK_COLUMNS_AFTER = 1


def numbered_lines(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(at, line): the lines of a text file with their place in it, from 0; large plain files are read in splits.

    Counts of the splits, by where they begin, give each split the number of its first line. Files come one after the other by name.
    """
    source = spark.read.option("lineSep", separator) if separator else spark.read
    rows = source.text(path).select(F.regexp_replace("value", "\r$", "").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"))
    sizes = rows.groupBy("file", "block").agg(F.min("m").alias("first"), F.count("*").alias("size"))  # a row per split
    before = F.coalesce(F.sum("size").over(W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(sizes.withColumn("before", before)), ["file", "block"]).select((F.col("before") + F.col("m") - F.col("first")).alias("at"), "line")


def reads(spark: SparkSession, path: str, split_bytes: int = fastq.SPLIT) -> DataFrame:
    """Reads of a FASTQ or FASTA file, gzipped or not, with read_id in file order; FASTA gets quality I throughout.

    A FASTQ record is four lines: @ and the name, the sequence, +, a quality as long as the sequence; all else is an error. Splits
    find their records themselves; a count of each split's records numbers them, without a shuffle of reads.
    """
    kind = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    if not kind:
        return spark.createDataFrame([], READ)
    if kind[0]["value"][0] == ">":
        rows = numbered_lines(spark, path, "\n>").where(F.trim("line") != "")
        body = F.split(F.regexp_replace(F.regexp_replace("line", "^>", ""), "\r", ""), "\n", 2)
        name, seq = F.split(body[0], r"\s+")[0], F.regexp_replace(F.coalesce(F.get(body, F.lit(1)), F.lit("")), r"[\n>]+$|\n", "")
        return rows.select(F.col("at").cast("long").alias("read_id"), name.alias("name"), seq.alias("seq")).withColumn("qual", F.repeat(F.lit("I"), F.length("seq")))
    scanned = fastq.scan(spark, path, split_bytes, fastq.TASK)
    sizes = scanned.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"))  # a row for each task
    before, offsets = 0, []
    for r in sizes.orderBy("part").collect():
        offsets.append((r["part"], before))
        before += r["n"]
    offset = F.broadcast(spark.createDataFrame(offsets or [(0, 0)], "part int, before long"))
    placed = scanned.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    return placed.join(offset, F.col("_part") == F.col("part")).select((F.col("before") + F.col("_at")).alias("read_id"), "name", "seq", "qual")


def paired_reads(spark: SparkSession, first: str, second: str, for_alignment: bool = False) -> DataFrame:
    """Both mates, read_id = 2 * pair + mate; for alignment the second mate is reverse-complemented. Counts must agree."""
    one, two = reads(spark, first).withColumn("mate", F.lit(0)), reads(spark, second).withColumn("mate", F.lit(1))
    if one.count() != two.count():
        raise ValueError("the mates' files hold different numbers of reads")
    if for_alignment:
        two = two.withColumn("seq", S.reverse_complement("seq")).withColumn("qual", F.reverse("qual"))
    return one.unionByName(two).withColumn("read_id", 2 * F.col("read_id") + F.col("mate"))


def amplicon_groups(reads_: DataFrame, amplicons: DataFrame) -> DataFrame:
    """reads with grp, the primer of their name; reads without one are in the last group, named ''."""
    return reads_.join(amplicons.select(F.col("read_name").alias("name"), F.col("primer_id").alias("grp")), "name", "left").fillna({"grp": ""})


def taxonomy(spark: SparkSession, path: str, rank: str = "Family") -> DataFrame:
    """(node, taxon) of a white-space separated table with header; `.` is missing; the rank can't be the first column."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("f"))
    header = rows.first()["f"]
    at = header.index(rank) if rank in header else -1
    if at < RANK_COLUMNS_AFTER:
        raise ValueError(f"no usable column {rank}")
    body = rows.where(F.col("f") != F.array(*(F.lit(x) for x in header)))
    taxon = F.when(F.size("f") <= at, F.raise_error(F.lit("a row is too short"))).otherwise(F.get("f", F.lit(at)))
    return body.select(F.col("f")[0].alias("node"), taxon.alias("taxon")).where("taxon <> '.'")


def manifest(spark: SparkSession, path: str, must_exist: bool = False) -> DataFrame:
    """(reads1, reads2, prefix) of a batch file; # starts a comment; the second field is a mate only if it names a read file.

    must_exist: a listed file that isn't there is an error; a batch file lists samples, so its rows are looked at one by one.
    """
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.trim("value").startswith("#")).select(f.alias("f"))
    second, third = F.get("f", F.lit(1)), F.get("f", F.lit(2))
    mate = second.contains(".fastq") | second.contains(".fq")
    plain = F.regexp_replace(F.regexp_replace(F.col("f")[0], r"\.gz$", ""), r"\.(fastq|fq)$", "")
    default = F.regexp_replace(plain, r"(_R1|_R2|_1|_2|\.R1|\.R2)$", "")
    prefix = F.coalesce(F.when(mate, third).otherwise(second), default)
    listed = rows.select(F.col("f")[0].alias("reads1"), F.when(mate, second).alias("reads2"), prefix.alias("prefix"))
    if must_exist:
        sc = spark.sparkContext
        for r in listed.toLocalIterator():
            for name in (r["reads1"], r["reads2"]):
                at = sc._jvm.org.apache.hadoop.fs.Path(name) if name else None
                if at is not None and not at.getFileSystem(sc._jsc.hadoopConfiguration()).exists(at):
                    raise FileNotFoundError(name)
    return listed


def primers(spark: SparkSession, path: str, offset: int = 0) -> DataFrame:
    """Inclusive (primer_id, start, stop, strand) of a BED file, widened by offset."""
    f = F.split("value", "\t")
    return spark.read.text(path).select(f[3].alias("primer_id"), (f[1].cast("long") - offset).alias("start"), (f[2].cast("long") - 1 + offset).alias("stop"), F.coalesce(F.get(f, F.lit(5)), F.lit("0")).alias("strand"))


def mutation_matrix(text: str) -> tuple[list[list[float]], dict[int, float], dict[int, float]]:
    """Four rows of four numbers, then size:probability rows of insertions and deletions; anything else is an error."""
    lines = [x.split() for x in text.splitlines() if x.strip()]
    if len(lines) != 6 or any(len(x) != 4 for x in lines[:4]):
        raise ValueError("a mutation matrix has four rows of four, insertions and deletions")
    sizes = [{int(a): float(b) for a, b in (p.split(":") for p in x)} for x in lines[4:]]
    return [[float(v) for v in x] for x in lines[:4]], sizes[0], sizes[1]


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """(nodes, seed_changes, parameters) of an index written by sinks.write_index; another version is an error."""
    meta = spark.read.parquet(f"{path}/meta").first().asDict()
    if meta["format_version"] != FORMAT_VERSION:
        raise ValueError(f"index format {meta['format_version']}, not {FORMAT_VERSION}")
    nodes, changes = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/seed_changes")
    checked_index(nodes, changes)
    return nodes, changes, meta


def checked_index(nodes: DataFrame, changes: DataFrame) -> None:
    """An error if a parent doesn't come before its child in depth-first order, or a change belongs to no node."""
    if {"dfs_index", "parent_index"} <= set(nodes.columns) and nodes.where(F.col("parent_index") >= F.col("dfs_index")).limit(1).count():
        raise ValueError("a node comes before its parent")
    if changes.select("node").distinct().join(nodes.select(F.col("dfs_index").alias("node")), "node", "left_anti").limit(1).count():
        raise ValueError("a change belongs to no node")


def load_mixture_index(spark: SparkSession, path: str, named: bool = True) -> tuple[DataFrame, DataFrame, dict]:
    """(changes(node, seed, d_fwd, d_rev), tree(node, parent), parameters) of an index written by sinks.write_mixture_index.

    Another version, or an index of another kind, is an error. Unless named, seed is the dictionary's id and changes are read as they lie.
    """
    meta = spark.read.parquet(f"{path}/meta").first().asDict()
    if meta["format_version"] != FORMAT_VERSION or meta.get("kind") != "mixture":
        raise ValueError(f"not a mixture index of format {FORMAT_VERSION}")
    rows, words, tree = (spark.read.parquet(f"{path}/{x}") for x in ("changes", "dictionary", "tree"))
    checked_changes(rows, words, tree)
    seeds = rows.join(words, "seed_id") if named else rows.withColumnRenamed("seed_id", "seed")
    return seeds.select("node", "seed", "d_fwd", "d_rev"), tree, meta


def checked_changes(changes: DataFrame, dictionary: DataFrame, tree: DataFrame) -> None:
    """An error if the dictionary's ids aren't 0 to n - 1, a change has none of them, or one belongs to no node."""
    ids = dictionary.agg(F.count("*").alias("n"), F.min("seed_id").alias("low"), F.max("seed_id").alias("high"), F.countDistinct("seed_id").alias("kinds")).first()
    if ids["n"] and (ids["low"], ids["high"] + 1, ids["kinds"]) != (0, ids["n"], ids["n"]):
        raise ValueError("the dictionary's ids have gaps")
    if changes.where(~F.col("seed_id").between(0, ids["n"] - 1)).limit(1).count():
        raise ValueError("a change has a seed that the dictionary doesn't have")
    if changes.select("node").distinct().join(tree.select("node"), "node", "left_anti").limit(1).count():
        raise ValueError("a change belongs to no node")


def index_taxa(spark: SparkSession, path: str) -> DataFrame:
    """(node, taxon) that a mixture index was written with; no rows where it has none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/taxa")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "node string, taxon string")
    return spark.read.parquet(f"{path}/taxa")


def alignments(spark: SparkSession, path: str) -> DataFrame:
    """(name, flag, reference, start from 0, mapq, cigar, seq, qual, rev, mapped) of SAM text; header lines are left out."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("@")).select(f.alias("f"))
    flag = F.col("f")[1].cast("int")
    return rows.select(
        F.col("f")[0].alias("name"), flag.alias("flag"), F.col("f")[2].alias("reference"), (F.col("f")[3].cast("long") - 1).alias("start"), F.col("f")[4].cast("int").alias("mapq"),
        F.col("f")[5].alias("cigar"), F.col("f")[9].alias("seq"), F.col("f")[10].alias("qual"), (flag.bitwiseAND(16) != 0).alias("rev"), (flag.bitwiseAND(4) == 0).alias("mapped"))


def true_abundances(spark: SparkSession, path: str) -> DataFrame:
    """(node, abundance) of a white-space separated file."""
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(f[0].alias("node"), f[1].cast("double").alias("abundance"))
