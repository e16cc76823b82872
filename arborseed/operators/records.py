"""Text records: VCF lines with haploid samples and their filters, alignment fields, and lines of result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from .variants import passes_gate, single_ploid, with_prior


def alternatives(alt: Column | str) -> Column:
    """The bases of an ALT list; `.` is none, anything but single letters is an error."""
    listed = F.split(S.col(alt), ",")
    wrong = F.exists(listed, lambda x: F.length(x) != 1)
    return F.when(S.col(alt) == ".", F.array().cast("array<string>")).when(wrong, F.raise_error(F.concat(F.lit("not single bases: "), S.col(alt))).cast("array<string>")).otherwise(listed)


def sample_fields(format_: Column | str, sample: Column | str) -> Column:
    """(gt, pl, ad) of a sample, by the names its FORMAT lists: the called allele, null without a call, and arrays, null where absent."""
    names, values = F.split(S.col(format_), ":"), F.split(S.col(sample), ":")
    field = lambda name: F.when(F.array_contains(names, name), F.get(values, (F.array_position(names, name) - 1).cast("int")))
    numbers = lambda x: F.when(x != ".", F.transform(F.split(x, ","), lambda v: v.try_cast("long")))
    return F.struct(F.element_at(F.split(field("GT"), "[/|]"), 1).try_cast("int").alias("gt"), numbers(field("PL")).alias("pl"), numbers(field("AD")).alias("ad"))


def vcf_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """(chrom, pos, id, ref, alt, qual, filter, info, format, sample, gt, pl, ad) of VCF text; header lines are left out."""
    f = F.split(column, "\t")
    names = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format", "sample")
    rows = lines.where(~F.col(column).startswith("#") & (F.trim(column) != "")).select(*(F.get(f, F.lit(i)).alias(n) for i, n in enumerate(names)))
    return rows.withColumn("pos", F.col("pos").cast("long")).withColumn("x", sample_fields("format", "sample")).select(*names, "x.*")


def plain_filter(records: DataFrame, min_qual: float = 30.0, min_depth: int = 1) -> DataFrame:
    """Variant records without a substitution prior: a called alternative, QUAL of min_qual or `.`, and the depth gate."""
    good = (F.col("alt") != ".") & (F.col("gt") != 0) & ((F.col("qual") == ".") | (F.col("qual").try_cast("double") >= min_qual))
    return records.where(F.coalesce(good & passes_gate(F.col("gt"), F.col("ad"), min_depth), F.lit(False)))


def prior_filter(records: DataFrame, priors: DataFrame, min_qual: float = 30.0, min_depth: int = 1) -> DataFrame:
    """Variant records under a substitution prior: re-called substitutions with their new QUAL; called indels pass as they are.

    A record is taken as a substitution if its INFO begins with DP and its REF is a base; PL and AD text stay unchanged.
    """
    plain = F.col("info").startswith("DP") & F.col("ref").rlike("^[ACGT]$")
    passed = records.where(~plain & (F.coalesce("gt", F.lit(0)) != 0)).select("chrom", "pos", "ref", "alt", F.col("qual").try_cast("double").alias("qual"), "sample")
    alts = alternatives("alt")
    sites = records.where(plain).select(F.struct("chrom", "pos").alias("site"), "ref", "ad", "sample", alts.alias("alts"), single_ploid(F.col("pl"), alts).alias("pl"))
    called = with_prior(sites, priors, min_qual)
    both = called.join(sites.select(F.col("site").alias("s"), "alts", "ad", "sample"), F.col("site") == F.col("s"))
    gate = passes_gate(F.array_position("alts", F.col("alt")).cast("int"), F.col("ad"), min_depth)
    return both.where(gate).select("site.chrom", "site.pos", "ref", "alt", "qual", "sample").union(passed)


def cigar(length: Column, clip_start: Column, clip_end: Column, rev: Column) -> Column:
    """Soft clips and the match between them in the order of the reference: a reverse read's clips change sides."""
    first, last = F.when(rev, clip_end).otherwise(clip_start), F.when(rev, clip_start).otherwise(clip_end)
    part = lambda n, c: F.when(n > 0, F.concat(n.cast("string"), F.lit(c))).otherwise("")
    return F.concat(part(first, "S"), part(length - clip_start - clip_end, "M"), part(last, "S"))


def oriented(seq: Column, qual: Column, rev: Column) -> tuple[Column, Column]:
    """(SEQ, QUAL) as an alignment lists them: those of a reverse read turned round."""
    return F.when(rev, S.reverse_complement(seq)).otherwise(seq), F.when(rev, F.reverse(qual)).otherwise(qual)


def mismatch_tag(read: Column, reference: Column) -> Column:
    """The MD text of an ungapped alignment: lengths of matches with the reference's bases between them."""
    n = F.length(read)
    pairs = F.arrays_zip(F.split(read, "").alias("r"), F.split(reference, "").alias("q"))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("run"))
    step = lambda a, x: F.when(x["r"] == x["q"], F.struct(a["text"].alias("text"), (a["run"] + 1).alias("run"))).otherwise(F.struct(F.concat(a["text"], a["run"].cast("string"), x["q"]).alias("text"), F.lit(0).alias("run")))
    return F.when(n == F.length(reference), F.aggregate(pairs, start, step, lambda a: F.concat(a["text"], a["run"].cast("string"))))


def mapped(alignments: DataFrame) -> DataFrame:
    """Alignments that count: a score above 0 and up to the read's length; of pairs (pair, mate) both mates or none."""
    good = alignments.where((F.col("score") > 0) & (F.col("score") <= F.length("seq")))
    if "mate" not in alignments.columns:
        return good
    both = good.groupBy("pair").agg(F.countDistinct("mate").alias("mates")).where("mates = 2").select("pair")
    return good.join(both, "pair", "left_semi")


def score_lines(scores: DataFrame) -> DataFrame:
    """(value): node and four scores of each node with any above 0; weighted containment is not listed. Best log_raw first, then the largest node."""
    listed = ("log_raw", "log_cosine", "containment", "log_containment")
    rows = scores.where(F.greatest(*listed) > 0).orderBy(F.col("log_raw").desc(), F.col("node").desc())
    return rows.select(F.concat_ws("\t", F.col("node").cast("string"), *(S.decimals(c) for c in listed)).alias("value"))


def rank_lines(ranks: DataFrame) -> DataFrame:
    """(value): rank, node and overlap of each node, best first."""
    return ranks.orderBy("oc_rank", "node").select(F.concat_ws("\t", F.col("oc_rank").cast("string"), F.col("node").cast("string"), S.decimals("overlap")).alias("value"))


def read_lines(best: DataFrame, totals: DataFrame) -> DataFrame:
    """(value): read, seeds, best score and the number of nodes that have it, of each read with a score."""
    rows = best.join(totals, "read_id").where("max_score > 0").orderBy("read_id")
    return rows.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in ("read_id", "seeds", "max_score", "epp"))).alias("value"))


def frequency_lines(counts: DataFrame, masked: DataFrame) -> DataFrame:
    """(value): hash in hexadecimal, count, share and whether the seed is masked, most frequent first."""
    total = counts.agg(F.sum("r").alias("total"))
    rows = counts.join(masked.select(F.col("seed").alias("m")), F.col("seed") == F.col("m"), "left").crossJoin(F.broadcast(total)).orderBy(F.col("r").desc(), "seed")
    return rows.select(F.concat_ws("\t", F.lower(F.lpad(F.hex("seed"), 16, "0")), F.col("r").cast("string"), S.decimals(F.col("r") / F.col("total")), F.when(F.col("m").isNull(), "0").otherwise("1")).alias("value"))


def sam_lines(alignments: DataFrame) -> DataFrame:
    """(value): SAM records by position of alignments(name, reference, start from 0, rev, seq, qual, target, clip_start, clip_end).

    seq and qual are as they were read; target is what the matched part lies on, in the reference's order. Names lose their mate suffix.
    """
    seq, qual = oriented(F.col("seq"), F.col("qual"), F.col("rev"))
    x = alignments.withColumns({"_s": seq, "_q": qual, "_c": cigar(F.length("seq"), F.col("clip_start"), F.col("clip_end"), F.col("rev"))})
    first = F.when(F.col("rev"), F.col("clip_end")).otherwise(F.col("clip_start"))
    matched = F.substring(F.col("_s"), first + 1, F.length("seq") - F.col("clip_start") - F.col("clip_end"))
    tag = F.concat(F.lit("MD:Z:"), mismatch_tag(matched, F.col("target")))
    fields = (S.without_mate("name"), F.when(F.col("rev"), "16").otherwise("0"), F.col("reference"), (F.col("start") + 1).cast("string"), F.lit("60"), F.col("_c"), F.lit("*"), F.lit("0"), F.lit("0"), F.col("_s"), F.col("_q"), tag)
    return x.orderBy("start", "name").select(F.concat_ws("\t", *fields).alias("value"))


def consensus_header(sample: Column | str, node: Column | str) -> Column:
    """The FASTA header of a sample's consensus."""
    return F.concat(F.lit(">"), S.col(sample), F.lit("_consensus ref="), S.col(node))


def fasta_index(name: str, length: int, width: int = 80, offset: int = 0) -> str:
    """A line of a FASTA index: name, bases, offset of the first base, bases and bytes of a line; offset: where the record begins."""
    return f"{name}\t{length}\t{offset + len(name.encode()) + 2}\t{width}\t{width + 1}"


#: The most bases that a proper pair spans.
MAX_SPAN = 800


def sam_records(found: DataFrame, reads: DataFrame, paired: bool = False, max_span: int = MAX_SPAN) -> DataFrame:
    """What alignment files hold of alignments(node, read_id, rev, start, end, cigar, md, edits, quality) of reads(read_id, name, seq, qual).

    If reads have a node, ids are unique within it only.
    Paired reads have ids 2 * pair + mate; a mate's fields come from its alignment on the same node, and a read whose mate isn't
    aligned there is left out. A pair is proper if it lies on opposite strands, the forward read first, within max_span bases.
    """
    at = [F.col("node").alias("_node")] if "node" in reads.columns else []
    own = reads.select(F.col("read_id").alias("_id"), *at, S.without_mate("name").alias("name"), F.col("seq").alias("_seq"), F.col("qual").alias("_qual"))
    x = found.join(own, (F.col("read_id") == F.col("_id")) & (F.col("node") == F.col("_node") if at else F.lit(True)))
    if paired:
        mate = found.select(F.col("node").alias("m_node"), F.col("read_id").bitwiseXOR(F.lit(1)).alias("m_id"), F.col("start").alias("m_start"), F.col("end").alias("m_end"), F.col("rev").alias("m_rev"))
        x = x.join(mate, (F.col("node") == F.col("m_node")) & (F.col("read_id") == F.col("m_id")))
    seq, qual = oriented(F.col("_seq"), F.col("_qual"), F.col("rev"))
    return record_fields(x.withColumns({"seq": seq, "qual": qual}), paired, max_span)


def record_fields(x: DataFrame, paired: bool = False, max_span: int = MAX_SPAN) -> DataFrame:
    """What `sam_records` gives, of alignments that carry their read's name without mate suffix, and seq and qual along the reference.

    Paired ones carry their mate's place as well: m_start, m_end, m_rev.
    """
    none, no = F.lit(None).cast("string"), F.lit(False)
    if paired:
        span = F.greatest("end", "m_end") - F.least("start", "m_start")
        ahead = F.when(F.col("rev"), F.col("m_start") <= F.col("start")).otherwise(F.col("start") <= F.col("m_start"))
        proper = (F.col("rev") != F.col("m_rev")) & ahead & (span <= max_span)
        flag = S.sam_flag(F.lit(True), proper, no, no, F.col("rev"), F.col("m_rev"), F.col("read_id") % 2 == 0)
        size = S.template_length(F.col("start"), F.col("end"), F.col("rev"), F.col("m_start"), F.col("m_end"), F.col("m_rev"))
        mate_fields = (F.col("node").cast("string"), F.col("m_start"), size)
    else:
        flag, mate_fields = F.when(F.col("rev"), 16).otherwise(0), (none, F.lit(-1), F.lit(0))
    other, other_start, size = mate_fields
    return x.select(
        "name", flag.cast("int").alias("flag"), F.col("node").cast("string").alias("reference"), F.col("start").cast("long").alias("start"), F.col("quality").cast("int").alias("mapq"), "cigar",
        other.alias("mate_reference"), other_start.cast("long").alias("mate_start"), size.cast("long").alias("tlen"), "seq", "qual", F.col("edits").cast("int").alias("edits"), "md")


def record_lines(records: DataFrame) -> DataFrame:
    """(value): sam_records' rows as SAM text, by reference and place."""
    same = F.when(F.col("mate_reference") == F.col("reference"), "=").otherwise(F.coalesce("mate_reference", F.lit("*")))
    either = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "*").otherwise(F.col(c))
    fields = (
        "name", F.col("flag").cast("string"), F.coalesce("reference", F.lit("*")), (F.col("start") + 1).cast("string"), F.col("mapq").cast("string"), either("cigar"), same, (F.col("mate_start") + 1).cast("string"),
        F.col("tlen").cast("string"), either("seq"), either("qual"), F.concat(F.lit("NM:i:"), "edits"), F.concat(F.lit("MD:Z:"), "md"))
    return records.orderBy("reference", "start", "name", "flag").select(F.concat_ws("\t", *fields).alias("value"))
