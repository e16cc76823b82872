"""Cross-site line dedup in DataFrame functions only.

Each line hash gets a HyperLogLog sketch of the sites that hold it, merged by aggregation. Where the estimate is near the
threshold the sites are counted exactly. A line on `min_sites` sites or more is boilerplate: it stays in the document with
the least id that holds it and is removed from all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, fresh, stash, text_column

#: Sites from which on a line is boilerplate; the base-2 logarithm of a sketch's registers; shares in which sketches merge first.
MIN_SITES, LG_K, SALTS = 5, 12, 64
SPACE = "[ \\t\\n\\x0B\\f\\r]"


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, f"^{SPACE}+|{SPACE}+$", "")


def line_rows(docs: DataFrame, site: str = "source") -> DataFrame:
    """(doc_id, row, site, at, h1, h2): a row for each line that isn't blank; 96 bits of hash stand for the trimmed line.

    `row` is a hash of the text that tells rows of one doc_id apart.
    """
    text = text_column(docs)
    lines = docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(text).alias("row"), docs[site].alias("site"), F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))
    line = trimmed(F.col("line"))
    return lines.withColumn("line", line).where(F.col("line") != "").select("doc_id", "row", "site", "at", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(h1, h2, first_doc) of the lines on min_sites sites or more; null sites don't count.

    Sketches of a line merge in two rounds, the first dealt by SALTS, so no task reads a sketch of a common line from every other.
    """
    salt = F.pmod(F.spark_partition_id(), F.lit(SALTS))
    some = lines.groupBy("h1", "h2", salt.alias("salt")).agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.min("doc_id").alias("first_doc"))
    spread = some.groupBy("h1", "h2").agg(F.hll_union_agg("sketch").alias("sketch"), F.min("first_doc").alias("first_doc"))
    # A line on a single site can't be near the threshold; the band is five standard errors, one site at least.
    band = max(1.0, 5 * 1.04 / 2 ** (lg_k / 2) * min_sites)
    spread = spread.select("h1", "h2", "first_doc", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites - band)
    spread = stash(spread, "spread")
    near = spread.where(F.col("sites") <= min_sites + band).select(F.col("h1").alias("n1"), F.col("h2").alias("n2"))
    held = lines.where(F.col("site").isNotNull()).join(near, (F.col("h1") == F.col("n1")) & (F.col("h2") == F.col("n2")), "left_semi")
    exact = held.select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count("*").alias("exact"))
    found = stash(spread.join(exact, ["h1", "h2"], "left").where(F.coalesce("exact", "sites") >= min_sites).select("h1", "h2", "first_doc"), "boilerplate")
    drop_stash(spread)
    return found


def without(text: Column, gone: Column) -> Column:
    """The text's lines but those at the places in `gone`; linear in the lines."""
    lines = F.split(text, "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.transform(F.array(F.struct(lines.alias("l"), left.alias("k"))), lambda s: F.array_join(F.transform(s["k"], lambda i: F.get(s["l"], i)), "\n"))[0]


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, site: str = "source") -> DataFrame:
    """All rows and columns of docs, text without boilerplate lines, and n_lines (not blank) and n_removed.

    Blank lines stay. A null text stays null with 0 lines. Rows of one id count as one document, so a line stays in all of its
    first document's rows; each row loses its own lines only. Rows without id keep their text whole, and a null site counts as
    none. Repeated rows stay repeated; an empty table gives no rows; other columns pass through (n_lines and n_removed replace
    columns of these names).
    """
    lines = stash(line_rows(docs, site), "lines")
    spread = boilerplate(lines, min_sites, lg_k).withColumnsRenamed({"h1": "b1", "h2": "b2"})
    hit = lines.join(spread, (lines["h1"] == spread["b1"]) & (lines["h2"] == spread["b2"]) & (lines["doc_id"] != spread["first_doc"]))
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    id_, row, gone, key = (fresh(f"_{c}", docs.columns) for c in ("id", "row", "gone", "key"))
    places = stash(hit.groupBy(F.col("doc_id").alias(id_), F.col("row").alias(row)).agg(F.collect_set("at").alias(gone)), "places")
    drop_stash(lines, spread)
    mine = docs.select(*keep, F.xxhash64(text_column(docs)).alias(key))
    out = mine.join(places, (F.col("doc_id") == F.col(id_)) & (F.col(key) == F.col(row)), "left")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(without(F.col("text"), F.col(gone)))
    n_lines = F.size(F.filter(F.split(text_column(docs), "\n", -1), lambda x: trimmed(x) != "")).cast("long")
    n_removed = F.coalesce(F.size(gone), F.lit(0)).cast("long")
    return out.select(*[text.alias("text") if c == "text" else F.col(c) for c in keep], n_lines.alias("n_lines"), n_removed.alias("n_removed"))


def oracle(docs: str = "documents", min_sites: int = MIN_SITES) -> str:
    """DuckDB SQL for (doc_id, text, n_lines, n_removed)."""
    trim = "trim({}, ' ' || chr(9) || chr(11) || chr(12) || chr(13))"
    return f"""WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {docs}),
    t AS (SELECT *, {trim.format("line")} AS k FROM l),
    b AS (SELECT k, min(doc_id) AS first_doc FROM t WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= {min_sites}),
    r AS (SELECT t.*, b.k IS NOT NULL AS gone FROM t LEFT JOIN b ON t.k = b.k AND t.doc_id <> b.first_doc)
    SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') END AS text,
      count(*) FILTER (k <> '') AS n_lines, count(*) FILTER (gone) AS n_removed
    FROM {docs} d LEFT JOIN r ON d.doc_id = r.doc_id GROUP BY d.doc_id, d.text"""
