"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every text version is content-addressed by SHA-256. The ledger keeps which (blob, rule version) pairs were scanned and
what was found; an update scans only the pairs that it has not seen, and joins the findings back to every path that
holds the blob. Positions are code points, end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_stash, stash, stash_path, text_column


@dataclass(frozen=True)
class Rule:
    """A kind of secret; a match counts if its group `group` has `least` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base kinds, in the order in which ties at one start are listed, then the kinds that the operator adds.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
ADDED_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE_RULES + ADDED_RULES
#: Blobs that are due whose hashes are broadcast; more meet their texts in a join.
FEW = 10_000
SCANS = "sha string, rule string"
FINDINGS = "sha string, rule string, kind string, start long, end long"


def _found(text: Column, rule: Rule) -> Column:
    """The pieces between matches, the matches and their decisive groups; null where nothing matches or nothing is due."""
    pattern = F.lit(rule.pattern)
    return F.when(
        F.array_contains("due", rule.key) & text.rlike(rule.pattern),
        F.struct(
            F.lit(rule.key).alias("rule"),
            F.lit(rule.kind).alias("kind"),
            F.lit(rule.least).alias("least"),
            F.arrays_zip(
                F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
                F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length).alias("size"),
                F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length).alias("core"),
            ).alias("hits"),
        ),
    )


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of blobs (sha, text, due: the keys of the rules to run)."""
    found = blobs.select("sha", F.explode(F.filter(F.array(*(_found(F.col("text"), r) for r in rules)), lambda x: x.isNotNull())).alias("f"))
    hits = found.select("sha", "f.rule", "f.kind", "f.least", F.posexplode("f.hits").alias("at", "hit"))
    so_far = Window.partitionBy("sha", "rule").orderBy("at")
    ends = F.sum(F.col("hit.gap").cast("long") + F.coalesce(F.col("hit.size"), F.lit(0))).over(so_far)
    spans = hits.withColumn("end", ends).where(F.col("hit.core") >= F.col("least"))
    return spans.select("sha", "rule", "kind", (F.col("end") - F.col("hit.size")).alias("start"), "end").distinct()


class SecretLedger:
    """The ledger in a shared folder: `scans` says which pairs are done, `findings` what they gave.

    Findings are written before scans, so a run that is lost in between is done again; readers drop repeated rows.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, rules: tuple[Rule, ...] = RULES):
        self.spark, self.path, self.rules = spark, path or stash_path(spark, "ledger"), rules

    def _read(self, name: str, schema: str) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def due(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """(sha, due): each blob with rules to run."""
        blobs = docs.select(F.sha2(text_column(docs, text), 256).alias("sha")).distinct()
        done = self._read("scans", SCANS).groupBy("sha").agg(F.collect_set("rule").alias("done"))
        every = F.array(*(F.lit(r.key) for r in self.rules))
        left = F.array_except(every, F.coalesce("done", F.array().cast("array<string>")))
        return blobs.join(done, "sha", "left").select("sha", left.alias("due")).where(F.size("due") > 0)

    def update(self, docs: DataFrame, text: str = "text") -> int:
        """Scans what is due and appends it to the ledger; returns the number of blobs scanned. A null text is an empty blob.

        Rows of one blob are brought together within each task first, so however many there are, a blob meets a row per task.
        """
        due = stash(self.due(docs, text), "due")
        n = due.count()
        rows = docs.select(F.sha2(text_column(docs, text), 256).alias("sha"), text_column(docs, text).alias("text"))
        if n <= FEW:  # texts of blobs that were scanned before don't leave their task
            blobs = rows.join(F.broadcast(due), "sha").groupBy("sha").agg(F.first("text").alias("text"), F.first("due").alias("due"))
        else:
            blobs = rows.groupBy("sha").agg(F.first("text").alias("text")).join(due, "sha")
        scan(blobs, self.rules).write.mode("append").parquet(f"{self.path}/findings")
        due.select("sha", F.explode("due").alias("rule")).write.mode("append").parquet(f"{self.path}/scans")
        drop_stash(due)
        return n

    def findings(self) -> DataFrame:
        """Spans of the rules in force, each once."""
        return self._read("findings", FINDINGS).where(F.col("rule").isin([r.key for r in self.rules])).distinct()

    def paths(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """One row per row of docs: the key, its blob and all spans of the blob, ordered by start, then kind as listed."""
        order = F.array_position(F.array(*(F.lit(r.kind) for r in self.rules)), F.col("kind"))
        span = F.struct("start", order.alias("rank"), "kind", "end")
        blobs = self.findings().groupBy("sha").agg(F.sort_array(F.collect_list(span)).alias("spans"))
        held = docs.select(docs[key].alias("doc_id"), F.sha2(text_column(docs, text), 256).alias("sha"))
        none = F.array().cast("array<struct<start:bigint,rank:bigint,kind:string,end:bigint>>")
        return held.join(blobs, "sha", "left").select("doc_id", "sha", F.coalesce("spans", none).alias("spans"))


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def secret_spans(docs: DataFrame, ledger: SecretLedger | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): counts of the base kinds, a digest of the base spans, all spans.

    A null text is empty; repeated rows, repeated ids and null ids give a row each; an empty table gives no rows; further
    columns are ignored. The ledger is updated first: only blobs and rule versions that it has not seen are scanned.
    """
    ledger = ledger or SecretLedger(docs.sparkSession)
    ledger.update(docs)
    kinds = [r.kind for r in BASE_RULES]
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in kinds]
    base = F.filter("spans", lambda x: x["kind"].isin(kinds))
    return ledger.paths(docs).select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def oracle() -> str:
    """The same in DuckDB SQL: pieces between matches and matches, summed to positions."""
    parts = []
    for rank, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, {r.least} AS least, unnest(range(1, len(m) + 1)) AS i, m, g, gap FROM
          (SELECT doc_id, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {r.group}) AS g, string_split_regex(t, '{p}') AS gap FROM d)""")
    spans = " UNION ALL ".join(parts)
    listed = lambda where: f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) {where}, '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), x AS ({spans}),
    y AS (SELECT doc_id, rank, kind, list_sum(list_transform(gap[:i], lambda v: length(v))) + coalesce(list_sum(list_transform(m[:i - 1], lambda v: length(v))), 0) AS s,
          length(m[i]) AS n FROM x WHERE length(g[i]) >= least),
    z AS (SELECT doc_id, rank, kind, s::BIGINT AS s, (s + n)::BIGINT AS e FROM y)
    SELECT d.doc_id, {counts}, sha256({listed("FILTER (rank < 3)")}) AS base_sha256, {listed("")} AS spans FROM d LEFT JOIN z USING (doc_id) GROUP BY d.doc_id"""
