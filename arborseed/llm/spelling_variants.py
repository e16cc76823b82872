"""Spelling variants: words that one edit turns into each other, joined by even partition.

If one edit parts two words, the shorter one's first or second half stands unchanged in the other, at its place or one further.
So each word's halves are keys, and a word asks with the halves that words of its own length and of one less would have. A key
under which too many words would be compared is refined in the same way: what the half leaves is split again, for the edit
lies in one half of it. Candidates that meet by both halves count at the first, and one edit is verified in the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, fresh, stash, text_column

#: Code points of the shortest word, its fewest occurrences, and how many times more frequent a word's form is.
MIN_LENGTH, MIN_COUNT, TIMES = 7, 2, 10
#: One in so many (document, word) pairs loses a code point; comparisons under one key beyond which it is refined.
ERRORS, HEAVY = 31, 1 << 16
LETTERS = "A-Za-z\\u00C0-\\u00FF"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, errors: int | None = ERRORS) -> DataFrame:
    """(word, n): the words of all texts and their occurrences.

    With `errors` a word of a document loses the code point h % length where that number divides h, the CRC-32 of `<doc_id>:<word>`.
    Runs are counted in their task first, so a frequent word leaves it as one row.
    """
    # a run that is too short stays too short
    runs = F.regexp_extract_all(text_column(docs, text), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    rows = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("doc_id"), F.explode(runs).alias("run"))
    word = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    rows = rows.select("doc_id", word.alias("word"))
    if errors:
        h = F.crc32(F.concat_ws(":", "doc_id", "word").cast("binary"))
        at = F.pmod(F.col("h"), F.length("word")).cast("int")
        short = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
        rows = rows.withColumn("h", h).select(F.when(F.col("h") % errors == 0, short).otherwise(F.col("word")).alias("word"))
    return rows.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def halves(entries: DataFrame) -> DataFrame:
    """Each entry's two keys: what it asks for further, and the `rest` in which the edit lies.

    An entry stands for a word under a key; `longer` marks one that asks for words that are a code point shorter, so its second
    half begins one further on. `left` is the first half of entries under their second half.
    """
    size = F.length("rest") - F.col("longer").cast("int")
    mid = F.floor(size / 2).cast("int")
    cut = lambda a, n=None: F.substring(F.col("rest"), a, F.length("rest") if n is None else n)
    one = F.struct(F.xxhash64("key", F.lit(0), cut(F.lit(1), mid)).alias("key"), cut(mid + 1).alias("rest"), F.lit(None).cast("string").alias("left"))
    second = mid + F.col("longer").cast("int")
    two = F.struct(F.xxhash64("key", F.lit(1), cut(second + 1)).alias("key"), cut(F.lit(1), second).alias("rest"), cut(F.lit(1), mid).alias("left"))
    return entries.select("word", "n", "longer", F.explode(F.array(one, two)).alias("h")).select("h.key", "word", "n", "longer", "h.rest", "h.left")


def verified(entries: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): pairs that meet under a key and that one edit parts, b as long as a and behind it in order, or longer."""
    asked = entries.where(~F.col("longer")).select("key", F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("left").alias("a_left"))
    asks = entries.select(F.col("key").alias("b_key"), F.col("word").alias("b"), F.col("n").alias("b_n"), "longer", F.col("left").alias("b_left"))
    first = F.col("a_left").isNull() | (F.col("a_left") != F.col("b_left"))
    fits = (F.col("longer") | (F.col("a") < F.col("b"))) & first & (F.levenshtein("a", "b", 1) == 1)
    return asked.join(asks, (F.col("key") == F.col("b_key")) & fits).select("a", "a_n", "b", "b_n")


def near_words(words: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(word, near, near_n): both directions of all pairs of words (word, n) that exactly one edit parts, each once.

    Rounds end when no key is heavy or what is left of words is one code point: 20 rounds for words of a million.
    """
    size = F.length("word")
    both = F.explode(F.array(F.lit(False), F.lit(True)))
    left = stash(words.select("word", "n", both.alias("longer")).select((size - F.col("longer").cast("int")).cast("long").alias("key"), "word", "n", "longer", F.col("word").alias("rest")), "entries")
    found = []
    while True:
        entries = stash(halves(left), "halves")
        drop_stash(left)
        a, b = F.count_if(~F.col("longer")), F.count_if("longer")
        splits = F.max(F.length("rest") - F.col("longer").cast("int")) > 1
        much = stash(entries.groupBy(F.col("key").alias("much")).agg((a * (a - 1) / 2 + a * b).alias("pairs"), splits.alias("splits")).where((F.col("pairs") > heavy) & F.col("splits")).select("much"), "much")
        if not much.limit(1).count():
            found.append(stash(verified(entries), "near"))
            drop_stash(entries, much)
            break
        on = F.col("key") == F.col("much")
        found.append(stash(verified(entries.join(much, on, "left_anti")), "near"))
        left = stash(entries.join(much, on, "left_semi").drop("left"), "entries")
        drop_stash(entries, much)
    pairs = found[0]
    for x in found[1:]:
        pairs = pairs.unionAll(x)
    ways = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))))
    return (pairs.distinct() if len(found) > 1 else pairs).select(ways.alias("w")).select("w.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms are followed to the last, in rounds that double the steps; each step is `times` rarer."""
    at = stash(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = at.select(F.col("word").alias("up"), F.col("root").alias("further"))
        met = at.join(up, F.col("root") == F.col("up"), "left")
        new = stash(met.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        drop_stash(at)
        at = new.select("word", "root")
        at._stash_path = new._stash_path
        if not new.where("moved").limit(1).count():
            return at


def variants(words: DataFrame, times: int = TIMES, heavy: int = HEAVY) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n).

    A word's form is its near word of largest n, ties to the least in code-point order, if that is `times` times its own or more.
    """
    words = stash(words.select("word", F.col("n").cast("long").alias("n")), "words")
    near = near_words(words, heavy)
    best = near.groupBy(F.col("word").alias("own")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("b"))
    named = words.join(best, F.col("word") == F.col("own"), "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("b.near").alias("near"), (-F.col("b.less")).alias("near_n"))
    is_form = F.col("near_n") >= times * F.col("n")
    named = stash(named.select("word", "n", "n_near", F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")), "named")
    last = roots(named.where(F.col("form").isNotNull())).withColumnRenamed("word", "own")
    return named.join(last, F.col("word") == F.col("own"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, times: int = TIMES, errors: int | None = ERRORS, heavy: int = HEAVY) -> DataFrame:
    """The words of all texts of docs (doc_id, text) with their forms: word, form, root, n, n_near, form_n.

    Words are runs of letters to U+00FF, A-Z lower-cased. Null and empty texts have no words; a null id counts as an empty text in
    the errors' hash; repeated rows count again; an empty table gives no rows; a word may be as long as a text; equally frequent
    near words go by code points; other columns are ignored, whatever their names.
    """
    return variants(word_counts(docs, text, min_length, min_count, errors), times, heavy)


def with_roots(docs: DataFrame, found: DataFrame, text: str = "text", name: str = "normal_text") -> DataFrame:
    """docs and their text with every word that has a form replaced by its root (lower-cased A-Z as words are), the rest as it is.

    `found` is spelling_variants' result. Texts go as rows of words and what lies between; a null text stays null, and rows without a
    variant are not touched.
    """
    known = found.where(F.col("form").isNotNull()).select(F.col("word").alias("_word"), "root")
    key, at, piece = (fresh(c, docs.columns) for c in ("_row", "_at", "_piece"))
    rows = stash(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    parts = F.regexp_extract_all(text_column(rows, text), F.lit(f"[{LETTERS}]+|[^{LETTERS}]+"), F.lit(0))
    pieces = rows.select(key, F.posexplode(parts).alias(at, piece))
    word = F.translate(F.col(piece), UPPER, LOWER)
    hit = pieces.join(known, word == F.col("_word")).groupBy(F.col(key).alias("_key")).agg(F.map_from_entries(F.collect_list(F.struct(F.col(at), F.col("root")))).alias("_new"))
    made = F.array_join(F.transform(parts, lambda p, i: F.coalesce(F.col("_new")[i], p)), "")
    return rows.join(hit, F.col(key) == F.col("_key"), "left").withColumn(name, F.when(F.col("_new").isNull(), F.col(text)).otherwise(made)).drop(key, "_key", "_new")


def oracle(docs: str = "documents") -> str:
    """DuckDB SQL for spelling_variants with its defaults; near words meet by what is left when one code point goes."""
    from .target_resampling import crc32_sql, crc_table_sql

    return f"""WITH RECURSIVE crc AS ({crc_table_sql()}),
    r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), '{UPPER}', '{LOWER}') AS run FROM {docs}),
    c AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= {MIN_LENGTH} GROUP BY doc_id, run),
    x AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM c),
    h AS (SELECT run, n, {crc32_sql("x")} AS h FROM x, crc),
    w AS (SELECT CASE WHEN h % {ERRORS} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h),
    v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
    i AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
    d AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM i),
    p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
          UNION SELECT v.word, d.word, d.n FROM v JOIN d ON v.word = d.d UNION SELECT d.word, v.word, v.n FROM v JOIN d ON v.word = d.d),
    k AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS r FROM p),
    f AS MATERIALIZED (SELECT v.word, v.n, coalesce(k.n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= {TIMES} * v.n THEN near END AS form, CASE WHEN near_n >= {TIMES} * v.n THEN near_n END AS form_n FROM v LEFT JOIN k ON v.word = k.word AND r = 1),
    t AS (SELECT word, form AS at FROM f WHERE form IS NOT NULL UNION ALL SELECT t.word, f.form FROM t JOIN f ON t.at = f.word WHERE f.form IS NOT NULL),
    e AS (SELECT t.word, t.at AS root FROM t JOIN f ON t.at = f.word WHERE f.form IS NULL)
    SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN e ON f.word = e.word"""
