"""Quality rules: base counts of each text and the perplexity of a character n-gram model.

The model is interpolated modified Kneser-Ney over characters, per language, counted by Spark over all documents. Texts are dealt
to two folds by their content, and a fold is judged by the counts of the other, so no text (nor a copy of it) speaks for itself;
n-grams that the other fold lacks back off order by order. The probabilities of all n-grams of the corpus are kept in sorted
arrays of 64-bit hashes, looked up in passes where they are many. Upper and lower bands on the log perplexity, per language,
reject documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hashed, chunks, drop_stash, grams, mix, per_row, stash, text_column, tidy, words
from .context_mix import gathered, looked_up

#: Characters of an n-gram; n-grams that a worker holds at a time; half width of a band in interquartile ranges, and its least value in nats.
ORDER, HELD, WIDTH, LEAST = 4, 4_000_000, 4.0, 0.1
#: Symbols of 16 bits: what the lowest order is interpolated with.
SYMBOL_KINDS = 1 << 16
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def base_counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words for each row of a chunk."""
    n = len(off) - 1
    start, end, first = words(data, off)
    hashed = Hashed(data)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    n_words = np.diff(first)
    chars = per_row(points[end] - points[start], first)
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    row = np.repeat(np.arange(n), n_words).astype(np.uint64)
    # Words in three-word windows found twice or more in their text.
    three, at = grams(hashed.of(start, end), first, 3)
    key = mix(three + row[at] * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(start) + 2, bool)
    for i in range(3):
        cover[at[twice] + i] = True
    repeat = per_row(cover[: len(start)], first)
    # Lines with a word that equal an earlier line of their text.
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([off[:-1], breaks + 1]))
    begin = begin[begin < len(data)]
    stop = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, begin)], off[np.searchsorted(off, begin, "right")])
    held = np.searchsorted(start, stop) > np.searchsorted(start, begin)
    begin, stop = begin[held], stop[held]
    owner = np.searchsorted(off, begin, "right") - 1
    line = mix(hashed.of(begin, stop) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, kept = np.unique(line, return_index=True)
    dup = np.bincount(owner, minlength=n) - np.bincount(owner[kept], minlength=n)
    return np.stack([n_words, chars, symbols[off[1:]] - symbols[off[:-1]], dup, repeat], 1)


def char_grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(four 16-bit symbols ending at each character as one integer, first index of each row). Symbol 0 stands before a text;

    digits count as one symbol and characters beyond 16 bits are dealt over the surrogates' codes.
    """
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[off]
    text = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    s = np.where(text > 0xFFFF, 0xD800 + text % 2048, text).astype(np.uint64)
    s[(s >= 48) & (s < 58)] = 48
    s[s == 0] = 1
    key, place = s.copy(), np.arange(len(s)) - np.repeat(points[:-1], np.diff(points))
    for back in range(1, ORDER):
        earlier = np.zeros_like(s)
        earlier[back:] = s[:-back]
        earlier[place < back] = 0
        key |= earlier << np.uint64(16 * back)
    return key, points


def table_hash(code: np.ndarray, key: np.ndarray) -> np.ndarray:
    return mix(key ^ mix(code.astype(np.uint64) + np.uint64(77)))


def language_code(docs: DataFrame):
    """The two or three ASCII letters that begin a language tag (en-US counts as en) as an integer below 2**24; 0 for any other value."""
    lang = F.regexp_extract(F.lower(F.coalesce(docs["lang"].cast("string"), F.lit(""))), "^([a-z]{2,3})([-_].*)?$", 1)
    return F.when(lang != "", F.conv(F.hex(lang), 16, 10).cast("int")).otherwise(F.lit(0))


def fold_code(docs: DataFrame):
    """Twice the language's code plus the text's fold; equal texts are in one fold."""
    return (2 * language_code(docs) + F.pmod(F.xxhash64(text_column(docs)), F.lit(2)).cast("int")).cast("int")


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, g, c): how often each n-gram occurs in the documents of a language and fold; workers add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {}
        for batch in batches:
            lang = batch.column(0).to_numpy()
            for i, j, data, off in chunks(batch.column(1)):
                key, points = char_grams(data, off)
                of = np.repeat(lang[i:j], np.diff(points))
                for code in np.unique(of):
                    parts = kept.setdefault(int(code), [])
                    parts.append(np.unique(key[of == code], return_counts=True))
                    if len(parts) > 8:
                        kept[int(code)] = [_merged(parts)]
        for code, parts in kept.items():
            g, c = _merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), code, np.int32)), pa.array(g.view(np.int64)), pa.array(c)], ["lang", "g", "c"])

    rows = docs.select(fold_code(docs).alias("lang"), text_column(docs).alias("text")).mapInArrow(tidy(run), "lang int, g long, c long")
    return rows.groupBy("lang", "g").agg(F.sum("c").alias("c"))


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    g, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return g, np.bincount(place, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)


def discounted(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, g, c less its discount) and (lang, h, total, what the discounts leave) of the counts of an order.

    The three discounts of modified Kneser-Ney by language, each between 0 and its count.
    """
    n = t.groupBy("lang").agg(*(F.sum((F.col("c") == i).cast("double")).alias(f"n{i}") for i in range(1, 5)))
    y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
    d = [F.when((F.col(f"n{i}") > 0) & (F.col(f"n{i + 1}") > 0), F.greatest(F.lit(0.1), F.least(F.lit(i - 0.05), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")))).otherwise(F.lit(0.5 * i)) for i in (1, 2, 3)]
    discounts = n.select(F.col("lang").alias("d_lang"), *(x.alias(f"d{i}") for i, x in enumerate(d, 1)))
    t = t.join(F.broadcast(discounts), t["lang"] == F.col("d_lang"))  # a row for each language code: bounded
    cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    t = t.select("lang", "g", "c", cut.alias("cut"))
    context = t.groupBy("lang", F.shiftrightunsigned("g", 16).alias("h")).agg(F.sum("c").alias("total"), F.sum("cut").alias("left"))
    return t.select("lang", "g", (F.col("c") - F.col("cut")).alias("own")), context


def kneser_ney(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(lang, g, p) for each of wanted (lang, g): the interpolated probability of the n-gram's last character by counts (lang, g, c).

    The highest order has true counts; a lower order counts the distinct symbols before its n-gram. An n-gram without a count
    has what its context leaves to the lower order, and all of that where the context has no count either; the unigrams are
    interpolated with the uniform distribution.
    """
    levels, asked = {ORDER: counts}, {ORDER: wanted.select("lang", "g")}
    for o in range(ORDER - 1, 0, -1):
        suffix = F.col("g").bitwiseAND((1 << (16 * o)) - 1)
        levels[o] = levels[o + 1].groupBy("lang", suffix.alias("g")).agg(F.count("*").alias("c"))
        asked[o] = asked[o + 1].select("lang", suffix.alias("g")).distinct()
    lower = None
    for o in range(1, ORDER + 1):
        own, context = discounted(levels[o])
        x = asked[o].join(own, ["lang", "g"], "left").withColumn("h", F.shiftrightunsigned("g", 16)).join(context, ["lang", "h"], "left")
        mine, rest = F.coalesce(F.col("own") / F.col("total"), F.lit(0.0)), F.coalesce(F.col("left") / F.col("total"), F.lit(1.0))
        if lower is None:
            x = x.select("lang", "g", (mine + rest / SYMBOL_KINDS).alias("p"))
        else:
            suffix = F.col("g").bitwiseAND((1 << (16 * (o - 1))) - 1)
            low = lower.select(F.col("lang").alias("l_lang"), F.col("g").alias("l_g"), F.col("p").alias("l_p"))
            x = x.join(low, (F.col("lang") == F.col("l_lang")) & (suffix == F.col("l_g"))).select("lang", "g", (mine + rest * F.col("l_p")).alias("p"))
        lower = x
    return lower


def held_out_model(grams_: DataFrame) -> DataFrame:
    """(h, lp): the log probability of each n-gram of a language and fold by the other fold's counts, by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = table_hash(b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.log(b.column(2).to_numpy()).astype(np.float32))], ["h", "lp"])

    other = grams_.select(F.col("lang").bitwiseXOR(F.lit(1)).alias("lang"), "g", "c")
    return kneser_ney(other, grams_).mapInArrow(run, "h long, lp float")


def quality_rules(docs: DataFrame, width: float = WIDTH, least: float = LEAST, held: int = HELD) -> DataFrame:
    """Per row of docs (doc_id, text, lang): the base counts, base_failed, log_ppl, the band, kept.

    A document is kept if its base counts pass and its mean negative log probability lies within the band of its language:
    the quartiles' middle plus and minus `width` interquartile ranges (`least` nats at least) over the texts that pass. A
    null text has no words; null or odd languages share code 0; repeated rows and null ids give a row each; an empty table
    gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    grams_ = stash(count_grams(docs), "grams")
    model = stash(held_out_model(grams_), "model")
    parts = max(1, -(-model.count() // held))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(docs["doc_id"].alias("doc_id"), language_code(docs).alias("lang"), text_column(docs).alias("text"), fold_code(docs).alias("code"), F.lit(0.0).alias("logs"))
    for part in range(parts):
        table = gathered(model.where(F.pmod(F.xxhash64("h"), F.lit(parts)) == part), np.float32)  # about `held` entries of 12 bytes
        shared, last = spark.sparkContext.broadcast(table), part == parts - 1

        def run(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            known, lp = shared.value
            for batch in batches:
                code, n = batch.column(3).to_numpy(), batch.num_rows
                base, size, logs = np.zeros((n, 5), np.int64), np.zeros(n, np.int64), batch.column(4).to_numpy().copy()
                for i, j, data, off in chunks(batch.column(2)):
                    key, points = char_grams(data, off)
                    size[i:j] = np.diff(points)
                    total = np.zeros(len(key) + 1)
                    for c in np.unique(code[i:j]):
                        at = np.flatnonzero(np.repeat(code[i:j] == c, size[i:j]))
                        kinds, back = np.unique(key[at], return_inverse=True)
                        total[at + 1] = looked_up(known, lp, table_hash(np.full(len(kinds), c), kinds))[back]
                    np.cumsum(total, out=total)
                    logs[i:j] += total[points[1:]] - total[points[:-1]]
                    if last:
                        base[i:j] = base_counts(data, off)
                if not last:
                    yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(logs)], ["doc_id", "lang", "text", "code", "logs"])
                    continue
                columns = [batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(base[:, k])) for k in range(5)), pa.array(np.round(-logs / np.maximum(1, size), 9))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", *(x.split()[0] for x in BASE.split(", ")), "log_ppl"])

        scored = rows.mapInArrow(tidy(run), f"doc_id {kind}, lang int, {BASE}, log_ppl double" if last else f"doc_id {kind}, lang int, text string, code int, logs double")
        if not last:
            rows = stash(scored, "logs")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = stash(scored.withColumn("base_failed", failed), "scored")
    drop_stash(grams_, model, *([rows] if parts > 1 else []))
    q = scored.where(~F.col("base_failed")).groupBy("lang").agg(F.percentile_approx("log_ppl", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(10000)).alias("q"))
    half = F.greatest(F.lit(least), width * (F.col("q")[2] - F.col("q")[0]))
    bands = q.select(F.col("lang").alias("b_lang"), (F.col("q")[1] - half).alias("low_band"), (F.col("q")[1] + half).alias("high_band"))
    out = scored.join(F.broadcast(bands), F.col("lang") == F.col("b_lang"), "left")  # a row for each language code: bounded
    kept = ~F.col("base_failed") & F.col("log_ppl").between(F.col("low_band"), F.col("high_band"))
    return out.select("doc_id", *(x.split()[0] for x in BASE.split(", ")), "base_failed", F.coalesce(kept, F.lit(False)).alias("kept"), "log_ppl", "low_band", "high_band")
