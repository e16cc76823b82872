import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from arborseed.llm import spelling_variants as V

WORD = re.compile("[A-Za-zÀ-ÿ]+")
low = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def counts_by_hand(rows):
    n = Counter()
    for i, text in rows:
        for run in WORD.findall(text or ""):
            w = low(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_hand(n):
    near = {a: [b for b in n if one_edit(a, b)] for a in n}
    form = {}
    for a in n:
        best = min(near[a], key=lambda b: (-n[b], b), default=None)
        form[a] = best if best and n[best] >= 10 * n[a] else None
    out = []
    for a in n:
        root = a
        while form[root]:
            root = form[root]
        out.append((a, form[a], root, n[a], len(near[a]), n[form[a]] if form[a] else None))
    return sorted(out, key=repr)


def corpus(rng):
    base = ["aaaaaaa", "aaaaaaaa", "aaaaaaab", "abababab", "bababab", "étéétéé", "Straßenbahn", "International", "INTERNATIONAL", "ÉCOLESXY", "wonderful", "wonderfull"]
    base += ["".join(rng.choice("ab") for _ in range(rng.randint(6, 10))) for _ in range(80)]
    rows = [(i, " ".join(rng.choices(base, [1 / (k + 1) for k in range(len(base))], k=rng.randint(0, 120)))) for i in range(120)]
    return [*rows, (None, "wonderful don't wonderful"), (500, None), (501, ""), (501, "wonderful-wonderful"), (501, "wonderful-wonderful"), (502, "z" * 20_000), (503, "z" * 20_000), (503, "z" * 20_001 + " " + "z" * 20_001)]


@pytest.mark.parametrize("heavy", [V.HEAVY, 10, 1])
def test_variants_match_brute_force(spark, heavy):
    rows = corpus(random.Random(3))
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, word string").repartition(4)
    got = V.spelling_variants(df, heavy=heavy)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    n = counts_by_hand(rows)
    want = by_hand(n)
    assert sum(r[4] for r in want) > 50 and any(r[1] for r in want)
    assert sorted(map(tuple, got.collect()), key=repr) == want


@pytest.mark.parametrize("heavy", [V.HEAVY, 3, 0])
def test_near_words_lose_no_pair(spark, heavy):
    """All words of 7 over three letters round a few centres: every key is refined as far as it goes."""
    rng = random.Random(heavy)
    words = {"".join(rng.choice("ab") for _ in range(rng.choice([7, 8, 8, 9]))) for _ in range(300)}
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    got = [tuple(r)[:2] for r in V.near_words(df, heavy).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_roots_follow_long_chains(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(17)] + [("x", "w3"), ("y", "z")]
    got = dict(map(tuple, V.roots(spark.createDataFrame(forms, "word string, form string")).collect()))
    assert got == {**{f"w{i}": "w17" for i in range(17)}, "x": "w17", "y": "z"}


def test_texts_with_roots(spark):
    found = spark.createDataFrame([("wonderfull", "wonderful", "wonderful", 2, 1, 40), ("wonderful", None, "wonderful", 40, 1, None)], "word string, form string, root string, n long, n_near long, form_n long")
    docs = spark.createDataFrame([(1, "A WONDERFULL, wonderfull day.\n", 1), (2, None, 2), (2, "wonderful", 3)], "doc_id long, text string, root int")
    got = {r["root"]: r["normal_text"] for r in V.with_roots(docs, found).collect()}
    assert got == {1: "A wonderful, wonderful day.\n", 2: None, 3: "wonderful"}


def test_empty_table_and_sql(spark, tmp_path):
    assert V.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = corpus(random.Random(4))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    got = duckdb.sql(V.oracle(f"'{tmp_path}/d/*.parquet'")).fetchall()
    assert sorted(got, key=repr) == by_hand(counts_by_hand(rows))


def test_counts_without_errors(spark):
    docs = spark.createDataFrame([(1, "Wonderful wonderful Éclairs Éclairs")], "doc_id long, text string")
    assert {r["word"]: r["n"] for r in V.word_counts(docs, errors=None).collect()} == {"wonderful": 2, "Éclairs": 2}
