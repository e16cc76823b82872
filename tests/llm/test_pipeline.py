import os
import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from arborseed.llm.common import stash

DIR = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "a very long text goes on and on with number {} in it "


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the test tables are not here")
def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, size = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stash(stage(spark, docs, DIR), name)
        assert docs.columns == columns
        assert docs.count() <= size
        size = docs.count()
    assert 0.5 * 200 < size < 200
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DIR).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert all(r["offset"] + r["length"] <= 1024 for r in packed)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, log_weight double, _gone string, gone_id string, leak_id int, c0 int, w int, _text int, id int, tok int, grp int"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """(folder of tables, rows): nulls in every column, empty and very long texts, ties, repeated rows and ids, clashing names."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    item = [word() for _ in range(24)]
    rows = []
    for d in range(60):
        body = [word() for _ in range(rng.choice([40, 120]))]
        if d % 10 == 3:
            body[5:5] = item
        rows.append((d, "boiler line\n" + " ".join(body) + ("\nboiler line" if d % 2 else ""), "en", f"s{d % 7}"))
    near = rows[1][1].split(" ")
    rows += [(70, rows[0][1], "en", "s1"), (71, " ".join([*near[:-1], "other"]), "en", "s2"), rows[2], rows[2], (4, "a second text of one id " + rows[5][1], "en", "s3")]
    rows += [(80, None, None, None), (81, "", "en", "s1"), (None, None, None, None), (None, rows[6][1], "en", "s4"), (None, rows[6][1], "en", "s4"), (82, " \n\t\n", "en", "s5")]
    rows += [(90, " ".join(LONG.format(i) for i in range(30_000)), "en", "s6")]
    full = [(d, t, lang, s, None if t is None else len(t), None, "g", None, d and d % 5, 1, None, 2, 3, 4, 5) for d, t, lang, s in rows]
    at = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(0, " ".join(item)), (1, None), (None, "x")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(d, 1, 0) for d in range(0, 60, 2)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, full


def same(got, want):
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("k", range(5))
def test_a_stage_on_odd_rows_and_on_none(spark, odd, k):
    at, rows = odd
    name, stage = corpus_pipeline.STAGES[k]
    docs = spark.read.parquet(f"{at}/documents.parquet")
    out = stage(spark, docs, at)
    got = out.collect()
    none = stage(spark, docs.limit(0), at)
    assert none.count() == 0
    if name == "pack":
        tokens = defaultdict(int)
        for r in got:
            tokens[r["doc_id"], r["doc_tokens"], r["ids_crc32"] if r["doc_tokens"] <= 1024 else None] += r["length"]
        assert sum(tokens.values()) == sum(r["length"] for r in got) and Counter(r["doc_id"] for r in got if r["start"] == 0) == Counter(r[0] for r in rows)
        return
    assert out.columns == docs.columns == none.columns
    if name == "quality":  # every labelled document is good, so all are drawn
        same(got, rows)
    elif name == "lines":
        sites, first = defaultdict(set), {}
        for d, t, _, s, *_ in rows:
            for line in (t or "").split("\n"):
                if WORDS.search(line):
                    if s is not None:
                        sites[line.strip()].add(s)
                    if d is not None:
                        first[line.strip()] = min(d, first.get(line.strip(), d))
        want = []
        for r in rows:
            gone = lambda x: WORDS.search(x) and len(sites[x.strip()]) >= 5 and r[0] is not None and r[0] != first[x.strip()]  # noqa: B023, E731
            t = None if r[1] is None else "\n".join(x for x in r[1].split("\n") if not gone(x))
            want.append((r[0], t, *r[2:4], None if t is None else len(t), *r[5:]))
        same(got, want)
    elif name == "near_duplicates":
        sets = [(r[0], {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())) for r in rows if r[0] is not None for w in [WORDS.findall((r[1] or "").lower())]]
        root = {d: d for d, _ in sets}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for i, (a, x) in enumerate(sets):
            for b, y in sets[:i]:
                if x and 100 * len(x & y) >= 80 * len(x | y):
                    low, high = sorted((find(a), find(b)))
                    root[high] = low
        same(got, [r for r in rows if r[0] is None or find(r[0]) == r[0]])
    else:
        same(got, [r for r in rows if r[0] is None or r[0] >= 60 or r[0] % 10 != 3])
