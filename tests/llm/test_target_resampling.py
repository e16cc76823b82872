import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from arborseed.llm import target_resampling as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def features(text, grams=1):
    w = WORD.findall(lower(text))
    return [" ".join(w[i : i + k]) for k in range(1, grams + 1) for i in range(len(w) - k + 1)], len(w)


def by_hand(docs, target, grams, buckets, least, percent, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for f in features(x, grams)[0]:
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for i, x in docs:
        f, n_words = features(x, grams)
        weight = math.floor(sum(gain[bucket(g)] for g in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


def texts(rng, n):
    pool = ["the", "The", "été", "ÉTÉ", "x1", "42", "漢字", "a", "b", "cat's", "no-one", "_", "\x7f"]
    return [None, "", "...", "A", *(rng.choice([" ", "\n", "--"]).join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(n))]


@pytest.mark.parametrize("grams,buckets,percent", [(1, 10_000, 10), (3, 50, 40), (2, 7, 100)])
def test_ranks_match_brute_force(spark, grams, buckets, percent):
    rng = random.Random(grams)
    rows = [(rng.choice([None, i, -i]) if i % 9 == 0 else i, x) for i, x in enumerate(texts(rng, 150))]
    target = texts(rng, 20)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, rank int, score string").repartition(4)
    got = R.resampled(df, spark.createDataFrame([(t,) for t in target], "text string"), grams, buckets, 20, percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = by_hand(rows, target, grams, buckets, 20, percent, 2024)
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_repeated_rows_share_the_ranks_there_are(spark):
    rows = [(7, "one two three")] * 30 + [(8, "four five six")] * 10
    got = R.resampled(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "text string"), min_words=3, percent=25).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 11)) and len(got) == 40


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert R.resampled(none, none).count() == 0


@pytest.mark.parametrize("most", [1 << 20, 64, 7])
def test_long_texts_in_shards(most):
    rng = random.Random(most)
    held = [*texts(rng, 20), " ".join(rng.choices(["ab", "c", "ab c"], k=500)), "w" * 300]
    for grams in (1, 2, 3):
        want = [sorted(zlib.crc32(f.encode()) % 97 for f in features(x, grams)[0]) for x in held]
        got, n = [[] for _ in held], np.zeros(len(held), int)
        for row, bucket, rows, own in R.buckets_of(pa.array(held, pa.string()), grams, 97, most):
            n[rows] += own
            for r, b in zip(row, bucket):
                got[r].append(b)
        assert [sorted(x) for x in got] == want and n.tolist() == [features(x)[1] for x in held]


def test_suffixes_are_in_order():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 3, 200)
    room = np.repeat([50, 100, 200], [50, 50, 100]) - np.arange(200)
    for depth in (1, 2, 5, 8):
        order, shared = R.suffix_array(ids, room, depth)
        cut = [tuple(ids[i : i + min(depth, room[i])]) for i in order]
        assert cut == sorted(cut) and sorted(order) == list(range(200))
        for a, b, n in zip(cut, cut[1:], shared[1:]):
            assert n == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def test_sql(spark, tmp_path):
    rng = random.Random(5)
    rows, target = list(enumerate(texts(rng, 100))), texts(rng, 9)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    spark.createDataFrame([(t,) for t in target], "text string").write.parquet(str(tmp_path / "t"))
    got = duckdb.sql(R.oracle(f"'{tmp_path}/d/*.parquet'", f"'{tmp_path}/t/*.parquet'")).fetchall()
    assert sorted(got, key=repr) == by_hand(rows, target, 1, 10_000, 20, 10, 2024)
