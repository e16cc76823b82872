import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arborseed.llm import induced_dedup as D
from arborseed.llm import induced_sort as S


def shared(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60), st.sampled_from([1, 5, 10_000]), st.booleans())
def test_suffixes_and_common_prefixes(symbols, most, twice):
    t = [*symbols, *(symbols if twice else []), 0]
    order, common = S.suffixes(np.array(t, np.int32), most)
    want = sorted(range(len(t)), key=lambda i: t[i:])
    assert list(order) == want
    assert list(common) == [0, *(shared(t[a:], t[b:]) for a, b in zip(want, want[1:]))]


def test_queue_spills_and_keeps_the_order():
    rng = np.random.default_rng(0)
    queue, want = S.RunQueue(100), []
    for turn in range(50):
        symbol = rng.integers(0, 40, 30)
        queue.push(symbol, np.arange(30) + 30 * turn, np.zeros(30))
        want += [(int(s), 30 * turn + i) for i, s in enumerate(symbol)]
    assert queue.spilled > 500
    got = []
    for bound in (7, 8, 31, S.NONE):
        assert queue.head() < bound
        part = queue.below(bound, take=True)
        got += list(zip(part[0].tolist(), part[1].tolist()))
    assert got == sorted(want) and queue.head() == S.NONE


def test_a_batch_of_the_queue_is_merged_once_and_range_minima_are_exact(monkeypatch):
    asked = {"below": 0, "drop": 0}
    for name in asked:
        kept = getattr(S.RunQueue, name)
        monkeypatch.setattr(S.RunQueue, name, lambda self, *a, name=name, kept=kept: (asked.__setitem__(name, asked[name] + 1), kept(self, *a))[1])
    rng = random.Random(5)
    t = [rng.randint(1, 4) for _ in range(500)] * 2 + [0]
    order, common = S.suffixes(np.array(t, np.int32), 64)
    want = sorted(range(len(t)), key=lambda i: t[i:])
    assert order.tolist() == want and common.tolist() == [0, *(shared(t[a:], t[b:]) for a, b in zip(want, want[1:]))]
    assert asked["below"] == asked["drop"] > 0
    values, first = np.array([5, 3, 9, 1, 7, 7, 2], np.int32), np.array([0, 2, 4, 6, 0])
    last = np.array([0, 5, 5, 6, 6])
    assert S.range_minima(values, first, last).tolist() == [min(values[a : b + 1]) for a, b in zip(first, last)]


def test_runs_hold_every_window_once_and_depend_on_content():
    rng = random.Random(3)
    base = bytes(rng.choice(b"ab ") for _ in range(900))
    texts = [base, b"x" * 50 + base[100:700] + b"y" * 500, b"", b"short", b"z" * 3000]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    begin, end, row, key, _ = D.runs(data, off, 48, 16)
    by = {}
    for b, e, r, k in zip(begin.tolist(), end.tolist(), row.tolist(), key.tolist()):
        for w in range(b, e):
            assert off[r] <= w and w + 48 <= off[r + 1] and (r, w) not in by
            by[r, w] = k
    assert len(by) == sum(max(0, len(t) - 47) for t in texts)
    kept = {}
    for (_, w), k in by.items():
        assert kept.setdefault(data[w : w + 48].tobytes(), k) == k


def check(spark, texts, n, shard, most, parts=3):
    df = spark.createDataFrame([(d, t, "x") for d, t in texts], "doc_id long, text string, name string").repartition(parts)
    raw = [(d, (t or "").encode()) for d, t in texts]
    seen = Counter(b[i : i + n] for _, b in raw for i in range(len(b) - n + 1))
    want = []
    for d, b in raw:
        gone = set()
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone.update(range(i, i + n))
        kept = bytes(c for i, c in enumerate(b) if i not in gone)
        want.append((d, len(b), len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in D.dedup_repeats(df, n, shard, most).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


@pytest.mark.parametrize("seed", [0, 1])
def test_matches_brute_force(spark, seed):
    """Small shards, and one shard far beyond the queue's memory, so that the queue spills."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    passages = [word(60), word(90), "z" * 120]
    texts = [None, "", "short"]
    for _ in range(25):
        texts.append("".join(rng.choice([word(rng.randint(0, 50)), rng.choice(passages), rng.choice(passages)[5:70]]) for _ in range(3)))
    texts += [texts[-1], texts[5]]
    check(spark, list(enumerate(texts)), 48, *((600, 50) if seed else (1 << 20, 40)))


def test_repeated_rows_null_ids_and_long_texts(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    long = word(30_000)
    texts = [(1, word(500)), (1, word(500)), (None, "q" * 700), (None, word(450)), (2, long), (3, "w" + long[10_000:20_000]), (4, long[:399]), (5, long[:400])]
    texts += [(6, x := word(900)), (6, x), (None, x), (7, None), (7, None), (8, "")]
    got = check(spark, texts, 400, 1 << 16, 10_000)
    assert sum(r[2] > 0 for r in got) >= 6
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert D.dedup_repeats(empty).count() == 0


def test_a_text_is_cut_into_overlapping_pieces(spark, monkeypatch):
    rng = random.Random(6)
    texts = [(d, "".join(rng.choice("abcdefgh ") for _ in range(5000))) for d in range(3)]
    texts.append((9, "".join(t[1000:3000] for _, t in texts)))
    monkeypatch.setattr(D, "PIECE", 700)
    whole = [D.runs(*x[3:], 400, 32) for x in D.pieces(D.pa.array([texts[-1][1]]), 400)]
    assert sum(int((e - b).sum()) for b, e, *_ in whole) == 6000 - 399
