import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from arborseed.llm import context_mix as C


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


TEXTS = [None, "", "The cat sat", "the CAT ran é", "ü ß x", "a b a b\na  b", "the dog sat on the mat " * 9]


@pytest.mark.parametrize("held", [1000, 4])
def test_base_scores_match_brute_force(spark, held):
    docs = [(i, TEXTS[i % len(TEXTS)]) for i in range(60)]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, score string").repartition(3)
    rows = {r["doc_id"]: r for r in C.mixing_scores(df, held).collect()}
    out = {d for d, _ in docs if zlib.crc32(str(d).encode()) % 7 == 2}
    c = Counter(t for d, x in docs if d not in out for t in tokens(x))
    n, v = sum(c.values()), len(c)
    for d, x in docs:
        t, r = tokens(x), rows[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (d in out, len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert r["score"] < 0 and r["bits_per_byte"] > 0


def test_bytes_of_a_context_sum_to_one():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 9, (C.ORDERS, C.SLOTS, 2))
    mixer = C.Mixer(counts)
    mixer.learn(rng.integers(0, 1 << 40, 3000).astype(np.uint64))
    key = (np.uint64(0x61626364) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
    assert (10 ** mixer.log_probability(key)).sum() == pytest.approx(1.0)


def test_stream_and_empty_table(spark):
    text = [b" Ab  c\n", b"", b"\xc3\xa9 Z"]
    data = np.frombuffer(b"".join(text), np.uint8)
    off = np.array([0, 7, 7, 11])
    _, start, end, first = C.vocabulary(data, off)
    got, s_off = C.stream(data, start, end, first)
    assert [got[a:b].tobytes() for a, b in zip(s_off, s_off[1:])] == [b"ab c \n", b"\n", b"\xc3\xa9 z \n"]
    assert C.mixing_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def some_events(spark, seed=1):
    rng = np.random.default_rng(seed)
    key = np.unique(rng.integers(97, 101, (5000, 5)) @ (1 << 8 * np.arange(5)))
    c = rng.integers(0, 1000, len(key))
    events = spark.createDataFrame(list(zip(key.tolist(), c.tolist())), "h long, c long").repartition(3)
    return key, c, events


def test_counts_are_exact_for_every_context(spark):
    key, c, events = some_events(spark)
    nearest, want = C.nearest_counts(events), Counter()
    for x, n in zip(key.tolist(), c.tolist()):
        for k in range(1, C.ORDERS + 1):
            for d in range(8):
                want[k, x >> 8 & (1 << 8 * k) - 1, d, (x & 255) >> 8 - d, x >> 7 - d & 1] += n
    seen = 0
    for row in C.grouped(events, 10 * C.DEALT).collect():
        h, w = np.frombuffer(row["h"], np.uint64), np.frombuffer(row["c"], np.int64)
        seen += len(h)
        for d, (n, bit) in enumerate(C.counts_of(h, w.astype(float), nearest)):
            for i, x in enumerate(h.tolist()):
                assert bit[i] == x >> 7 - d & 1
                for k in range(1, C.ORDERS + 1):
                    assert n[k - 1, i].tolist() == [want[k, x >> 8 & (1 << 8 * k) - 1, d, (x & 255) >> 8 - d, b] for b in (0, 1)]
    assert seen == len(key)


def test_mixer_learns_from_every_training_byte(spark):
    key, c, events = some_events(spark)
    nearest = C.nearest_counts(events)
    mixer = C.learned(C.grouped(events, 10 * C.DEALT), nearest)
    assert (mixer.hits - C.Mixer().hits).sum() == pytest.approx(8 * c.sum())
    again = C.Mixer()
    for _ in range(C.ROUNDS):
        again.stepped(sum(again.gradients(n[:, c > 0], C.place_in_word(key.astype(np.uint64))[c > 0], b[c > 0], c[c > 0]) for n, b in C.counts_of(key.astype(np.uint64), c.astype(float), nearest)))
    assert mixer.weights == pytest.approx(again.weights, abs=1e-6)


def test_scores_do_not_depend_on_passes(spark):
    df = spark.createDataFrame([(i, TEXTS[i % len(TEXTS)]) for i in range(30)], "doc_id long, text string")
    a, b = ({r["doc_id"]: r["score"] for r in C.mixing_scores(df, held).collect()} for held in (1000, 60))
    assert a == pytest.approx(b)


def test_keys_tell_the_word_so_far_apart():
    text = b"abcdefgh xbcdefgh bcdefgh \n"
    data = np.frombuffer(text, np.uint8)
    key = C.packed(data, np.array([0, len(data)]))
    at = {w: i for i, w in ((7, "abcdefgh"), (16, "xbcdefgh"), (24, "bcdefgh"))}
    near = np.uint64((1 << 40) - 1)
    assert len({int(key[i] & near) for i in at.values()}) == 1 and len({int(key[i]) for i in at.values()}) == 3
    want, place = [], 0
    for c in text:
        want.append(min(place, 4))
        place = 0 if c in b" \n" else place + 1
    assert C.place_in_word(key).tolist() == want


def test_scores_beat_the_base_on_most_held_out_texts(spark):
    import random

    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    docs = [(d, " ".join(rng.choices(words, weights, k=150) + [words[0] + str(d)])) for d in range(600)]
    got = C.mixing_scores(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    out = [r for r in got if r["held_out"]]
    assert len(out) > 40 and sum(r["score"] > r["base_score"] for r in out) > 0.8 * len(out)


def test_beginnings_are_those_of_frequent_words(spark):
    from arborseed.llm.common import Hashed, in_bitmap

    rows = [("Abcdefg abcdefg xyzzy", False)] * 3 + [("rareword xyzzy", False), ("heldout " * 20, True)]
    tokens = C.counted_tokens(spark.createDataFrame(rows, "text string, held_out boolean").repartition(2))
    assert {(bytes(r["w"]).decode() if r["w"] else None): r["c"] for r in tokens.collect()} == {"abcdefg": 6, "xyzzy": 4, "rareword": 1, None: 4}
    bits = C.beginnings(tokens, 4)
    said = {w for w in ("abcd", "abcdef", "abcdefg", "abc", "xyzz", "rare", "held", "bcde") if in_bitmap(bits, Hashed(np.frombuffer(w.encode(), np.uint8)).of(np.array([0]), np.array([len(w)])))[0]}
    assert said == {"abcd", "abcdef", "abcdefg", "xyzz"}


def test_scores_match_a_model_counted_by_hand(spark, monkeypatch):
    """Every decision of every byte, its counts taken from dictionaries of the training texts, under the mixer that was learned."""
    import random

    rng = random.Random(5)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 8))) for _ in range(25)]
    docs = [(d, " ".join(rng.choices(words, k=rng.choice([0, 1, 12])))) for d in range(40)] + [(3, None), (None, "Abcde abcde")]
    learned, kept = C.learned, []
    monkeypatch.setattr(C, "learned", lambda *a: kept.append(learned(*a)) or kept[-1])
    got = C.mixing_scores(spark.createDataFrame(docs, "doc_id long, text string").repartition(2)).collect()
    mixer = kept[0]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    seen = Counter(w for d, t in docs if not held(d) for w in tokens(t) if w)
    often = {w[:n] for w, c in seen.items() if c >= C.OFTEN for n in range(C.NEAR, len(w) + 1)}

    def events(text):
        whole = "".join(w + " " for w in tokens(text)[:-1]).encode() + b"\n"
        for i, b in enumerate(whole):
            near = (b"\n" * 4 + whole[:i])[-4:]
            begun = (b"\n" + whole[:i]).replace(b" ", b"\n").rsplit(b"\n", 1)[1].decode()
            yield b, near, begun if len(begun) >= C.NEAR and begun in often else ""

    def contexts(b, near, begun, depth):
        node = (1 << depth) | b >> 8 - depth
        return [*((k, near[-k:], node) for k in range(1, 5)), (5, near, begun, node)]

    counts = Counter()
    for d, t in docs:
        if not held(d):
            for b, near, begun in events(t):
                for depth in range(8):
                    for c in contexts(b, near, begun, depth):
                        counts[c, b >> 7 - depth & 1] += 1

    def score(text):
        total = 0.0
        for b, near, begun in events(text):
            tail = (b" " + near).replace(b"\n", b" ").rsplit(b" ", 1)[1]
            place = np.array([min(len(tail), C.NEAR)])
            for depth in range(8):
                n = np.array([[[counts[c, 0], counts[c, 1]]] for c in contexts(b, near, begun, depth)], float)
                x, gate = mixer.inputs(n, place)
                p, cell = mixer.mixed(x, gate)
                q = mixer.refined(p, gate, cell)[0]
                total += math.log10(q if b >> 7 - depth & 1 else 1 - q)
        return total

    by = {}
    for d, t in docs:
        by.setdefault(d, []).append(score(t))
    for r in got:
        assert min(abs(r["score"] - s) for s in by[r["doc_id"]]) < 1e-3


def test_repeated_rows_and_a_very_long_text(spark):
    long = " ".join(f"w{i % 5000}" for i in range(200_000))
    df = spark.createDataFrame([(1, long), (4, "w1 w2"), (4, "w1 w2"), (4, "w3"), (None, "w1 w2")], "doc_id long, text string").repartition(2)
    got = C.mixing_scores(df).collect()
    assert len(got) == 5 and {r["n_tokens"] for r in got} == {200_001, 3, 2}
    assert len({r["score"] for r in got if r["n_tokens"] == 3}) == 1 and all(r["score"] < 0 for r in got)


def test_texts_are_written_once_however_small_the_groups(spark, monkeypatch):
    stash, made = C.stash, []
    monkeypatch.setattr(C, "stash", lambda df, name: made.append(name) or stash(df, name))
    df = spark.createDataFrame([(i, TEXTS[i % len(TEXTS)]) for i in range(30)], "doc_id long, text string")
    assert C.mixing_scores(df, 1).count() == 30 and len(made) == 2


def test_order_keeps_events_and_their_buckets():
    key = np.random.default_rng(3).integers(0, 1 << 63, 4000).astype(np.uint64)
    order = C.Order(7)
    value = np.sort(order.sortable(key))
    assert sorted(order.key(value).tolist()) == sorted(key.tolist())
    where = {}
    for bucket, which, a, b in order.cuts(value, value):
        if which == 0:
            for near in set((order.key(value[a:b]) >> np.uint64(8) & np.uint64(0xFFFF)).tolist()):
                assert where.setdefault(near, bucket) == bucket
    x = np.sort(key)
    assert C.unpacked(C.pa.scalar(C.packed_bytes(x, np.uint64, True), C.pa.binary()), len(x), np.uint64, True).tolist() == x.tolist()


def test_a_text_shorter_than_a_context():
    assert [hex(k) for k in C.packed(np.frombuffer(b"a \n", np.uint8), np.array([0, 3])).tolist()] == ["0xa0a0a0a61", "0xa0a0a6120", "0xa0a61200a"]


def test_events_of_a_kind_are_mixed_once_and_passes_share_a_dictionary():
    rng = np.random.default_rng(4)
    word = np.arange(1, 301, dtype=np.uint64)  # words that end alike: 300 longest contexts over the same nearest bytes
    key = word << np.uint64(40) | np.uint64(0x6E6F6974 << 8) | rng.choice(np.array([32, 115], np.uint64), 300)
    key[:20] = key[0] & np.uint64((1 << 40) - 1)
    key = np.unique(np.r_[key, key ^ np.uint64(1) << np.uint64(62)])
    for c in (rng.integers(0, 3, len(key)).astype(float), rng.integers(0, 3, len(key)) * 2.0**31):
        nearest = np.full((256, 256, 2), 7.0)
        kinds = list(C.kinds_of(key, c, nearest))
        assert len(kinds) == 8
        for depth, (n, bit, first, kind) in enumerate(kinds):
            assert len(first) == len(bit) == n.shape[1] < 40 and kind.max() + 1 == len(first)
            symbol = key & np.uint64(255)
            for at in rng.integers(0, len(key), 30).tolist():
                assert bit[kind[at]] == int(symbol[at]) >> 7 - depth & 1 and kind[first[kind[at]]] == kind[at]
                same = symbol >> np.uint64(8 - depth) == symbol[at] >> np.uint64(8 - depth)
                for k, seen in enumerate(C.SEEN[1:], 1):
                    own = same & (key >> np.uint64(8) & seen == key[at] >> np.uint64(8) & seen)
                    for b in (0, 1):
                        assert n[k, kind[at], b] == c[own & (symbol >> np.uint64(7 - depth) & np.uint64(1) == b)].sum()
    assert list(C.kinds_of(key[:0], np.zeros(0), nearest)) == []
    values, at = C.in_order_of([C.pa.array([9, 4, 9], C.pa.uint64()).dictionary_encode(), C.pa.array([2**63 + 1, 4], C.pa.uint64()).dictionary_encode()], np.array([0.4, 0.9, 6.3]))
    assert [values[x].tolist() for x in at] == [[0.9, 0.4, 0.9], [6.3, 0.4]]
