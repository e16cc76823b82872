import random
import re

from arborseed.llm import jaccard_join


def brute(docs, n, percent):
    rows = []
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        rows.append((d, {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())))
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, one) in enumerate(rows):
        for b, two in rows[:i]:
            both = len(one & two)
            if a is not None and b is not None and both and 100 * both >= percent * len(one | two):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted(((d, len(x), find(d)) for d, x in rows), key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    base = [[word() for _ in range(rng.randint(1, 90))] for _ in range(12)]
    texts = [None, "", " \t\n", "A b", "a  B", "one two three four", "ONE two three\nfour"]
    for b in base:
        for _ in range(rng.choice([1, 2, 14])):
            c = [w if rng.random() > rng.choice([0.0, 0.02, 0.05]) else word() for w in b]
            texts.append(rng.choice([" ", "\n"]).join(c))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_components_match_brute_force(spark):
    for seed, (n, percent) in enumerate([(4, 85), (5, 80), (4, 70)]):
        docs = corpus(seed)
        df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n int, toks string").repartition(3)
        got = sorted((tuple(r) for r in jaccard_join.jaccard_components(df, n, percent).collect()), key=str)
        assert got == brute(docs, n, percent)


def test_odd_rows(spark):
    text = "a b c d e f"
    df = spark.createDataFrame([(None, text), (3, text), (3, text), (2, text), (7, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard_join.jaccard_components(df).collect()), key=str)
    assert got == sorted([(None, 3, None), (3, 3, 2), (3, 3, 2), (2, 3, 2), (7, 0, 7)], key=str)
    assert jaccard_join.jaccard_components(df.limit(0)).count() == 0


def test_repeated_ids_do_not_depend_on_partitions(spark):
    rng = random.Random(9)
    a, b, c = (" ".join(f"{x}{rng.randrange(50)}" for _ in range(60)) for x in "xyz")
    docs = [(1, a), (2, b), (5, a + " q"), (5, b + " r"), (5, ""), (6, None), (6, c), (7, c), (None, a), (8, "one"), (8, "two"), (9, "two"), (9, "two"), (10, "w " * 40_000), (11, "w " * 39_000)]
    for parts in (1, 3, 4, 7):
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
        got = sorted((tuple(r) for r in jaccard_join.jaccard_components(df).collect()), key=str)
        assert got == brute(docs, 4, 85)


def test_histograms_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(0)
    sizes = np.array([0, 1, 5, 40, 3000, 47, 2900])
    sets = [np.unique(rng.integers(0, 1 << 64, k, dtype=np.uint64)) for k in sizes]
    sets[5] = np.union1d(sets[3], sets[2])
    sets[6] = sets[4][:2900]
    g, r = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    bins = jaccard_join.histograms(g, r, np.bincount(r, minlength=len(sets))).to_pylist()
    one, two = zip(*((i, j) for i in range(len(sets)) for j in range(len(sets))))
    got = jaccard_join.differences([bins[i] for i in one], [bins[j] for j in two])
    assert all(x <= len(np.setxor1d(sets[i], sets[j])) for i, j, x in zip(one, two, got))
    assert sum(got) > 0.5 * sum(len(np.setxor1d(sets[i], sets[j])) for i, j in zip(one, two))
