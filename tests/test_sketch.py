import random

import pytest

from arborseed.functions import sketch as K

RC = str.maketrans("ACGT", "TGCA")
genome = lambda rng, n: "".join(rng.choice("ACGT") for _ in range(n))


def slow_hash(s):
    def one(x):
        h = 0
        for c in x:
            h = ((h << 1) | (h >> 63)) & K.M
            h ^= K.NT[c]
        return h

    return one(s), one(s[::-1].translate(RC))


def slow_syncmers(s, k, w, t, opened):
    out = []
    for i in range(len(s) - k + 1):
        x = s[i : i + k]
        if set(x) - set("ACGT"):
            continue
        hit = False
        for y in (x, x[::-1].translate(RC)):
            h = [slow_hash(y[j : j + w])[0] for j in range(k - w + 1)]
            hit |= h[t] == min(h) or (not opened and h[k - w - t] == min(h))
        f, r = slow_hash(x)
        if hit and f != r:
            out.append((min(f, r), r < f, i))
    return out


@pytest.mark.parametrize("opened", [False, True])
@pytest.mark.parametrize("t", [0, 2])
def test_syncmers_match_a_slow_model(opened, t):
    rng = random.Random(3)
    s = genome(rng, 150) + "NN" + genome(rng, 60)
    h, r, p = K.syncmers(s, 15, 8, t, opened)
    assert list(zip(h.tolist(), r.tolist(), p.tolist())) == slow_syncmers(s, 15, 8, t, opened)


def test_hashes_don_t_depend_on_the_strand():
    s = genome(random.Random(1), 300)
    one, other = K.kminmers(s, 15, 8, 0, 3), K.kminmers(s[::-1].translate(RC), 15, 8, 0, 3)
    assert sorted(x[0] for x in one) == sorted(x[0] for x in other) and one


def test_compression_and_dust():
    assert K.compressed("AAccGTTT") == ("AcGT", [0, 2, 4, 5])
    assert K.dust("A" * 50) == 100.0 and K.dust("A" * 200) == 100.0 and K.dust("AC") == 0.0
    assert K.dust(genome(random.Random(2), 100)) < 10
    assert len(set(K.homopolymer_hashes(15))) <= 4


def test_seed_rows_and_totals(spark):
    rng = random.Random(5)
    rows = [(i, None if i == 3 else genome(rng, rng.choice([0, 5, 15, 16, 200])) + rng.choice(["", "N", "é", "acgtn"])) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, s string").repartition(3)
    got = sorted(tuple(r) for r in K.seed_rows(df, "id", "s", 15, 8, l=3).collect())
    assert got == sorted((i, b, K.signed(a), r) for i, s in rows for a, r, b, _ in K.kminmers(s or "", 15, 8, l=3))
    want = {}
    for i, s in rows:
        for a, r, *_ in K.kminmers(s or "", 15, 8, l=1):
            n = want.setdefault((i, K.signed(a)), [0, 0])
            n[r] += 1
    got = {(r["node"], r["seed"]): [r["n_fwd"], r["n_rev"]] for r in K.seed_totals(df, "id", "s", 15, 8).collect()}
    assert got == want


def test_sketch_udf(spark):
    s = genome(random.Random(4), 120)
    got = spark.createDataFrame([(s,), (None,)], "s string").select(K.sketch("s", 15, 8).alias("x")).collect()
    assert [(e["hash"], e["pos"]) for e in got[0]["x"]] == [(K.signed(a), b) for a, _, b, _ in K.kminmers(s, 15, 8)]
    assert got[1]["x"] == []
    with pytest.raises(ValueError):
        K.sketch("s", 5, 8)


def test_dust_matches_counting_all_pairs(spark):
    rng = random.Random(6)
    texts = [None, "", "A", "ACG", "NNN", *("".join(rng.choices(letters, k=n)) for n in (3, 10, 65, 66, 67, 68, 70, 130, 400) for letters in ("ACGT", "AC", "AN", "ACGTNacgt-"))]

    def plain(seq, window):
        s = "".join(c for c in (seq or "").upper() if c in "ACGT")
        three = [s[i : i + 3] for i in range(len(s) - 2)]
        n = min(len(three), window)
        pairs = lambda x: sum(a == b for i, a in enumerate(x) for b in x[:i])
        windows = [three] if len(three) <= window else [three[i - window + 1 : i + 1] for i in range(window, len(three))]
        return 0.0 if n < 2 else max(200.0 * pairs(x) / (n * (n - 1)) for x in windows)

    for t in texts:
        assert K.dust(t) == pytest.approx(plain(t, 64)) and K.dust(t, 8) == pytest.approx(plain(t, 8))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").repartition(2)
    got = {r["i"]: r["d"] for r in df.select("i", K.dust_score("s").alias("d")).collect()}
    assert got == {i: pytest.approx(plain(t, 64)) for i, t in enumerate(texts)}


def test_lists_of_seeds_hold_what_rows_and_totals_do(spark):
    import random

    from arborseed.functions.sketch import seed_lists, seed_rows, seed_totals

    rng = random.Random(7)
    texts = [(1, "".join(rng.choices("ACGT", k=400)) * 2), (2, ""), (3, None), (4, "ACGT"), (5, "".join(rng.choices("ACGTN", k=300)))]
    rows = spark.createDataFrame(texts, "g long, s string")
    flat = lambda x: sorted(tuple(r) for r in x.selectExpr("node", "inline(seeds)").collect())
    assert flat(seed_lists(rows, "g", "s", 15, 8)) == sorted(tuple(r) for r in seed_totals(rows, "g", "s", 15, 8).collect())
    places = seed_lists(rows, "g", "s", 15, 8, counted=False)
    assert flat(places) == sorted(tuple(r) for r in seed_rows(rows, "g", "s", 15, 8).collect())
    assert {r["node"] for r in places.collect()} == {1, 5}
    assert sorted((r["node"], len(r["seeds"]) > 0) for r in seed_lists(rows, "g", "s", 15, 8, every=True).collect()) == [(1, True), (2, False), (3, False), (4, False), (5, True)]


def test_whole_documents_are_compared_without_moving_their_seeds(spark, monkeypatch):
    from arborseed.plans import queries, records

    rows = spark.createDataFrame([(1, "s", "abcdefghij klmnopqrstuvwxyz " * 9), (2, "s", "abcdefghij klmnopqrstuvwxyz " * 9), (3, "s", "zyx")], "doc_id long, source string, text string")
    monkeypatch.setattr(queries, "genomes", lambda *a: rows.select("doc_id", "source", queries.S.dna("text").alias("s")))
    for found in (queries.sketch_dedup(spark, ""), records.sketch_dedup_by_gaps(spark, "")):
        assert [(r["copies"], r["first_id"]) for r in found.collect()] == [(2, 1)]
        assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    found = queries.collapse_identical(spark, "")
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 1)]
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_seed_sets_are_shuffled_once(spark, monkeypatch):
    from arborseed.plans import queries

    one = lambda *v: spark.createDataFrame([(x,) for x in v], "seed long")
    monkeypatch.setattr(queries, "sample_seeds", lambda *a: one(1, 2, 2, 3))
    monkeypatch.setattr(queries, "genome_seeds", lambda *a: one(3, 3, 4))
    found = queries.set_operations(spark, "")
    assert {r["op"]: r["n"] for r in found.collect()} == {"union": 4, "intersect": 1, "only_reads": 2}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2


def test_the_top_mask_reads_counts_once(spark):
    from arborseed.operators import placement as P

    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    counts = spark.createDataFrame([(i, 5 if i < 3 else 1) for i in range(40)], "seed long, r long").mapInArrow(counted, "seed long, r long")
    assert P.mask_top(counts, 0.1).count() == 36
    assert runs.value == 40


def test_batches_of_sequences_are_bounded_whatever_the_length_of_rows(spark):
    from arborseed.storage import BATCH

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    kept = spark.conf.get(name, None)
    spark.conf.unset(name)
    try:
        rng = random.Random(2)
        seqs = [genome(rng, n) for n in (K.PASS + 5000, 40, K.PASS // 2, K.PASS // 2 + 9, 0, 700)]
        rows = spark.createDataFrame(list(enumerate(seqs)), "id long, s string").coalesce(1)
        made = K.seed_totals(rows, "id", "s", 15, 8)
        assert int(spark.conf.get(name).rstrip("b")) <= BATCH
        got = {(r["node"], r["seed"]): r["n"] for r in made.collect()}
        want = {}
        for i, s in enumerate(seqs):
            for r in K.seed_totals(spark.createDataFrame([(i, s)], "id long, s string"), "id", "s", 15, 8).collect():
                want[i, r["seed"]] = r["n"]
        assert got == want and {i for i, _ in got} == {0, 1, 2, 3, 5}
    finally:
        spark.conf.unset(name) if kept is None else spark.conf.set(name, kept)
