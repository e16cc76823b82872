import numpy as np
import pytest
from pyspark.sql import functions as F

from arborseed.operators import genomes as G
from arborseed.operators import mixture as M
from arborseed.operators import placement as P
from arborseed.operators import records as R
from arborseed.operators import tree as T
from arborseed.operators import variants as V


def test_mutations_along_the_path_give_each_nodes_genome(spark):
    blocks = spark.createDataFrame([(0, "ACGTAC"), (1, "GGTT")], "block long, seq string")
    up = spark.createDataFrame([("r", "r", 0), ("a", "r", 0), ("a", "a", 1), ("b", "r", 0), ("b", "a", 1), ("b", "b", 2)], "node string, ancestor string, ancestor_depth int")
    states = spark.createDataFrame([("a", 1, True, True), ("b", 0, False, False)], "node string, block long, present boolean, inverted boolean")
    bases = spark.createDataFrame([("a", 0, 2, 0, "T"), ("a", 0, 2, 1, "C"), ("a", 0, 2, 2, "A"), ("a", 1, 0, 0, "-"), ("b", 1, 0, 0, "A"), ("b", 1, 4, 1, "C")], "node string, block long, pos long, slot long, base string")
    got = {r["node"]: r["genome"] for r in G.node_genomes(up, blocks, states, bases).collect()}
    assert got == {"r": "ACGTACGGTT", "a": "ACCATTAC" + "AAC", "b": "GAACT"}


def test_places_with_and_without_gaps_turn_round(spark):
    gaps = spark.createDataFrame([("g", 3, 5), ("g", 9, 9)], "k string, beg long, stop long")
    points = spark.createDataFrame([("g", x) for x in (0, 2, 3, 5, 6, 7)], "k string, x long")
    assert {r["x"]: r["regapped"] for r in G.regapped(points, gaps, "k").collect()} == {0: 0, 2: 2, 3: 6, 5: 8, 6: 10, 7: 11}
    runs = spark.createDataFrame([("g", 0, 9), ("g", 5, 12), ("h", 1, 1)], "k string, beg long, stop long")
    assert sorted(tuple(r) for r in G.subtracted(runs, gaps, "k").collect()) == [("g", 0, 2), ("g", 6, 8), ("g", 10, 12), ("h", 1, 1)]


def test_vcf_text_is_read_and_filtered(spark):
    lines = ["##x", "c\t5\t.\tA\tG,T\t40\t.\tDP=9\tGT:PL:AD\t1:50,0,60:1,8,0", "c\t6\t.\tA\tG\t.\t.\tDP=9\tGT:AD\t1:.", "c\t7\t.\tAC\tA\t9\t.\tINDEL\tGT\t1", "c\t8\t.\tA\t.\t40\t.\tDP=3\tGT\t0", "c\t9\t.\tA\tC\t40\t.\tDP=3\tGT:PL\t."]
    x = R.vcf_records(spark.createDataFrame([(v,) for v in lines], "value string"))
    assert [(r["pos"], r["gt"], r["pl"], r["ad"]) for r in x.orderBy("pos").collect()][:2] == [(5, 1, [50, 0, 60], [1, 8, 0]), (6, 1, None, None)]
    assert sorted(r["pos"] for r in R.plain_filter(x, 30.0).collect()) == [5, 6]
    priors = spark.createDataFrame([(a, b, 0.0 if a == b else 10.0) for a in "ACGT" for b in "ACGT"], "base_from string, base_to string, phred double")
    got = {r["pos"]: (r["alt"], r["qual"]) for r in R.prior_filter(x.where("pos in (5, 7)"), priors, 30.0).collect()}
    assert got == {5: ("G", 40.0), 7: ("A", 9.0)}
    with pytest.raises(Exception, match="single bases"):
        x.where("pos = 7").select(R.alternatives(F.lit("AC,G"))).collect()


def test_alignment_text(spark):
    r = spark.range(1).select(R.mismatch_tag(F.lit("ACGTT"), F.lit("ACCTA")).alias("md"), R.cigar(F.lit(10), F.lit(2), F.lit(0), F.lit(True)).alias("c"), R.mismatch_tag(F.lit("AA"), F.lit("AA")).alias("same")).first()
    assert (r["md"], r["c"], r["same"]) == ("2C1A0", "8M2S", "2")
    x = spark.createDataFrame([(1, 1, 5, "AAAAA"), (1, 2, 0, "AAAAA"), (2, 1, 3, "AAAA"), (2, 2, 4, "AAAA"), (3, 1, 9, "AA")], "pair int, mate int, score int, seq string")
    assert sorted((r["pair"], r["mate"]) for r in R.mapped(x).collect()) == [(2, 1), (2, 2)]


def test_simulated_changes_are_distinct_and_keep_off_the_ends(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "".join(rng.choice(list("ACGT"), n))) for i, n in enumerate((0, 1, 30, 2500))]
    got = G.simulated_changes(spark.createDataFrame(rows, "id int, s string"), "id", "s", 5).collect()
    assert len({(r["id"], r["pos"]) for r in got}) == len(got)
    assert all(rows[r["id"]][1][r["pos"]] == r["ref"] != r["alt"] for r in got)
    by = {i: [r["pos"] for r in got if r["id"] == i] for i in range(4)}
    assert [len(by[i]) for i in range(4)] == [0, 1, 5, 5] and all(1000 <= p < 1500 for p in by[3])
    m = G.scaled_rates([[0.7, 0.1, 0.1, 0.1]] * 4, 0.03)
    assert np.allclose(np.sum(m, 1), 1) and np.isclose((np.sum(m) - np.trace(m)) / 4, 0.03)


def test_a_deep_tree_and_taxa(spark):
    nodes = spark.createDataFrame([("n0", None)] + [(f"n{i}", f"n{i - 1}") for i in range(1, 40)] + [("x", "y"), ("y", "x")], "node_id string, parent_id string")
    x = T.paths(nodes)
    assert {r["node_id"]: r["depth"] for r in x.collect()} == {f"n{i}": i for i in range(40)}
    assert {r["node_id"]: (r["dfs_index"], r["subtree_end"]) for r in T.numbered(x).collect()} == {f"n{i}": (i, 40) for i in range(40)}
    taxa = spark.createDataFrame([("n39", "a"), ("n20", "b"), ("n10", "c")], "node string, taxon string")
    got = {r["node"]: (r["taxa"], r["over"]) for r in T.subtree_taxa(T.ancestors(x), taxa, 2).collect()}
    assert got["n39"] == (["a"], False) and got["n15"] == (["a", "b"], False) and got["n5"] == ([], True)


def test_row_numbers_are_those_of_the_order(spark):
    df = spark.range(5000).selectExpr("id * 7919 % 5000 AS x").repartition(7)
    assert all(r["x"] == r["i"] for r in T.row_numbers(df, ["x"], "i").collect())


def test_a_fit_on_the_driver_and_over_partitions_agree_with_plain_em(spark):
    rng = np.random.default_rng(2)
    scores, totals = [], []
    for r in range(300):
        totals.append((r, 30))
        best = 0 if rng.random() < 0.6 else 1
        scores += [(r, n, int(s)) for n, s in enumerate((30 if best == 0 else 24, 30 if best == 1 else 25, 23, 23))]
    sc, t = spark.createDataFrame(scores, "read_id int, node int, score int"), spark.createDataFrame(totals, "read_id int, seeds int")
    oc = spark.createDataFrame([(n, 0) for n in range(4)], "node int, oc_rank int")
    one, two = ({r["nodes"]: r["prop"] for r in M.abundances(sc, t, oc, cells=c).collect()} for c in (1 << 20, 0))
    assert set(one) == {"0", "1"} and one == pytest.approx(two)
    m = np.zeros((300, 2))
    for r, n, s in scores:
        if n < 2:
            m[r, n] = 0.005 ** (30 - s) * 0.995**s
    q = np.array([0.5, 0.5])
    for _ in range(300):
        j = m * q
        q = (j / j.sum(1, keepdims=True)).mean(0)
    assert [one["0"], one["1"]] == pytest.approx(q, abs=1e-3)


def test_substitutions_and_consensus(spark):
    pairs = spark.createDataFrame([("ACGT", "ACTTA"), ("AAN", "CAA"), (None, "A")], "parent string, child string")
    assert sorted(tuple(r) for r in V.substitutions(pairs).collect()) == [("A", "C", 1), ("G", "T", 1)]
    g = spark.createDataFrame([(1, "ACGT"), (2, "GG")], "id int, s string")
    calls = spark.createDataFrame([(1, 2, "T"), (1, 9, "A")], "id int, pos int, alt string")
    assert {r["id"]: r["consensus"] for r in V.consensus(g, calls, "id", "s").collect()} == {1: "ATGT", 2: "GG"}


def test_scores_of_samples_equal_scores_of_each(spark):
    rng = np.random.default_rng(3)
    nodes = spark.createDataFrame([(n, int(s), int(rng.integers(1, 4))) for n in range(5) for s in rng.choice(40, 15, False)], "node int, seed long, n long")
    kept = spark.createDataFrame([(a, int(s), int(rng.integers(1, 5))) for a in range(3) for s in rng.choice(40, 20, False)], "sample int, seed long, r long")
    root = nodes.where("node = 0").select("seed", "n")
    got = {(r["sample"], r["node"]): [r[m] for m in P.METRICS] for r in P.sample_scores(nodes, kept, root).collect()}
    for a in range(3):
        for r in P.node_scores(nodes, kept.where(F.col("sample") == a).drop("sample"), root).collect():
            if (a, r["node"]) in got:
                assert got[a, r["node"]] == pytest.approx([r[m] for m in P.METRICS])
    assert len(got) > 10


def test_trimming_walks_the_alignment(spark):
    rows = [("10M", 0, 3, 7), ("2S4M2I4M", 10, 13, 16), ("3M2D3M", 0, 4, 7), ("4M", 0, 0, 9)]
    x = spark.createDataFrame([(c, s, "ABCDEFGHIJKL"[: sum(int(n) for n, o in __import__("re").findall(r"(\d+)(.)", c) if o in "MIS")], a, b) for c, s, a, b in rows], "cigar string, start int, seq string, keep_from int, keep_to int")
    got = [r["seq"] for r in G.primer_trimmed(x.withColumn("qual", F.col("seq"))).collect()]
    assert got == ["DEFG", "FGHIJ", "DE", "ABCD"]


def test_parameters_are_checked():
    from arborseed.parameters import Parameters

    assert Parameters(reads=("a.fq",), discard=0.5).stop == "consensus"
    for bad in ({"dust": 101}, {"discard": -0.1}, {"reads": ("a", "b", "c")}, {"stop": "x"}, {"aligner": "x"}, {"s": 20}, {"t": 12}):
        with pytest.raises(ValueError):
            Parameters(**bad)
    assert [V.preset_of(x) for x in (100, 900, 9000)] == ["short", "long", "accurate"] and set(V.PRESETS) == {"short", "long", "accurate", "old"}


def test_an_interrupt_cancels_the_group(spark):
    from arborseed.streaming.assign import cancellable

    assert cancellable(spark, "one", lambda: spark.range(5).count()) == 5
    with pytest.raises(KeyboardInterrupt):
        cancellable(spark, "two", lambda: (_ for _ in ()).throw(KeyboardInterrupt))
    assert spark.range(3).count() == 3


def test_a_mixture_index_of_another_kind_is_an_error(spark, tmp_path):
    from arborseed.sources import readers, sinks

    nodes = spark.createDataFrame([("r", 5, 1, 0), ("a", 5, 1, 1), ("a", 7, 0, 2)], "node string, seed long, n_fwd long, n_rev long")
    parents = spark.createDataFrame([("r", None), ("a", "r")], "node string, parent string")
    sinks.write_mixture_index(nodes, parents, str(tmp_path / "m"), k=15)
    changes, up, meta = readers.load_mixture_index(spark, str(tmp_path / "m"))
    assert sorted(tuple(r) for r in changes.collect()) == [("a", 5, 0, 1), ("a", 7, 0, 2), ("r", 5, 1, 0)] and meta["k"] == 15
    sinks.write_index(spark.createDataFrame([(0, "r")], "dfs_index int, node_id string"), nodes.select("node", "seed"), str(tmp_path / "p"))
    with pytest.raises(Exception):
        readers.load_mixture_index(spark, str(tmp_path / "p"))


def test_reads_of_a_node_are_aligned_on_its_genome(spark):
    rng = np.random.default_rng(8)
    refs = {n: "".join(rng.choice(list("ACGT"), 200)) for n in (1, 2, 3)}
    reads = {i: refs[1 + i % 2][i : i + 50] for i in range(0, 100, 5)}
    assigned = [(i, 1 + i % 2) for i in reads] + [(0, 3)]
    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = V.node_alignments(made(assigned, "read_id int, node int"), made(list(reads.items()), "read_id int, seq string"), made(list(refs.items()), "node int, reference string"), 2, 4).collect()
    assert {(r["node"], r["read_id"], r["start"], r["edits"], r["rev"]) for r in got} == {(n, i, i, 0, False) for i, n in assigned if n < 3}


def test_candidates_and_small_readers(spark, tmp_path):
    from arborseed.sources import readers

    oc = spark.createDataFrame([("node_1", 0), ("x", 0), ("y", 1), ("z", 2)], "node string, oc_rank int")
    assert {r["node"] for r in M.candidates(oc, 2).collect()} == {"node_1", "x", "y"} and {r["node"] for r in M.candidates(oc, 2, True).collect()} == {"x", "y"}
    (tmp_path / "t").write_text("a 0.25\nb\t0.75\n")
    assert [tuple(r) for r in readers.true_abundances(spark, str(tmp_path / "t")).collect()] == [("a", 0.25), ("b", 0.75)]


def test_alignment_records_of_pairs(spark):
    """Mates' fields, signed spans and proper pairs; a read whose mate isn't aligned there goes; equal 5' ends give 0."""
    rows = [("g", 0, False, 10, 20, "10M"), ("g", 1, True, 50, 60, "10M"), ("g", 2, False, 5, 15, "10M"), ("h", 3, True, 50, 60, "10M"), ("g", 4, True, 0, 10, "10M"), ("g", 5, False, 9, 19, "10M"), ("g", 6, False, 0, 10, "10M"), ("g", 7, True, 2000, 2010, "10M")]
    found = spark.createDataFrame([(*r, "10", 0, 60) for r in rows], "node string, read_id long, rev boolean, start long, end long, cigar string, md string, edits long, quality int")
    reads = spark.createDataFrame([(i, f"q{i // 2}/{i % 2 + 1}", "AACCGGTTAC", "ABCDEFGHIJ") for i in range(8)], "read_id long, name string, seq string, qual string")
    got = {(r["name"], r["flag"] & 64): r for r in R.sam_records(found, reads, True).collect()}
    assert set(got) == {(f"q{i}", m) for i in (0, 2, 3) for m in (0, 64)}
    assert [(got["q0", m]["flag"], got["q0", m]["tlen"], got["q0", m]["mate_start"]) for m in (64, 0)] == [(99, 50, 50), (147, -50, 10)]
    assert (got["q0", 0]["seq"], got["q0", 0]["qual"]) == ("GTAACCGGTT", "JIHGFEDCBA")
    assert [(got["q2", m]["flag"], got["q2", m]["tlen"]) for m in (64, 0)] == [(81, 0), (161, 0)]
    assert [got["q3", m]["flag"] for m in (64, 0)] == [97, 145]
    lone = R.sam_records(found.where("read_id = 4"), reads).first()
    assert (lone["flag"], lone["mate_reference"], lone["mate_start"], lone["tlen"]) == (16, None, -1, 0)
    assert R.record_lines(R.sam_records(found.where("read_id = 0"), reads)).first()["value"] == "q0\t0\tg\t11\t60\t10M\t*\t0\t0\tAACCGGTTAC\tABCDEFGHIJ\tNM:i:0\tMD:Z:10"


def test_listed_numbers_round_as_c_does(spark):
    ranks = spark.createDataFrame([(1, 0.0078125, 0), (2, 0.0078125 / 2**10, 1), (3, 0.2 / 3, 2), (4, 1.0, 3)], "node long, overlap double, oc_rank long")
    want = [f"{rank}\t{node}\t{'%.6f' % x}" for node, x, rank in ((1, 0.0078125, 0), (2, 0.0078125 / 2**10, 1), (3, 0.2 / 3, 2), (4, 1.0, 3))]
    assert want[0] == "0\t1\t0.007812"
    assert [r["value"] for r in R.rank_lines(ranks).collect()] == want
