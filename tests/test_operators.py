import numpy as np
import pytest
from pyspark.sql import functions as F

from arborseed.functions import sequence as S
from arborseed.operators import mixture as M
from arborseed.operators import placement as P
from arborseed.operators import ranges as R
from arborseed.operators import tree as T
from arborseed.operators import variants as V


@pytest.mark.parametrize("reads,node,want", [({"a": 3}, {"a": 2}, (0.5, 1, 1, 0.5, 1)), ({"a": 3, "b": 3}, {"a": 2, "b": 2}, (2**-0.5, 1, 1, 1, 1)), ({"a": 3, "b": 3}, {"a": 2}, (8**-0.5, 2**-0.5, 0.5, 0.5, 0.5))])
def test_scores_by_hand(spark, reads, node, want):
    nodes = spark.createDataFrame([(1, s, n) for s, n in node.items()], "node int, seed string, n long")
    kept = spark.createDataFrame(list(reads.items()), "seed string, r long")
    root = spark.createDataFrame([(s, 1) for s in node], "seed string, n long")
    if len(reads) == 2 and len(node) == 2:
        root = spark.createDataFrame([(s, 2) for s in node], "seed string, n long")
    r = P.node_scores(nodes, kept, root).first()
    assert [r[m] for m in P.METRICS] == pytest.approx(want)


def test_squarem_finds_a_mixture():
    rng = np.random.default_rng(0)
    scores = np.where(rng.random(2000)[:, None] < 0.7, [30, 22, 20], [21, 30, 20])
    q = M.squarem(0.005 ** (30.0 - scores) * 0.995**scores, np.ones(2000))
    assert q[0] == pytest.approx(0.7, abs=0.04) and q[1] == pytest.approx(0.3, abs=0.04) and q[2] == 0


def test_ranges(spark):
    gaps = spark.createDataFrame([("g", 3, 5), ("g", 9, 9)], "k string, beg long, stop long")
    points = spark.createDataFrame([("g", x) for x in (1, 3, 5, 6, 9, 12)], "k string, x long")
    got = {r["x"]: r["degapped"] for r in R.degapped(points, gaps, "k").collect()}
    assert got == {1: 1, 3: None, 5: None, 6: 3, 9: None, 12: 8}
    bases = spark.createDataFrame([("g", i, c) for i, c in enumerate("A-CGT-A")], "k string, pos long, base string")
    assert sorted(r["pos"] for r in R.flank_masked(bases, "k", 1).collect()) == [2, 3, 4]


def test_alignment_recovers_an_edit(spark):
    rng = np.random.default_rng(5)
    ref = "".join(rng.choice(list("ACGT"), 200))
    read = ref[40:100]
    assert V.align(read, ref) == (40, 60, 0)
    changed = read[:30] + ("A" if read[30] != "A" else "C") + read[31:]
    assert V.align(changed, ref)[::2] == (40, 1)
    turned = changed[::-1].translate(str.maketrans("ACGT", "TGCA"))
    r = V.aligned(spark.createDataFrame([(1, 2, turned, ref)], "read_id int, node int, seq string, reference string")).first()
    assert (r["start"], r["edits"], r["rev"]) == (40, 1, True)


def test_sequence_functions(spark):
    df = spark.createDataFrame([("AACGGT", "IIII!!")], "s string, q string")
    r = df.select(S.reverse_complement("s").alias("rc"), S.complement(F.lit("acNx")).alias("c"), S.homopolymer_starts("s").alias("h"), S.mean_phred("q", F.lit(2), 4).alias("m"), S.rotate_left(F.lit(1).cast("long"), 65).alias("r"), S.wrapped("s", 2).alias("w")).first()
    assert (r["rc"], r["c"], r["h"], r["m"], r["r"], r["w"]) == ("ACCGTT", "tgNN", [0, 2, 3, 5], 20.0, 2, "AA\nCG\nGT")


def test_newick_and_capped(spark):
    assert T.newick([("r", None), ("a", "r"), ("b", "r")]) == "(a:1.0{1},b:1.0{2})r:1.0{0};"
    near = spark.createDataFrame([("s", "x", 1), ("s", "y", 0)], "source string, node_id string, distance int")
    assert [r["node_id"] for r in T.capped(near, 1).collect()] == ["y"]


def slow_align(read, reference, low, band=16, match=1, mismatch=-2, gap=-3):
    target = reference[low : low + len(read) + 2 * band]
    row = [(0, 0, j) for j in range(len(target) + 1)]
    for i, a in enumerate(read, 1):
        new = [(i * gap, i, 0)]
        for j, b in enumerate(target, 1):
            (s, e, o), (su, eu, ou), (sl, el, ol) = row[j - 1], row[j], new[-1]
            new.append(max((s + (match if a == b else mismatch), e + (a != b), o), (su + gap, eu + 1, ou), (sl + gap, el + 1, ol), key=lambda x: x[0]))
        row = new
    best = max(row, key=lambda x: x[0])
    return low + best[2], best[0], best[1]


def test_alignment_matches_the_plain_recurrence():
    rng = np.random.default_rng(3)
    for _ in range(30):
        ref = "".join(rng.choice(list("ACGT"), 120))
        read = list(ref[16:76])
        for at in rng.integers(14, 60, 3):
            read[at] = rng.choice(["", "A", "CG", "T"])
        read = "".join(read)
        assert V.align(read, ref) == slow_align(read, ref, 0)


def test_reads_aligned_together_are_those_aligned_one_by_one():
    rng = np.random.default_rng(6)
    ref = "".join(rng.choice(list("ACGT"), 300))
    reads = ["", "ACGT", ref, "N" * 30]
    for _ in range(40):
        a, n = rng.integers(0, 260), rng.integers(5, 90)
        read = list(ref[a : a + n])
        for at in rng.integers(0, len(read), 3):
            read[at] = rng.choice(["", "A", "CG", "T"])
        reads.append("".join(read))
    where = V.kmer_places(ref)
    assert V.align_all(reads, ref, where) == [V.align(r, ref, where=where) for r in reads]


def test_refinement_aligns_all_candidates(spark):
    rng = np.random.default_rng(4)
    genome = "".join(rng.choice(list("ACGT"), 300))
    far = "".join(rng.choice(list("ACGT"), 300))
    change = lambda s, places: "".join("ACGT"[("ACGT".index(c) + 1) % 4] if i in places else c for i, c in enumerate(s))
    refs = {1: change(genome, {50, 150}), 2: genome, 3: change(genome, {50}), 4: far, 5: far}
    reads = {i: genome[s : s + 60] for i, s in enumerate(range(0, 240, 30))}
    x = spark.createDataFrame([(n, *[0.9 if n == 1 else 0.5 if n == 4 else 0.2 + n / 100] * 5) for n in refs], ["node", *P.METRICS])
    tree = spark.createDataFrame([(str(n), "a" if n < 4 else "b") for n in refs], "node_id string, parent_id string")
    chosen = P.refinement_candidates(x, tree)
    assert {(r["metric"], r["node"]) for r in chosen.collect()} == {(m, n) for m in P.METRICS for n in (1, 2, 3)}
    found = V.alignment_scores(spark.createDataFrame(list(refs.items()), "node long, reference string"), spark.createDataFrame(list(reads.items()), "read_id long, seq string"), 3)
    want = {n: -sum(V.best_strand(q, r)[2] for q in reads.values()) for n, r in refs.items()}
    assert {r["node"]: r["align_score"] for r in found.collect()} == want
    assert {(r["metric"], r["node"]) for r in P.refined(chosen.join(found, "node")).collect()} == {(m, 2) for m in P.METRICS}


def test_masked_places_hold_what_the_parent_has(spark):
    """Place by place along each path, with bounds that overlap, lie within each other, apart, or are missing."""
    import random

    from arborseed.operators import ranges as R

    rng = random.Random(1)
    parent = {0: None, **{i: rng.randrange(i) for i in range(1, 25)}}
    bounds = {i: tuple(sorted((rng.randint(1, 30), rng.randint(1, 30)))) for i in parent if i % 6}
    own = {(i, p): rng.randrange(100) for i in parent for p in range(1, 31) if rng.random() < 0.5}
    path = lambda i: [] if i is None else [*path(parent[i]), i]
    want = set()
    for i in parent:
        for p in range(1, 31):
            keeper = next((a for a in reversed(path(i)) if a in bounds and bounds[a][0] <= p <= bounds[a][1]), None)
            if (keeper, p) in own:
                want.add((i, p, own[keeper, p], keeper))
    up = spark.createDataFrame([(i, a, k) for i in parent for k, a in enumerate(path(i))], "node_id int, ancestor int, ancestor_depth int")
    seeds = spark.createDataFrame([(i, p, s) for (i, p), s in own.items()], "node int, pos int, seed long")
    got = R.inherited_seeds(seeds, spark.createDataFrame([(i, *b) for i, b in bounds.items()], "node int, low int, high int"), up).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want
    bases = spark.createDataFrame([(1, p, c) for p, c in enumerate("--AC-GT--A-", 1)] + [(2, 1, "A"), (3, 1, "-")], "node int, pos int, base string")
    assert sorted(map(tuple, R.kept_extent(bases, "node").collect())) == [(1, 3, 10), (2, 1, 1)]
    assert sorted(map(tuple, R.kept_extent(bases, "node", 2).collect())) == [(1, 6, 6)]


def test_shares_of_a_long_list_are_taken_once(spark):
    from arborseed.operators import mixture as M

    found = spark.createDataFrame([("a,b,c,d", 1.0), ("a", 0.5)], "nodes string, prop double")
    x = M.lineage_rollup(found, spark.createDataFrame([(c, c if c == "a" else "z") for c in "abcd"], "node string, lineage string"))
    assert {r["lineage"]: r["prop"] for r in x.collect()} == {"a": 0.75, "z": 0.75}
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan[: plan.index("Generate explode")]  # what stands above runs for each node of the list


def test_bases_to_call_are_found_in_one_pass(spark, monkeypatch):
    from arborseed.plans import queries

    seen, made = [], queries.V.consensus
    monkeypatch.setattr(queries.V, "consensus", lambda g, calls, *a: seen.append(calls) or made(g, calls, *a))
    rows = spark.createDataFrame([(1, "aaaaaaaaabaaaaaaaaacaaaa"), (2, "abc"), (3, "ddddddddda"), (4, None)], "doc_id long, text string")
    monkeypatch.setattr(queries, "genomes", lambda *a: rows.select("doc_id", queries.S.dna("text").alias("s")))
    found = {r["doc_id"]: r["h"] for r in queries.consensus_build(spark, "").collect()}
    import hashlib

    assert found == {i: hashlib.md5(s.encode()).hexdigest() for i, s in ((1, "AAAAAAAAAGAAAAAAAAACAAAA"), (2, "ACG"), (3, "TTTTTTTTTT"))}
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "substring(" not in plan[: plan.index("Generate")]


def test_orientations_differ_row_by_row_as_in_the_join(spark):
    from arborseed.operators import tree

    seeds = {"p": [(1, 2, 0), (2, 1, 1), (7, 0, 3)], "a": [(1, 2, 0), (2, 0, 1), (9, 1, 0)], "b": []}
    nodes = spark.createDataFrame([(n, *x) for n, v in seeds.items() for x in v], "node string, seed long, n_fwd long, n_rev long")
    want = sorted(map(tuple, tree.orientation_changes(spark.createDataFrame([("a", "p"), ("b", "p")], "node string, parent string"), nodes).collect()))
    kind = "array<struct<seed:bigint,n:bigint,n_fwd:bigint,n_rev:bigint>>"
    listed = {n: [(s, f + r, f, r) for s, f, r in v] for n, v in seeds.items()}
    pairs = spark.createDataFrame([(n, listed[n], listed["p"]) for n in "ab"], f"node string, seeds {kind}, above {kind}")
    assert sorted(map(tuple, tree.orientation_differences(pairs).collect())) == want


def test_listed_changes_and_counts_are_those_of_the_joins(spark):
    from arborseed.operators import tree

    seeds = {"p": [(1, 2), (2, 1), (7, 3)], "a": [(1, 2), (2, 4), (9, 1)], "b": []}
    nodes = spark.createDataFrame([(n, *x) for n, v in seeds.items() for x in v], "node string, seed long, n long")
    up = spark.createDataFrame([("a", "p"), ("b", "p")], "node string, parent string")
    kind = "array<struct<seed:bigint,n:bigint>>"
    rows = spark.createDataFrame([(n, "p", seeds[n] or None, seeds["p"]) for n in "ab"], f"node string, parent string, seeds {kind}, above {kind}")
    found = tree.listed_changes(rows)
    want = sorted(map(tuple, tree.seed_changes(up, nodes).collect()))
    assert sorted(map(tuple, found.selectExpr("node", "inline(changes)").collect())) == want
    counts = tree.listed_counts(found.join(rows.select("node", "above"), "node"))
    assert sorted(map(tuple, counts.collect())) == [("a", *x) for x in seeds["a"]]


def test_inner_nodes_hold_what_all_their_documents_do(spark, monkeypatch):
    from arborseed.plans import queries

    word = "abcdefghijklmnopqrstuvwxyz"
    docs = [(1, "x", "s", word * 3), (2, "x", "s", word * 2 + "zzyyxx" * 9), (3, "x", "t", word * 4), (4, "y", "s", ""), (5, "y", "s", word)]
    rows = spark.createDataFrame(docs, "doc_id long, lang string, source string, text string")
    monkeypatch.setattr(queries, "genomes", lambda *a: rows.select("doc_id", "lang", "source", queries.S.dna("text").alias("s")))
    every = queries.nodes(spark, "").collect()
    counts = {}
    for r in every:
        counts.setdefault(r["node"], {})[r["seed"]] = r["n"]
    want = set()
    for name, members in (("root", (1, 2, 3, 4, 5)), ("x", (1, 2, 3)), ("y", (4, 5)), ("x|s", (1, 2)), ("x|t", (3,)), ("y|s", (4, 5))):
        held = set.intersection(*(set(counts.get(m, {})) for m in members))
        want |= {(name, s, min(counts[m][s] for m in members)) for s in held}
    assert want and {tuple(r) for r in queries._inner_counts(spark, "").collect()} == want


def test_seeds_are_weighed_in_one_shuffle(spark):
    import random

    rng = random.Random(9)
    counts = spark.createDataFrame([(r, f"g{r % 3}", s, rng.randint(1, 3)) for r in range(60) for s in rng.sample(range(80), rng.randint(1, 12))], "read_id long, grp string, seed long, n long").repartition(3)
    rows = counts.select("read_id", "grp", "seed", F.explode(F.array_repeat("n", F.col("n").cast("int"))).alias("x")).drop("x")
    bounds = M.group_bounds(rows, 0.1, 1, last="g0")
    held = M.held_counts(counts, bounds)
    assert held._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    left = lambda x, n: sorted(map(tuple, x.groupBy("read_id").agg(n.alias("n")).collect()))
    assert left(held.where("strong"), F.sum("n")) == left(M.mask_seeds(rows, bounds), F.count("*")) != []
    kept = counts.join(M.weak_reads(counts.drop("n"), bounds), "read_id", "left_anti")
    assert left(kept, F.sum("n")) == left(M.mask_reads(rows, bounds), F.count("*")) != []


def test_extents_of_rows_and_salted_ancestors(spark):
    from arborseed.operators import ranges as R

    bases = [(k, i + 1, b) for k, s in ((1, "--ACGT-ACG--"), (2, "A"), (3, "---")) for i, b in enumerate(s)]
    rows, places = spark.createDataFrame([(1, 12), (2, 1), (3, 3), (4, None), (5, 0)], "node int, n int"), {1: [3, 4, 5, 6, 8, 9, 10], 2: [1], 3: []}
    for flank in (0, 2, 3):
        want = R.kept_extent(spark.createDataFrame(bases, "node int, pos int, base string"), "node", flank)
        assert sorted(map(tuple, R.placed_extent(rows, lambda k, n: places[k], flank).collect())) == sorted(map(tuple, want.collect()))
    # 200 nodes under one root: its seeds are dealt out, and each node still gets each of them once
    up = spark.createDataFrame([(0, 0, 0)] + [(i, a, k) for i in range(1, 201) for k, a in enumerate((0, i))], "node_id int, ancestor int, ancestor_depth int")
    bounds = spark.createDataFrame([(0, 1, 9)] + [(i, 3, 5) for i in range(1, 201)], "node int, low int, high int")
    seeds = spark.createDataFrame([(i, p, 100 * i + p) for i in range(201) for p in (2, 4, 8)], "node int, pos int, seed int")
    found = R.inherited_seeds(seeds, bounds, up)
    assert sorted(map(tuple, found.collect())) == sorted([(0, p, p, 0) for p in (2, 4, 8)] + [x for i in range(1, 201) for x in ((i, 2, 2, 0), (i, 4, 100 * i + 4, i), (i, 8, 8, 0))])
    assert "_salt" in found._jdf.queryExecution().optimizedPlan().toString()


def test_counts_of_rows_are_summed_where_they_are_made(spark):
    from arborseed.operators import tree

    kind = "node string, changes array<struct<seed:bigint,parent_count:bigint,child_count:bigint>>, above array<struct<seed:bigint,n:bigint>>"
    rows = [("a", [(1, 0, 4), (2, 3, 0)], [(2, 3), (5, 6)]), ("b", [], None), ("c", None, [(7, 2)]), ("d", [(2, 3, 0)], [(2, 3)])]
    x = spark.createDataFrame(rows, kind)
    assert sorted(map(tuple, tree.listed_counts(x, summed=True).collect())) == [("a", 2, 10), ("c", 1, 2)]
    assert sorted(map(tuple, tree.listed_counts(x).collect())) == [("a", 1, 4), ("a", 5, 6), ("c", 7, 2)]


@pytest.mark.parametrize("match", [1, 1 << 28, 1 << 45])
def test_reads_aligned_together_in_cells_of_one_number(match):
    rng = np.random.default_rng(9)
    ref = "".join(rng.choice(list("ACGT"), 200))
    reads = [ref[a : a + 40] + "T" + ref[a + 42 : a + 70] for a in range(0, 130, 10)] + [ref[20:32], "ACG"]
    where = V.kmer_places(ref)
    found = V.align_all(reads, ref, where, match=match, mismatch=-2 * match, gap=-3 * match)
    assert found == [V.align(r, ref, match=match, mismatch=-2 * match, gap=-3 * match, where=where) for r in reads]
