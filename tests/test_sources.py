import gzip
import json

import pytest

from arborseed.operators import placement as P
from arborseed.sources import readers, sinks


def test_reads_pairs_and_fasta(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@r1 x\nACGT\n+\nIIII\n@r2\n@@GG\n+r2\n!!!!\n")
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
        f.write("@r1/2\nAACC\n+\nABCD\n@r2/2\nGG\n+\nII\n")
    (tmp_path / "c.fa").write_text(">one d\nAC\nGT\n>two\nG\n")
    rows = readers.reads(spark, str(tmp_path / "a.fastq")).orderBy("read_id").collect()
    assert [tuple(r) for r in rows] == [(0, "r1", "ACGT", "IIII"), (1, "r2", "@@GG", "!!!!")]
    pair = readers.paired_reads(spark, str(tmp_path / "a.fastq"), str(tmp_path / "b.fastq.gz"), True).orderBy("read_id").collect()
    assert [(r["read_id"], r["seq"]) for r in pair] == [(0, "ACGT"), (1, "GGTT"), (2, "@@GG"), (3, "CC")]
    assert pair[1]["qual"] == "DCBA"
    fasta = readers.reads(spark, str(tmp_path / "c.fa")).orderBy("read_id").collect()
    assert [tuple(r) for r in fasta] == [(0, "one", "ACGT", "IIII"), (1, "two", "G", "I")]


def test_small_files(spark, tmp_path):
    (tmp_path / "t").write_text("id Order Family\nn1 O1 F1\nn2 O1 .\n")
    (tmp_path / "m").write_text("# c\nx/a_R1.fastq.gz x/a_R2.fastq.gz\nb.fq out\n")
    (tmp_path / "p").write_text("chr\t10\t20\tp1\t1\t+\n")
    assert [tuple(r) for r in readers.taxonomy(spark, str(tmp_path / "t")).collect()] == [("n1", "F1")]
    with pytest.raises(ValueError):
        readers.taxonomy(spark, str(tmp_path / "t"), "id")
    assert [tuple(r) for r in readers.manifest(spark, str(tmp_path / "m")).collect()] == [("x/a_R1.fastq.gz", "x/a_R2.fastq.gz", "x/a"), ("b.fq", None, "out")]
    assert tuple(readers.primers(spark, str(tmp_path / "p"), 2).first()) == ("p1", 8, 21, "+")
    assert readers.mutation_matrix("1 0 0 0\n" * 4 + "1:0.5\n2:0.25")[1] == {1: 0.5}
    with pytest.raises(ValueError):
        readers.mutation_matrix("1 2")


def test_sinks(spark, tmp_path):
    scores = spark.createDataFrame([(1, 0.5, 0.1, 0.2, 0.0, 0.4), (2, 0.5, 0.3, 0.2, 0.0, 0.1)], "node int, " + ", ".join(f"{m} double" for m in P.METRICS))
    lines = [r["value"] for r in sinks.placement_lines(P.placements(scores)).collect()]
    assert lines == ["log_raw\t0.500000\t1,2", "log_cosine\t0.300000\t2", "containment\t0.200000\t1,2", "log_containment\t0.400000\t1"]
    assigned = spark.createDataFrame([("a", 3), ("a", 1)], "node string, read_id long")
    taxa = spark.createDataFrame([("a", "T")], "node string, taxon string")
    assert sinks.assignment_lines(assigned, taxa).first()["value"] == "a\tT\t2\t1,3"
    assert json.loads(sinks.jplace([("r", None), ("a", "r")], assigned))["placements"] == [{"p": [[1, "a"]], "n": ["1", "3"]}]
    nodes = spark.createDataFrame([(0, "r")], "dfs_index int, node_id string")
    changes = spark.createDataFrame([(0, "ACG", 0, 1)], "node int, seed string, parent_count int, child_count int")
    sinks.write_index(nodes, changes, str(tmp_path / "i"), k=15, s=8)
    assert readers.load_index(spark, str(tmp_path / "i"))[2]["k"] == 15


def test_faults_in_inputs_are_errors(spark, tmp_path):
    (tmp_path / "m").write_text(f"{tmp_path}/a.fq\n")
    with pytest.raises(FileNotFoundError):
        readers.manifest(spark, str(tmp_path / "m"), True)
    (tmp_path / "a.fq").write_text("@r\nAC\n+\nI\n")
    assert readers.manifest(spark, str(tmp_path / "m"), True).count() == 1
    with pytest.raises(Exception, match="FASTQ"):
        readers.reads(spark, str(tmp_path / "a.fq")).collect()
    nodes = spark.createDataFrame([(0, None), (1, 2), (2, 0)], "dfs_index int, parent_index int")
    changes = spark.createDataFrame([(1, 5)], "node int, seed long")
    with pytest.raises(ValueError, match="before its parent"):
        readers.checked_index(nodes, changes)
    with pytest.raises(ValueError, match="no node"):
        readers.checked_index(nodes.where("dfs_index <> 1"), changes)


def test_many_small_splits_keep_the_order(spark, tmp_path):
    (tmp_path / "x.fastq").write_text("".join(f"@r{i}\n{'ACGT' * (i % 9)}\n+\n{'IIII' * (i % 9)}\n" for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        got = readers.reads(spark, str(tmp_path / "x.fastq")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r["read_id"], r["name"], r["seq"]) for r in got) == [(i, f"r{i}", "ACGT" * (i % 9)) for i in range(3000)]


def test_no_prior_without_changes(spark):
    from arborseed.operators import variants as V

    still = spark.createDataFrame([("A", "A", 1.0), ("A", "C", 0.0)], "base_from string, base_to string, rate double")
    assert V.substitution_prior(still).count() == 0
    moved = spark.createDataFrame([("A", "A", 0.9), ("A", "C", 0.1)], "base_from string, base_to string, rate double")
    assert {r["base_to"]: round(r["phred"], 3) for r in V.substitution_prior(moved).collect()} == {"A": 0.458, "C": 10.0}


def test_mixture_indexes_are_checked_and_keep_their_taxa(spark, tmp_path):
    path = str(tmp_path / "m")
    nodes = spark.createDataFrame([("r", 5, 1, 0), ("a", 5, 2, 0), ("a", 7, 0, 1)], "node string, seed long, n_fwd long, n_rev long")
    parents = spark.createDataFrame([("r", None), ("a", "r")], "node string, parent string")
    sinks.write_mixture_index(nodes, parents, path, k=15)
    assert readers.index_taxa(spark, path).count() == 0
    sinks.write_mixture_index(nodes, parents, path, spark.createDataFrame([("a", "T")], "node string, taxon string"), k=15)
    assert [tuple(r) for r in readers.index_taxa(spark, path).collect()] == [("a", "T")]
    assert sorted(tuple(r) for r in readers.load_mixture_index(spark, path)[0].collect()) == [("a", 5, 1, 0), ("a", 7, 0, 1), ("r", 5, 1, 0)]
    changes, words, tree = (spark.read.parquet(f"{path}/{x}") for x in ("changes", "dictionary", "tree"))
    for bad, text in (((changes.withColumn("seed_id", changes["seed_id"] + 9), words, tree), "dictionary"), ((changes, words, tree.where("node = 'r'")), "node"), ((changes, words.where("seed_id = 1"), tree), "gaps")):
        with pytest.raises(ValueError, match=text):
            readers.checked_changes(*bad)


def test_mixture_index_of_known_changes(spark, tmp_path):
    from pyspark.sql import functions as F

    from arborseed.operators import tree as T
    from arborseed.sources import readers, sinks

    counts = [(n, s, (s * 7 + i) % 4, (s + i) % 3 + 1) for i, n in enumerate(("a", "b", "a1", "a2", "b1")) for s in range(-30, 30) if (s + i) % (i + 2)]
    nodes = spark.createDataFrame(counts, "node string, seed long, n_fwd long, n_rev long")
    parents = spark.createDataFrame([("a", None), ("b", None), ("a1", "a"), ("a2", "a"), ("b1", "b")], "node string, parent string")
    roots = nodes.where("length(node) = 1").select("node", "seed", F.col("n_fwd").alias("d_fwd"), F.col("n_rev").alias("d_rev"))
    known = T.orientation_changes(parents.where("parent is not null"), nodes).union(roots)
    sinks.write_mixture_changes(known, parents, str(tmp_path / "known"), k=15, s=8)
    changes, up, meta = readers.load_mixture_index(spark, str(tmp_path / "known"))
    assert sorted(map(tuple, changes.collect())) == sorted(map(tuple, known.collect())) and meta["k"] == 15
    words = spark.read.parquet(str(tmp_path / "known/dictionary")).orderBy("seed").collect()
    assert [r["seed_id"] for r in words] == list(range(len(words))) and {r["seed"] for r in words} == {r[1] for r in counts}
    assert sorted(map(tuple, T.orientations_below(changes, up).collect())) == sorted(counts)
    ids = readers.load_mixture_index(spark, str(tmp_path / "known"), named=False)[0]
    place = {r["seed"]: r["seed_id"] for r in words}
    assert sorted(map(tuple, T.orientations_below(ids, up).collect())) == sorted((n, place[s], f, v) for n, s, f, v in counts)


def test_changes_of_a_mixture_index_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.range(0, 400, 1, 4).selectExpr("if(id < 200, 'r', 'a') as node", "(id % 200 - 100) * 92233720368547758 as seed", "1L as d_fwd", "0L as d_rev")
    parents = spark.createDataFrame([("r", None), ("a", "r")], "node string, parent string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_mixture_changes(rows.mapInArrow(told, rows.schema), parents, str(tmp_path / "m"), k=15)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert made.value == 400  # a pass ahead of a range sort made them twice
    changes = readers.load_mixture_index(spark, str(tmp_path / "m"))[0]
    assert sorted(map(tuple, changes.collect())) == sorted(map(tuple, rows.collect()))
    words = spark.read.parquet(str(tmp_path / "m/dictionary")).orderBy("seed").collect()
    assert [r["seed_id"] for r in words] == list(range(200))
