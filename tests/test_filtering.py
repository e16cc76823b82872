import random

import pytest
from pyspark.sql import functions as F

from arborseed.functions.sketch import seed_totals
from arborseed.operators.tours import numbered_tree
from arborseed.streaming.assign import assign_batch
from arborseed.streaming.filtering import READ, FilterAssign


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    shared = letters(200)
    genomes = {f"g{i}": letters(400) + (shared if i < 4 else "") for i in range(8)}
    genomes["g7"] = genomes["g6"]
    nodes = seed_totals(spark.createDataFrame(list(genomes.items()), "doc_id string, s string"), "doc_id", "s", 15, 8)
    taxa = spark.createDataFrame([(g, "even" if int(g[1]) % 2 == 0 or g == "g7" else "odd") for g in genomes], "node string, taxon string")
    tree = numbered_tree(spark.createDataFrame([("root", None), ("even", "root"), ("odd", "root"), *((g, "even" if int(g[1]) % 2 == 0 or g == "g7" else "odd") for g in genomes)], "node_id string, parent_id string"))
    reads = []
    for i in range(60):
        g = genomes[f"g{rng.randrange(8)}"]
        at = rng.randrange(300)
        seq = [g[at : at + 90], shared[5:95], letters(90), reads[-1][2] if reads else g[:90]][i % 4]
        reads.append((i, f"r{i}", seq, "I" * len(seq)))
    return nodes.cache(), taxa, tree, reads


def test_a_stop_and_a_restart_between_batches(spark, world, tmp_path):
    nodes, taxa, tree, reads = world
    source, home = str(tmp_path / "in"), f"file://{tmp_path}/home"
    make = lambda: FilterAssign(spark, home, nodes, taxa, 1, tree, 0.2, files=1)
    for i in range(3):
        spark.createDataFrame(reads[10 * i : 10 * i + 10], READ).coalesce(1).write.mode("append").parquet(source)
    make().run(source)
    first = make().lists().count()
    for i in range(3, 6):
        spark.createDataFrame(reads[10 * i : 10 * i + 10], READ).coalesce(1).write.mode("append").parquet(source)
    run = make()
    run.run(source)
    run.run(source)  # nothing new
    # the same at once, without a stream
    df = spark.createDataFrame([(r[0], r[2]) for r in reads], "read_id long, s string")
    found = assign_batch(df, nodes, 0.2, 15, 8)
    kinds = {r["node"]: r["taxon"] for r in taxa.collect()}
    want = {}
    for r in found.collect():
        want.setdefault(r["read_id"], set()).add(r["node"])
    want = {i: held for i, held in want.items() if len({kinds[n] for n in held}) == 1}
    records = {r["record"]: r for r in run.records().collect()}
    assert sorted(records) == list(range(len(want))) and {r["read_id"] for r in records.values()} == set(want)
    assert all((r["name"], r["seq"]) == reads[r["read_id"]][1:3] for r in records.values())
    epochs = [(r["epoch"], r["record"]) for r in sorted(records.values(), key=lambda r: r["record"])]
    assert epochs == sorted(epochs) and len({e for e, _ in epochs}) > 4
    lists = run.lists().collect()
    assert {(records[r["record"]]["read_id"], r["node"]) for r in lists} == {(i, n) for i, held in want.items() for n in held} and len(lists) == sum(map(len, want.values())) > first > 0
    for node in {r["node"] for r in lists}:
        own = sorted((r["place"], r["record"]) for r in lists if r["node"] == node)
        assert [p for p, _ in own] == list(range(len(own))) and [x for _, x in own] == sorted(x for _, x in own)
    lca = {r["read_id"]: r["lca"] for r in run.ancestors().collect()}
    assert lca == {i: next(iter(held)) if len(held) == 1 else kinds[next(iter(held))] for i, held in want.items()}
    assert tuple(run.totals().agg(F.sum("reads"), F.sum("records")).first()) == (60, len(want))


def test_a_batch_that_is_run_again(spark, world, tmp_path):
    nodes, _, _, reads = world
    run = FilterAssign(spark, f"file://{tmp_path}/home", nodes, discard=0.2)
    for epoch, part in ((0, reads[:20]), (1, reads[20:40]), (1, reads[20:40])):
        run.take(spark.createDataFrame(part, READ), epoch)
    got = [r["record"] for r in run.records().collect()]
    assert sorted(got) == list(range(len(got)))
    run.take(spark.createDataFrame([], READ), 2)
    run.take(spark.createDataFrame([(99, "x", None, None), (98, "y", "", "")], READ), 3)
    assert run.records().count() == len(got) and run.totals().count() == 4
