import gzip
import random
import struct

import pytest

from arborseed.sources import bam


def made(rng, n):
    refs = [("one", 90_000), ("two", 400), ("none", 50)]
    rows = []
    for i in range(n):
        size = rng.choice([0, 1, 20, 151, 700])
        paired = i % 3 == 0
        row = (
            f"r{i}", 99 if paired else 16 * (i % 2), rng.choice(["one", "one", "two"]), rng.randrange(300) * rng.choice([1, 250]), rng.randrange(61), f"3S{size}M2I7D5M" if size else "*",
            "one" if paired else None, 17 if paired else -1, rng.randrange(-300, 300) if paired else 0, "".join(rng.choices("ACGTN", k=size + 10)) if size else "", "".join(rng.choices("!I5", k=size + 10)) if size else "",
            rng.randrange(9) if i % 2 else None, f"{size}A3" if i % 2 else None)
        rows.append(row)
    return refs, [*rows, ("lost", 4, None, -1, 0, "*", None, -1, 0, "ACG", None, None, None)]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(3)
    refs, rows = made(rng, 900)
    path = str(tmp_path_factory.mktemp("bam") / "b")
    df = spark.createDataFrame(rows, bam.SCHEMA).repartition(4)
    bam.write_bam(df, refs, path)
    return path, refs, rows


def collected(df):
    return sorted(map(tuple, df.select(*bam.COLUMNS).collect()), key=repr)


def test_round_trip_in_splits(spark, stored):
    path, _, rows = stored
    want = sorted((tuple(r) for r in rows), key=repr)
    for size in (1 << 30, 20_000, 700):
        df = bam.read_bam(spark, path, size)
        assert collected(df) == want
    assert bam.read_bam(spark, path, 5_000).rdd.getNumPartitions() > 8
    assert bam.read_bam(spark, path).where("NOT mapped").count() == 1


def test_parts_are_sorted_whole_files(stored):
    path, refs, rows = stored
    seen = []
    for name, _ in bam.listed(path, ".bam"):
        data = open(name, "rb").read()
        plain = gzip.decompress(data)
        assert plain[:4] == b"BAM\x01" and data.endswith(bam.END)
        text, found, (block, within) = bam.header(name)
        assert found == refs and text.startswith("@HD\tVN:1.6\tSO:coordinate\n") and within == 0
        at = len(gzip.decompress(data[:block]))
        while at < len(plain):
            size, ref, pos = struct.unpack_from("<iii", plain, at)
            seen.append((ref if ref >= 0 else 9, pos))
            at += 4 + size
    assert seen == sorted(seen) and len(seen) == len(rows)


def test_regions_by_the_index(spark, stored):
    path, _, rows = stored
    span = lambda r: 1 if r[5] == "*" else int(r[5].split("S")[1].split("M")[0]) + 12
    for name, begin, end in (("one", 0, 10), ("one", 20_000, 30_000), ("two", 100, 101), ("one", 80_000, 90_000), ("none", 0, 50), ("other", 0, 5)):
        want = sorted((r for r in rows if r[2] == name and r[3] < end and r[3] + span(r) > begin), key=repr)
        for size in (1 << 30, 5000):
            assert collected(bam.read_bam(spark, path, size, f"{name}:{begin}-{end}")) == want


def test_records_cross_blocks(spark, tmp_path):
    """Reads longer than several blocks, in splits smaller than a block."""
    rng = random.Random(1)
    rows = [(f"long{i}", 0, "one", i, 60, f"{n}M", None, -1, 0, "".join(rng.choices("ACGT", k=n)), "".join(rng.choices("!#5I", k=n)), 0, str(n)) for i, n in enumerate([200_000, 10, 150_000, 3, 90_001])]
    path = str(tmp_path / "b")
    bam.write_bam(spark.createDataFrame(rows, bam.SCHEMA).coalesce(1), [("one", 300_000)], path)
    for size in (1 << 30, 3000):
        assert collected(bam.read_bam(spark, path, size)) == sorted(rows, key=repr)


def test_faults_and_empty_files(spark, tmp_path, stored):
    path = str(tmp_path / "e")
    bam.write_bam(spark.createDataFrame([], bam.SCHEMA), [("one", 5)], path)
    assert bam.read_bam(spark, path).count() == 0
    whole = open(bam.listed(stored[0], ".bam")[0][0], "rb").read()
    (tmp_path / "cut.bam").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "no.bam").write_bytes(b"plain text")
    for name in ("cut", "no"):
        with pytest.raises(Exception, match="block|record|BAM"):
            bam.read_bam(spark, str(tmp_path / f"{name}.bam")).collect()


def test_mates_of_tiles_need_no_join(spark):
    from pyspark.sql import functions as F

    from arborseed.operators import records as T
    from arborseed.plans import alignments as L

    d = "/root/testdata/sf0.001"
    here = L.paired_records(spark, d)
    assert "Join" not in here._jdf.queryExecution().executedPlan().toString()
    x = here.withColumn("i", F.substring("name", 2, 20).cast("long") * 2 + (F.col("flag").bitwiseAND(16) != 0).cast("long"))
    seq, qual = T.oriented(F.col("seq"), F.col("qual"), F.col("flag").bitwiseAND(16) != 0)
    found = x.select(F.col("reference").alias("node"), F.col("i").alias("read_id"), (F.col("flag").bitwiseAND(16) != 0).alias("rev"), "start", (F.col("start") + L.SPAN).alias("end"), "cigar", "md", "edits", F.col("mapq").alias("quality"))
    reads = x.select(F.col("i").alias("read_id"), "name", seq.alias("seq"), qual.alias("qual"))
    assert sorted(map(tuple, here.collect())) == sorted(map(tuple, T.sam_records(found, reads, paired=True).collect())) != []


@pytest.mark.parametrize("most", [1, 7, 10_000])
def test_many_splits_are_dealt_to_few_tasks(stored, monkeypatch, most):
    path, _, rows = stored
    monkeypatch.setattr(bam, "TASKS", most)
    reader = bam.BamReader({"path": path, "splitbytes": "2000"})
    tasks = reader.partitions()
    assert len(tasks) <= most and sum(len(t.splits) for t in tasks) > 10
    found = [tuple(r.values()) for t in tasks for b in reader.read(t) for r in b.to_pylist()]
    assert sorted(found, key=repr) == sorted((tuple(r) for r in rows), key=repr)
