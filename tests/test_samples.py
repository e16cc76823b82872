import random

import pytest
from pyspark.sql import functions as F

from arborseed import samples
from arborseed.parameters import Parameters
from arborseed.sources import bam

P = Parameters(k=15, s=8, l=1)


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(21)
    base = [rng.choice("ACGT") for _ in range(900)]
    genomes = {}
    for i in range(5):
        g = base[:]
        for at in range(13 * i + 5, 900, 41):
            g[at] = rng.choice("ACGT")
        genomes[f"g{i}"] = "".join(g)
    own, rows = {}, []
    for sample, node in (("one", "g1"), ("two", "g3"), ("three", "g3")):
        s = genomes[node]
        if sample != "three":
            swap = {"A": "C", "C": "G", "G": "T", "T": "A"}
            s = s[:300] + swap[s[300]] + s[301:420] + s[424:600] + "GATTACA" + s[600:]
        own[sample] = (node, s)
        other = str.maketrans("ACGT", "TGCA")
        for pair, at in enumerate(range(0, len(s) - 260, 10)):
            for mate, seq in ((0, s[at : at + 120]), (1, s[at + 140 : at + 260][::-1].translate(other))):
                rows.append((sample, 2 * pair + mate, f"{sample}{pair}/{mate + 1}", seq, "I" * 120))
    rows.append(("lost", 0, "x", "AC" * 60, "I" * 120))
    reads = spark.createDataFrame(rows, "sample string, read_id long, name string, seq string, qual string")
    return spark.createDataFrame(list(genomes.items()), "node string, reference string"), reads, own, genomes


def test_from_reads_to_consensus(spark, world, tmp_path):
    genomes, reads, own, texts = world
    path = f"file://{tmp_path}/index"
    samples.index(genomes, P, path)
    with pytest.raises(ValueError, match="index"):
        samples.load(spark, path, Parameters(k=17, s=8, l=1))
    found = samples.run(reads, genomes, P, samples.load(spark, path, P), paired=True)
    assert {r["sample"]: r["node"] for r in found.chosen.collect()} == {s: n for s, (n, _) in own.items()}
    made = {r["sample"]: r["consensus"] for r in found.genomes.collect()}
    assert made == {s: g for s, (_, g) in own.items()}
    assert {r["flag"] for r in found.records.collect()} == {99, 147}
    samples.write(found, str(tmp_path / "out"))
    vcf = [x for p in sorted((tmp_path / "out/vcf/sample=one").glob("part-*")) for x in p.read_text().splitlines()]
    assert vcf[0] == "##fileformat=VCFv4.2" and vcf[len(samples.VCF_HEADER)].startswith("#CHROM") and len(vcf) == len(samples.VCF_HEADER) + 4
    body = [x.split("\t") for x in vcf[-3:]]
    assert [(x[0], x[1]) for x in body][0] == ("g1", "301") and [len(x[3]) - len(x[4]) for x in body] == [0, 4, -7]
    assert all(x[9].startswith("1:") and float(x[5]) > 30 for x in body) and ",0:0," in body[0][9]  # a read that ends within an insertion may go on without it
    fasta = next((tmp_path / "out/consensus/sample=two").glob("part-*")).read_text().splitlines()
    assert fasta[0] == ">two_consensus ref=g3" and "".join(fasta[1:]) == own["two"][1]
    lines = [x for p in (tmp_path / "out/placement/sample=three").glob("part-*") for x in p.read_text().splitlines()]
    assert [x.split("\t")[0] for x in lines][0] == "log_raw" and "containment\t1.000000\tg3" in lines
    back = bam.read_bam(spark, str(tmp_path / "out/bam"))
    assert back.count() == found.records.count() and back.where(F.col("edits") == 0).count() > 100


def test_stages_and_forced_nodes(world):
    genomes, reads, own, _ = world
    none = samples.run(reads, genomes, Parameters(k=15, s=8, l=1, stop="index"))
    assert none.placements is None
    placed = samples.run(reads, genomes, Parameters(k=15, s=8, l=1, stop="place"))
    assert placed.records is None and {r["sample"] for r in placed.placements.collect()} == set(own)
    forced = samples.run(reads.where("sample = 'three'"), genomes, Parameters(k=15, s=8, l=1, stop="align", forced="g1"))
    assert forced.calls is None and forced.chosen.first()["node"] == "g1" and forced.records.count() > 50
