import random
import re

import numpy as np
import pytest

from arborseed.operators import alignment as A

ROOM = 200


def plain(read, window, p):
    """The best score of a local alignment (or, for old reads, of the whole read) with affine gaps, end bonuses included, cell by cell."""
    low = -10**9
    h = [[low] * (len(window) + 1) for _ in range(len(read) + 1)]
    e, f = [row[:] for row in h], [row[:] for row in h]
    h[0] = [p.end_bonus] * (len(window) + 1)
    best = 0 if not p.whole else low
    for i in range(1, len(read) + 1):
        for j in range(len(window) + 1):
            e[i][j] = max(h[i - 1][j] - p.opens - p.extends, e[i - 1][j] - p.extends)
            over = low
            if j:
                f[i][j] = max(h[i][j - 1] - p.opens - p.extends, f[i][j - 1] - p.extends)
                over = h[i - 1][j - 1] + (p.match if read[i - 1] == window[j - 1] else -p.mismatch)
            h[i][j] = max(over, e[i][j], f[i][j], low if p.whole else 0)
            if i == len(read):
                best = max(best, h[i][j] + p.end_bonus)
            elif not p.whole:
                best = max(best, h[i][j])
    return best


def score_of(ops, read, window, start, p):
    total, i, j = 0, 0, start
    total += p.end_bonus * (ops[0][1] != "S") + p.end_bonus * (ops[-1][1] != "S")
    for n, kind in ops:
        if kind == "M":
            total += sum(p.match if a == b else -p.mismatch for a, b in zip(read[i : i + n], window[j : j + n], strict=True))
        elif kind in "ID":
            total -= p.opens + n * p.extends
        i, j = i + n * (kind in "MIS"), j + n * (kind in "MD")
    assert i == len(read)
    return total


def edited(rng, s, rate):
    out = []
    for c in s:
        x = rng.random()
        out.append(rng.choice("ACGT") if x < rate else "" if x < 1.5 * rate else c + rng.choice("ACGT") * rng.randint(1, 3) if x < 2 * rate else c)
    return "".join(out)


@pytest.mark.parametrize("name", list(A.PRESETS))
def test_scores_match_the_plain_recurrence(name):
    """Random pairs in a band that holds every cell: the best score, and a path that has it."""
    p, rng = A.PRESETS[name], random.Random(name)
    pairs = []
    for _ in range(60):
        window = "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 70)))
        a = rng.randrange(len(window))
        pairs.append((edited(rng, window[a : a + rng.randint(1, 50)], rng.choice([0, 0.05, 0.3])) or "A", window))
    n, m = (np.array([len(x[i]) for x in pairs]) for i in range(2))
    own, there = np.full((60, n.max()), 5), np.full((60, m.max()), 9)
    for k, (a, b) in enumerate(pairs):
        own[k, : n[k]], there[k, : m[k]] = (["ACGT".index(c) for c in x] for x in (a, b))
    got = A.banded(own, n, there, m, -n, int((n + m).max()) + 1, p)
    for (read, window), (score, start, ops) in zip(pairs, got, strict=True):
        want = plain(read, window, p)
        if not ops:
            assert want <= 0
            continue
        assert score_of(ops, read, window, start, p) == want
        assert score == want - p.end_bonus * ((ops[0][1] != "S") + (ops[-1][1] != "S"))
        assert all(a[1] != b[1] for a, b in zip(ops, ops[1:])) and all(x[0] > 0 for x in ops)


def rebuilt(reference, start, cigar, md, read):
    """The reference's aligned part from the read, CIGAR and MD alone, and the edits."""
    i, bases, edits, inserted = 0, [], 0, 0
    for n, kind in re.findall(r"(\d+)([MIDS])", cigar):
        n = int(n)
        if kind == "M":
            bases += list(read[i : i + n])
        inserted += n * (kind == "I")
        i += n * (kind in "MIS")
    out, at = [], 0
    for run, gone, other in re.findall(r"(\d+)(?:\^([ACGTN]+)|([ACGTN]))?", md):
        out += bases[at : at + int(run)]
        at += int(run)
        if gone:
            out.append(gone)
            edits += len(gone)
        elif other:
            assert bases[at] != other
            out.append(other)
            at, edits = at + 1, edits + 1
    return "".join(out), edits + inserted


def test_reads_with_insertions_deletions_and_clips(spark):
    rng = random.Random(9)
    genomes = {f"g{i}": "".join(rng.choice("ACGT") for _ in range(3000)) for i in range(3)}
    comp = str.maketrans("ACGT", "TGCA")
    rows, want = [], {}
    for i in range(120):
        node = f"g{i % 3}"
        a, n = rng.randrange(2500), rng.randint(160, 300)
        part, kind = genomes[node][a : a + n], i % 4
        mid = n // 2
        if kind == 1:
            part, expect = part[:mid] + part[mid + 5 :], (f"{mid}M5D", 5)
        elif kind == 2:
            part, expect = part[:mid] + "ACGTTGCA" + part[mid:], (None, 8)
        elif kind == 3:
            tail = "".join(rng.choice("ACGT") for _ in range(60))
            part, expect = part + tail, ("S", None)
        else:
            swap = {"A": "C", "C": "G", "G": "T", "T": "A"}[part[70]]
            part, expect = part[:70] + swap + part[71:], (f"{n}M", 1)
        rev = i % 2 == 1
        rows.append((i, part[::-1].translate(comp) if rev else part))
        want[i] = (node, a, rev, part, *expect)
    reads = spark.createDataFrame([*rows, (500, "A" * 200), (501, ""), (502, None)], "read_id long, seq string")
    refs = spark.createDataFrame([*genomes.items(), ("none", None), ("short", "ACG")], "node string, reference string")
    pairs = spark.createDataFrame([(i, w[0]) for i, w in want.items()] + [(500, "g0"), (501, "g0"), (502, "g1"), (0, "short"), (0, "none"), (9999, "g0")], "read_id long, node string")
    got = {r["read_id"]: r for r in A.aligned_pairs(pairs, reads, refs).collect()}
    assert set(got) == set(want)
    for i, (node, a, rev, part, cigar, edits) in want.items():
        r = got[i]
        assert (r["node"], r["rev"]) == (node, rev)
        there, counted = rebuilt(genomes[node], r["start"], r["cigar"], r["md"], part)
        assert genomes[node][r["start"] : r["end"]] == there and counted == r["edits"]
        assert abs(r["start"] - a) <= 8 and (edits is None or r["edits"] <= edits) and r["quality"] > 0
        if cigar == "S":
            assert r["cigar"].endswith("S") or r["cigar"].count("S")
        elif i % 4 == 0:
            assert r["cigar"] == cigar and r["start"] == a
        elif i % 4 == 1:
            assert "5D" in r["cigar"]


def test_presets(spark):
    assert [A.preset_of(x) for x in (0, 499, 500, 4999, 5000)] == ["short", "short", "long", "long", "accurate"]
    assert [A.allowed_edits(n, 0.02, 0.04) for n in (17, 37, 38, 64, 93, 124)] == [2, 2, 3, 4, 5, 6] and A.allowed_edits(100) == 6
    rng = random.Random(2)
    g = "".join(rng.choice("ACGT") for _ in range(2000))
    part = list(g[300:360])
    for at in (0, 1, 59):  # damaged ends
        part[at] = "T" if part[at] != "T" else "A"
    bad = edited(rng, g[900:960], 0.4)
    reads = spark.createDataFrame([(1, "".join(part)), (2, bad), (3, g[1000:1900])], "read_id long, seq string")
    pairs = spark.createDataFrame([(1, "g"), (2, "g"), (3, "g")], "read_id long, node string")
    refs = spark.createDataFrame([("g", g)], "node string, reference string")
    old = {r["read_id"]: r for r in A.aligned_pairs(pairs, reads, refs, "old").collect()}
    assert (old[1]["cigar"], old[1]["start"], old[1]["edits"]) == ("60M", 300, 3) and 2 not in old
    for name in ("short", "long", "accurate"):
        found = {r["read_id"]: r for r in A.aligned_pairs(pairs, reads, refs, name).collect()}
        assert (found[3]["cigar"], found[3]["start"], found[3]["md"]) == ("900M", 1000, "900")


def test_repeats_have_no_mapping_quality(spark):
    rng = random.Random(5)
    unit = "".join(rng.choice("ACGT") for _ in range(300))
    g = unit + "".join(rng.choice("ACGT") for _ in range(500)) + unit
    refs = spark.createDataFrame([("g", g)], "node string, reference string")
    reads = spark.createDataFrame([(1, unit), (2, g[350:650])], "read_id long, seq string")
    got = {r["read_id"]: r for r in A.aligned_pairs(reads.selectExpr("read_id", "'g' AS node"), reads, refs).collect()}
    assert got[1]["quality"] == 0 and got[1]["start"] == 0 and got[2]["quality"] == 60
