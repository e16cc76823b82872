import random

import pytest

from arborseed.operators import selection as S


def by_hand(pairs, most):
    """The plain loop: all gains anew for each choice."""
    gone, out, taken = set(), [], set()
    while len(out) < most:
        gain, reads = {}, {}
        for r, n, w in pairs:
            if r not in gone and n not in taken:
                gain[n], reads[n] = gain.get(n, 0) + w, reads.get(n, 0) + 1
        if not gain:
            break
        best = min(gain, key=lambda n: (-gain[n], n))
        out.append((len(out), best, gain[best] / S.UNIT, reads[best]))
        taken.add(best)
        gone |= {r for r, n, _ in pairs if n == best}
    return out


@pytest.mark.parametrize("held,at_once,most", [(1024, 32, 300), (4, 2, 300), (1, 1, 6)])
def test_choices_match_the_plain_loop(spark, held, at_once, most):
    rng = random.Random(held)
    weight = {r: rng.choice([1, 2, 5]) * S.UNIT // 10 for r in range(60)}
    pairs = sorted({(r, rng.randrange(14)) for r in range(60) for _ in range(rng.choice([1, 1, 3]))})
    rows = [(r, n, weight[r]) for r, n in pairs]
    got = S.greedy_nodes(spark.createDataFrame(rows, "read_id long, node long, w long"), most, held, at_once)
    assert list(map(tuple, got.orderBy("place").collect())) == by_hand(rows, most)


def test_weights(spark):
    pairs = spark.createDataFrame([(1, "a", 8), (1, "b", 8), (2, "a", 5)], "read_id long, node string, max_score long")
    totals = spark.createDataFrame([(1, 9), (2, 5)], "read_id long, seeds long")
    copies = spark.createDataFrame([(2, 3)], "read_id long, n long")
    weighed = S.read_weights(pairs, totals, copies)
    assert sorted(map(tuple, weighed.collect())) == [(1, "a", 250_000_000), (1, "b", 250_000_000), (2, "a", 3_000_000_000)]
    assert {r["node"]: r["weight"] for r in S.node_weights(weighed).collect()} == {"a": 3.25, "b": 0.25}
    assert S.greedy_nodes(weighed.limit(0)).count() == 0


def test_greedy_nodes_ask_once_for_several_choices(spark, monkeypatch):
    rows = [(100 * n + r, n, 10 + n) for n in range(20) for r in range(5)] + [(5000 + n, m, 3) for n in range(19) for m in (n, n + 1)]
    left, want = rows, []
    while left:
        gains = {n: sum(w for _, m, w in left if m == n) for _, n, _ in left}
        best = min(gains, key=lambda n: (-gains[n], n))
        own = {r for r, m, _ in left if m == best}
        want.append((len(want), best, gains[best] / S.UNIT, sum(m == best for _, m, _ in left)))
        left = [x for x in left if x[0] not in own]
    stash, made = S.stash, []
    monkeypatch.setattr(S, "stash", lambda df, name: (made.append(name), stash(df, name))[1])
    got = [tuple(r) for r in S.greedy_nodes(spark.createDataFrame(rows, "read_id long, node long, w long")).orderBy("place").collect()]
    assert got == want and len(want) == 20
    assert made.count("gone") <= 6  # one for each choice before


@pytest.mark.parametrize("driven", [0, S.PAIRS])
def test_copies_of_nodes_cost_no_rounds(spark, driven):
    rng = random.Random(3)
    rows = sorted({(r, 100 * n, 1 + r % 3) for r in range(40) for n in (r % 8, rng.randrange(8))})
    rows += [(r, n + c, w) for r, n, w in rows for c in range(1, 60)]
    weighed = spark.createDataFrame(rows, "read_id long, node long, w long")
    spark.sparkContext.setJobGroup(f"copies{driven}", "")
    got = [tuple(r) for r in S.greedy_nodes(weighed, driven=driven).orderBy("place").collect()]
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"copies{driven}"))
    spark.sparkContext.setJobGroup("", "")
    assert got == by_hand(rows, S.MOST)
    assert jobs < 60  # 60 copies of a node took five rounds of several jobs for each choice


@pytest.mark.parametrize("held,at_once", [(1024, 32), (2, 1)])
def test_choices_of_pairs_that_the_driver_does_not_hold(spark, held, at_once):
    rng = random.Random(at_once)
    rows = [(r, f"n{n:02}", 1 + (r + n) % 4) for r, n in sorted({(r, rng.randrange(14)) for r in range(50) for _ in range(3)})]
    weighed = spark.createDataFrame(rows, "read_id long, node string, w long")
    for driven in (0, S.PAIRS):
        got = S.greedy_nodes(weighed, 9, held, at_once, driven)
        assert list(map(tuple, got.orderBy("place").collect())) == by_hand(rows, 9)
