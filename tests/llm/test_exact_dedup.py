import hashlib
import re

import duckdb
import pytest

from arborseed.llm import exact_dedup

SPACE = re.compile(r"[\x20\x09-\x0D]+")
LONG = "lang er  text\t" * 40_000
TEXTS = [
    (1, "a b"), (2, "a\t\nb"), (3, "a  b"), (4, "a b "), (5, " a b"), (6, None), (7, ""), (8, " "), (9, "\x0b\x0c\r"), (10, LONG), (11, LONG.replace("\t", " \r\n")),
    (12, LONG + "x"), (13, LONG + "y"), (14, "ab"), (15, "ba"), (16, "é b"), (17, "é b"), (18, "\U0001f600 b"), (None, "a b"), (None, "lone"), (None, "two"), (None, "two"),
    (19, "a\x1cb"), (20, "a\x85b"), (21, "again"), (21, "again"), (22, "again"),
]


def by_hand(rows):
    norm = [(i, SPACE.sub(" ", t or "")) for i, t in rows]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    out = []
    for i, t in norm:
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("prefix,bits", [(256, 26), (2, 6), (1, 8)])
def test_groups_match_brute_force(spark, prefix, bits):
    df = spark.createDataFrame([(*r, 1, "k", i) for i, r in enumerate(TEXTS)], "doc_id long, text string, size int, kept string, n int").repartition(3)
    got = exact_dedup.exact_groups(df, prefix=prefix, bits=bits, digest=True)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = by_hand(TEXTS)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    plain = exact_dedup.exact_groups(df, prefix=prefix, bits=bits)
    assert sorted(map(tuple, plain.collect()), key=repr) == sorted((r[:4] for r in want), key=repr)


def test_one_row_of_each_group_stays(spark):
    df = spark.createDataFrame([(*r, 1, "k", "m") for r in TEXTS], "doc_id long, text string, _sha int, keep string, _May string").repartition(3)
    got = exact_dedup.dedup_documents(df)
    assert got.columns == df.columns
    rows = got.collect()
    want = {(r[1], r[4]) for r in by_hand(TEXTS)}
    assert {(r[0], hashlib.sha256(SPACE.sub(" ", r[1] or "").encode()).hexdigest()) for r in rows} == want and len(rows) == len(want)
    assert all(r[2:] == (1, "k", "m") for r in rows)


def test_only_rows_that_share_a_beginning_are_hashed_whole(spark):
    df = spark.createDataFrame([(1, "abcd"), (2, "abxy"), (3, "zbcd"), (4, "zbcde")], "doc_id long, text string")
    keys = exact_dedup.survivors(df, prefix=2)
    found = exact_dedup.hashed(df, keys, "text", 2, exact_dedup.BITS, "sha", "may").collect()
    assert {r["doc_id"] for r in found if r["sha"]} == {1, 2}


def test_empty_table_and_sql(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_groups(none, digest=True).count() == exact_dedup.dedup_documents(none).count() == 0
    rows = [r for r in TEXTS if r[0] is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "d"))
    got = duckdb.sql(exact_dedup.oracle(f"'{tmp_path}/d/*.parquet'")).fetchall()
    assert sorted(got, key=repr) == by_hand(rows)
