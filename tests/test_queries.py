import os

import duckdb
import pytest

import __spark_entry__
from arborseed import catalog

DIR = "/root/testdata/sf0.001"
QUICK = ("closed_syncmers", "kminmers_l3", "sequence_hashes", "dust_of_reads", "seed_quality", "node_genomes", "vcf_prior_records", "sam_fields", "stream_daily", "stream_assign", "mask_reads", "subtracted_intervals", "reverse_complements", "dust_of_names", "phred_scale", "read_dedup", "tree_dfs", "common_ancestors", "vcf_prior", "primer_range_join", "gap_islands", "coordinate_prefix", "merged_intervals", "lineage_rollup", "seed_stats", "read_max_epp")


def plain(rows):
    return sorted(repr(tuple(round(float(v), 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the test tables are not here")
@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    got = catalog.QUERIES[name](spark, DIR)
    want = con.sql(catalog.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(got.select(*columns).collect()) == plain(want.select(*columns).fetchall())


def test_entry_lists_what_there_is():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and set(catalog.QUERIES) <= set(queries)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the test tables are not here")
def test_em_abundance_takes_all_ranks_of_the_reference(spark, monkeypatch):
    import inspect

    from arborseed.operators import mixture

    bound, seen = inspect.signature(mixture.abundances), []
    monkeypatch.setattr(mixture, "abundances", lambda *a, **k: seen.append(bound.bind(*a, **k)))
    catalog.QUERIES["em_abundance"](spark, DIR)
    seen[0].apply_defaults()
    assert seen[0].arguments["top_oc"] == 1000


def test_candidates_score_documents_once(spark):
    from arborseed.plans import queries as Q

    x = Q.topk_candidates(spark, "/root/testdata/sf0.001")
    assert "MapInArrow" not in x._jdf.queryExecution().executedPlan().toString()  # scores are written, not made for each metric


def test_drawn_changes_carry_no_genomes(spark):
    from arborseed.operators import genomes as G

    x = spark.createDataFrame([(1, "ACGT" * 30), (2, "")], "k long, s string")
    plan = G.simulated_changes(x, "k", "s", 8)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = max(i for i, line in enumerate(plan) if "Aggregate [" in line)
    assert "Project [" in plan[at + 1] and ", s#" not in plan[at + 1]  # what the aggregation sorts
