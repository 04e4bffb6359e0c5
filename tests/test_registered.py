"""Registered queries against their SQL on the smallest tables, and the driver's contract."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from loginloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One of each family here; the driver compares every query.
NAMES = ["d08_user_unique_dst", "d23_causal_features_sparse", "d24_incremental_features", "d25_counterfactual_features", "e03_chain_hop", "e05_fanout_baseline", "e06_fanout_hop", "e10_fuse_noisy_or", "f02_recent_neighbors", "f07_entity_risk", "g09_tgt_context", "i01_chronological_split", "i02_average_precision", "i14_precision_gate", "i22_grouped_auc", "c12_build_dictionary", "a06_normalize_windows", "b01_parse_event_time", "j06_host_day_rank", "k06_lock_intervals", "k01_response_plan", "k03_budget_gate", "k04_corroborated_lock", "k08_feedback_labels", "j08_lock_policy", "l01_overview", "i19_exact_auc_ap", "d28_process_novelty", "i22_group_summary", "b08_canonical_words", "b09_one_hot", "b15_severity_bands", "c14_resolve_live_ids", "g12_technique_metrics", "j12_latency_summary", "k12_evidence_rows", "h08_combine_percentiles_max"]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(rows):
    return sorted((tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = registry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert _plain(map(tuple, got.select(*columns).collect())) == _plain(want.fetchall())


def test_every_sql_parses_and_has_a_query(con):
    for name, sql in registry.oracle_sql().items():
        assert name in registry.queries()
        con.execute(f"EXPLAIN {sql}")


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
