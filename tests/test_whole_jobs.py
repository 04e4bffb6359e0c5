"""Queries that do the whole of a job whose registered SQL has a cut."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loginloom.operators import evaluation, features, graph
from loginloom.plans import analysis_queries, registry
from tests.test_registered import SF, TABLES, _plain


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def equals_sql(spark, con, name):
    want = con.execute(registry.oracle_sql()[name])
    columns, rows = [c[0] for c in want.description], want.fetchall()
    got = registry.queries()[name](spark, SF).select(*columns).collect()
    assert rows and _plain(map(tuple, got)) == _plain(rows)


@pytest.mark.parametrize("name", ["h07_empirical_percentile", "f14_related_alerts", "j06_host_day_rank"])
def test_all_ids_equal_sql(spark, con, name):
    equals_sql(spark, con, name)


@pytest.mark.parametrize("name", ["f03_rank_paths", "f04_score_paths", "f05_incremental_paths"])
def test_long_paths_equal_sql(spark, con, name):
    sql = registry.oracle_sql()["f03_rank_paths"]
    assert con.execute(f"SELECT max(n_edges) FROM ({sql})").fetchone()[0] > 3
    equals_sql(spark, con, name)


def test_distance_has_no_bound(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(13)] + [(13, 5), (20, 12), (30, 31)], "a long, b long")
    seeds = spark.createDataFrame([(0,), (20,)], "node long")
    want = {i: min(i, 3 + i - 5) if i > 5 else i for i in range(12)} | {12: 1, 13: 2, 5: 3, 20: 0}
    assert {r.node: r.hops for r in graph.hop_distance(edges, seeds).collect()} == want
    alone = graph.hop_distance(edges, seeds.filter("node = 0"))
    assert {r.node: r.hops for r in alone.collect()} == {i: i for i in range(14)}


def test_diffusion_and_distance_of_the_queries(spark):
    edges, seeds = analysis_queries._whole_graph(spark, SF)
    edges, seeds = edges.collect(), {r.node: r.seed for r in seeds.collect()}
    nodes = sorted({x for r in edges for x in (r.a, r.b)} | set(seeds))
    at = {x: i for i, x in enumerate(nodes)}
    share, seed = np.zeros((len(nodes), len(nodes))), np.array([seeds.get(x, 0.0) for x in nodes])
    for r in edges:
        share[at[r.b], at[r.a]] += r.weight
    share /= np.maximum(share.sum(0), 1)
    mass = seed
    for _ in range(300):
        mass = 0.15 * seed + 0.85 * share @ mass
    got = {r.node: r.mass for r in registry.queries()["f08_risk_propagation"](spark, SF).collect()}
    assert set(got) == set(nodes) and all(abs(got[x] - mass[at[x]]) < 5e-6 for x in nodes)
    hops, front = dict.fromkeys(seeds, 0), set(seeds)
    while front:
        front = {r.b for r in edges if r.a in front} - set(hops)
        hops |= dict.fromkeys(front, max(hops.values()) + 1)
    assert {r.node: r.hops for r in registry.queries()["f09_hop_distance"](spark, SF).collect()} == hops


def test_every_sampled_event_has_its_five_probes(spark):
    day = 86_400
    rows = [(i, i % 3 * day, 1, 10 + i % 2, 20 + i % 2) for i in range(60)] + [(60 + i, 3 * day, 1, 30, 31) for i in range(40)]
    e = spark.createDataFrame(rows, "event_id long, t long, usr long, src long, dst long")
    probes = features.counterfactuals(e, share=1.0).collect()
    real = {r[0]: r for r in rows}
    seen = {d: {x for r in rows if r[1] <= d * day for x in r[3:]} for d in range(4)}
    kinds = {}
    for r in probes:
        _, t, usr, src, dst = real[r.real_id]
        kinds.setdefault(r.real_id, []).append(r.kind)
        assert (r.t, r.usr) == (t, usr) and r.src != r.dst and (r.src, r.dst) != (src, dst)
        assert r.src == src if r.kind.startswith("dst") else r.dst == dst
        assert {r.src, r.dst} <= seen[t // day]
    assert set(kinds) == set(real) and all(sorted(k) == ["dst_popular"] * 2 + ["dst_uniform"] + ["src_popular"] * 2 for k in kinds.values())
    assert len({r.event_id for r in probes}) == 500 and max(r.event_id for r in probes) < 0
    redrawn = {(r.src, r.dst) for r in probes if r.real_id >= 60}  # the day has one pair, so every popular draw is redrawn
    assert {d for s, d in redrawn if s == 30} == {10, 11, 20, 21} == {s for s, d in redrawn if d == 31}


def test_bootstrap_of_all_replicates(spark):
    rng = np.random.default_rng(3)
    rows = [(float(s), int(rng.integers(0, 4)), int(rng.integers(0, 30))) for s in range(40)]
    blocks = spark.createDataFrame(rows, "score double, n_pos long, n_neg long")
    pos, neg = (np.array([r[c] for r in reversed(rows)]) for c in (1, 2))
    p, q = (rng.multinomial(x.sum(), x / x.sum(), 20_000).cumsum(1) for x in (pos, neg))
    want = np.percentile((np.diff(p, axis=1, prepend=0) * p / np.maximum(1, p + q)).sum(1) / pos.sum(), [2.5, 97.5])
    for chunk in (7, 20_000):
        got = evaluation.bootstrap(blocks, chunk=chunk).first()
        assert got.replicates == 2_000 and np.allclose([got.low, got.high], want, atol=0.015)


def test_similar_by_blocks(spark, con, monkeypatch):
    monkeypatch.setattr(graph, "QUERIES", 2)
    monkeypatch.setattr(graph, "VECTORS", 60)
    equals_sql(spark, con, "f13_similar_entities")
    many = spark.range(10_001).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id") % 7).alias("embedding"))
    monkeypatch.undo()
    got = {r.query_id: r.vec_id for r in graph.similar(many, many, k=1).collect()}
    assert got == {i: i % 7 if i >= 7 else i + 7 for i in range(10_001)}


def test_incidents_are_cut_by_gaps(spark):
    rows = [(1, 7, 0), (2, 7, 1_800), (3, 7, 3_601), (4, 8, 10), (5, 7, 3_601)]
    a = spark.createDataFrame(rows, "event_id long, usr long, t long")
    assert {r.event_id: r.incident for r in graph.incidents(a).collect()} == {1: "7@0", 2: "7@0", 3: "7@3601", 4: "8@10", 5: "7@3601"}
    f10 = registry.queries()["f10_kill_chain"](spark, SF).select("incident").distinct().collect()
    assert f10 and all("@" in r.incident for r in f10)


def test_features_share_sorts_and_keep_keys_apart(spark):
    """Windows of a key and partner share one sort, small partitions of keys aren't merged, and marks of runs carry no columns."""
    from loginloom.operators import features
    from loginloom.plans import registry

    for name in ("d23_causal_features", "d25_counterfactual_features"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Sort [") <= 13 and plan.count("REPARTITION_BY_NUM") == 3 and "REPARTITION_BY_COL" not in plan
    events = spark.createDataFrame([(i, 100 * (i % 7), i % 2, i % 3, i % 5, 0, 1) for i in range(40)], "event_id long, t long, usr long, src long, dst long, logon_id int, success int")
    got = features.with_features(events, ["user_unique_dst_5m", "pair_seen_before"], on=events["event_id"] % 4 != 0).collect()
    assert len(got) == 40
    for r in got:
        past = [o for o in got if o.event_id % 4 != 0 and o.usr == r.usr and o.t < r.t]
        assert r.user_unique_dst_5m == len({o.dst for o in past if o.t > r.t - 300}) and r.pair_seen_before == int(any(o.dst == r.dst for o in past))


def test_recent_neighbors_need_one_shuffle(spark):
    from loginloom.operators import graph

    events = spark.createDataFrame([(i, i // 3, None if i % 11 == 0 else i % 2, None if i % 7 == 0 else i % 5) for i in range(60)], "event_id long, t long, usr long, dst long")
    for window in (None, 6):
        found = graph.recent_neighbors(events, 4, window)
        rows = events.collect()
        for r, got in ((r, {g.event_id: g for g in found.collect()}[r.event_id]) for r in rows):
            past = [o for o in rows if r.usr is not None and o.usr == r.usr and o.t < r.t][::-1][:4]
            past = [o for o in past if not window or o.t > r.t - window]
            assert (got.n_neighbors, got.neighbors) == (len(past), ",".join(str(o.dst) for o in past if o.dst is not None))
    plan = graph.recent_neighbors(events, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
