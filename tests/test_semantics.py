"""Hand-made rows: ties, boundaries, chains, fan-out, paths, diffusion, streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from loginloom.operators import evaluation, features, graph, rules, studies
from loginloom.operators.windows import global_position, rolling_split, running_totals
from loginloom.plans import registry
from loginloom.plans.detection_queries import rounded
from loginloom.plans.fixtures import auth_sparse
from loginloom.streaming import streams

E = "event_id long, t long, usr long, src long, dst long, logon_id int, success int, label int"


def events(spark, rows):
    return spark.createDataFrame([(i, t, u, s, d, 0, ok, 0) for i, (t, u, s, d, ok) in enumerate(rows)], E)


def test_ties_and_window_boundary(spark):
    e = events(spark, [(0, 1, 5, 6, 1), (300, 1, 5, 6, 1), (300, 1, 5, 7, 0), (301, 1, 5, 6, 1)])
    x = {r.event_id: r for r in features.with_features(e, ["user_auth_rate_5m", "pair_seen_before", "user_unique_dst_5m"]).collect()}
    assert [x[i].user_auth_rate_5m for i in range(4)] == [0, 0, 0, 2]
    assert [x[i].pair_seen_before for i in range(4)] == [0, 1, 0, 1]
    assert x[3].user_unique_dst_5m == 2


def test_chain_fires_after_three_novel_hops(spark):
    walk = [(0, 1, 10, 11, 1), (100, 1, 11, 12, 1), (200, 1, 12, 13, 1), (300, 1, 13, 14, 1), (400, 1, 14, 15, 1)]
    flags = {r.event_id: r.chain_hop for r in rules.chain_flags(events(spark, walk)).collect()}
    assert [flags[i] for i in range(5)] == [0, 0, 0, 0, 1]
    failed = [*walk[:3], (300, 1, 13, 14, 0), (400, 1, 14, 15, 1)]
    assert sum(r.chain_hop for r in rules.chain_flags(events(spark, failed)).collect()) == 0
    slow = [(t * 30, *rest) for t, *rest in walk]
    assert sum(r.chain_hop for r in rules.chain_flags(events(spark, slow)).collect()) == 0


def test_one_account_is_no_fanout(spark):
    one = [(i, 1, 5, 100 + i, 1) for i in range(12)]
    many = [(i, i, 5, 100 + i, 1) for i in range(12)]
    hops = lambda rows: sum(r.fanout_hop for r in rules.fanout_flags(events(spark, rows)).collect())
    assert hops(one) == 0 and hops(many) > 0


def test_paths(spark):
    rows = [(1, 0, 1, 2), (2, 10, 2, 3), (3, 10, 3, 4), (4, 20, 3, 1), (5, 5_000, 3, 9)]
    s = spark.createDataFrame([(i, t, a, b, 0.9, 1, 1) for i, t, a, b in rows], "event_id long, t long, src long, dst long, risk double, is_new int, support int")
    assert {tuple(r.events) for r in graph.rank_paths(s).collect()} == {(1, 2), (2, 4)}


def test_diffusion_and_distance(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("x", "y", 1.0)], "a string, b string, weight double")
    seeds = spark.createDataFrame([("a", 1.0)], "node string, seed double")
    mass = {r.node: r.mass for r in graph.propagate(edges, seeds).collect()}
    assert mass["x"] == mass["y"] == 0 and mass["a"] == pytest.approx(0.15) and mass["c"] == pytest.approx(0.15 * 0.85**2)
    assert {r.node: r.hops for r in graph.hop_distance(edges, seeds).collect()} == {"a": 0, "b": 1, "c": 2}


def test_kill_chain_diamond(spark):
    hops = [(1, 1, 10, 0, "a", "b", 0.5), (1, 2, 10, 0, "a", "c", 0.5), (1, 3, 20, 0, "b", "d", 0.5), (1, 4, 30, 0, "d", "e", 0.5)]
    rows = graph.kill_chain(spark.createDataFrame(hops, "incident long, event_id long, t long, hop long, actor string, target string, risk double")).collect()
    assert {r.node: r.layer for r in rows} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3} and rows[0].longest == 3


def test_metrics_with_ties(spark):
    scores = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.5, 1), (0.5, 0)], "score double, label int")
    assert evaluation.roc_auc(evaluation.block_table(scores)).first().roc_auc == 0.5
    assert evaluation.average_precision(evaluation.block_table(scores)).first().average_precision == 0.5


def test_prefixes_equal_a_global_window(spark):
    rows = spark.range(1_000).select(F.pmod(F.xxhash64("id"), F.lit(10_000)).alias("k"), "id").withColumn("v", F.col("id") % 7)
    at = {r.id: r.position for r in global_position(rows, ["k", "id"]).collect()}
    order = sorted(rows.collect(), key=lambda r: (r.k, r.id))
    assert [at[r.id] for r in order] == list(range(1_000))
    total = 0
    cum = {r.id: r.cum_v for r in running_totals(rows.select("id", "v"), "id", ["v"]).collect()}
    for i in range(1_000):
        total += i % 7
        assert cum[i] == total


def test_split_windows_equal_whole_ones(spark):
    e = events(spark, [(i * 977 % 400_000, i % 3, 1, i % 11, 1) for i in range(500)])
    whole = {r.event_id: r.user_auth_rate_5m for r in features.with_features(e, ["user_auth_rate_5m"]).collect()}
    assert {r.event_id: r.n for r in rolling_split(e, 300, ["usr"], {"n": F.count("*")}).collect()} == whole


def test_incremental_features_of_all_days_equal_batch(spark):
    sf, names = "/root/testdata/sf0.001", streams.incremental.FEATURES
    got = registry.queries()["d24_incremental_features"](spark, sf).select("event_id", *names).collect()
    e = auth_sparse(spark, sf)
    want = {r.event_id: r for r in rounded(features.with_features(e, names), "event_id", *names).collect()}
    assert e.select(F.floor(F.col("t") / 86_400)).distinct().count() > 3 and len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == pytest.approx(tuple(want[r.event_id])[1:], abs=2e-6)


def test_incremental_features_know_null_accounts_and_shuffle_once_a_key(spark):
    """What is known of events without an account or a logon type isn't lost with the day, and a step deals its rows three times."""
    rows = [(i, 1_700_000_000 + i * 9_000, [1, None, 2][i % 3], i % 4, 10 + i % 5, [0, None][i % 2], i % 2, 0) for i in range(60)]
    e = spark.createDataFrame(rows, "event_id long, t long, usr long, src long, dst long, logon_id int, success int, label int")
    incremental, names = streams.incremental, streams.incremental.FEATURES
    want = {r.event_id: r for r in features.with_features(e, names).select("event_id", *names).collect()}
    got, _ = incremental.advance_days(e, step=2)
    got = got.select("event_id", *names).collect()
    assert len(got) == 60
    for r in got:
        assert tuple(r)[1:] == pytest.approx(tuple(want[r.event_id])[1:], abs=1e-9)
    x, _ = incremental.advance_day(e, incremental.empty_state(spark), cut=False)
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 3 and plan.count("Join") == 0


def test_stream_context_equals_a_plain_loop_and_joins_no_events(spark):
    from loginloom.operators import tactics
    from loginloom.plans.detection_queries import classified

    n, rows = 7, [(i, 1_000 + i * 13 % 97, i % 5, ["TGT", "TGS", "LogOn"][i * 7 % 11 % 3], ["Kerberos", "NTLM"][i * 5 % 7 % 2]) for i in range(200)]
    e = spark.createDataFrame(rows, "event_id long, t long, usr long, orient_name string, auth_name string")
    got = {r.event_id: r for r in tactics.stream_context(e, n).collect()}
    last, asked, done = {}, set(), []
    for i, t, usr, orient, auth in sorted(rows, key=lambda r: (r[1], r[0])):
        r = got[i]
        assert r.seconds_since_tgt == (t - last[usr] if usr in last else None)
        assert r.tgt_coverage == pytest.approx(len(last) / len(asked) if asked else 0.0)
        assert r.kerberos_share == pytest.approx(sum(done[-n:]) / len(done[-n:]) if done else 0.0)
        if orient == "TGT":
            last[usr] = t
        if orient != "LogOn":
            asked.add(usr)
        done.append(auth == "Kerberos")
    # joins with the small tables of partitions' starts and ends only, none of events with events
    plan = classified(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == plan.count("strategy=broadcast") == 3


def _batches(tmp_path, rows):
    (tmp_path / "in").mkdir()
    for i, part in enumerate(rows):
        file = tmp_path / "in" / f"{i:03}.json"
        file.write_text("\n".join(json.dumps(dict(zip(["event_id", "t", "usr", "src", "dst", "logon_id", "success", "label"], r))) for r in part))
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(tmp_path / "in")


def test_streams_equal_batch(spark, tmp_path):
    rows = [(i, 1_700_000_000 + i * 40, i % 3, (i * 7) % 9, (i * 5 + 1) % 11 + 20, 0, int(i % 4 > 0), 0) for i in range(90)]
    rows = [r if i % 2 else (*r[:3], 20 + (i % 5), *r[4:]) for i, r in enumerate(rows)]
    path = _batches(tmp_path, [rows[:40], rows[40:70], rows[70:]])
    streams.start_features(streams.events_stream(spark, path), str(tmp_path / "state"), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    e = spark.createDataFrame(rows, E)
    names = streams.incremental.FEATURES
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out/features")).select("event_id", *names).collect()))
    want = sorted(map(tuple, features.with_features(e, names).select("event_id", *names).collect()))
    assert [tuple(round(v, 9) for v in r) for r in got] == [tuple(round(v, 9) for v in r) for r in want]


def test_stream_chain_rule_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    walk = [(i, i * 100, 1, 10 + i, 11 + i, 0, 1, 0) for i in range(8)]
    path = _batches(tmp_path, [walk[:3], walk[3:]])
    streams.start_chain_rule(streams.events_stream(spark, path), str(tmp_path / "flags"), str(tmp_path / "c")).awaitTermination()
    got = {r.event_id: r.chain_hop for r in spark.read.parquet(str(tmp_path / "flags")).collect()}
    assert got == {r.event_id: r.chain_hop for r in rules.chain_flags(spark.createDataFrame(walk, E)).collect()}


def test_late_rows_go_to_quarantine_and_keep_the_state(spark, tmp_path):
    t = 1_700_000_000
    path = _batches(tmp_path, [[(1, t, 1, 2, 3, 0, 1, 0), (2, t + 10, 1, 2, 3, 0, 1, 0)], [(3, t + 5, 1, 2, 3, 0, 1, 0)], [(4, t + 20, 1, 2, 3, 0, 1, 0), (5, t + 10, 1, 2, 4, 0, 1, 0)]])
    streams.start_features(streams.events_stream(spark, path), str(tmp_path / "state"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = {r.event_id: r.user_auth_rate_5m for r in spark.read.parquet(str(tmp_path / "out/features")).collect()}
    assert got == {1: 0, 2: 1, 4: 2}
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out/quarantine")).collect()) == [3, 5]


def test_windowed_counts_up_to_the_watermark(spark, tmp_path):
    hour, t = 3_600, 1_699_999_200
    rows = [(i, t + i * 600, 1, 2, 3, 0, i % 3 and 1, 0) for i in range(48)]
    path = _batches(tmp_path, [rows[:20], rows[20:40], rows[40:]])
    streams.start_counts(streams.events_stream(spark, path), str(tmp_path / "counts"), str(tmp_path / "c")).awaitTermination()
    got = {r.start_t: (r.events, r.failures) for r in spark.read.parquet(str(tmp_path / "counts")).collect()}
    closed = [k for k in range(8) if t + (k + 1) * hour <= rows[-1][1] - hour]
    assert got == {t + k * hour: (6, 2) for k in closed} and len(closed) == 6


def test_receipts_take_a_batch_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, part in enumerate([[("a", "1"), ("a", "2"), ("b", "1")], [("a", "2"), ("a", "1")], [("b", "other"), ("c", "1")]]):
        file = tmp_path / "in" / f"{i}.json"
        file.write_text("\n".join(json.dumps({"batch_key": k, "payload": p}) for k, p in part))
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema("batch_key string, payload string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    streams.start_receipts(stream, str(tmp_path / "receipts"), str(tmp_path / "accepted"), str(tmp_path / "c")).awaitTermination()
    receipts = sorted((r.batch, r.batch_key, r.status) for r in spark.read.parquet(str(tmp_path / "receipts")).collect())
    assert receipts == [(0, "a", "accepted"), (0, "b", "accepted"), (1, "a", "repeated"), (2, "b", "rejected"), (2, "c", "accepted")]
    assert sorted((r.batch_key, r.payload) for r in spark.read.parquet(str(tmp_path / "accepted")).collect()) == [("a", "1"), ("a", "2"), ("b", "1"), ("c", "1")]
