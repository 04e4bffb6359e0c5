"""Streams whose state is keyed or versioned: fan-out in any order of arrival, paths, counts for each source."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from loginloom.operators import graph, rules
from loginloom.streaming import keyed, status, streams

E = "event_id long, t long, usr long, src long, dst long, logon_id int, success int, label int"
LIMITS = dict(accounts=3, novel=2, baseline=4.0, window=3_600, days=3)


def batches(tmp_path, parts, columns):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, part in enumerate(parts):
        file = folder / f"{i:03}.json"
        file.write_text("\n".join(json.dumps({k: v for k, v in zip(columns, r) if v is not None}) for r in part))
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(folder)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def fanout_events():
    """Eleven days of a workstation, a hub and an attacker that begins late; ties, failures and a gap of two days."""
    rnd, rows = random.Random(3), []
    for day in [0, 1, 2, 3, 6, 7, 8]:
        base = 1_700_006_400 + day * 86_400
        for src, busy in ((1, 6), (2, 40), (3, 45 if day == 8 else 3)):
            for _ in range(busy):
                rows.append((base + rnd.randint(0, 5_000), rnd.randint(1, 9), src, rnd.randint(10, 60), int(rnd.random() < 0.8)))
    rows.sort()
    return [(i, t, usr, src, dst, 0, ok, 0) for i, (t, usr, src, dst, ok) in enumerate(rows)]


def test_fanout_in_any_order_equals_batch(spark, tmp_path, rocks):
    rows = fanout_events()
    late = 1_800
    rnd = random.Random(4)
    arrival = sorted(rows, key=lambda r: r[1] + rnd.uniform(0, late * 0.9))  # within the allowed lateness, so none is dropped
    cuts = [0, 25, 60, 61, 130, 190, len(arrival)]
    parts = [arrival[a:b] for a, b in zip(cuts, cuts[1:])]
    for p in parts:
        rnd.shuffle(p)
    end = (9_999, rows[-1][1] + 10 * 86_400, 99, 99, 98, 0, 0, 0)  # moves the watermark past all others
    path = batches(tmp_path, [*parts, [end]], [c.split()[0] for c in E.split(", ")])
    keyed.start_fanout_rule(streams.events_stream(spark, path), str(tmp_path / "out"), str(tmp_path / "c"), late=f"{late} seconds", accounts=3, novel=2, baseline=4.0, days=3).awaitTermination()
    names = ["event_id", "fanout_accounts", "fanout_novel", "dst_novel", "fanout_hop"]
    got = spark.read.parquet(str(tmp_path / "out"))
    e = spark.createDataFrame(rows, E)
    inputs = rules.fanout_inputs(e).withColumn("day", F.floor(F.col("t") / 86_400))
    base = rules.fanout_baseline(inputs, days=3)
    want = rules.fanout_flags(e, accounts=3, novel=2, baseline=1e9)
    want = want.withColumn("day", F.floor(F.col("t") / 86_400)).drop("baseline").join(base, ["src", "day"]).withColumn("fanout_hop", F.when(F.col("baseline") <= 4.0, F.col("fanout_hop")).otherwise(0))
    assert sorted(map(tuple, got.select(*names, "baseline").collect())) == sorted(map(tuple, want.select(*names, "baseline").collect()))
    last = [r[0] for r in rows if r[1] >= rows[-1][1] - 86_400]
    hops = {r.src for r in got.filter("fanout_hop = 1").collect() if r.event_id in last}
    assert 3 in hops and 2 not in hops  # the hub's own past keeps it out


def test_fanout_state_shrinks_after_its_window(spark, tmp_path, rocks):
    t = 1_700_006_400
    first = [(i, t + i, i % 5, 1, 10 + i, 0, 1, 0) for i in range(30)]
    path = batches(tmp_path, [first, [(100, t + 20_000, 1, 2, 3, 0, 1, 0)], [(101, t + 40_000, 1, 2, 4, 0, 1, 0)]], [c.split()[0] for c in E.split(", ")])
    keyed.start_fanout_rule(streams.events_stream(spark, path), str(tmp_path / "out"), str(tmp_path / "c"), late="60 seconds", forget=7_200).awaitTermination()
    state = lambda name: spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "c"))
    for name in ("accounts", "moves", "reached", "waiting"):
        keys = {r.key.src if hasattr(r, "key") else r[0] for r in state(name).select("key").collect()}
        assert 1 not in keys, name
    assert spark.read.parquet(str(tmp_path / "out")).count() == 31  # the last row still waits


def test_chain_rule_lets_go_of_hosts_behind_the_window(spark, tmp_path, rocks):
    walk = [(i, i * 600, 1, 10 + i, 11 + i, 0, 1, 0) for i in range(12)]
    path = batches(tmp_path, [walk[:4], walk[4:9], walk[9:]], [c.split()[0] for c in E.split(", ")])
    streams.start_chain_rule(streams.events_stream(spark, path), str(tmp_path / "flags"), str(tmp_path / "c")).awaitTermination()
    got = {r.event_id: (r.chain_continues, r.chain_hop) for r in spark.read.parquet(str(tmp_path / "flags")).collect()}
    assert got == {r.event_id: (r.chain_continues, r.chain_hop) for r in rules.chain_flags(spark.createDataFrame(walk, E)).collect()}
    held = spark.read.format("statestore").option("stateVarName", "reached").load(str(tmp_path / "c")).count()
    assert held == 4  # those of the last 1,800 seconds


def test_paths_of_batches_are_those_of_all_rows(spark, tmp_path):
    rnd = random.Random(6)
    columns = ["event_id", "t", "usr", "src", "dst", "risk", "is_new", "support"]
    rows = [(i, 1_700_000_000 + i * 97, rnd.randint(1, 4), rnd.randint(1, 9), rnd.randint(1, 9), round(rnd.uniform(0.3, 1), 3), rnd.randint(0, 1), rnd.randint(0, 3)) for i in range(120)]
    rows = [r for r in rows if r[3] != r[4]]
    path = batches(tmp_path, [rows[:30], rows[30:32], rows[32:80], rows[80:]], columns)
    schema = "event_id long, t long, usr long, src long, dst long, risk double, is_new int, support int"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path)
    run = lambda checkpoint: streams.start_alert_paths(stream(), str(tmp_path / "state"), str(tmp_path / "out"), str(tmp_path / checkpoint), threshold=0.7, max_edges=4).awaitTermination()
    run("c1")
    found = lambda: sorted(map(tuple, spark.read.parquet(str(tmp_path / "out/paths")).select("path_id", "score", "n_edges").collect()))
    all_rows = spark.createDataFrame(rows, schema)
    paths = graph.score_paths(graph.rank_paths(all_rows.drop("usr"), max_edges=4), top_k=None)
    want = sorted(map(tuple, paths.select(F.concat_ws("-", "events").alias("path_id"), "score", "n_edges").collect()))
    assert found() == want and len(want) > 20
    alerts = spark.read.parquet(str(tmp_path / "out/alerts")).collect()
    assert sorted(r.event_id for r in alerts) == [r[0] for r in rows if r[5] >= 0.7]
    ids = {p for p, *_ in want}
    assert all(r.path_id is None or (r.path_id in ids and str(r.event_id) in r.path_id.split("-")) for r in alerts) and any(r.path_id for r in alerts)
    run("c2")  # every batch again, from its own version of the state
    assert found() == want and spark.read.parquet(str(tmp_path / "out/alerts")).count() == len(alerts)


def test_status_counts_each_source(spark, tmp_path):
    t = 1_700_000_000
    row = lambda i, source, at, usr=1: (i, at, usr, 2, 3, source)
    parts = [
        [row(1, "dc", t), row(1, "dc", t), row(1, "vpn", t), row(2, "dc", t, None), row(7, "lab", t)],
        [row(1, "dc", t), row(3, "dc", t + 60), row(4, "vpn", t + 61), (None, t, 1, 2, 3, "vpn")],
        [row(5, "dc", t + 90_000)],
        [row(8, "vpn", t + 90_001)],
        [row(6, "dc", t + 10)],  # far behind the watermark, which reaches late rows a batch after it has moved
    ]
    path = batches(tmp_path, parts, ["event_id", "t", "usr", "src", "dst", "source"])
    listener = status.StatusListener(spark, ["dc", "vpn"], str(tmp_path / "status"))
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("event_id long, t long, usr long, src long, dst long, source string").option("maxFilesPerTrigger", 1).json(path)
        status.start_counted(stream, ["dc", "vpn"], str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    finally:
        spark.streams.removeListener(listener)
    got = {r.source: tuple(r)[1:] for r in status.status(spark, str(tmp_path / "status")).collect()}
    assert got["dc"] == (7, 1, 3, 3, t + 90_000) and got["vpn"] == (4, 1, 3, 0, t + 90_001) and got[None] == (1, 0, 1, 0, t)
    kept = sorted((r.source, r.event_id) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert kept == [("dc", 1), ("dc", 3), ("dc", 5), ("lab", 7), ("vpn", 1), ("vpn", 4), ("vpn", 8)]
    late = spark.read.schema(status.STATUS).parquet(str(tmp_path / "status/run=*/part=*")).agg(F.sum("late")).first()[0]
    assert late == 1
