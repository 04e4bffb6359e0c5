"""Locks, gates, feedback and streams on hand-made rows."""

from pyspark.sql import functions as F

from loginloom.operators import reports, studies
from loginloom.operators.windows import earlier_in_window
from loginloom.streaming import incremental

ALERT = "event_id long, t long, usr long, src long, label int, score double"


def test_earlier_alerts_count_in_stream_order(spark):
    rows = [(1, 100, 1, 9), (2, 3_700, 1, 9), (3, 3_700, 1, 9), (4, 3_699, 1, 8), (5, 7_299, 1, 9)]
    a = spark.createDataFrame(rows, "event_id long, t long, usr long, src long")
    got = {r.event_id: r.n for r in a.select("event_id", earlier_in_window(3_600, "usr").alias("n")).collect()}
    # a row a full window back is out, an earlier one of the same second is in
    assert got == {1: 0, 4: 1, 2: 1, 3: 2, 5: 2}
    both = {r.event_id: (r.user_before, r.host_before, r.corroborated) for r in studies.corroborated(a).collect()}
    assert both[3] == (2, 1, 1) and both[2] == (1, 0, 0)


def test_lock_policy_replays_a_day(spark):
    rows = [
        (1, 10, 1, 5, 0, 0.85),  # an alert, too low to lock
        (2, 10, 1, 5, 0, 0.95),  # one earlier alert of the same second backs it: lock
        (3, 20, 1, 5, 0, 0.95),  # held
        (4, 30, 2, 6, 1, 0.95),  # nothing before
        (5, 31, 2, 6, 1, 0.95),  # lock of an attack
        (6, 7_210, 1, 5, 0, 0.95),  # nothing in the last hour
        (7, 7_211, 1, 5, 0, 0.95),  # the hold is over: lock
    ]
    a = spark.createDataFrame(rows, ALERT)
    (r,) = studies.lock_policy(a, action=0.9).collect()
    assert (r.benign_locks, r.benign_accounts, r.attack_locks, r.attack_hosts, r.refused) == (2, 1, 1, 1, 0)
    (r,) = studies.lock_policy(a, action=0.9, per_hour=1).collect()
    assert (r.benign_locks, r.attack_locks, r.refused) == (2, 0, 1)
    assert studies.lock_policy(a.limit(0), action=0.9).collect() == []


def test_plans_keep_every_alert(spark):
    rows = [(1, "T1021", "high", 0.9), (2, "T1021", "medium", 0.9), (3, None, "none", 0.99), (4, "T1550.003", "high", 0.8), (5, "T9999", "high", 0.9)]
    plans: dict = {}
    for r in studies.response_plan(spark.createDataFrame(rows, "event_id long, technique string, confidence string, risk double")).orderBy("event_id", "step").collect():
        plans.setdefault(r.event_id, []).append((r.action, r.mode))
    assert [len(plans[k]) for k in (1, 2, 3, 4, 5)] == [5, 3, 2, 4, 2]
    assert plans[1][2] == ("force_reauth", "auto") and plans[2][2] == ("force_reauth", "approval") and plans[4][2] == ("force_reauth", "approval")
    assert all(mode == "approval" for action, mode in plans[1] if action in ("block_network_path", "isolate_host"))


def test_empty_batch_keeps_the_tail(spark):
    events = spark.createDataFrame([(1, 100, 1, 2, 3, 0, 1)], incremental.TAIL.rpartition(",")[0])
    _, state = incremental.advance_day(events, incremental.empty_state(spark))
    _, after = incremental.advance_day(events.limit(0), state)
    assert after["tail"].count() == 1 and after["registry"].count() == state["registry"].count()


def test_budget_gate(spark):
    rows = [(0, i, 1_000 + i, i) for i in range(22)] + [(0, 50, 1_010, 3), (0, 90, 4_700, 0), (1, 91, 1_000, 0), (1, 92, 1_001, 0), (1, 93, 4_600, 0)]
    a = spark.createDataFrame([(tenant, k, t, u) for tenant, k, t, u in rows], "tenant long, event_id long, t long, usr long")
    got = {r.event_id: r.verdict for r in reports.budget_gate(a).collect()}
    assert got[50] == "cooldown" and sorted(k for k, v in got.items() if v == "hourly") == [20, 21]
    assert got[90] == "allowed" and (got[91], got[92], got[93]) == ("allowed", "cooldown", "allowed")


def test_feedback_verdicts(spark):
    rows = [
        (1, "a", "lock_account", "executed", "approval", "ann", 5, None),
        (2, "a", "force_reauth", "reverted", "policy", None, 6, "lifted by bob"),
        (3, "b", "isolate_host", "pending_approval", "approval", None, 1, None),
        (4, "b", "isolate_host", "rejected", "approval", "cat", 2, None),
        (5, "c", "isolate_host", "pending_approval", "approval", None, 1, None),
        (6, "c", "lock_account", "rejected", "approval", "cat", 2, None),
        (7, "d", "lock_account", "reverted", "policy", None, 3, "expired"),
        (8, "e", "notify_soc", "executed", "approval", "ann", 3, None),
        (9, "f", "lock_account", "reverted", "policy", None, 4, "lifted by dan"),
    ]
    records = spark.createDataFrame(rows, "seq long, alert_id string, action string, outcome string, authority string, approved_by string, t long, output string")
    got = {r.alert_id: (r.label, r.source, r.decided_by, r.decided_at) for r in reports.feedback_labels(records).collect()}
    assert got == {"a": (1, "approved lock_account", "ann", 5), "b": (0, "rejected every action", "cat", 2), "f": (0, "lifted lock_account", "dan", 4)}


def test_process_novelty_edges(spark):
    events = spark.createDataFrame([(1, 1_000, 7, 1, 2)], "event_id long, t long, usr long, src long, dst long")
    starts = spark.createDataFrame([(1_000, 8, 2, 1), (1_001, 8, 2, 2), (1_300, 8, 2, 3), (1_301, 8, 2, 4), (1_300, 8, 2, 1), (-2_600, 8, 1, 5), (-2_599, 8, 1, 6), (1_000, 7, 9, 7)], "t long, usr long, host long, process long")
    (r,) = reports.process_novelty(events, starts).collect()
    assert (r.dst_new_5m, r.dst_new_30m, r.src_new_1h, r.user_new_1h) == (2, 3, 1, 1)


def test_exact_auc_with_ties(spark):
    scores = spark.createDataFrame([(1, 0.5, 1), (2, 0.5, 0), (3, 0.9, 1), (4, 0.1, 0)], "event_id long, score double, label int")
    (r,) = reports.exact_auc_ap(scores).collect()
    assert r.roc_auc == 0.875 and abs(r.ap - (1 + 2 / 3) / 2) < 1e-9
    assert {x.event_id: (x.above, x.tied) for x in reports.rank_statistics(scores).collect()} == {1: (0, 1), 3: (0, 0)}


def test_unknown_names_get_buckets(spark):
    names = spark.createDataFrame([("known",), ("new",)], "name string")
    got = {r.name: r.id for r in reports.resolve_ids(names, spark.createDataFrame([("known", 4)], "name string, id long"), "host", 100, 8).collect()}
    assert got["known"] == 4 and 100 <= got["new"] < 108
    assert reports.resolve_ids(names, spark.createDataFrame([], "name string, id long"), "category", 1, 1).agg(F.sum("id")).first()[0] == 0
