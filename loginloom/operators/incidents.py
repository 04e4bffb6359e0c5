"""Incidents of accounts: locks with decisions, rollups, playbooks with risk minima, what a case hands over."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import severity

# The steps of each playbook and the least risk from which each applies.
PLAYBOOKS = {
    "containment": (("increase_monitoring", 0.0), ("notify_soc", 0.5), ("force_reauth", 0.7), ("block_network_path", 0.8), ("isolate_host", 0.85), ("reset_credentials", 0.9)),
    "investigation": (("increase_monitoring", 0.0), ("notify_soc", 0.4), ("force_reauth", 0.6)),
    "monitoring": (("increase_monitoring", 0.0), ("notify_soc", 0.3)),
}
#: Actions that only watch: they aren't counted as acting on an account.
WATCHING = ("notify_soc", "increase_monitoring")


def playbook_steps(alerts: DataFrame) -> DataFrame:
    """event_id, playbook, step (from 1), action, applied: each step of each playbook for each alert (event_id, risk)."""
    rows = [(name, i, action, least) for name, steps in PLAYBOOKS.items() for i, (action, least) in enumerate(steps, 1)]
    table = alerts.sparkSession.createDataFrame(rows, "playbook string, step int, action string, least double")
    return alerts.select("event_id", "risk").join(F.broadcast(table)).select("event_id", "playbook", "step", "action", (F.col("risk") >= F.col("least")).cast("int").alias("applied"))


def locks_with_decisions(alerts: DataFrame, decisions: DataFrame, hold: int = 7_200) -> DataFrame:
    """usr, start_t, end_t (null: kept, still in force), n_alerts, kept, reverted of each lock.

    alerts: event_id, t, usr. decisions: seq, t, usr, decision (`kept` or `reverted`). An alert on a free account locks it for `hold`
    seconds; alerts on a locked one start the hold again. Keeping a lock that is in force makes it last until it is
    reverted; reverting ends it at once. Decisions on free accounts change nothing. On one second alerts come first.
    An account's stream is cut at its reverts, and inside a part at gaps longer than the hold, unless a lock was kept before.
    """
    asked = alerts.select("usr", "t", F.lit(0).alias("late"), F.col("event_id").alias("seq"), F.lit("alert").alias("kind"))
    rows = asked.union(decisions.select("usr", "t", F.lit(1), "seq", "decision"))
    order = Window.partitionBy("usr").orderBy("t", "late", "seq")
    is_alert, is_kept, is_reverted = F.col("kind") == "alert", F.col("kind") == "kept", F.col("kind") == "reverted"
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("part", F.coalesce(F.sum(is_reverted.cast("int")).over(before), F.lit(0)))
    own = Window.partitionBy("usr", "part").orderBy("t", "late", "seq")
    past = own.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("last", F.max(F.when(is_alert, F.col("t"))).over(past))
    rows = rows.withColumn("keeps", (is_kept & F.coalesce(F.col("t") <= F.col("last") + hold, F.lit(False))).cast("int"))
    held = F.coalesce(F.max("keeps").over(past), F.lit(0)) == 1
    opens = is_alert & ~held & (F.col("last").isNull() | (F.col("t") > F.col("last") + hold))
    rows = rows.withColumn("opens", opens.cast("int")).withColumn("lock", F.sum("opens").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    by = rows.filter("lock > 0").groupBy("usr", "part", "lock").agg(
        F.min(F.when(is_alert, F.col("t"))).alias("start_t"),
        F.max(F.when(is_alert, F.col("t"))).alias("last_t"),
        F.count_if(is_alert).alias("n_alerts"),
        F.max("keeps").alias("kept"),
        F.max(F.when(is_reverted, F.col("t"))).alias("revert_t"),
    )
    lifted = F.col("revert_t").isNotNull() & ((F.col("kept") == 1) | (F.col("revert_t") <= F.col("last_t") + hold))
    end = F.when(lifted, F.col("revert_t")).when(F.col("kept") == 0, F.col("last_t") + hold)
    return by.select("usr", "start_t", end.alias("end_t"), "n_alerts", "kept", F.coalesce(lifted, F.lit(False)).cast("int").alias("reverted"))


def rollup(alerts: DataFrame, records: DataFrame, escalated: DataFrame, top_k: int = 50) -> DataFrame:
    """usr, n_alerts, max_risk, first_t, last_t, n_hosts (left or reached), actions, pending, escalated: the worst accounts first.

    records: usr, action, outcome of what was done; watching isn't acting. escalated: usr of accounts under an escalation.
    """
    hosts = alerts.select("usr", F.explode(F.array("src", "dst")).alias("host")).groupBy("usr").agg(F.count_distinct("host").alias("n_hosts"))
    acted = records.filter(~F.col("action").isin(*WATCHING)).groupBy("usr").agg(F.count("*").alias("actions"), F.count_if(F.col("outcome") == "pending_approval").alias("pending"))
    rows = alerts.groupBy("usr").agg(F.count("*").alias("n_alerts"), F.max("risk").alias("max_risk"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    rows = rows.join(hosts, "usr").join(acted, "usr", "left").join(escalated.select("usr").distinct().withColumn("escalated", F.lit(1)), "usr", "left").fillna(0, ["actions", "pending", "escalated"])
    return rows.orderBy(F.desc("escalated"), F.desc("max_risk"), F.desc("n_alerts"), "usr").limit(top_k).select("usr", "n_alerts", "max_risk", "first_t", "last_t", "n_hosts", "actions", "pending", "escalated")


def incident_facts(alerts: DataFrame, records: DataFrame, escalated: DataFrame, most_alerts: int = 12) -> DataFrame:
    """usr, fact (F-001 ...), kind, ref, t, value: the numbered facts of each account's incident.

    Kinds in order: `alert` (the first most_alerts by time, with their risk), `hosts` (how many were left or reached), `gated` (alerts
    that may act on their own, by `gate`), `action` (each action taken, by time), `escalation`. ref is the alert or the action.
    """
    w = Window.partitionBy("usr").orderBy("t", "event_id")
    first = alerts.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most_alerts)
    kind = lambda k, name: [F.lit(k).alias("place"), F.lit(name).alias("kind")]
    facts = first.select("usr", *kind(1, "alert"), F.col("event_id").cast("string").alias("ref"), "t", F.col("risk").cast("double").alias("value"))
    hosts = alerts.select("usr", F.explode(F.array("src", "dst")).alias("host")).groupBy("usr").agg(F.count_distinct("host").alias("v"))
    none = [F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("t")]
    facts = facts.union(hosts.select("usr", *kind(2, "hosts"), *none, F.col("v").cast("double")))
    facts = facts.union(alerts.groupBy("usr").agg(F.sum("gate").alias("v")).select("usr", *kind(3, "gated"), *none, F.col("v").cast("double")))
    mine = records.join(alerts.select("usr").distinct(), "usr", "left_semi").filter(~F.col("action").isin(*WATCHING))
    facts = facts.union(mine.select("usr", *kind(4, "action"), F.concat_ws(":", "action", "outcome"), "t", F.col("seq").cast("double")))
    facts = facts.union(escalated.join(alerts.select("usr").distinct(), "usr", "left_semi").select("usr", *kind(5, "escalation"), F.lit(None).cast("string"), "t", F.lit(1.0)))
    number = F.row_number().over(Window.partitionBy("usr").orderBy("place", "t", "ref", "value"))
    return facts.withColumn("fact", F.format_string("F-%03d", number)).select("usr", "fact", "kind", "ref", "t", "value")


def compliance_bundle(cases: DataFrame, alerts: DataFrame) -> DataFrame:
    """case_id, alert_id, resolved, t, risk, severity, usr, src, dst: every alert that a case names, found or not.

    cases: case_id, alert_ids. alerts: event_id, t, risk, usr, src, dst.
    """
    asked = cases.select("case_id", F.explode("alert_ids").alias("alert_id"))
    found = asked.join(alerts, F.col("alert_id") == F.col("event_id"), "left")
    level = F.when(F.col("event_id").isNotNull(), severity(F.col("risk"), "console"))
    return found.select("case_id", "alert_id", F.col("event_id").isNotNull().cast("int").alias("resolved"), "t", "risk", level.alias("severity"), "usr", "src", "dst")
