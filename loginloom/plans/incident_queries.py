"""Registered queries of incidents, playbooks, cases, the scored cache and the evaluation report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation, features, incidents, studies, uncertainty
from .analysis_queries import ALERTS_CTE, SCORES_CTE, alerts, scores
from .detection_queries import FEATURE_CTE, SCORE_CTE, rounded, scored, selected
from .fixtures import DENSE_SQL, auth_dense, auth_sparse
from .report_queries import _RECORDS

QUERIES, ORACLE_SQL = {}, {}


def registered(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


# ---- all features of probes ------------------------------------------------------------------------------------------


def _probe_sql() -> str:
    """FEATURE_CTE over real events and probes, where every count, sum and first sighting takes real rows only."""
    import re

    of_real = re.sub(r"\b(count|max|sum|avg)\(((?:[^()]|\([^()]*\))*)\) OVER", r"\1(\2) FILTER (real) OVER", FEATURE_CTE)
    of_real = re.sub(r"CAST\(row_number\(\) OVER \(PARTITION BY (\w+, \w+) ORDER BY t, event_id\) = 1 AS BIGINT\)", r"CAST(real AND row_number() OVER (PARTITION BY \1, real ORDER BY t, event_id) = 1 AS BIGINT)", of_real)
    both = """, both_kinds AS (
        SELECT event_id, t, usr, src, dst, logon_id, success, true AS real FROM e UNION ALL
        SELECT -1 - event_id, t, usr, CASE WHEN event_id % 2 = 1 THEN (src + 1) % 97 ELSE src END, CASE WHEN event_id % 2 = 0 THEN (dst + 1) % 97 ELSE dst END, logon_id, success, false FROM e
    )"""
    return f"{DENSE_SQL}{both}{of_real.replace('FROM e' + chr(10), 'FROM both_kinds' + chr(10), 1)} SELECT event_id, {selected(features.ALL)} FROM f WHERE NOT real"


@registered("d25_counterfactual_features", _probe_sql())
def d25(spark, sf_dir):
    """All features of one probe for each event, its source or its destination replaced, against the history of the real ones."""
    e = auth_dense(spark, sf_dir).select("event_id", "t", "usr", "src", "dst", "logon_id", "success")
    odd = F.col("event_id") % 2 == 1
    made = {"event_id": -1 - F.col("event_id"), "src": F.when(odd, (F.col("src") + 1) % 97).otherwise(F.col("src")), "dst": F.when(odd, F.col("dst")).otherwise((F.col("dst") + 1) % 97)}
    return rounded(features.featurise_probes(e, e.withColumns(made)), "event_id", *features.ALL)


# ---- incidents -------------------------------------------------------------------------------------------------------

_STEPS = ", ".join(f"('{name}', {i}, '{action}', {least})" for name, steps in incidents.PLAYBOOKS.items() for i, (action, least) in enumerate(steps, 1))


@registered("k02_playbook_steps", f"{DENSE_SQL}{SCORE_CTE}, b(playbook, step, action, least) AS (VALUES {_STEPS}) SELECT event_id, playbook, step::INTEGER AS step, action, CAST(round(risk, 6) >= least::DOUBLE AS INTEGER) AS applied FROM s, b")
def k02(spark, sf_dir):
    return incidents.playbook_steps(scored(spark, sf_dir).withColumn("risk", F.round("risk", 6)))


@registered(
    "k06_locks_with_decisions",
    f"""{ALERTS_CTE}, l AS (SELECT usr, t, kind, row_number() OVER (PARTITION BY usr ORDER BY t, late, seq) AS n FROM (
        SELECT usr, t, 0 AS late, event_id AS seq, 'alert' AS kind FROM a UNION ALL SELECT usr, t + 1, 1, event_id, CASE event_id % 11 WHEN 4 THEN 'kept' ELSE 'reverted' END FROM e WHERE event_id % 11 IN (4, 7))),
    st(usr, n, lock, start_t, last_t, n_alerts, kept, reverted, end_t, active) AS (
        SELECT DISTINCT usr, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0, 0, NULL::BIGINT, false FROM l
        UNION ALL
        SELECT usr, n, CASE WHEN opens THEN lock + 1 ELSE lock END, CASE WHEN opens THEN t ELSE start_t END, CASE WHEN kind = 'alert' THEN t ELSE last_t END, CASE WHEN opens THEN 1 WHEN kind = 'alert' THEN n_alerts + 1 ELSE n_alerts END,
            CASE WHEN opens THEN 0 WHEN kind = 'kept' AND locked THEN 1 ELSE kept END, CASE WHEN opens THEN 0 WHEN kind = 'reverted' AND locked THEN 1 ELSE reverted END,
            CASE WHEN opens THEN NULL WHEN kind = 'reverted' AND locked THEN t ELSE end_t END, CASE WHEN opens THEN true WHEN kind = 'reverted' AND locked THEN false ELSE active END
        FROM (SELECT s.*EXCLUDE (n), l.n, l.t, l.kind, s.active AND (s.kept = 1 OR l.t <= s.last_t + 7200) AS locked, l.kind = 'alert' AND NOT (s.active AND (s.kept = 1 OR l.t <= s.last_t + 7200)) AS opens
            FROM st s JOIN l ON l.usr = s.usr AND l.n = s.n + 1)
    )
    SELECT usr, start_t, CASE WHEN reverted = 1 THEN end_t WHEN kept = 0 THEN last_t + 7200 END AS end_t, n_alerts, kept, reverted FROM st WHERE lock > 0 QUALIFY row_number() OVER (PARTITION BY usr, lock ORDER BY n DESC) = 1""",
)
def k06(spark, sf_dir):
    e = auth_dense(spark, sf_dir)
    part = F.col("event_id") % 11
    decisions = e.filter(part.isin(4, 7)).select(F.col("event_id").alias("seq"), (F.col("t") + 1).alias("t"), "usr", F.when(part == 4, "kept").otherwise("reverted").alias("decision"))
    return incidents.locks_with_decisions(alerts(spark, sf_dir), decisions)


_DONE = f", r AS (SELECT * , alert_id // 40 AS usr FROM ({_RECORDS} (SELECT *, (dst + usr) % 97 AS k FROM e))), x AS (SELECT usr, min(t) AS t FROM r WHERE action = 'lock_account' AND outcome = 'executed' GROUP BY usr)"


def _done(spark, sf_dir):
    rows = auth_dense(spark, sf_dir).withColumn("k", (F.col("dst") + F.col("usr")) % 97)
    records = spark.sql(f"{_RECORDS} {{rows}}", rows=rows).withColumn("usr", F.floor(F.col("alert_id") / 40))
    return records, records.filter("action = 'lock_account' AND outcome = 'executed'").groupBy("usr").agg(F.min("t").alias("t"))


@registered(
    "k10_incident_rollup",
    f"""{ALERTS_CTE}{_DONE}, h AS (SELECT usr, count(DISTINCT h) AS n_hosts FROM (SELECT usr, src AS h FROM a UNION ALL SELECT usr, dst FROM a) GROUP BY usr),
    d AS (SELECT usr, count(*) AS actions, count(*) FILTER (outcome = 'pending_approval') AS pending FROM r WHERE action NOT IN ('notify_soc', 'increase_monitoring') GROUP BY usr)
    SELECT a.usr, count(*) AS n_alerts, max(risk) AS max_risk, min(a.t) AS first_t, max(a.t) AS last_t, any_value(n_hosts) AS n_hosts, coalesce(any_value(actions), 0) AS actions, coalesce(any_value(pending), 0) AS pending, CAST(any_value(x.usr) IS NOT NULL AS INTEGER) AS escalated
    FROM a JOIN h ON h.usr = a.usr LEFT JOIN d ON d.usr = a.usr LEFT JOIN x ON x.usr = a.usr GROUP BY a.usr ORDER BY escalated DESC, max_risk DESC, n_alerts DESC, a.usr LIMIT 50""",
)
def k10(spark, sf_dir):
    return incidents.rollup(alerts(spark, sf_dir), *_done(spark, sf_dir))


@registered(
    "k11_incident_facts",
    f"""{ALERTS_CTE}{_DONE}, facts AS (
        SELECT usr, 1 AS place, 'alert' AS kind, event_id::VARCHAR AS ref, t, risk::DOUBLE AS value FROM a QUALIFY row_number() OVER (PARTITION BY usr ORDER BY t, event_id) <= 12
        UNION ALL SELECT usr, 2, 'hosts', NULL, NULL, count(DISTINCT h)::DOUBLE FROM (SELECT usr, src AS h FROM a UNION ALL SELECT usr, dst FROM a) GROUP BY usr
        UNION ALL SELECT usr, 3, 'gated', NULL, NULL, sum((risk >= 0.9)::INTEGER)::DOUBLE FROM a GROUP BY usr
        UNION ALL SELECT usr, 4, 'action', action || ':' || outcome, t, seq::DOUBLE FROM r WHERE action NOT IN ('notify_soc', 'increase_monitoring') AND usr IN (SELECT usr FROM a)
        UNION ALL SELECT usr, 5, 'escalation', NULL, t, 1.0 FROM x WHERE usr IN (SELECT usr FROM a))
    SELECT usr, printf('F-%03d', row_number() OVER (PARTITION BY usr ORDER BY place, t NULLS FIRST, ref NULLS FIRST, value)) AS fact, kind, ref, t, value FROM facts""",
)
def k11(spark, sf_dir):
    return incidents.incident_facts(alerts(spark, sf_dir).withColumn("gate", (F.col("risk") >= 0.9).cast("int")), *_done(spark, sf_dir))


@registered(
    "k13_compliance_bundle",
    f"""{ALERTS_CTE}, cases AS (SELECT usr AS case_id, list(DISTINCT event_id) AS ids FROM e WHERE usr % 5 = 0 GROUP BY usr), named AS (SELECT case_id, unnest(ids) AS alert_id FROM cases)
    SELECT case_id, alert_id, CAST(event_id IS NOT NULL AS INTEGER) AS resolved, t, risk, CASE WHEN event_id IS NULL THEN NULL WHEN risk >= 0.85 THEN 'critical' WHEN risk >= 0.7 THEN 'high' WHEN risk >= 0.5 THEN 'medium' ELSE 'low' END AS severity, usr, src, dst FROM named LEFT JOIN a ON a.event_id = named.alert_id""",
)
def k13(spark, sf_dir):
    """A case for every fifth account names all of its events; those that never alerted can't be resolved."""
    cases = auth_dense(spark, sf_dir).filter("usr % 5 = 0").groupBy(F.col("usr").alias("case_id")).agg(F.collect_set("event_id").alias("alert_ids"))
    return incidents.compliance_bundle(cases, alerts(spark, sf_dir).select("event_id", "t", "risk", "usr", "src", "dst"))


# ---- the scored cache and what is said of it -------------------------------------------------------------------------

_CHANNELS = ["model", "pivot_signal", "is_new_pair", "chain_hop"]


@registered(
    "a21_scored_cache",
    f"""{DENSE_SQL}{SCORE_CTE}, n AS (SELECT *, row_number() OVER (ORDER BY t, event_id) - 1 AS p, count(*) OVER () AS n FROM e), k AS (SELECT max(t) FILTER (p = floor(n * 0.70)::BIGINT - 1) AS c1, max(t) FILTER (p = floor(n * 0.85)::BIGINT - 1) AS c2 FROM n)
    SELECT event_id, t, label, src, dst, usr, round(model, 6) AS model, round(pivot_signal, 6) + 0.0 AS pivot_signal, is_new_pair, chain_hop, round(risk, 6) AS risk, CASE WHEN t <= c1 THEN 'train' WHEN t <= c2 THEN 'validation' ELSE 'test' END AS partition FROM s, k""",
)
def a21(spark, sf_dir):
    """Every event's channels, rule flag, risk and partition in one table."""
    rows = evaluation.chronological_split(scored(spark, sf_dir))
    return rounded(rows, "event_id", "t", "label", "src", "dst", "usr", *_CHANNELS, "risk", "partition")


@registered("i17_evaluation_report")
def i17(spark, sf_dir):
    """Three detectors on the chronological split; the tests compare its figures with the single metrics."""
    other = ((F.col("event_id") * 104729 + F.col("src") * 17) % 997 + F.col("label") * 100) / F.lit(1100.0)
    rows = evaluation.chronological_split(scores(spark, sf_dir)).withColumns({"rule": F.round(other, 1), "mean": (F.col("score") + other) / 2})
    return rounded(uncertainty.evaluation_report(rows.withColumnRenamed("score", "model"), ["model", "rule", "mean"], "src", resamples=500), "section", "detector", "metric", "value")


@registered("i19_bootstrap_positives")
def i19_bootstrap(spark, sf_dir):
    return rounded(uncertainty.bootstrap_positives(scores(spark, sf_dir)), "auc_low", "auc_high", "ap_low", "ap_high", "replicates")


@registered(
    "i16_entity_holdout",
    f"""{SCORES_CTE}, top AS (SELECT usr AS held_out, count(*) AS removed FROM x WHERE label = 1 GROUP BY usr ORDER BY removed DESC, usr LIMIT 10),
    g AS (SELECT held_out, any_value(removed) AS removed, score, sum(label) AS n_pos, count(*) AS n FROM x JOIN top ON usr <> held_out GROUP BY held_out, score
        UNION ALL SELECT -1, 0, score, sum(label), count(*) FROM x GROUP BY score),
    h AS (SELECT *, sum(n_pos) OVER w AS cp, sum(n) OVER w AS cn FROM g WINDOW w AS (PARTITION BY held_out ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    m AS (SELECT held_out, any_value(removed) AS removed, sum(n_pos) AS left_p, sum(n) AS left_n, sum(n_pos * cp / cn::DOUBLE) / sum(n_pos) AS ap FROM h GROUP BY held_out)
    SELECT held_out, removed AS attacks_removed, CAST(left_p AS BIGINT) AS attacks_remaining, CAST(left_n AS BIGINT) AS events_remaining, round(left_p / left_n::DOUBLE, 6) AS base_rate, round(ap, 6) AS average_precision,
        round(1 - ap / (SELECT ap FROM m WHERE held_out = -1), 6) + 0.0 AS share_of_metric, left_p >= 20 AS credible FROM m WHERE held_out <> -1 AND left_p > 0""",
)
def i16(spark, sf_dir):
    rows, _ = uncertainty.contamination(scores(spark, sf_dir), "usr")
    return rounded(rows, "held_out", "attacks_removed", "attacks_remaining", "events_remaining", "base_rate", "average_precision", "share_of_metric", "credible")


@registered("h12_baseline_experiment")
def h12(spark, sf_dir):
    """Rule, rarity, logistic and isolation forest: thresholds from validation, figures on test."""
    columns = ["is_new_pair", "user_unique_dst_5m", "failures_before_success_15m", "pair_rarity", "destination_novelty", "user_new_dst_ratio_1h"]
    # the split needs times only, so it is made before the features
    rows = features.with_features(evaluation.chronological_split(auth_sparse(spark, sf_dir)), columns)
    return rounded(studies.baseline_experiment(rows, columns), "detector", "threshold", "validation_ap", "test_ap", "test_recall", "test_precision", "test_fp_per_10k", "best")
