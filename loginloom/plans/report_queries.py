"""Registered queries of feedback, gates, rank statistics, categories and telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import evaluation, graph, reports
from .analysis_queries import ALERTS_CTE, PATH_RISK, SCORES_CTE, WHOLE_PATHS_CTE, alerts, scores
from .detection_queries import TACTIC_CTE, classified, rounded, scored
from .fixtures import DENSE_SQL, SPARSE_SQL, auth_dense, auth_sparse
from .ingest_queries import AUTH_SPELLINGS, LOGON_SPELLINGS, ORIENTATION_SPELLINGS, spelled, spelled_sql

QUERIES, ORACLE_SQL = {}, {}


def registered(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


_SPELLED = {"auth": AUTH_SPELLINGS, "logon": LOGON_SPELLINGS, "orientation": ORIENTATION_SPELLINGS}
_SEEDS = {"auth": 1, "logon": 3, "orientation": 5}
_HOT = ", ".join(f"CAST(lower({kind}) = '{w}' AS INTEGER) AS {kind}_{w}" for kind, words in scalars.CATEGORY_BLOCK.items() for w in words.split())


@registered("b09_one_hot", f"{DENSE_SQL}, w AS (SELECT event_id, success, {', '.join(f'{spelled_sql(words, _SEEDS[k])} AS {k}' for k, words in _SPELLED.items())} FROM e) SELECT event_id, {_HOT}, success FROM w")
def b09(spark, sf_dir):
    """Fifteen columns over the canonical words of raw spellings."""
    raw = {k: spelled(words, _SEEDS[k]) for k, words in _SPELLED.items()}
    block = scalars.category_block(raw["auth"], raw["logon"], raw["orientation"], F.col("success"))
    return auth_dense(spark, sf_dir).select("event_id", *[c.alias(name) for name, c in block.items()])


@registered("c09_chronological_sort", f"{DENSE_SQL} SELECT event_id, t, row_number() OVER (ORDER BY t, event_id) - 1 AS position FROM e")
def c09(spark, sf_dir):
    return reports.chronological(auth_dense(spark, sf_dir).select("event_id", "t")).select("event_id", "t", "position")


@registered(
    "c14_resolve_live_ids",
    f"{DENSE_SQL}, d AS (SELECT DISTINCT usr, 'u' || usr AS name FROM e), k AS (SELECT name, usr AS id FROM d WHERE usr % 3 <> 0) SELECT d.name, coalesce(k.id, 1000 + (('0x' || substr(sha256('user' || chr(0) || d.name), 1, 16))::UBIGINT % 1000)::BIGINT) AS id FROM d LEFT JOIN k ON k.name = d.name",
)
def c14(spark, sf_dir):
    names = auth_dense(spark, sf_dir).select("usr", F.concat(F.lit("u"), F.col("usr").cast("string")).alias("name")).distinct()
    return reports.resolve_ids(names.select("name"), names.filter("usr % 3 <> 0").select("name", F.col("usr").alias("id")), "user", 1_000, 1_000)


@registered(
    "c16_windows_ingest_summary",
    f"{DENSE_SQL}, w AS (SELECT *, CASE WHEN auth_name = 'NTLM' THEN 4776 WHEN orient_name = 'TGT' THEN 4768 WHEN orient_name = 'TGS' THEN 4769 ELSE 4624 END AS code FROM e) SELECT 'total' AS kind, 'events' AS key, count(*) AS value FROM w UNION ALL SELECT 'total', 'users', count(DISTINCT usr) FROM w UNION ALL SELECT 'total', 'failures', CAST(sum(1 - success) AS BIGINT) FROM w UNION ALL SELECT 'total', 'span', max(t) - min(t) FROM w UNION ALL SELECT 'total', 'hosts', count(DISTINCT h) FROM (SELECT src AS h FROM w UNION ALL SELECT dst FROM w) UNION ALL SELECT 'code', code::VARCHAR, count(*) FROM w GROUP BY code",
)
def c16(spark, sf_dir):
    code = F.when(F.col("auth_name") == "NTLM", 4776).when(F.col("orient_name") == "TGT", 4768).when(F.col("orient_name") == "TGS", 4769).otherwise(4624)
    return reports.ingest_summary(auth_dense(spark, sf_dir).withColumn("code", code))


@registered(
    "d28_process_novelty",
    f"""{DENSE_SQL}, st AS (SELECT t, usr, dst AS host, (event_id * 7 + usr) % 23 AS process FROM e WHERE success = 1),
    f AS (SELECT 'h' AS kind, host AS key, min(t) AS t FROM st GROUP BY host, process UNION ALL SELECT 'u', usr, min(t) FROM st GROUP BY usr, process)
    SELECT event_id, count(*) FILTER (kind = 'h' AND f.key = dst AND f.t > e.t AND f.t <= e.t + 300) AS dst_new_5m, count(*) FILTER (kind = 'h' AND f.key = dst AND f.t > e.t AND f.t <= e.t + 1800) AS dst_new_30m,
        count(*) FILTER (kind = 'h' AND f.key = src AND f.t > e.t - 3600 AND f.t <= e.t) AS src_new_1h, count(*) FILTER (kind = 'u' AND f.key = usr AND f.t > e.t - 3600 AND f.t <= e.t + 300) AS user_new_1h
    FROM e LEFT JOIN f ON f.t > e.t - 3600 AND f.t <= e.t + 1800 AND (kind = 'h' AND f.key IN (src, dst) OR kind = 'u' AND f.key = usr) GROUP BY event_id""",
)
def d28(spark, sf_dir):
    e = auth_dense(spark, sf_dir)
    starts = e.filter("success = 1").select("t", "usr", F.col("dst").alias("host"), F.pmod(F.col("event_id") * 7 + F.col("usr"), F.lit(23)).alias("process"))
    return reports.process_novelty(e, starts)


_TRUTH = "CASE WHEN label = 0 THEN NULL WHEN usr % 3 = 0 THEN 'T1021' WHEN usr % 3 = 1 THEN 'T1110' ELSE 'T1078' END"


@registered(
    "g12_technique_metrics",
    f"""{DENSE_SQL}{TACTIC_CTE}, z AS (SELECT {_TRUTH} AS truth, technique, round(risk, 6) >= 0.8 AS alerted,
        technique IS NOT NULL AND (chain_hop = 1 AND technique = 'T1021' OR technique_score >= 0.45) AS sure FROM q),
    technique_ids AS (SELECT truth AS id FROM z WHERE truth IS NOT NULL UNION SELECT technique FROM z WHERE sure),
    by_id AS (SELECT id, count(*) FILTER (truth = id) AS injected, count(*) FILTER (truth = id AND alerted) AS alerted, count(*) FILTER (truth = id AND sure AND technique = id) AS attributed,
        count(*) FILTER (truth = id AND sure AND technique <> id) AS attributed_other, count(*) FILTER (truth IS NULL AND sure AND technique = id) AS false_attributions, count(*) FILTER (truth IS NULL) AS benign FROM technique_ids, z GROUP BY id)
    SELECT id AS technique, injected, alerted, attributed, attributed_other, false_attributions, round(coalesce(alerted / nullif(injected, 0)::DOUBLE, 0.0), 6) + 0.0 AS detection_recall, round(coalesce(attributed / nullif(injected, 0)::DOUBLE, 0.0), 6) + 0.0 AS attribution_recall,
        round(coalesce(attributed / nullif(attributed + false_attributions, 0)::DOUBLE, 0.0), 6) + 0.0 AS precision, round(coalesce(10000 * false_attributions / nullif(benign, 0)::DOUBLE, 0.0), 6) + 0.0 AS false_per_10k FROM by_id""",
)
def g12(spark, sf_dir):
    rows = classified(spark, sf_dir).select(F.expr(_TRUTH).alias("truth"), "technique", "confidence", (F.round("risk", 6) >= 0.8).cast("int").alias("alerted"))
    return rounded(reports.technique_metrics(rows), "technique", "injected", "alerted", "attributed", "attributed_other", "false_attributions", "detection_recall", "attribution_recall", "precision", "false_per_10k")


@registered(
    "h08_combine_percentiles",
    f"{SCORES_CTE}, m AS (SELECT event_id, cume_dist() OVER (ORDER BY score) AS a, (event_id % 1000) / 1000.0::DOUBLE AS b FROM x), z AS (SELECT event_id, round((round(a, 9) + b) / 2, 9) AS mean FROM m) SELECT event_id, round(cume_dist() OVER (ORDER BY mean), 6) AS combined FROM z",
)
def h08(spark, sf_dir):
    rows = scores(spark, sf_dir).select("event_id", "score")
    own = evaluation.percentile_of(rows, rows.select("score")).select("event_id", F.round("percentile", 9).alias("a"))
    members = own.withColumn("b", (F.col("event_id") % 1_000) / 1_000.0)
    return rounded(reports.combine_percentiles(members, ["a", "b"]), "event_id", "combined")


@registered(
    "h08_combine_percentiles_max",
    f"{SCORES_CTE}, m AS (SELECT event_id, cume_dist() OVER (ORDER BY score) AS a, cume_dist() OVER (ORDER BY (event_id * 104729 + src * 17) % 997) AS b FROM x), z AS (SELECT event_id, round(greatest(round(a, 9), round(b, 9)), 9) AS most FROM m) SELECT event_id, round(cume_dist() OVER (ORDER BY most), 6) AS combined FROM z",
)
def h08_max(spark, sf_dir):
    """The greater percentile of two scorings of the same events."""
    x = scores(spark, sf_dir)
    other = x.select("event_id", ((F.col("event_id") * 104729 + F.col("src") * 17) % 997).cast("double").alias("score"))
    own = [evaluation.percentile_of(rows, rows.select("score")).select("event_id", F.round("percentile", 9).alias(name)) for rows, name in ((x.select("event_id", "score"), "a"), (other, "b"))]
    return rounded(reports.combine_percentiles(own[0].join(own[1], "event_id"), ["a", "b"], "max"), "event_id", "combined")


@registered(
    "i19_rank_statistics",
    f"{SCORES_CTE}, b AS (SELECT score FROM x WHERE label = 0) SELECT event_id, (SELECT count(*) FROM b WHERE b.score > x.score) AS above, (SELECT count(*) FROM b WHERE b.score = x.score) AS tied FROM x WHERE label = 1",
)
def i19_rows(spark, sf_dir):
    return reports.rank_statistics(scores(spark, sf_dir)).select("event_id", "above", "tied")


@registered(
    "i19_exact_auc_ap",
    f"{SCORES_CTE}, p AS (SELECT score, (SELECT count(*) FROM x b WHERE b.label = 0 AND b.score > x.score) AS above, (SELECT count(*) FROM x b WHERE b.label = 0 AND b.score = x.score) AS tied, (SELECT count(*) FROM x b WHERE b.label = 1 AND b.score >= x.score) AS tp FROM x WHERE label = 1), n AS (SELECT count(*) AS n FROM x WHERE label = 0) SELECT round(avg((n - above - tied * 0.5::DOUBLE) / n), 6) AS roc_auc, round(avg(tp / (tp + above + tied)::DOUBLE), 6) AS ap FROM p, n",
)
def i19(spark, sf_dir):
    return rounded(reports.exact_auc_ap(scores(spark, sf_dir)), "roc_auc", "ap")


@registered(
    "i23_truth_match",
    f"{DENSE_SQL}, z AS (SELECT event_id, (t // 900) % 5 AS recording, usr, src, dst FROM e) SELECT event_id, recording, CAST(CASE recording WHEN 0 THEN usr IN (1, 2, 3) AND dst IN (4, 5, 6, 7) WHEN 1 THEN dst IN (10, 11, 12) WHEN 2 THEN usr IN (7) AND dst IN (20, 21, 22, 23) AND src IN (1, 30, 31) ELSE false END AS INTEGER) AS attack FROM z",
)
def i23(spark, sf_dir):
    truth = spark.createDataFrame([(0, [1, 2, 3], [4, 5, 6, 7], []), (1, [], [10, 11, 12], []), (2, [7], [20, 21, 22, 23], [1, 30, 31])], "recording long, accounts array<long>, targets array<long>, sources array<long>")
    return reports.truth_match(auth_dense(spark, sf_dir).withColumn("recording", F.pmod(F.floor(F.col("t") / 900), F.lit(5))), F.broadcast(truth))


@registered("j07_host_ranking_max", f"{SCORES_CTE}, h AS (SELECT t // 86400 AS day, src, round(max(score), 9) AS hs FROM x GROUP BY ALL) SELECT day, src, round(hs, 6) AS host_score, CAST(rank() OVER (PARTITION BY day ORDER BY hs DESC) AS INTEGER) AS rank FROM h")
def j07(spark, sf_dir):
    return rounded(reports.host_ranking(scores(spark, sf_dir)), "day", "src", "host_score", "rank")


_HOPS_CTE = f"""{DENSE_SQL}, h0 AS (SELECT src AS campaign, src % 4 AS family, (src % 3) * 300 AS interval, usr, row_number() OVER (PARTITION BY src ORDER BY t, event_id) AS hop, CAST(event_id % 5 = 3 AS INTEGER) AS alerted, CAST(event_id % 7 = 4 AS INTEGER) AS acted FROM e WHERE label = 1),
    h1 AS (SELECT *, min(hop) FILTER (acted = 1) OVER (PARTITION BY campaign, usr) AS stopped FROM h0),
    lat AS (SELECT campaign, family, interval, max(hop) AS hops, min(hop) FILTER (alerted = 1) AS first_alert_hop, min(hop) FILTER (acted = 1) AS first_action_hop, coalesce(max(hop) - min(hop) FILTER (acted = 1), 0) AS prevented, count(*) FILTER (hop > stopped) AS prevented_account FROM h1 GROUP BY campaign, family, interval)"""


def _campaigns(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("src").orderBy("t", "event_id")
    flag = lambda n, at: (F.col("event_id") % n == at).cast("int")
    rows = auth_dense(spark, sf_dir).filter("label = 1").select(F.col("src").alias("campaign"), (F.col("src") % 4).alias("family"), ((F.col("src") % 3) * 300).alias("interval"), "usr", F.row_number().over(w).cast("long").alias("hop"), flag(5, 3).alias("alerted"), flag(7, 4).alias("acted"))
    return reports.hop_latency(rows)


@registered("j12_hop_latency_metrics", f"{_HOPS_CTE} SELECT * FROM lat")
def j12(spark, sf_dir):
    return _campaigns(spark, sf_dir)


_SUMMED = "count(*) AS campaigns, count(first_alert_hop) AS detected, round(count(first_alert_hop) / count(*)::DOUBLE, 6) + 0.0 AS detection_rate, round(median(first_alert_hop), 6) AS median_latency, round(avg(first_alert_hop), 6) AS mean_latency, round(sum(prevented) / sum(hops)::DOUBLE, 6) + 0.0 AS prevented_campaign, round(sum(prevented_account) / sum(hops)::DOUBLE, 6) + 0.0 AS prevented_account"


@registered("j12_latency_summary", f"{_HOPS_CTE} SELECT 'all' AS by, NULL::VARCHAR AS value, {_SUMMED} FROM lat UNION ALL SELECT 'family', family::VARCHAR, {_SUMMED} FROM lat GROUP BY family UNION ALL SELECT 'interval', interval::VARCHAR, {_SUMMED} FROM lat GROUP BY interval")
def j12_summary(spark, sf_dir):
    return rounded(reports.latency_summary(_campaigns(spark, sf_dir)), "by", "value", "campaigns", "detected", "detection_rate", "median_latency", "mean_latency", "prevented_campaign", "prevented_account")


@registered("j12_benign_cost", f"{DENSE_SQL}, b AS (SELECT usr, event_id % 50 = 3 AS alerted, event_id % 70 = 4 AS acted FROM e WHERE label = 0) SELECT count(*) AS benign_events, count(*) FILTER (alerted) AS alerted, count(*) FILTER (acted) AS acted, count(DISTINCT usr) FILTER (acted) AS users_hit, round(10000 * count(*) FILTER (alerted) / count(*)::DOUBLE, 6) AS alerted_per_10k, round(10000 * count(*) FILTER (acted) / count(*)::DOUBLE, 6) AS acted_per_10k FROM b")
def j12_cost(spark, sf_dir):
    flag = lambda n, at: (F.col("event_id") % n == at).cast("int")
    rows = auth_dense(spark, sf_dir).filter("label = 0").select("usr", flag(50, 3).alias("alerted"), flag(70, 4).alias("acted"))
    return rounded(reports.benign_cost(rows), "benign_events", "alerted", "acted", "users_hit", "alerted_per_10k", "acted_per_10k")


_RECORDS = """SELECT event_id AS seq, usr * 40 + k % 40 AS alert_id, t, CASE logon_id WHEN 0 THEN 'force_reauth' WHEN 1 THEN 'lock_account' WHEN 2 THEN 'notify_soc' ELSE 'isolate_host' END AS action,
    CASE k % 6 WHEN 0 THEN 'pending_approval' WHEN 1 THEN 'rejected' WHEN 2 THEN 'executed' WHEN 3 THEN 'kept' WHEN 4 THEN 'reverted' ELSE 'dry_run' END AS outcome,
    CASE WHEN orient_name = 'LogOn' THEN 'policy' ELSE 'approval' END AS authority, concat('analyst', src % 4) AS approved_by,
    CASE WHEN k % 12 = 4 THEN concat('lifted by analyst', dst % 3) WHEN k % 12 = 10 THEN 'expired' END AS output FROM"""
_VERDICTS = f"""{SPARSE_SQL}, r AS ({_RECORDS} (SELECT *, (dst + usr) % 97 AS k FROM e)),
    confirmed AS (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY seq DESC) AS n, CASE WHEN outcome = 'kept' THEN 'kept the lock' ELSE 'approved ' || action END AS source FROM r WHERE outcome = 'kept' OR authority = 'approval' AND outcome IN ('dry_run', 'executed') AND action <> 'notify_soc'),
    lifted AS (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY seq DESC) AS n FROM r WHERE outcome = 'reverted' AND output LIKE 'lifted by %'),
    refused AS (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY t DESC, seq) AS n FROM r WHERE outcome = 'rejected'),
    left_open AS (SELECT DISTINCT alert_id FROM r p WHERE outcome = 'pending_approval' AND NOT EXISTS (SELECT 1 FROM r q WHERE q.alert_id = p.alert_id AND q.action = p.action AND q.outcome = 'rejected')),
    v AS (SELECT alert_id, 1 AS label, source, approved_by AS decided_by, t AS decided_at FROM confirmed WHERE n = 1
        UNION ALL SELECT alert_id, 0, 'lifted ' || action, substr(output, 11), t FROM lifted WHERE n = 1 AND alert_id NOT IN (SELECT alert_id FROM confirmed)
        UNION ALL SELECT alert_id, 0, 'rejected every action', approved_by, t FROM refused WHERE n = 1 AND alert_id NOT IN (SELECT alert_id FROM confirmed) AND alert_id NOT IN (SELECT alert_id FROM lifted) AND alert_id NOT IN (SELECT alert_id FROM left_open))"""


def _records(spark, sf_dir):
    rows = auth_sparse(spark, sf_dir).withColumn("k", (F.col("dst") + F.col("usr")) % 97)
    return spark.sql(f"{_RECORDS} {{rows}}", rows=rows)


@registered("k08_feedback_labels", f"{_VERDICTS} SELECT * FROM v")
def k08(spark, sf_dir):
    return reports.feedback_labels(_records(spark, sf_dir))


@registered(
    "k09_training_set",
    f"{_VERDICTS}, al AS (SELECT min(seq) AS event_id, alert_id FROM r GROUP BY alert_id), feats AS (SELECT event_id, success, logon_id FROM e) SELECT f.event_id, v.label, 'feedback' AS kind, f.success, f.logon_id FROM al JOIN v ON v.alert_id = al.alert_id JOIN feats f ON f.event_id = al.event_id UNION ALL SELECT event_id, 0, 'background', success, logon_id FROM feats WHERE event_id * 2654435761 % 4294967296 % 10 = 0 AND event_id NOT IN (SELECT event_id FROM al)",
)
def k09(spark, sf_dir):
    records = _records(spark, sf_dir)
    by_alert = records.groupBy("alert_id").agg(F.min("seq").alias("event_id"))
    return reports.training_rows(reports.feedback_labels(records), by_alert, auth_sparse(spark, sf_dir), 10, ["success", "logon_id"])


@registered(
    "k03_budget_gate",
    f"""{ALERTS_CTE}, o AS (SELECT *, src % 7 AS tenant FROM a), n AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY t, event_id) AS n FROM o),
    st(tenant, n, event_id, spent, verdict) AS (
        SELECT DISTINCT tenant, 0::BIGINT, 0::BIGINT, [{{'t': 0::BIGINT, 'usr': -1::BIGINT}}], '' FROM n
        UNION ALL
        SELECT tenant, n, event_id, CASE WHEN verdict = 'allowed' THEN list_append(spent, {{'t': t, 'usr': usr}}) ELSE spent END, verdict
        FROM (SELECT n.tenant, n.n, n.event_id, n.t, n.usr, list_filter(s.spent, lambda x: x.t > n.t - 3600) AS spent, CASE WHEN len(list_filter(s.spent, lambda x: x.t > n.t - 3600)) >= 20 THEN 'hourly'
            WHEN n.event_id % 6 <> 0 AND len(list_filter(s.spent, lambda x: x.usr = n.usr AND x.t > n.t - 3600)) > 0 THEN 'cooldown' ELSE 'allowed' END AS verdict
            FROM st s JOIN n ON n.tenant = s.tenant AND n.n = s.n + 1)
    ) SELECT event_id, verdict FROM st WHERE n > 0""",
)
def k03(spark, sf_dir):
    return reports.budget_gate(alerts(spark, sf_dir).withColumns({"tenant": F.col("src") % 7, "escalation": (F.col("event_id") % 6 == 0).cast("int")}))


_SOURCES = {"kerberos": "auth_name = 'Kerberos'", "ntlm": "auth_name = 'NTLM'", "tickets": "orient_name IN ('TGT', 'TGS')", "failures": "success = 0", "process": "false"}


@registered("l04_telemetry_coverage", f"{DENSE_SQL}, z AS (" + " UNION ALL ".join(f"SELECT '{n}' AS source, count(*) FILTER ({on}) AS n FROM e" for n, on in _SOURCES.items()) + ") SELECT source, n, CAST(n > 0 AS INTEGER) AS available FROM z")
def l04(spark, sf_dir):
    return reports.telemetry_coverage(auth_dense(spark, sf_dir), _SOURCES)


@registered("b10_day_hour", f"{SPARSE_SQL} SELECT event_id, t // 86400 AS day, (t % 86400) // 3600 AS hour FROM e")
def b10(spark, sf_dir):
    return reports.clock(auth_sparse(spark, sf_dir)).select("event_id", "day", "hour")


@registered("i08_describe", f"{SPARSE_SQL} SELECT count(*) AS events, CAST(sum(label) AS BIGINT) AS attacks, count(*) FILTER (label = 0) AS benign, round(avg(label), 6) AS prevalence FROM e")
def i08_describe(spark, sf_dir):
    return rounded(reports.describe(auth_sparse(spark, sf_dir)), "events", "attacks", "benign", "prevalence")


@registered(
    "k12_evidence_rows",
    f"""{WHOLE_PATHS_CTE}, k_w AS (SELECT a.*, s.user_unique_dst_5m AS fanout, s.failures_before_success_15m AS failures, round(s.model, 6) AS model FROM a JOIN s ON s.event_id = a.event_id),
    k_p AS (SELECT event_id, path, score FROM (SELECT unnest(events) AS event_id, * EXCLUDE (events), events AS ids FROM scored_paths) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY score DESC, first_t, last_t, ids) = 1),
    k_z AS (SELECT k_w.*, k_p.path, k_p.score FROM k_w LEFT JOIN k_p ON k_p.event_id = k_w.event_id),
    k_i AS (SELECT *, unnest([{{'k': 'E-001', 'c': 'observed', 'v': t::DOUBLE}}, {{'k': 'E-002', 'c': 'derived', 'v': is_new::DOUBLE}}, {{'k': 'E-003', 'c': 'derived', 'v': fanout::DOUBLE}}, {{'k': 'E-004', 'c': 'derived', 'v': failures::DOUBLE}},
        {{'k': 'E-005', 'c': 'model', 'v': model::DOUBLE}}, {{'k': 'E-006', 'c': 'model', 'v': risk::DOUBLE}}, {{'k': 'E-007', 'c': 'derived', 'v': score::DOUBLE}}]) AS e FROM k_z)
    SELECT event_id, e.k AS evidence_id, e.c AS category, e.v AS value, CASE WHEN e.k = 'E-007' THEN path END AS path_id, CAST(e.k IN ('E-001', 'E-002', 'E-005', 'E-007') AS INTEGER) AS cited, 'T1021' AS technique, CASE WHEN path IS NOT NULL AND risk >= 0.8 THEN 'medium' ELSE 'low' END AS confidence
    FROM k_i WHERE path IS NOT NULL OR e.k <> 'E-007'""",
)
def k12(spark, sf_dir):
    rows = scored(spark, sf_dir, ["failures_before_success_15m"]).withColumn("risk", F.round("risk", 6)).filter(F.col("risk") >= PATH_RISK)
    rows = graph.cut_lineage(rows.select("event_id", "t", "usr", "src", "dst", "risk", F.col("is_new_pair").alias("is_new"), "support", F.col("user_unique_dst_5m").alias("fanout"), F.col("failures_before_success_15m").alias("failures"), F.round("model", 6).alias("model")), "evidence")
    paths = graph.score_paths(graph.rank_paths(rows.select("event_id", "t", "usr", "src", "dst", "risk", "is_new", "support"), min_risk=PATH_RISK), top_k=None)
    return reports.evidence_rows(rows, reports.best_paths(paths))
