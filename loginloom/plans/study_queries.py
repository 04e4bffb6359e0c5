"""Registered queries of sweeps, detectors, response planning, reports and incremental features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import deployment, evaluation, features, graph, rules, studies
from ..shared import fresh_path
from ..streaming import incremental
from .analysis_queries import ALERTS_CTE, SCORES_CTE, alerts, scores
from .detection_queries import CHAIN_CTE, FANOUT_CTE, FEATURE_CTE, SCORE_CTE, TACTIC_CTE, classified, r6, rounded, scored, selected
from .fixtures import DENSE_SQL, SPARSE_SQL, auth_dense, auth_sparse

QUERIES, ORACLE_SQL = {}, {}


def registered(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


@registered(
    "j01_chain_rule_cost",
    f"{DENSE_SQL}{CHAIN_CTE}, k AS (SELECT *, CAST(success = 1 AND before_n = 0 AND coalesce(last_strict >= t - 1800, false) AS INTEGER) AS base FROM c), g AS (SELECT unnest([1, 2, 3]) AS prior) SELECT CAST(prior AS INTEGER) AS prior, count(k.event_id) AS flags, round(coalesce(sum(1 - label), 0) * 10000 / (SELECT count(*) FROM e)::DOUBLE, 6) + 0.0 AS benign_per_10k, count(DISTINCT usr) AS users, CAST(coalesce(sum(label), 0) AS BIGINT) AS caught FROM g LEFT JOIN k ON base = 1 AND prior_hops >= prior GROUP BY prior",
)
def j01(spark, sf_dir):
    flags = rules.chain_flags(auth_dense(spark, sf_dir), prior=0).withColumn("chain_base", F.col("chain_hop"))
    return rounded(studies.chain_rule_cost(flags, [1, 2, 3]), "prior", "flags", "benign_per_10k", "users", "caught")


@registered("j02_chain_rule_hourly", f"{DENSE_SQL}{CHAIN_CTE} SELECT (t % 86400) // 3600 AS hour, count(*) AS events, CAST(sum(chain_hop * (1 - label)) AS BIGINT) AS benign_flags FROM c GROUP BY 1")
def j02(spark, sf_dir):
    return studies.hourly_cost(rules.chain_flags(auth_dense(spark, sf_dir)), "chain_hop")


@registered("j03_hop_strictness", f"{DENSE_SQL}{CHAIN_CTE} SELECT (t % 86400) // 3600 AS hour, CAST(sum(chain_continues) AS BIGINT) AS loose, CAST(sum(chain_continues * success) AS BIGINT) AS successful, CAST(sum(chain_hop) AS BIGINT) AS strict FROM c GROUP BY 1")
def j03(spark, sf_dir):
    rows = rules.chain_flags(auth_dense(spark, sf_dir))
    hour = F.floor(F.pmod("t", F.lit(86_400)) / 3_600)
    return rows.groupBy(hour.alias("hour")).agg(F.sum("chain_continues").cast("long").alias("loose"), F.sum(F.col("chain_continues") * F.col("success")).cast("long").alias("successful"), F.sum("chain_hop").cast("long").alias("strict"))


@registered("j04_fanout_grid", f"{DENSE_SQL}{FANOUT_CTE}, z AS (SELECT unnest([3, 5, 8]) AS a), y AS (SELECT unnest([2, 5]) AS b) SELECT CAST(a AS INTEGER) AS min_accounts, CAST(b AS INTEGER) AS min_novel, count(g.event_id) AS flags, round(count(g.event_id) / (SELECT count(*) FROM e)::DOUBLE, 6) + 0.0 AS rate FROM z CROSS JOIN y LEFT JOIN g ON success = 1 AND dst_novel = 1 AND fanout_accounts >= a AND fanout_novel >= b GROUP BY a, b")
def j04(spark, sf_dir):
    return rounded(studies.fanout_grid(rules.fanout_inputs(auth_dense(spark, sf_dir)), [3, 5, 8], [2, 5]), "min_accounts", "min_novel", "flags", "rate")


@registered("j05_sampling_artefact", f"{DENSE_SQL}{FEATURE_CTE}, thin AS (SELECT * FROM e WHERE event_id % 3 = 0), h AS (SELECT event_id, count(*) OVER (PARTITION BY usr ORDER BY t RANGE BETWEEN 299 PRECEDING AND 1 PRECEDING) AS r, count(*) OVER (PARTITION BY usr, dst ORDER BY t RANGE BETWEEN 3599 PRECEDING AND 1 PRECEDING) AS p FROM thin) SELECT round(avg(f.user_auth_rate_5m - h.r), 6) + 0.0 AS rate_shift, round(avg(f.pair_frequency_1h - h.p), 6) + 0.0 AS pair_shift FROM f JOIN h ON h.event_id = f.event_id")
def j05(spark, sf_dir):
    names = ["user_auth_rate_5m", "pair_frequency_1h"]
    e = auth_dense(spark, sf_dir)
    full, thin = features.with_features(e, names), features.with_features(e.filter("event_id % 3 = 0"), names)
    both = full.select("event_id", *[F.col(n).alias(f"full_{n}") for n in names]).join(thin.select("event_id", *names), "event_id")
    return rounded(both.agg(F.avg(F.col("full_user_auth_rate_5m") - F.col("user_auth_rate_5m")).alias("rate_shift"), F.avg(F.col("full_pair_frequency_1h") - F.col("pair_frequency_1h")).alias("pair_shift")), "rate_shift", "pair_shift")


@registered("j11_feedback_review_queue", f"{SCORES_CTE}, r AS (SELECT t // 86400 AS day, event_id, score, row_number() OVER (PARTITION BY t // 86400 ORDER BY score DESC, event_id) AS n, count(*) OVER (PARTITION BY t // 86400) AS k FROM x) SELECT day, event_id, round(score, 6) + 0.0 AS score FROM r WHERE n <= greatest(1, floor(k * 0.02::DOUBLE))")
def j11(spark, sf_dir):
    return rounded(studies.review_queue(scores(spark, sf_dir), 0.02), "day", "event_id", "score")


@registered(
    "j08_lock_policy",
    f"""{ALERTS_CTE}, p AS (SELECT *, t // 86400 AS day FROM a), w AS (
        SELECT *, (SELECT count(*) FROM p b WHERE b.usr = p.usr AND b.day = p.day AND b.t > p.t - 3600 AND (b.t < p.t OR b.t = p.t AND b.event_id < p.event_id)) AS prior FROM p
    ), ready AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY t, event_id) AS n FROM w WHERE risk > 0.9 AND prior >= 1),
    st(day, n, locks, label, usr, src, took, refused) AS (
        SELECT day, 0::BIGINT, [{{'t': 0::BIGINT, 'usr': -1::BIGINT}}], 0, 0::BIGINT, 0::BIGINT, 0, 0 FROM ready GROUP BY day
        UNION ALL
        SELECT day, n, CASE WHEN take THEN list_append(locks, {{'t': t, 'usr': usr}}) ELSE locks END, label, usr, src, take::INTEGER, (NOT held AND full_)::INTEGER
        FROM (SELECT *, NOT held AND NOT full_ AS take FROM (
            SELECT r.day, r.n, r.t, r.usr, r.src, r.label, s.locks, len(list_filter(s.locks, lambda x: x.usr = r.usr AND x.t + 7200 > r.t)) > 0 AS held,
                len(list_filter(s.locks, lambda x: x.t > r.t - 3600)) >= 20 AS full_
            FROM st s JOIN ready r ON r.day = s.day AND r.n = s.n + 1))
    )
    SELECT day, count(*) FILTER (took = 1 AND label = 0) AS benign_locks, count(DISTINCT usr) FILTER (took = 1 AND label = 0) AS benign_accounts,
        count(*) FILTER (took = 1 AND label = 1) AS attack_locks, count(DISTINCT src) FILTER (took = 1 AND label = 1) AS attack_hosts, CAST(sum(refused) AS BIGINT) AS refused
    FROM st WHERE n > 0 GROUP BY day""",
)
def j08(spark, sf_dir):
    return studies.lock_policy(alerts(spark, sf_dir).withColumnRenamed("risk", "score"), action=0.9)


_RULE = "2.0::DOUBLE * is_new_pair + 0.3::DOUBLE * least(user_unique_dst_5m, 10) + 0.5::DOUBLE * least(failures_before_success_15m, 5) - 3"


@registered("h01_score_rule", f"{DENSE_SQL}{FEATURE_CTE} SELECT event_id, round(1 / (1 + exp(-({_RULE}))), 6) AS score FROM f")
def h01(spark, sf_dir):
    x = features.with_features(auth_dense(spark, sf_dir), ["is_new_pair", "user_unique_dst_5m", "failures_before_success_15m"])
    return rounded(studies.score_rule(x), "event_id", "score")


@registered("h02_score_rarity", f"{DENSE_SQL}{FEATURE_CTE} SELECT event_id, round(0.5::DOUBLE * pair_rarity + 0.25::DOUBLE * is_new_pair + 0.15::DOUBLE * destination_novelty + 0.1::DOUBLE * user_new_dst_ratio_1h, 6) + 0.0 AS score FROM f")
def h02(spark, sf_dir):
    x = features.with_features(auth_dense(spark, sf_dir), ["pair_rarity", "is_new_pair", "destination_novelty", "user_new_dst_ratio_1h"])
    return rounded(studies.score_rarity(x), "event_id", "score")


@registered("h03_score_novelty", f"{DENSE_SQL}{FEATURE_CTE} SELECT event_id, 1 - pair_seen_before AS edge_new, 1 - src_dst_seen_before AS hosts_new, 1 - user_src_seen_before AS source_new FROM f")
def h03(spark, sf_dir):
    x = features.with_features(auth_dense(spark, sf_dir), ["pair_seen_before", "src_dst_seen_before", "user_src_seen_before"])
    return x.select("event_id", (1 - F.col("pair_seen_before")).alias("edge_new"), (1 - F.col("src_dst_seen_before")).alias("hosts_new"), (1 - F.col("user_src_seen_before")).alias("source_new"))


ML = ["is_new_pair", "user_auth_rate_5m", "destination_novelty", "delta_user_log", "user_failure_rate_15m"]


def _fitted(kind):
    def run(spark, sf_dir):
        x = features.with_features(auth_sparse(spark, sf_dir), ML)
        model = studies.fit_classifier(x.filter("event_id % 10 < 7"), ML, kind)
        from pyspark.ml.functions import vector_to_array

        return model.transform(x.filter("event_id % 10 >= 7")).select("event_id", "label", vector_to_array("probability")[1].alias("score"))

    return run


QUERIES["h04_fit_logistic"] = _fitted("logistic")
QUERIES["h05_fit_gbt"] = _fitted("gbt")


@registered("h06_isolation_forest")
def h06(spark, sf_dir):
    x = features.with_features(auth_sparse(spark, sf_dir), ML)
    return studies.isolation_forest(x, x.select("event_id", *ML), ML).select("event_id", "anomaly", "percentile")


@registered("h10_onboard_calibrate")
def h10(spark, sf_dir):
    """A profile from the first half of the days, read again to score all rows."""
    path = fresh_path(spark, "profile")
    days = F.floor(F.col("t") / 86_400)
    half = auth_sparse(spark, sf_dir).select(F.percentile(days, 0.5).alias("day")).first().day
    x = graph.cut_lineage(deployed(spark, sf_dir), "deployed")
    deployment.onboard(x.filter(days <= half), PROFILED, path, alert_budget=0.01, action_budget=0.001)
    return rounded(deployment.score_with_profile(x, PROFILED, path), "event_id", "p_rarity", "p_iforest", "percentile", "alert", "action")


PROFILED = ["is_new_pair", "pair_rarity", "destination_novelty", "user_new_dst_ratio_1h", "user_auth_rate_5m", "delta_user_log", "user_failure_rate_15m"]


def deployed(spark, sf_dir):
    return features.with_features(auth_sparse(spark, sf_dir), PROFILED)


@registered("h11_plausibility_model")
def h11(spark, sf_dir):
    """The anomaly of every event by a model of real against counterfactual events, which reads no label."""
    real, examples = deployment.plausibility_rows(auth_dense(spark, sf_dir), features.ALL, share=0.05)
    return rounded(deployment.anomaly(deployment.fit_plausibility(examples, features.ALL), real), "event_id", "anomaly")


_PARTS = {"p1": "score", "p2": "((event_id * 104729 + src * 17) % 997 + label * 150) / 1200.0::DOUBLE", "p3": "((t // 60 + usr * 13) % 777 + label * 90) / 900.0::DOUBLE"}


def _search_sql() -> str:
    lists = []
    for name, op, mask in deployment.combination_names(list(_PARTS)):
        own = [m for i, m in enumerate(_PARTS) if mask >> i & 1]
        value = f"({' + '.join(own)}) / {len(own)}" if op == "mean" else f"greatest({', '.join(own)})"
        lists.append(f"{{'name': '{name}', 'mask': {mask}, 's': round({value}, 9)}}")
    cdf = ", ".join(f"round(count(*) FILTER (day < {{cut}}) OVER (ORDER BY {m}_raw RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / (count(*) FILTER (day < {{cut}}) OVER ())::DOUBLE, 9) AS {m}" for m in _PARTS)
    return f"""{SCORES_CTE}, d AS (SELECT *, t // 86400 - (SELECT min(t // 86400) FROM x) AS day, {', '.join(f'{v} AS {m}_raw' for m, v in _PARTS.items())} FROM x),
    m AS (SELECT day, src, label, {cdf.format(cut=10)} FROM d),
    c AS (SELECT day, src, label, unnest([{', '.join(lists)}]) AS c FROM m), z AS (SELECT day, src, label, c.name, c.mask, c.s FROM c),
    k AS (SELECT name, mask, budget, list_sort(list(s) FILTER (day < 10))[ceil((count(*) FILTER (day < 10) - 1) * (1 - budget))::BIGINT + 1] AS threshold FROM z, (VALUES (0.01::DOUBLE), (0.001::DOUBLE)) AS b(budget) GROUP BY name, mask, budget)
    SELECT k.name, CAST(k.mask AS INTEGER) AS mask, budget, round(threshold, 6) AS threshold, count(*) FILTER (s > threshold) AS alerts, CAST(coalesce(sum(label) FILTER (s > threshold), 0) AS BIGINT) AS hits,
        count(DISTINCT (day, src)) FILTER (label = 1 AND s > threshold) AS campaigns, count(DISTINCT (day, src)) FILTER (label = 1) AS all_campaigns
    FROM k JOIN z ON z.name = k.name AND z.day >= 10 GROUP BY ALL"""


@registered("j09_combination_search", _search_sql())
def j09(spark, sf_dir):
    """Three detectors, ten combinations, thresholds from the first ten days."""
    x = scores(spark, sf_dir)
    first = F.broadcast(x.agg(F.floor(F.min("t") / 86_400).alias("first")))
    rows = x.join(first).withColumns({"day": F.floor(F.col("t") / 86_400) - F.col("first"), "p2": ((F.col("event_id") * 104729 + F.col("src") * 17) % 997 + F.col("label") * 150) / F.lit(1200.0), "p3": ((F.floor(F.col("t") / 60) + F.col("usr") * 13) % 777 + F.col("label") * 90) / F.lit(900.0)})
    found = graph.cut_lineage(rows.withColumnRenamed("score", "p1"), "members")
    for m in _PARTS:
        reference = found.filter("day < 10").select(F.col(f"{m}").alias("score"))
        own = evaluation.percentile_of(found.select("event_id", F.col(m).alias("score")), reference)
        found = found.drop(m).join(own.select("event_id", F.round("percentile", 9).alias(m)), "event_id")
    return rounded(deployment.combination_search(found, list(_PARTS), F.col("day") < 10), "name", "mask", "budget", "threshold", "alerts", "hits", "campaigns", "all_campaigns")


@registered("j10_leave_one_attacker_out")
def j10(spark, sf_dir):
    """Every labelled source left out in turn, ranked among all rows of the days that it attacked on."""
    x = features.with_features(auth_sparse(spark, sf_dir), ML).withColumn("day", F.floor(F.col("t") / 86_400))
    return rounded(deployment.leave_one_attacker_out(x, ML), "src", "day", "best_rank", "attacks", "average_precision")


@registered("h09_percentile_to_risk", f"{SCORES_CTE}, p AS (SELECT event_id, (event_id % 1000) / 999.0::DOUBLE AS p FROM x) SELECT event_id, round(CASE WHEN p < 0.9 THEN p / 0.9::DOUBLE * 0.329195::DOUBLE WHEN p < 0.99 THEN 0.329195::DOUBLE + (p - 0.9::DOUBLE) / (0.99::DOUBLE - 0.9::DOUBLE) * (0.846394::DOUBLE - 0.329195::DOUBLE) ELSE 0.846394::DOUBLE + (p - 0.99::DOUBLE) / (1 - 0.99::DOUBLE) * (1 - 0.846394::DOUBLE) END, 6) + 0.0 AS risk FROM p")
def h09(spark, sf_dir):
    p = (F.col("event_id") % 1000) / 999.0
    return rounded(scores(spark, sf_dir).withColumn("risk", studies.percentile_to_risk(p, 0.1, 0.01)), "event_id", "risk")


@registered("h13_leakage_checks", f"{SPARSE_SQL}, p AS (SELECT CASE WHEN t <= 1705700000 THEN 'a_train' WHEN t <= 1706200000 THEN 'b_validation' ELSE 'c_test' END AS part, * FROM e) SELECT part, min(t) AS first_t, max(t) AS last_t, CAST(sum(label) AS BIGINT) AS positives, count(*) AS n FROM p GROUP BY part")
def h13(spark, sf_dir):
    part = F.when(F.col("t") <= 1_705_700_000, "a_train").when(F.col("t") <= 1_706_200_000, "b_validation").otherwise("c_test")
    return auth_sparse(spark, sf_dir).groupBy(part.alias("part")).agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.sum("label").cast("long").alias("positives"), F.count("*").alias("n"))


@registered("g11_technique_coverage", f"{DENSE_SQL}{TACTIC_CTE} SELECT technique, count(*) AS n, CAST(sum(label) AS BIGINT) AS labelled, {r6('max(technique_score)').replace('AS max(technique_score)', 'AS best')} FROM q WHERE technique IS NOT NULL GROUP BY technique")
def g11(spark, sf_dir):
    rows = classified(spark, sf_dir).filter("technique IS NOT NULL")
    return rounded(rows.groupBy("technique").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("labelled"), F.max("technique_score").alias("best")), "technique", "n", "labelled", "best")


_BOOK = """book(technique, actions) AS (VALUES
    ('T1021', ['increase_monitoring', 'notify_soc', 'force_reauth', 'block_network_path', 'isolate_host']),
    ('T1110', ['increase_monitoring', 'notify_soc', 'lock_account']),
    ('T1087', ['increase_monitoring', 'notify_soc']),
    ('T1078', ['increase_monitoring', 'notify_soc', 'force_reauth', 'reset_credentials']),
    ('T1550.003', ['increase_monitoring', 'notify_soc', 'force_reauth', 'reset_credentials']),
    ('T1078.002', ['increase_monitoring', 'notify_soc', 'disable_service_account', 'isolate_host']),
    ('T1550.002', ['increase_monitoring', 'notify_soc', 'block_network_path', 'reset_credentials']))"""
_CONFIDENCE = """CASE WHEN technique IS NULL THEN 'none' WHEN chain_hop = 1 AND technique = 'T1021' THEN 'high'
    WHEN technique_score >= 0.65 AND technique_score - second >= 0.15 THEN 'high' WHEN technique_score >= 0.45 THEN 'medium' ELSE 'low' END"""


@registered(
    "k01_response_plan",
    f"""{DENSE_SQL}{TACTIC_CTE}, {_BOOK}, conf AS (SELECT event_id, q.technique, round(risk, 6) AS risk, {_CONFIDENCE.replace('technique IS', 'q.technique IS').replace('technique =', 'q.technique =')} AS confidence,
        coalesce(actions, ['increase_monitoring', 'notify_soc']) AS actions FROM q LEFT JOIN book ON book.technique = q.technique WHERE round(risk, 6) >= 0.8),
    reached AS (SELECT *, CASE confidence WHEN 'high' THEN 5 WHEN 'medium' THEN 3 ELSE 2 END AS reach FROM conf),
    u AS (SELECT event_id, technique, risk, confidence, unnest(actions[1:reach]) AS action, unnest(range(1, least(reach, len(actions)) + 1)) AS step FROM reached)
    SELECT event_id, technique, CAST(step AS INTEGER) AS step, action, CASE WHEN action IN ('increase_monitoring', 'notify_soc') THEN 'auto'
        WHEN action = 'force_reauth' AND confidence = 'high' AND risk >= 0.846394 THEN 'auto' ELSE 'approval' END AS mode FROM u""",
)
def k01(spark, sf_dir):
    rows = classified(spark, sf_dir).withColumn("risk", F.round("risk", 6)).filter("risk >= 0.8")
    return studies.response_plan(rows.select("event_id", "technique", "confidence", "risk"))


_BEFORE = "(SELECT count(*) FROM a b WHERE b.{c} = a.{c} AND b.t > a.t - 3600 AND (b.t < a.t OR b.t = a.t AND b.event_id < a.event_id))"


@registered("k04_corroborated_lock", f"{ALERTS_CTE}, z AS (SELECT event_id, {_BEFORE.format(c='usr')} AS user_before, {_BEFORE.format(c='src')} AS host_before FROM a) SELECT *, CAST(greatest(user_before, host_before) >= 2 AS INTEGER) AS corroborated FROM z")
def k04(spark, sf_dir):
    return studies.corroborated(alerts(spark, sf_dir))


@registered("k05_failed_containment", f"{ALERTS_CTE}, done AS (SELECT usr, t FROM a WHERE event_id % 5 = 0), z AS (SELECT event_id, a.t, (SELECT max(d.t) FROM done d WHERE d.usr = a.usr AND d.t < a.t) AS contained_t FROM a) SELECT event_id, contained_t FROM z WHERE t - contained_t <= 1800")
def k05(spark, sf_dir):
    rows = alerts(spark, sf_dir)
    return studies.failed_containment(rows, rows.filter("event_id % 5 = 0").select("usr", "t"))


@registered("k06_lock_intervals", f"{ALERTS_CTE}, o AS (SELECT usr, t, event_id, CASE WHEN t > lag(t) OVER w + 600 OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM a WINDOW w AS (PARTITION BY usr ORDER BY t, event_id)), l AS (SELECT *, sum(opens) OVER (PARTITION BY usr ORDER BY t, event_id) AS lock FROM o) SELECT usr, min(t) AS start_t, max(t) + 600 AS end_t, count(*) AS n_alerts FROM l GROUP BY usr, lock")
def k06(spark, sf_dir):
    return studies.lock_intervals(alerts(spark, sf_dir), hold=600)


@registered("k07_approval_status", f"{SPARSE_SQL}, r AS (SELECT usr AS alert_id, src % 3 AS action, t, event_id AS seq, CASE logon_id WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' ELSE 'rejected' END AS outcome FROM e), l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY alert_id, action ORDER BY t DESC, seq DESC) = 1) SELECT alert_id, action, CASE WHEN outcome = 'pending' AND (SELECT max(t) FROM r) - t > 3600 THEN 'timeout' ELSE outcome END AS outcome FROM l")
def k07(spark, sf_dir):
    e = auth_sparse(spark, sf_dir)
    outcome = F.when(F.col("logon_id") == 0, "pending").when(F.col("logon_id") == 1, "approved").otherwise("rejected")
    return studies.approval_status(e.select(F.col("usr").alias("alert_id"), (F.col("src") % 3).alias("action"), "t", F.col("event_id").alias("seq"), outcome.alias("outcome")))


@registered(
    "l01_overview",
    f"""{DENSE_SQL}{SCORE_CTE}, r AS (SELECT usr, src, dst, round(risk, 6) AS risk FROM s), a AS (SELECT * FROM r WHERE risk >= 0.8),
    n AS (SELECT entity, max(risk) AS most, count(*) AS n FROM (SELECT risk, unnest(['user:' || usr, 'host:' || src, 'host:' || dst]) AS entity FROM a) GROUP BY entity ORDER BY most DESC, n DESC, entity LIMIT 8)
    SELECT 'total' AS kind, 'scored' AS key, count(*)::DOUBLE AS value FROM r UNION ALL SELECT 'total', 'alerts', count(*)::DOUBLE FROM a
    UNION ALL SELECT 'severity', CASE WHEN risk >= 0.85 THEN 'critical' WHEN risk >= 0.70 THEN 'high' WHEN risk >= 0.50 THEN 'medium' ELSE 'low' END, count(*)::DOUBLE FROM a GROUP BY 2
    UNION ALL SELECT 'bin', least(floor(risk * 5)::BIGINT, 4)::VARCHAR, count(*)::DOUBLE FROM a GROUP BY 2
    UNION ALL SELECT 'entity_alerts', entity, n::DOUBLE FROM n UNION ALL SELECT 'entity_risk', entity, most::DOUBLE FROM n""",
)
def l01(spark, sf_dir):
    return studies.overview(scored(spark, sf_dir).withColumn("risk", F.round("risk", 6)), 0.8)


@registered("l02_store_metrics", f"{ALERTS_CTE} SELECT (SELECT count(*) FROM s) AS scored, count(*) AS alerts, round(count(*) / (SELECT count(*) FROM s)::DOUBLE, 6) AS alert_rate FROM a")
def l02(spark, sf_dir):
    fired = (F.round("risk", 6) >= 0.85).cast("int")
    return rounded(scored(spark, sf_dir).agg(F.count("*").alias("scored"), F.sum(fired).cast("long").alias("alerts"), F.avg(fired.cast("double")).alias("alert_rate")), "scored", "alerts", "alert_rate")


@registered("l03_score_distribution", f"{SCORES_CTE} SELECT round(avg(score), 6) AS mean, round(min(score), 6) + 0.0 AS least, round(max(score), 6) AS most, round(quantile_disc(score, 0.5), 6) AS p50, round(quantile_disc(score, 0.95), 6) AS p95 FROM x")
def l03(spark, sf_dir):
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY score)")
    return rounded(scores(spark, sf_dir).agg(F.avg("score").alias("mean"), F.min("score").alias("least"), F.max("score").alias("most"), disc(0.5).alias("p50"), disc(0.95).alias("p95")), "mean", "least", "most", "p50", "p95")


@registered("d24_incremental_features", f"{SPARSE_SQL}{FEATURE_CTE} SELECT event_id, {selected(incremental.FEATURES)} FROM f")
def d24(spark, sf_dir):
    """All features, week after week, each from what the weeks before left; equals d23_causal_features_sparse."""
    out, _ = incremental.advance_days(auth_sparse(spark, sf_dir), step=7)
    return rounded(out, "event_id", *incremental.FEATURES)


_J06 = (
    f"{SCORES_CTE}, b AS (SELECT t // 86400 AS day, src, score FROM x QUALIFY row_number() OVER (PARTITION BY t // 86400, src ORDER BY score DESC, event_id) <= 3), h AS (SELECT day, src, round(avg(score), 9) AS hs FROM b GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY day ORDER BY hs DESC) AS rank FROM h) SELECT day, src, round(hs, 6) AS host_score, CAST(rank AS INTEGER) AS rank FROM r WHERE src IN (SELECT src FROM x WHERE label = 1)"
)


@registered("j06_host_day_rank", _J06)
def j06_attackers(spark, sf_dir):
    """Attackers are the hosts that labelled rows leave."""
    rows = scores(spark, sf_dir)
    return rounded(studies.host_day_rank(rows, rows.filter("label = 1").select("src").distinct()), "day", "src", "host_score", "rank")
