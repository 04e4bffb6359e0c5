"""Incidents, locks and evaluation reports on hand-made rows and against single metrics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loginloom.operators import evaluation, incidents, studies, uncertainty
from loginloom.plans import incident_queries, registry
from tests.test_uncertainty import precision

SF = "/root/testdata/sf0.001"


def locks(spark, alerts, decisions, hold=100):
    a = spark.createDataFrame([(i, t, 7) for i, t in enumerate(alerts)], "event_id long, t long, usr long")
    d = spark.createDataFrame([(i, t, 7, k) for i, (t, k) in enumerate(decisions)], "seq long, t long, usr long, decision string")
    return sorted(tuple(r)[1:] for r in incidents.locks_with_decisions(a, d, hold).collect())


def test_locks_and_decisions(spark):
    assert locks(spark, [0, 50, 300], []) == [(0, 150, 2, 0, 0), (300, 400, 1, 0, 0)]
    # kept: later alerts belong to the lock however late they are, until it is reverted
    assert locks(spark, [0, 5_000], [(20, "kept")]) == [(0, None, 2, 1, 0)]
    assert locks(spark, [0, 5_000, 9_000], [(20, "kept"), (6_000, "reverted")]) == [(0, 6_000, 2, 1, 1), (9_000, 9_100, 1, 0, 0)]
    # reverted at once; the next alert locks again
    assert locks(spark, [0, 60], [(30, "reverted")]) == [(0, 30, 1, 0, 1), (60, 160, 1, 0, 0)]
    # decisions on a free account change nothing
    assert locks(spark, [0, 500], [(150, "kept"), (400, "reverted")]) == [(0, 100, 1, 0, 0), (500, 600, 1, 0, 0)]
    assert locks(spark, [], [(1, "kept")]) == []


def test_total_capture_has_no_holdout(spark):
    rows = spark.createDataFrame([(0.9, 1, 5), (0.8, 0, 6), (0.7, 1, 5), (0.2, 0, 5)], "score double, label int, usr long")
    holdouts, summary = uncertainty.contamination(rows, "usr")
    s = summary.first()
    assert holdouts.collect() == [] and (s.total_capture, s.contaminated, s.dominant, s.dominant_share) == (True, True, 5, 1.0)
    two = spark.createDataFrame([(0.9, 1, 5), (0.8, 1, 5), (0.7, 0, 6), (0.1, 1, 6), (0.05, 0, 5)], "score double, label int, usr long")
    holdouts, summary = uncertainty.contamination(two, "usr", credible=2)
    got = {r.held_out: r for r in holdouts.collect()}
    y, s = np.array([1, 1, 0, 1, 0]), np.array([0.9, 0.8, 0.7, 0.1, 0.05])
    full = precision(y, s)
    for out, keep in ((5, [2, 3]), (6, [0, 1, 4])):
        r, value = got[out], precision(y[keep], s[keep])
        assert r.average_precision == pytest.approx(value) and r.share_of_metric == pytest.approx(1 - value / full)
        assert (r.attacks_remaining, r.events_remaining, r.credible) == (y[keep].sum(), len(keep), y[keep].sum() >= 2)
    assert summary.first().contaminated == (1 - 0.5 / full >= 0.5)
    none = uncertainty.contamination(rows.withColumn("label", F.lit(0)), "usr")
    assert none[0].collect() == [] and none[1].first().attacking_entities == 0 and not none[1].first().contaminated


@pytest.mark.parametrize("chunk", [4, 20_000])
def test_bootstrap_of_positives_equals_numpy(spark, chunk):
    rng = np.random.default_rng(4)
    y = (rng.random(500) < 0.1).astype(int)
    s = np.round(np.clip(rng.normal(0.3 + 0.3 * y, 0.2, 500), 0, 1), 2)
    rows = spark.createDataFrame(list(zip(s.tolist(), y.tolist())), "score double, label int")
    got = uncertainty.bootstrap_positives(rows, n=4_000, seed=3, chunk=chunk).first()
    pos, neg = s[y == 1], s[y == 0]
    auc, ap = [], []
    for _ in range(4_000):
        p = rng.choice(pos, len(pos))
        auc.append(((neg[None] < p[:, None]).mean(1) + 0.5 * (neg[None] == p[:, None]).mean(1)).mean())
        tp = (p[None] >= p[:, None]).sum(1)
        ap.append((tp / (tp + (neg[None] >= p[:, None]).sum(1))).mean())
    want = [*np.percentile(auc, [2.5, 97.5]), *np.percentile(ap, [2.5, 97.5])]
    assert tuple(got)[:4] == pytest.approx(want, abs=0.015) and got.replicates == 4_000


def test_report_says_what_the_metrics_say(spark):
    rng = np.random.default_rng(6)
    n = 900
    y = (rng.random(n) < 0.08).astype(int)
    good, weak = np.round(np.clip(rng.normal(0.3 + 0.4 * y, 0.15, n), 0, 1), 3), np.round(rng.random(n), 3)
    part = np.where(np.arange(n) < 500, "train", np.where(np.arange(n) < 700, "validation", "test"))
    rows = spark.createDataFrame([(str(p), int(l), int(i % 7), float(a), float(b)) for i, (p, l, a, b) in enumerate(zip(part, y, good, weak))], "partition string, label int, src long, good double, weak double")
    got = {(r.section, r.detector, r.metric): r.value for r in uncertainty.evaluation_report(rows, ["good", "weak"], "src", per_10k=300, resamples=100, recall_at=(10,)).collect()}
    test = part == "test"
    assert got["partition", "train", "attacks"] == y[part == "train"].sum()
    for d, s in (("good", good), ("weak", weak)):
        assert got["detector", d, "test_ap"] == pytest.approx(precision(y[test], s[test]))
        assert got["detector", d, "test_ap_low"] <= got["detector", d, "test_ap"] <= got["detector", d, "test_ap_high"]
        assert got["detector", d, "threshold"] == sorted(s[(part == "validation") & (y == 0)])[-max(1, int(((part == "validation") & (y == 0)).sum() * 0.03))]
        assert got["detector", d, "test_tp"] == (y[test] & (s[test] >= got["detector", d, "threshold"])).sum()
    assert got["comparison", "good - weak", "difference"] == pytest.approx(got["detector", "good", "test_ap"] - got["detector", "weak", "test_ap"])
    assert got["comparison", "good - weak", "significant"] == 1 and got["generalisation", "good", "attacking_entities"] == len({i % 7 for i in np.flatnonzero(test & (y == 1))})


def test_baselines_are_judged_on_rows_they_never_saw(spark):
    rng = np.random.default_rng(7)
    n = 1_500
    y = (rng.random(n) < 0.1).astype(int)
    cols = {"is_new_pair": (rng.random(n) < 0.2 + 0.6 * y).astype(int), "user_unique_dst_5m": rng.poisson(1 + 3 * y), "failures_before_success_15m": rng.poisson(0.2 + y), "pair_rarity": rng.random(n), "destination_novelty": rng.random(n), "user_new_dst_ratio_1h": rng.random(n)}
    part = np.where(np.arange(n) < 900, "train", np.where(np.arange(n) < 1_200, "validation", "test"))
    rows = spark.createDataFrame([(i, str(part[i]), int(y[i]), *(float(c[i]) for c in cols.values())) for i in range(n)], "event_id long, partition string, label int, " + ", ".join(f"{c} double" for c in cols))
    got = {r.detector: r for r in studies.baseline_experiment(rows, list(cols), per_10k=500).collect()}
    assert set(got) == {"rule", "rarity", "logistic", "isolation_forest"}
    assert got["logistic"].test_ap > 0.7 and got["logistic"].test_ap > got["rarity"].test_ap
    assert sum(r.best for r in got.values()) == 1 and max(got.values(), key=lambda r: r.validation_ap).best == 1
    model = spark.createDataFrame([(int(y[i]), float(2 * cols["is_new_pair"][i] + 0.3 * min(cols["user_unique_dst_5m"][i], 10) + 0.5 * min(cols["failures_before_success_15m"][i], 5))) for i in range(n) if part[i] == "test"], "label int, score double")
    assert got["rule"].test_ap == pytest.approx(evaluation.average_precision(evaluation.block_table(model)).first()[0])


def test_baselines_count_a_row_once_where_ids_repeat(spark):
    """Scores stay on their rows instead of coming back by event_id, where rows of one id were multiplied."""
    rng = np.random.default_rng(3)
    n, columns = 400, ["is_new_pair", "user_unique_dst_5m", "failures_before_success_15m", "pair_rarity", "destination_novelty", "user_new_dst_ratio_1h"]
    part = ["train" if i < 200 else "validation" if i < 300 else "test" for i in range(n)]
    same = [i if i < 300 else 300 + (i - 300) // 2 for i in range(n)]
    rows = spark.createDataFrame([(same[i], part[i], int(i % 7 == 0), *(float(v) for v in rng.random(6))) for i in range(n)], "event_id long, partition string, label int, " + ", ".join(f"{c} double" for c in columns))
    got = {r.detector: r for r in studies.baseline_experiment(rows, columns, per_10k=500).collect()}
    want = evaluation.average_precision(evaluation.block_table(studies.score_rarity(rows.filter("partition = 'test'")))).first()[0]
    assert got["rarity"].test_ap == pytest.approx(want)


@pytest.mark.parametrize("name", sorted(incident_queries.ORACLE_SQL))
def test_incident_queries_equal_sql(spark, name):
    import duckdb

    from tests.test_registered import TABLES, _plain

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    names, rows = [c[0] for c in want.description], want.fetchall()
    got = registry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names) and rows
    assert _plain(map(tuple, got.select(*names).collect())) == _plain(rows)
