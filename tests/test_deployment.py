"""Models that read no label, detectors and their combinations, the attacker left out, chains of hops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loginloom.operators import deployment, features, graph, reports, studies
from loginloom.plans import study_queries
from loginloom.plans.fixtures import auth_dense, auth_sparse

SF = "/root/testdata/sf0.01"


def auc(labels, scores):
    order = np.argsort(scores, kind="stable")
    s, y = np.asarray(scores)[order], np.asarray(labels)[order]
    _, inverse, counts = np.unique(s, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    p = y.sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


def test_plausibility_tells_counterfactuals_on_later_days(spark):
    """Accounts keep to hosts of their own, so an end that is swapped is implausible; the model sees the first days only."""
    rnd = random.Random(1)
    rows = []
    for i in range(9_000):
        usr = rnd.randint(0, 29)
        rows.append((i, i * 60, usr, 100 + usr % 10, 200 + usr * 3 + rnd.randint(0, 2), rnd.randint(0, 1), int(rnd.random() < 0.95)))
    e = spark.createDataFrame(rows, "event_id long, t long, usr long, src long, dst long, logon_id int, success int")
    examples = deployment.plausibility_examples(e, features.ALL, share=0.3).cache()
    n = {r.label: r["count"] for r in examples.groupBy("label").count().collect()}
    assert n[0] >= 4.5 * n[1] and n[1] > 2_000
    cut = 300_000
    model = deployment.fit_plausibility(examples.filter(F.col("t") < cut), features.ALL)
    held = deployment.anomaly(model, examples.filter(F.col("t") >= cut)).select("label", "anomaly").collect()
    assert auc([1 - r.label for r in held], [r.anomaly for r in held]) > 0.9
    real = features.causal_features(e).collect()
    mine = {r.event_id: r for r in examples.filter("label = 1").collect()}
    by_id = {r.event_id: r for r in real}
    for k in list(mine)[:200]:
        assert all(mine[k][c] == pytest.approx(by_id[k][c]) for c in features.ALL)  # counterfactuals left no trace


def test_plausibility_makes_its_features_once(spark, monkeypatch):
    """One pass gives the features of all events and probes; a fit and the scores read them again and don't make them."""
    made, whole = [], features.with_features
    monkeypatch.setattr(features, "with_features", lambda *a, **b: made.append(1) or whole(*a, **b))
    scored = study_queries.h11(spark, "/root/testdata/sf0.001")
    assert len(made) == 1 and "Window" not in scored._jdf.queryExecution().optimizedPlan().toString()
    e = auth_dense(spark, "/root/testdata/sf0.001")
    assert sorted(r.event_id for r in scored.collect()) == sorted(r.event_id for r in e.select("event_id").collect())
    examples = deployment.plausibility_examples(e, features.ALL, share=0.1)
    assert "Window" not in examples._jdf.queryExecution().optimizedPlan().toString()


def test_plausibility_takes_real_examples_from_the_events(spark):
    """Features of all events are those without probes; examples are the picked events and their probes, however the events arrive."""
    e = auth_dense(spark, "/root/testdata/sf0.001")
    real, examples = deployment.plausibility_rows(e, features.ALL, share=0.1)
    want = {r.event_id: r for r in features.causal_features(e).select("event_id", "t", *features.ALL).collect()}
    assert {r.event_id: r for r in real.collect()} == want
    probes = {r.event_id: r.real_id for r in features.counterfactuals(e, share=0.1).collect()}
    got = examples.collect()
    assert sorted(r.event_id for r in got if r.label == 0) == sorted(probes)
    own = {r.event_id: r for r in got if r.label == 1}
    assert set(own) == set(probes.values()) and len(own) + len(probes) == len(got)
    assert all(tuple(r[c] for c in want[k].__fields__) == tuple(want[k]) for k, r in own.items())
    again = deployment.plausibility_examples(e.orderBy(F.desc("event_id")), features.ALL, share=0.1)
    assert again.collect() == got
    lone = spark.createDataFrame([(1, 5, 0, 3, 4, 0, 1)], "event_id long, t long, usr long, src long, dst long, logon_id int, success int")
    real, examples = deployment.plausibility_rows(lone, features.ALL, share=1.0)  # no third host, so no probe and no example
    assert real.count() == 1 and examples.collect() == []


def test_probes_see_history_as_a_real_event_would(spark):
    """A probe's 24 features are those of the same row put into the stream alone."""
    e = auth_dense(spark, "/root/testdata/sf0.001").drop("auth_name", "orient_name")
    picked = e.orderBy(F.xxhash64("event_id")).limit(6).collect()
    probes = spark.createDataFrame([(-1 - r.event_id, r.t, r.usr, r.src, (r.dst + 1) % 97, r.logon_id, r.success, 0) for r in picked], e.schema)
    got = {r.event_id: r for r in features.featurise_probes(e, probes).collect()}
    assert len(got) == 6
    for p in probes.collect():
        alone = features.causal_features(e.union(spark.createDataFrame([p], e.schema))).filter(F.col("event_id") == p.event_id).first()
        for c in features.ALL:
            assert got[p.event_id][c] == pytest.approx(alone[c], abs=1e-9), c


def test_a_profile_runs_its_forest_once_over_the_rows(spark, tmp_path):
    """Percentiles read their rows several times; the forest's answers are kept, and rows aren't joined with themselves for the rarity."""
    x = study_queries.deployed(spark, "/root/testdata/sf0.001")
    path = str(tmp_path / "profile")
    deployment.onboard(x, study_queries.PROFILED, path)
    plan = deployment.score_with_profile(x, study_queries.PROFILED, path)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan
    scaled = deployment._scaled(x, spark.read.parquet(f"{path}/scaler"), study_queries.PROFILED)
    assert "Join" not in scaled._jdf.queryExecution().optimizedPlan().toString()


def test_profile_scores_like_the_rows_it_came_from(spark, tmp_path):
    x = study_queries.deployed(spark, "/root/testdata/sf0.001").cache()
    path = str(tmp_path / "profile")
    deployment.onboard(x, study_queries.PROFILED, path, alert_budget=0.02, action_budget=0.002)
    got = {r.event_id: r for r in deployment.score_with_profile(x, study_queries.PROFILED, path).collect()}
    rarity = {r.event_id: r.score for r in studies.score_rarity(x).collect()}
    values = np.sort(list(rarity.values()))
    n = len(values)
    for k, r in got.items():
        assert r.p_rarity == pytest.approx(np.searchsorted(values, rarity[k], "right") / n)
    mean = {k: round((r.p_rarity + r.p_iforest) / 2, 9) for k, r in got.items()}
    means = np.sort(list(mean.values()))
    assert all(r.percentile == pytest.approx(np.searchsorted(means, mean[k], "right") / n) for k, r in got.items())
    assert all(r.alert == (r.percentile > 0.98) for r in got.values()) and len(got) == n
    manifest = spark.read.parquet(f"{path}/manifest").first()
    span = max(1.0, (x.agg(F.max("t")).first()[0] - x.agg(F.min("t")).first()[0]) / 86_400)
    assert manifest.events == n and manifest.alerts_per_day == pytest.approx(0.02 * n / span, abs=0.006)
    again = {r.event_id: r.percentile for r in deployment.score_with_profile(x.filter("event_id % 3 = 0"), study_queries.PROFILED, path).collect()}
    assert again == {k: got[k].percentile for k in again}  # a row's score doesn't depend on what it is scored with


def test_isolation_forest_finds_outliers(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (1_500, 3))
    x[:30] += 7
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "event_id long, a double, b double, c double")
    got = {r.event_id: r for r in studies.isolation_forest(rows, rows, ["a", "b", "c"], trees=40).collect()}
    assert auc([int(i < 30) for i in range(1_500)], [got[i].anomaly for i in range(1_500)]) > 0.97
    values = np.sort([round(got[i].anomaly, 9) for i in range(1_500)])
    assert all(got[i].percentile == pytest.approx(np.searchsorted(values, round(got[i].anomaly, 9), "right") / 1_500) for i in range(0, 1_500, 50))


@pytest.mark.parametrize("kind", ["logistic", "gbt"])
def test_classifiers_rank_held_out_attacks(spark, kind):
    rng = np.random.default_rng(3)
    y = (rng.random(3_000) < 0.06).astype(int)
    a, b = rng.normal(1.6 * y, 1), rng.normal(-1.2 * y, 1)
    rows = spark.createDataFrame([(i, int(y[i]), float(a[i]), float(b[i])) for i in range(3_000)], "event_id long, label int, a double, b double")
    from pyspark.ml.functions import vector_to_array

    model = studies.fit_classifier(rows.filter("event_id % 10 < 7"), ["a", "b"], kind)
    held = model.transform(rows.filter("event_id % 10 >= 7")).select("label", vector_to_array("probability")[1].alias("p")).collect()
    assert auc([r.label for r in held], [r.p for r in held]) > 0.88


def test_attacker_left_out_of_a_known_table(spark):
    """The score is the feature itself, so every rank is known; the model of a fold must not have seen its source."""
    rows = [(1, 0, 7, 1, 0.9), (2, 0, 7, 1, 0.4), (3, 0, 7, 0, 0.99), (4, 0, 8, 0, 0.5), (5, 0, 9, 0, 0.95), (6, 0, 9, 0, 0.4), (7, 1, 8, 1, 0.2), (8, 1, 7, 0, 0.1), (9, 1, 9, 0, 0.1), (10, 1, 8, 1, 0.2), (11, 2, 9, 0, 1.0)]
    x = spark.createDataFrame(rows, "event_id long, day long, src long, label int, f double")
    seen = []

    def fitted(train, columns):
        seen.append({r.src for r in train.select("src").distinct().collect()})
        return lambda part: part.withColumn("score", F.col("f"))

    got = {(r.src, r.day): (r.best_rank, r.attacks, r.average_precision) for r in deployment.leave_one_attacker_out(x, ["f"], least_attacks=1, fitted=fitted).collect()}
    assert seen == [{8, 9}, {7, 9}]
    # day 0: 0.9 has two rows above, 0.4 four; day 1: two tied ones on top
    assert got == {(7, 0): (3, 2, pytest.approx((1 / 3 + 2 / 5) / 2)), (8, 1): (1, 2, pytest.approx((1 + 2) / 2))}
    assert deployment.leave_one_attacker_out(x, ["f"], least_attacks=9, fitted=fitted).collect() == []
    s = deployment.summarize_folds(deployment.leave_one_attacker_out(x, ["f"], least_attacks=1, fitted=fitted), (1, 5)).first()
    assert (s.host_days, s.within_1, s.within_5, s.median_best_rank) == (2, 1, 2, 2.0)


def chain_by_hand(hops):
    """Hop after hop: the best chain into each node, replaced only by a longer one, or one as long and riskier."""
    best, layer = {}, {}
    for h in sorted(hops, key=lambda h: (h["t"], h["event_id"], h["hop"])):
        n, risk, way = best.get(h["actor"], (0, 0.0, []))
        layer.setdefault(h["actor"], 0)
        layer[h["target"]] = max(layer.get(h["target"], 0), layer[h["actor"]] + 1)
        new = (n + 1, risk + h["risk"], [*way, h["event_id"]])
        if h["target"] not in best or new[:2] > best[h["target"]][:2]:
            best[h["target"]] = new
    return layer, max(best.values(), key=lambda x: x[:2])


def test_primary_chains_equal_hop_by_hop(spark):
    rnd = random.Random(5)
    rows = []
    for inc in range(12):
        for i in range(rnd.randint(1, 45)):
            a, b = rnd.sample(range(7), 2)
            rows.append({"incident": f"i{inc}", "event_id": inc * 100 + i, "t": rnd.randint(0, 30), "hop": 1, "actor": f"h{a}", "target": f"h{b}", "risk": rnd.choice([0.5, 0.75, 1.0])})
    rows.append({"incident": "loop", "event_id": 5_000, "t": 1, "hop": 1, "actor": "x", "target": "x", "risk": 1.0})
    hops = spark.createDataFrame(rows)
    got, layers = {}, {}
    for r in sorted(graph.kill_chain_primary(hops).collect(), key=lambda r: r.place):
        got.setdefault(r.incident, []).append(r)
    for r in graph.kill_chain(hops).collect():
        layers.setdefault(r.incident, {})[r.node] = (r.layer, r.longest)
    for inc in {r["incident"] for r in rows}:
        layer, (n, risk, way) = chain_by_hand([r for r in rows if r["incident"] == inc])
        assert [r.event_id for r in got[inc]] == way and {(r.length, r.total) for r in got[inc]} == {(n, risk)}, inc
        assert [r.place for r in got[inc]] == list(range(1, n + 1))
        assert layers[inc] == {k: (v, n) for k, v in layer.items()}
    edges = graph.kill_chain_edges(hops).collect()
    assert len(edges) == len(rows) and {r.event_id for r in edges if r.primary} == {r.event_id for rs in got.values() for r in rs}
    assert graph.kill_chain_primary(hops.limit(0)).collect() == []


def test_claims_need_confidence_and_not_an_alert(spark):
    rows = [("T1021", "T1021", "high", 0), ("T1021", "T1110", "low", 1), (None, "T1021", "high", 0), (None, "T1021", "low", 1), ("T1110", "T1021", "medium", 1)]
    got = {r.technique: r for r in reports.technique_metrics(spark.createDataFrame(rows, "truth string, technique string, confidence string, alerted int")).collect()}
    r = got["T1021"]
    assert (r.injected, r.alerted, r.attributed, r.attributed_other, r.false_attributions) == (2, 1, 1, 0, 1)
    assert (r.detection_recall, r.attribution_recall, r.precision, r.false_per_10k) == (0.5, 0.5, 0.5, 5_000.0)
    r = got["T1110"]
    assert (r.injected, r.attributed, r.attributed_other, r.precision) == (1, 0, 1, 0.0)


def test_hot_account_needs_three_shuffles(spark):
    plan = features.causal_features(auth_sparse(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3


def test_shuffles_of_destinations_carry_no_account_features(spark):
    """The account's features are most of the columns and come last; novelty of a destination needs its own shuffle only."""
    e = auth_sparse(spark, "/root/testdata/sf0.001")
    shuffles = lambda names: [line for line in features.with_features(e, names)._jdf.queryExecution().sparkPlan().toString().split("\n") if "RepartitionByExpression" in line or "Exchange" in line]
    assert len(shuffles(["destination_novelty"])) == 1 and len(shuffles(["user_new_dst_ratio_1h"])) == 1
    last, *_, first = shuffles(features.ALL)
    assert "(usr#" in last and "(dst#" in first
