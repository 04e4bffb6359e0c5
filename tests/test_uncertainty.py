"""Paired resampling and calibration against numpy on the same draws and on the same rule."""

import numpy as np
import pytest

from loginloom.operators import uncertainty


def precision(labels, scores):
    """Average precision with ties credited at the end of their block."""
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    ends = np.append(np.flatnonzero(np.diff(s)), len(s) - 1)
    tp, n = y.cumsum()[ends], ends + 1
    return (np.diff(tp, prepend=0) * tp / n).sum() / y.sum()


def table(seed, n, levels):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.12).astype(int)
    a = np.round(np.clip(rng.normal(0.4 + 0.25 * y, 0.2, n), 0, 1) * levels) / levels
    b = np.round(np.clip(rng.normal(0.4 + 0.10 * y, 0.2, n), 0, 1) * levels) / levels
    return a, b, y


@pytest.mark.parametrize("chunk", [5, 40, 20_000])
def test_paired_comparison_equals_numpy_on_the_same_draws(spark, chunk):
    a, b, y = table(1, 400, 12)
    rows = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), y.tolist())), "score_a double, score_b double, label int")
    blocks = sorted({(-x, -z) for x, z in zip(a, b)})
    n_pos = np.array([sum(y[(a == -x) & (b == -z)]) for x, z in blocks])
    n_neg = np.array([sum(1 - y[(a == -x) & (b == -z)]) for x, z in blocks])
    cuts = [slice(i, i + chunk) for i in range(0, len(blocks), chunk)]
    totals = [np.array([w[c].sum() for c in cuts], np.int64) for w in (n_pos, n_neg)]
    differences = []
    for r in range(120):
        parts = [uncertainty.resample(totals, [n_pos[c], n_neg[c]], k, 9, r) for k, c in enumerate(cuts)]
        p, q = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
        assert (p.sum(), q.sum()) == (n_pos.sum(), n_neg.sum())
        labels = np.repeat(np.tile([1, 0], len(blocks)), np.stack([p, q], 1).reshape(-1))
        values = [np.repeat(np.repeat([-x[i] for x in blocks], 2), np.stack([p, q], 1).reshape(-1)) for i in (0, 1)]
        differences.append(precision(labels, values[0]) - precision(labels, values[1]))
    d = np.array(differences)
    got = uncertainty.paired_comparison(rows, n=120, seed=9, chunk=chunk, together=50).first()
    want = (precision(y, a) - precision(y, b), *np.percentile(d, [2.5, 97.5]), (d > 0).mean())
    assert tuple(got)[:4] == pytest.approx(want, abs=1e-12) and got.replicates == 120
    assert got.significant == (want[1] > 0 or want[2] < 0) and got.significant


def test_paired_comparison_of_equals_and_of_nothing(spark):
    schema = "score_a double, score_b double, label int"
    a, b, y = table(2, 300, 20)
    same = uncertainty.paired_comparison(spark.createDataFrame(list(zip(a.tolist(), a.tolist(), y.tolist())), schema), n=60).first()
    assert tuple(same)[:5] == (0.0, 0.0, 0.0, 0.0, False)
    for rows in ([], [(0.5, 0.4, 0)], [(None, 0.4, 1), (0.3, None, 1)]):
        got = uncertainty.paired_comparison(spark.createDataFrame(rows, schema), n=10).first()
        assert got.replicates == 0 and got.difference is None


def edges_by_rule(scores, bins):
    """Quantiles first; then the fullest interval that can be is split at the value that halves it best."""
    edges = sorted(set(np.quantile(scores, np.linspace(0, 1, bins + 1)).tolist()))
    if len(edges) < 2:
        return [scores.min(), np.nextafter(scores.max(), np.inf)]
    while len(edges) - 1 < bins:
        options = []
        for lo, hi in zip(edges, edges[1:]):
            held = np.sort(scores[(scores >= lo) & (scores < hi)])
            inner = np.unique(held[held > lo])
            if len(held) >= 2 and len(inner):
                left = np.array([(held < v).sum() for v in inner])
                options.append((len(held), lo, inner[np.argmin(np.abs(left - (len(held) - left)))]))
        if not options:
            break
        most = max(o[0] for o in options)
        edges = sorted([*edges, next(o[2] for o in options if o[0] == most)])
    return [*edges[:-1], np.nextafter(edges[-1], np.inf)]


@pytest.mark.parametrize("kind", ["spread", "ties", "one value", "two values"])
def test_calibration_survives_ties(spark, kind):
    rng = np.random.default_rng(5)
    n = 700
    y = (rng.random(n) < 0.1).astype(int)
    s = {"spread": rng.random(n), "ties": np.where(rng.random(n) < 0.93, 0.0, np.round(rng.random(n), 2)), "one value": np.full(n, 0.25), "two values": np.where(rng.random(n) < 0.9, 0.1, 0.9)}[kind]
    rows = spark.createDataFrame(list(zip(s.tolist(), y.tolist())), "score double, label int")
    edges = edges_by_rule(s, 10)
    assert uncertainty.equal_frequency_edges(rows, 10) == pytest.approx(edges, abs=1e-12)
    at = np.clip(np.digitize(s, edges) - 1, 0, len(edges) - 2)
    table, summary = uncertainty.calibration_report(rows, 10)
    table = sorted(table.collect())
    assert [r.bin for r in table] == sorted(set(at.tolist()))
    gaps = []
    for r in table:
        own = at == r.bin
        assert (r.n, r.positives) == (own.sum(), y[own].sum()) and r.mean_predicted == pytest.approx(s[own].mean()) and r.low <= r.observed <= r.high
        gaps.append((own.mean(), abs(y[own].mean() - s[own].mean()), y[own].mean()))
    got = summary.first()
    assert got.expected_error == pytest.approx(sum(w * g for w, g, _ in gaps)) and got.maximum_error == pytest.approx(max(g for _, g, _ in gaps))
    assert got.reliability == pytest.approx(sum(w * g * g for w, g, _ in gaps)) and got.resolution == pytest.approx(sum(w * (o - y.mean()) ** 2 for w, _, o in gaps))
    assert got.brier == pytest.approx(((s - y) ** 2).mean()) and got.uncertainty == pytest.approx(y.mean() * (1 - y.mean()))
    if kind == "ties":
        assert len(table) > 8  # though nine of ten quantiles coincide


def test_draws_of_a_comparison_are_sent_in_four_bytes(spark, monkeypatch):
    """Chunks of few blocks, so that a level of one detector comes from several; a draw takes four bytes on its way."""
    rng, kept, cut = np.random.default_rng(11), {}, uncertainty.cut_lineage
    monkeypatch.setattr(uncertainty, "cut_lineage", lambda df, name: kept.update({name: cut(df, name)}) or kept[name])
    rows = [(float(rng.integers(0, 40)), float(rng.integers(0, 6)), int(rng.random() < 0.2)) for _ in range(600)]
    scores = spark.createDataFrame(rows, "score_a double, score_b double, label int")
    one, many = (uncertainty.paired_comparison(scores, n=60, chunk=c, together=20).first() for c in (20_000, 30))
    assert one.replicates == many.replicates == 60 and one.difference == pytest.approx(many.difference)
    assert abs(one.low - many.low) < 0.05 and abs(one.high - many.high) < 0.05
    parts = kept["drawn"].selectExpr("length(level) / 8 AS levels", "length(p) AS p", "length(q) AS q").collect()
    assert len(parts) > 6 and all(r.p == r.q == 4 * 20 * r.levels for r in parts)
