"""How sure a comparison or a calibration is: paired resampling of two detectors, reliability bins that survive ties.

Both work on block tables (events of one score, or of one pair of scores, counted once), never on single events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import average_precision, block_table, wilson
from .graph import cut_lineage
from .windows import global_position, running_totals


def joint_blocks(scores: DataFrame) -> DataFrame:
    """score_a, score_b, n_pos, n_neg of rows (score_a, score_b, label); rows that lack a score or a label don't count."""
    held = scores.filter(F.col("score_a").isNotNull() & F.col("score_b").isNotNull() & F.col("label").isNotNull())
    return held.groupBy("score_a", "score_b").agg(F.sum("label").cast("long").alias("n_pos"), F.sum(1 - F.col("label")).cast("long").alias("n_neg"))


def _draw(rng, count, weights):
    import numpy as np

    total = weights.sum()
    return rng.multinomial(count, weights / total) if total else np.zeros(len(weights), np.int64)


def resample(chunk_totals: list, own: list, chunk: int, seed: int, replicate: int) -> list:
    """The draws of one chunk of blocks in one replicate, for positives and negatives.

    First all chunks share the class's total by their sums, then the chunk's blocks share its part. Every task that knows
    the chunks' sums draws the same numbers.
    """
    import numpy as np

    over, inside = np.random.default_rng([seed, replicate]), np.random.default_rng([seed, replicate, chunk + 1])
    counts = [_draw(over, t.sum(), t) for t in chunk_totals]
    return [_draw(inside, c[chunk], w) for c, w in zip(counts, own)]


def paired_comparison(scores: DataFrame, n: int = 2_000, seed: int = 1729, chunk: int = 20_000, together: int = 50) -> DataFrame:
    """difference, low, high, fraction_a_wins, significant, replicates: average precision of detector a less that of b.

    scores: score_a, score_b, label. Every replicate draws one stratified resample of the events (a multinomial over the joint
    blocks, class by class) and rates both detectors on it, so what they share cancels. Tasks draw `together` replicates of a chunk of joint
    blocks; their draws go to the chunks of each detector's own order, where ties are summed and precision is taken
    with the counts that stand above the chunk. No task holds the block table, the driver sees sums of chunks.
    """
    import numpy as np

    spark = scores.sparkSession
    blocks = cut_lineage(joint_blocks(scores), "joint")
    places = [global_position(blocks.select((-F.col(c)).alias("_down"), c).distinct(), ["_down"], f"at_{c[-1]}").select(c, f"at_{c[-1]}") for c in ("score_a", "score_b")]
    rows = global_position(blocks.join(places[0], "score_a").join(places[1], "score_b"), ["at_a", "at_b"])
    rows = cut_lineage(rows.withColumn("chunk", F.floor(F.col("position") / chunk)).select("chunk", "position", "at_a", "at_b", "n_pos", "n_neg"), "placed")
    sums = sorted(rows.groupBy("chunk").agg(F.sum("n_pos").alias("p"), F.sum("n_neg").alias("q")).collect())
    totals = [np.array([r[c] for r in sums], dtype=np.int64) for c in ("p", "q")]
    schema = "difference double, low double, high double, fraction_a_wins double, significant boolean, replicates long"
    if not sums or not totals[0].sum():
        return spark.createDataFrame([(None, None, None, None, None, 0)], schema)
    n_pos = int(totals[0].sum())
    # a draw is at most its class's total; the narrow kind halves what tasks hold and send
    kinds = [np.int32 if t.sum() < 1 << 31 else np.int64 for t in totals]

    def drawn(frame):
        import pandas as pd

        frame = frame.sort_values("position")
        k, batch = int(frame["chunk"].iloc[0]), int(frame["batch"].iloc[0])
        own = [frame[c].to_numpy() for c in ("n_pos", "n_neg")]
        replicates = range(batch * together, min(n, (batch + 1) * together))
        p, q = (np.empty((len(replicates), len(frame)), kind) for kind in kinds)
        for i, r in enumerate(replicates):
            p[i], q[i] = resample(totals, own, k, seed, r)
        out = []
        for detector, name in enumerate(("at_a", "at_b")):
            at = frame[name].to_numpy()
            order = np.argsort(at, kind="stable")
            level, first = np.unique(at[order], return_index=True)
            by_level = [np.add.reduceat(x[:, order], first, axis=1, dtype=x.dtype) for x in (p, q)]
            for part in np.unique(level // chunk):
                own_levels = level // chunk == part
                x, y = (m[:, own_levels] for m in by_level)
                out.append((detector, int(part), batch, level[own_levels].tobytes(), x.tobytes(), y.tobytes(), x.sum(1).tolist(), y.sum(1).tolist()))
        return pd.DataFrame(out, columns=["detector", "part", "batch", "level", "p", "q", "sum_p", "sum_q"])

    batches = F.explode(F.sequence(F.lit(0), F.lit((n - 1) // together)))
    parts = rows.withColumn("batch", batches).groupBy("chunk", "batch").applyInPandas(drawn, "detector int, part long, batch int, level binary, p binary, q binary, sum_p array<long>, sum_q array<long>")
    parts = cut_lineage(parts, "drawn")
    each = parts.select("detector", "part", "batch", F.posexplode(F.arrays_zip("sum_p", "sum_q")).alias("at", "s")).groupBy("detector", "part", "batch", "at").agg(F.sum("s.sum_p").alias("p"), F.sum("s.sum_q").alias("q"))
    above = Window.partitionBy("detector", "batch", "at").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumns({c: F.coalesce(F.sum(c).over(above), F.lit(0)) for c in ("p", "q")})
    before = each.groupBy("detector", "part", "batch").agg(F.array_sort(F.collect_list(F.struct("at", "p", "q"))).alias("before"))

    def rated(key, frame):
        import pandas as pd

        detector, _, batch = key
        before = frame["before"].iloc[0]
        levels = [np.frombuffer(x, np.int64) for x in frame["level"]]
        level, size = np.unique(np.concatenate(levels)), len(before)
        summed = []
        for c, kind in zip(("p", "q"), kinds):
            out = np.zeros((size, len(level)), kind)
            for own, x in zip(levels, frame[c]):  # a chunk holds a level once
                out[:, np.searchsorted(level, own)] += np.frombuffer(x, kind).reshape(size, -1)
            summed.append(out)
        value = np.empty(size)
        for i, (p, q) in enumerate(zip(*summed)):  # one replicate's running counts at a time
            cp, cq = (b + x.cumsum(dtype=np.int64) for b, x in ((before[i]["p"], p), (before[i]["q"], q)))
            value[i] = (p * cp / np.maximum(1, cp + cq)).sum() / n_pos
        return pd.DataFrame({"detector": detector, "replicate": batch * together + np.arange(size), "value": value})

    values = parts.join(before, ["detector", "part", "batch"]).groupBy("detector", "part", "batch").applyInPandas(rated, "detector int, replicate long, value double")
    sign = F.when(F.col("detector") == 0, F.col("value")).otherwise(-F.col("value"))
    found = values.groupBy("replicate").agg(F.sum(sign).alias("d"))
    found = found.agg(F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"), F.avg((F.col("d") > 0).cast("double")).alias("fraction_a_wins"), F.count("*").alias("replicates"))
    held = scores.filter(F.col("score_a").isNotNull() & F.col("score_b").isNotNull())
    point = [average_precision(block_table(held.select(F.col(c).alias("score"), "label"))).withColumnRenamed("average_precision", c) for c in ("score_a", "score_b")]
    one = point[0].join(F.broadcast(point[1])).select((F.col("score_a") - F.col("score_b")).alias("difference"))
    return one.join(F.broadcast(found)).select("difference", "low", "high", "fraction_a_wins", ((F.col("low") > 0) | (F.col("high") < 0)).alias("significant"), "replicates")


def equal_frequency_edges(scores: DataFrame, bins: int = 10) -> list[float]:
    """Edges of at most `bins` intervals of about equally many events; the last one lies just above the greatest score.

    Interpolated quantiles first; where ties make quantiles coincide, the fullest interval that holds a further score is split at the
    score that halves it best, until there are enough intervals or none can be split. The counts come from running totals over
    distinct scores, so the driver sees an edge or two at a time.
    """
    import math

    blocks = scores.filter(F.col("score").isNotNull()).groupBy("score").agg(F.count("*").alias("n"))
    steps = cut_lineage(running_totals(blocks, "score", ["n"]).select("score", "n", (F.col("cum_n") - F.col("n")).alias("below")), "steps")
    total = steps.agg(F.sum("n"), F.min("score"), F.max("score")).first()
    n, least, most = total
    if not n:
        return []
    wanted = [(n - 1) * i / bins for i in range(bins + 1)]
    ranks = sorted({r for w in wanted for r in (math.floor(w), math.ceil(w))})
    spark = scores.sparkSession
    asked = F.broadcast(spark.createDataFrame([(r,) for r in ranks], "rank long"))
    at = {r.rank: r.score for r in steps.join(asked, (F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("n"))).select("rank", "score").collect()}
    edges = sorted({at[math.floor(w)] + (at[math.ceil(w)] - at[math.floor(w)]) * (w - math.floor(w)) for w in wanted})
    if len(edges) < 2:
        return [least, math.nextafter(most, math.inf)]
    while len(edges) - 1 < bins:
        spans = F.broadcast(spark.createDataFrame(list(zip(edges[:-1], edges[1:])), "lo double, hi double"))
        held = steps.join(spans, (F.col("score") >= F.col("lo")) & (F.col("score") < F.col("hi")))
        ends = held.groupBy("lo", "hi").agg(F.min("below").alias("start"), F.max(F.col("below") + F.col("n")).alias("stop"))
        inside = held.filter("score > lo").join(F.broadcast(ends), ["lo", "hi"])
        best = inside.groupBy("lo", "start", "stop").agg(F.min_by("score", F.struct(F.abs(2 * F.col("below") - F.col("start") - F.col("stop")), "score")).alias("cut"))
        widest = best.filter("stop - start >= 2").orderBy(F.desc(F.col("stop") - F.col("start")), "lo").first()
        if widest is None:
            break
        edges = sorted([*edges, widest.cut])
    return [*edges[:-1], math.nextafter(edges[-1], math.inf)]


def calibration_report(scores: DataFrame, bins: int = 10) -> tuple[DataFrame, DataFrame]:
    """(bins, summary) of rows (score, label).

    bins: bin, n, positives, mean_predicted, observed, low, high (95 % of observed), from_score, to_score; empty ones are left out.
    summary: expected and maximum calibration error, brier, reliability, resolution, uncertainty, prevalence, mean_prediction.
    """
    held = scores.filter(F.col("score").isNotNull() & F.col("label").isNotNull()).select(F.col("score").cast("double"), "label")
    edges = equal_frequency_edges(held, bins)
    spans = list(enumerate(zip(edges[:-1], edges[1:])))
    at = F.lit(0)
    for i, (lo, _) in spans[1:]:
        at = F.when(F.col("score") >= lo, i).otherwise(at)
    by = held.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("positives"), F.avg("score").alias("mean_predicted"), F.avg(F.col("label").cast("double")).alias("observed"))
    low, high = wilson(F.col("positives").cast("double"), F.col("n").cast("double"))
    span = scores.sparkSession.createDataFrame([(i, lo, hi) for i, (lo, hi) in spans], "bin int, from_score double, to_score double")
    table = by.withColumns({"low": F.greatest(F.lit(0.0), low), "high": F.least(F.lit(1.0), high)}).join(F.broadcast(span), "bin")
    table = table.select("bin", "n", "positives", "mean_predicted", "observed", "low", "high", "from_score", "to_score")
    whole = held.agg(F.count("*").alias("total"), F.avg(F.col("label").cast("double")).alias("prevalence"), F.avg("score").alias("mean_prediction"), F.avg((F.col("score") - F.col("label")) * (F.col("score") - F.col("label"))).alias("brier"))
    share, gap = F.col("n") / F.col("total"), F.abs(F.col("observed") - F.col("mean_predicted"))
    parts = table.join(F.broadcast(whole)).groupBy("prevalence", "mean_prediction", "brier").agg(F.sum(share * gap).alias("expected_error"), F.max(gap).alias("maximum_error"), F.sum(share * gap * gap).alias("reliability"), F.sum(share * F.pow(F.col("observed") - F.col("prevalence"), 2)).alias("resolution"))
    return table, parts.withColumn("uncertainty", F.col("prevalence") * (1 - F.col("prevalence"))).select("expected_error", "maximum_error", "brier", "reliability", "resolution", "uncertainty", "prevalence", "mean_prediction")


def contamination(scores: DataFrame, entity: str, k: int = 10, credible: int = 20) -> tuple[DataFrame, DataFrame]:
    """(holdouts, summary): how much of the average precision hangs on single attacking entities.

    holdouts: held_out, attacks_removed, attacks_remaining, events_remaining, base_rate, average_precision without it, share_of_metric (what
    of the full value is lost), credible (attacks enough remain); for the k entities with most attacks, ties to the smaller one.
    An entity without which no attack is left has no row: then total_capture says so. summary: average_precision,
    attacking_entities, dominant, dominant_share, total_capture, contaminated (half of the metric or more is lost with one).
    Block tables less the entity's own counts are ranked in one global order over (entity, score).
    """
    rows = scores.filter(F.col("score").isNotNull() & F.col("label").isNotNull())
    held = cut_lineage(rows.groupBy(F.col(entity).alias("entity"), "score").agg(F.sum("label").cast("long").alias("p"), F.count("*").alias("n")), "held")
    blocks = cut_lineage(held.groupBy("score").agg(F.sum("p").alias("p"), F.sum("n").alias("n")), "blocks")
    by_entity = held.groupBy("entity").agg(F.sum("p").alias("attacks"), F.sum("n").alias("events")).filter("attacks > 0")
    top = cut_lineage(by_entity.orderBy(F.desc("attacks"), "entity").limit(k), "top")  # k rows
    own = held.join(F.broadcast(top.select("entity")), "entity").select(F.col("entity").alias("held_out"), "score", F.col("p").alias("own_p"), F.col("n").alias("own_n"))
    every = blocks.join(F.broadcast(top.select(F.col("entity").alias("held_out"), "attacks", "events"))).join(own, ["held_out", "score"], "left").fillna(0, ["own_p", "own_n"])
    left = every.select("held_out", "attacks", "events", (-F.col("score")).alias("down"), (F.col("p") - F.col("own_p")).alias("p"), (F.col("n") - F.col("own_n")).alias("n"))
    steps = cut_lineage(running_totals(global_position(left, ["held_out", "down"], "at"), "at", ["p", "n"]), "steps")
    first = steps.groupBy("held_out").agg(F.min(F.col("cum_p") - F.col("p")).alias("p0"), F.min(F.col("cum_n") - F.col("n")).alias("n0"))
    part = F.when(F.col("p") > 0, F.col("p") * (F.col("cum_p") - F.col("p0")) / (F.col("cum_n") - F.col("n0"))).otherwise(0.0)
    without = steps.join(F.broadcast(first), "held_out").groupBy("held_out", "attacks").agg(F.sum("p").alias("attacks_remaining"), F.sum("n").alias("events_remaining"), F.sum(part).alias("credit"))
    full = average_precision(blocks.select("score", F.col("p").alias("n_pos"), (F.col("n") - F.col("p")).alias("n_neg"))).withColumnRenamed("average_precision", "full")
    value = F.col("credit") / F.col("attacks_remaining")
    holdouts = without.filter("attacks_remaining > 0").join(F.broadcast(full)).select(
        "held_out",
        F.col("attacks").alias("attacks_removed"),
        "attacks_remaining",
        "events_remaining",
        (F.col("attacks_remaining") / F.col("events_remaining")).alias("base_rate"),
        value.alias("average_precision"),
        F.when(F.col("full") > 0, 1 - value / F.col("full")).otherwise(0.0).alias("share_of_metric"),
        (F.col("attacks_remaining") >= credible).alias("credible"),
    )
    most = F.max_by(F.struct("entity", "attacks"), F.struct("attacks", -F.col("entity")))
    total = by_entity.agg(F.count("*").alias("attacking_entities"), F.sum("attacks").alias("all_attacks"), most.alias("most"))
    worst = holdouts.agg(F.coalesce(F.max("share_of_metric"), F.lit(0.0)).alias("worst"))
    capture = F.col("attacking_entities") == 1
    summary = full.join(F.broadcast(total)).join(F.broadcast(worst)).select(F.col("full").alias("average_precision"), "attacking_entities", F.col("most.entity").alias("dominant"), (F.col("most.attacks") / F.col("all_attacks")).alias("dominant_share"), capture.alias("total_capture"), (capture | (F.col("worst") >= 0.5)).alias("contaminated"))
    return holdouts, summary


def bootstrap_positives(scores: DataFrame, n: int = 1_000, seed: int = 1729, chunk: int = 20_000, together: int = 50) -> DataFrame:
    """auc_low, auc_high, ap_low, ap_high, replicates: 95 % intervals over resamples of the positives; the benign rows stay as they are.

    A positive counts by the benign rows above it and level with it, so a resample is a multinomial over the scores that have
    positives, drawn in two steps as in `resample`, and no benign row is read again.
    """
    import numpy as np

    spark = scores.sparkSession
    blocks = running_totals(block_table(scores), "score", ["n_neg"], descending=True)
    rows = cut_lineage(blocks.filter("n_pos > 0").select((-F.col("score")).alias("down"), "n_pos", "n_neg", F.col("cum_n_neg").alias("upto")), "positives")
    benign = scores.agg(F.sum(1 - F.col("label"))).first()[0] or 0
    rows = cut_lineage(global_position(rows, ["down"]).withColumn("chunk", F.floor(F.col("position") / chunk)), "placed")
    sums = sorted(rows.groupBy("chunk").agg(F.sum("n_pos").alias("p")).collect())
    totals = np.array([r.p for r in sums], np.int64)
    if not len(totals) or not benign:
        return spark.createDataFrame([(None, None, None, None, 0)], "auc_low double, auc_high double, ap_low double, ap_high double, replicates long")
    n_pos = int(totals.sum())

    def part(frame):
        import pandas as pd

        frame = frame.sort_values("position")
        k, batch = int(frame["chunk"].iloc[0]), int(frame["batch"].iloc[0])
        w, level, upto = (frame[c].to_numpy() for c in ("n_pos", "n_neg", "upto"))
        above = upto - level
        out = []
        for r in range(batch * together, min(n, (batch + 1) * together)):
            counts = _draw(np.random.default_rng([seed, r]), n_pos, totals)
            p = _draw(np.random.default_rng([seed, r, k + 1]), counts[k], w)
            hits = counts[:k].sum() + p.cumsum()
            out.append((r, float((p * (benign - above - 0.5 * level)).sum() / benign / n_pos), float((p * hits / np.maximum(1, hits + upto)).sum() / n_pos)))
        return pd.DataFrame(out, columns=["replicate", "auc", "ap"])

    parts = rows.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // together)))).groupBy("chunk", "batch").applyInPandas(part, "replicate long, auc double, ap double")
    each = parts.groupBy("replicate").agg(F.sum("auc").alias("auc"), F.sum("ap").alias("ap"))
    return each.agg(F.percentile("auc", 0.025).alias("auc_low"), F.percentile("auc", 0.975).alias("auc_high"), F.percentile("ap", 0.025).alias("ap_low"), F.percentile("ap", 0.975).alias("ap_high"), F.count("*").alias("replicates"))


def evaluation_report(rows: DataFrame, detectors: list[str], entity: str, per_10k: float = 25.0, resamples: int = 2_000, seed: int = 1729, recall_at: tuple[int, ...] = (100, 1_000)) -> DataFrame:
    """section, detector, metric, value: everything that is said of several detectors on one labelled stream.

    rows: partition (train, validation, test), label, the entity and a score for each detector. Sections: `partition` (events, attacks,
    prevalence of each), `detector` (threshold chosen on validation, validation_ap, test_ap with its interval, test_roc_auc,
    recall at fixed depths, the operating point on test), `comparison` (each pair on the same resamples: difference, interval,
    share won, significant), `generalisation` (of the detector with the best test_ap: entities with attacks only in training,
    and the holdouts' summary). Each metric is one job over a block table or the rows; the report itself is a few dozen numbers.
    """
    from . import evaluation

    spark = rows.sparkSession
    rows = cut_lineage(rows.select("partition", "label", F.col(entity).alias("entity"), *detectors), "report")
    out: list[tuple[str, str, str, float | None]] = []

    def say(section, detector, **values):
        out.extend((section, detector, k, None if v is None else float(v)) for k, v in values.items())

    for r in sorted(rows.groupBy("partition").agg(F.count("*").alias("events"), F.sum("label").alias("attacks"), F.avg("label").alias("prevalence")).collect()):
        say("partition", r.partition, events=r.events, attacks=r.attacks, prevalence=r.prevalence)
    test_ap = {}
    for d in detectors:
        part = {p: rows.filter(F.col("partition") == p).select(F.col(d).alias("score"), "label") for p in ("validation", "test")}
        blocks = {p: cut_lineage(block_table(x), "blocks") for p, x in part.items()}
        threshold = evaluation.threshold_at_budget(part["validation"], per_10k).first()[0]
        interval = evaluation.bootstrap(blocks["test"], resamples, seed).first()
        test_ap[d] = average_precision(blocks["test"]).first()[0]
        say("detector", d, threshold=threshold, validation_ap=average_precision(blocks["validation"]).first()[0], test_ap=test_ap[d], test_ap_low=interval.low, test_ap_high=interval.high, test_roc_auc=evaluation.roc_auc(blocks["test"]).first()[0])
        say("detector", d, **{f"test_recall_at_{k}": evaluation.at_k(part["test"], k).first().recall for k in recall_at})
        if threshold is not None:
            say("detector", d, **{f"test_{k}": v for k, v in evaluation.operating_point(part["test"], threshold).first().asDict().items()})
    test = rows.filter("partition = 'test'")
    for i, a in enumerate(detectors):
        for b in detectors[i + 1 :]:
            r = paired_comparison(test.select(F.col(a).alias("score_a"), F.col(b).alias("score_b"), "label"), resamples, seed).first()
            say("comparison", f"{a} - {b}", difference=r.difference, low=r.low, high=r.high, fraction_a_wins=r.fraction_a_wins, significant=r.significant)
    best = max(detectors, key=lambda d: (test_ap[d] if test_ap[d] is not None else -1.0))
    only = evaluation.attack_only(rows.filter("partition = 'train'"), "entity").count()
    r = contamination(test.select(F.col(best).alias("score"), "label", "entity"), "entity")[1].first()
    say("generalisation", best, attack_only_entities_in_train=only, attacking_entities=r.attacking_entities, dominant_share=r.dominant_share, total_capture=r.total_capture, contaminated=r.contaminated)
    return spark.createDataFrame(out, "section string, detector string, metric string, value double")
