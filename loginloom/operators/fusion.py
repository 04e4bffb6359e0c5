"""Signals of an event, their fusion into a risk, floors by rules, alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHANNELS = ("tgn", "novelty", "burst", "pivot", "corroboration")
# Fixed values of the two fusions: the weights and the reliabilities of the channels, in their order.
LINEAR = (0.55, 0.20, 0.10, 0.10, 0.05)
NOISY_OR = (0.95, 0.05, 0.30, 0.05, 0.35)
#: Alert and action thresholds of the noisy-or risk.
ALERT, ACTION = 0.329195, 0.846394


def signals(rows: DataFrame) -> DataFrame:
    """rows with novelty, burst and pivot_signal, from features and chain_continues."""
    burst = 1 - F.exp(-(F.col("user_auth_rate_5m") + F.col("user_unique_dst_5m")) / 10.0)
    pivot = F.when(F.col("chain_continues") == 1, 1.0).otherwise(F.least(F.lit(1.0), F.col("src_host_unique_dst_1h") / 5.0))
    return rows.withColumns({"novelty": F.greatest(F.col("is_new_pair").cast("double"), F.col("destination_novelty")), "burst": burst, "pivot_signal": pivot})


def fallback_score() -> Column:
    """A model's place where there is none."""
    return F.least(F.lit(1.0), 0.40 * F.col("novelty") + 0.35 * F.col("burst") + 0.25 * F.col("pivot_signal"))


def fuse_linear(channels: list[Column], weights=LINEAR) -> Column:
    total = reduce(lambda a, b: a + b, (w * c for w, c in zip(weights, channels)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def fuse_noisy_or(channels: list[Column], reliability=NOISY_OR) -> Column:
    return 1 - reduce(lambda a, b: a * b, (1 - r * c for r, c in zip(reliability, channels)))


def contributions(channels: list[Column], operator: str = "noisy_or") -> list[Column]:
    """Each channel's part of the risk: its share of the sum, or what the risk loses without it."""
    if operator == "linear":
        return [w * c for w, c in zip(LINEAR, channels)]
    whole = fuse_noisy_or(channels)
    return [whole - fuse_noisy_or([F.lit(0.0) if j == i else c for j, c in enumerate(channels)]) for i in range(len(channels))]


def dominant(parts: dict[str, Column]) -> Column:
    """The name of the greatest part; the first of equal ones."""
    order = [F.struct(v.alias("v"), F.lit(-i).alias("i"), F.lit(n).alias("n")) for i, (n, v) in enumerate(parts.items())]
    return F.array_max(F.array(*order))["n"]


def apply_floor(rows: DataFrame, rule: str, floor: float, needs_alert: bool = False) -> DataFrame:
    """risk raised to `floor` where the rule fired, never lowered; rule_floor names the rule then."""
    raised = (F.col(rule) == 1) & (F.col("risk") < floor)
    if needs_alert:
        raised = raised & (F.col("risk") >= ALERT)
    return rows.withColumns({"rule_floor": F.when(raised, F.lit(rule)), "risk": F.when(raised, F.lit(floor)).otherwise(F.col("risk"))})


def alerts(scored: DataFrame, threshold: float = ALERT) -> DataFrame:
    return scored.filter(F.col("risk") >= threshold)


def risk_intelligence(channels: dict[str, Column], support: Column) -> dict[str, Column]:
    """confidence (agreement of the channels and their support), level, and the three greatest channels of 0.5 or more."""
    values = list(channels.values())
    n = float(len(values))
    mean = reduce(lambda a, b: a + b, values) / n
    spread = F.sqrt(reduce(lambda a, b: a + b, ((v - mean) * (v - mean) for v in values)) / n)
    agreement = F.greatest(F.lit(0.0), 1 - 2 * spread)
    backing = F.least(F.lit(1.0), support / 3.0)
    top = F.slice(F.sort_array(F.filter(F.array(*[F.struct((-v).alias("v"), F.lit(k).alias("n")) for k, v in channels.items()]), lambda x: x["v"] <= -0.5)), 1, 3)
    return {"agreement": agreement, "confidence": 0.6 * agreement + 0.4 * backing, "top_channels": F.array_join(F.transform(top, lambda x: x["n"]), ",")}


def scored_events(featured: DataFrame) -> DataFrame:
    """The model-free scored table: signals, score, risk, and what paths and alerts need.

    featured: events with causal features and chain flags.
    """
    rows = signals(featured)
    rows = rows.withColumn("model", fallback_score())
    support = ((F.col("novelty") >= 0.5).cast("int") + (F.col("burst") >= 0.5).cast("int") + (F.col("pivot_signal") >= 0.5).cast("int")).cast("long")
    rows = rows.withColumn("support", support).withColumn("corroboration", F.least(F.lit(1.0), F.col("support") / 3.0))
    channels = [F.col(c) for c in ("model", "novelty", "burst", "pivot_signal", "corroboration")]
    return rows.withColumns({"risk": fuse_noisy_or(channels), "risk_linear": fuse_linear(channels)})
