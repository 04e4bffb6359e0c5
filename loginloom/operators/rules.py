"""Movement rules: pivots, chains of one account, fan-out of one host. Only successful logons reach a host."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import closed_left, distinct_in_window, open_window, strict_past

DAY = 86_400


def pivot(events: DataFrame, w: int = 1_800) -> DataFrame:
    """events with `pivot`: anyone reached the source host in [t-w, t)."""
    uses = events.withColumns({"_host": F.col("src"), "_reach": F.lit(0)})
    reaches = events.filter("success = 1").select("t", F.col("dst").alias("_host"), F.lit(1).alias("_reach"))
    both = uses.unionByName(reaches, allowMissingColumns=True)
    found = F.coalesce(F.sum("_reach").over(closed_left(w, "_host")), F.lit(0))
    return both.withColumn("pivot", (found > 0).cast("int")).filter("event_id IS NOT NULL").select(*events.columns, "pivot")


def chain_flags(events: DataFrame, w: int = 1_800, prior: int = 3, novel: bool = True) -> DataFrame:
    """events with prior_hops, chain_continues, chain_hop.

    A hop is a successful logon to a host new to the account, from a host that the account reached within w before it in
    stream order. The chain continues if the account reached the source in [t-w, t) and made `prior` hops in that time.
    """
    none = F.lit(None).cast("long")
    use = F.struct(F.col("src").alias("host"), none.alias("reach"))
    reach = F.when(F.col("success") == 1, F.struct(F.col("dst").alias("host"), F.col("t").alias("reach")))
    both = events.repartition("usr").select("*", F.explode(F.array_compact(F.array(use, reach))).alias("_m")).select(*events.columns, F.col("_m.host").alias("_host"), F.col("_m.reach").alias("_reach"))
    # a row's own reach comes behind it: it isn't its own past
    in_stream = Window.partitionBy("usr", "_host").orderBy("t", "event_id", F.col("_reach").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumns({"_last_seen": F.max("_reach").over(in_stream), "_last_strict": F.max("_reach").over(strict_past("usr", "_host"))})
    rows = both.filter("_reach IS NULL").drop("_reach", "_host")
    pair = Window.partitionBy("usr", "dst", "success").orderBy("t", "event_id")
    rows = rows.withColumns({"_novel": (F.row_number().over(pair) == 1) if novel else F.lit(True), "_before": F.coalesce(F.sum("success").over(strict_past("usr", "dst")), F.lit(0))})
    rows = rows.withColumn("_hop", F.coalesce((F.col("success") == 1) & F.col("_novel") & (F.col("_last_seen") >= F.col("t") - w), F.lit(False)).cast("int"))
    rows = rows.withColumn("prior_hops", F.coalesce(F.sum("_hop").over(closed_left(w, "usr")), F.lit(0)).cast("long"))
    rows = rows.withColumn("chain_continues", F.coalesce((F.col("_last_strict") >= F.col("t") - w) & (F.col("prior_hops") >= prior), F.lit(False)).cast("int"))
    hop = (F.col("success") == 1) & (F.col("chain_continues") == 1) & ((F.col("_before") == 0) if novel else F.lit(True))
    return rows.withColumn("chain_hop", hop.cast("int")).select(*events.columns, "prior_hops", "chain_continues", "chain_hop")


def fanout_inputs(events: DataFrame, w: int = 3_600) -> DataFrame:
    """events with fanout_accounts, fanout_novel (moves of the open window) and dst_novel (never reached from src before)."""
    rows = distinct_in_window(events, "src", [("usr", {"fanout_accounts": w}, F.col("success") == 1)])
    pair = Window.partitionBy("src", "dst", "success").orderBy("t", "event_id")
    rows = rows.withColumns({"_first": ((F.row_number().over(pair) == 1) & (F.col("success") == 1)).cast("int"), "_before": F.coalesce(F.sum("success").over(strict_past("src", "dst")), F.lit(0))})
    novel = F.coalesce(F.sum("_first").over(open_window(w, "src")), F.lit(0)).cast("long")
    return rows.withColumns({"fanout_novel": novel, "dst_novel": (F.col("_before") == 0).cast("int")}).drop("_first", "_before")


def fanout_baseline(inputs: DataFrame, days: int = 7, kind: str = "active") -> DataFrame:
    """src, day, baseline: the median of the host's daily greatest account counts over its last days before.

    kind: `active` counts days with events, `calendar` all days of the range.
    """
    daily = inputs.groupBy("src", F.floor(F.col("t") / DAY).alias("day")).agg(F.max("fanout_accounts").alias("most"))
    w = Window.partitionBy("src").orderBy("day")
    w = w.rowsBetween(-days, -1) if kind == "active" else w.rangeBetween(-days, -1)
    return daily.withColumn("baseline", F.coalesce(F.percentile("most", 0.5).over(w), F.lit(0.0))).select("src", "day", "baseline")


def fanout_flags(events: DataFrame, accounts: int = 8, novel: int = 5, baseline: float = 2.0, w: int = 3_600) -> DataFrame:
    """events with the fan-out inputs, baseline and fanout_hop."""
    rows = fanout_inputs(events, w).withColumn("day", F.floor(F.col("t") / DAY))
    rows = rows.join(fanout_baseline(rows), ["src", "day"]).drop("day")
    hop = (F.col("fanout_accounts") >= accounts) & (F.col("fanout_novel") >= novel) & (F.col("baseline") <= baseline) & (F.col("success") == 1) & (F.col("dst_novel") == 1)
    return rows.withColumn("fanout_hop", hop.cast("int")).select(*events.columns, "fanout_accounts", "fanout_novel", "dst_novel", "baseline", "fanout_hop")


def detect(events: DataFrame, **limits) -> DataFrame:
    """event_id with both rules' flags."""
    chain = chain_flags(events).select("event_id", "chain_hop")
    return fanout_flags(events, **limits).select("event_id", "fanout_hop").join(chain, "event_id")
