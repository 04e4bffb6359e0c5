"""Features day by day: registries of what is known and a tail of recent events, so that a day never reads the whole past.

State is two tables: `registry` (kind, a, b, n, last_t, first_t), a row for each known user, pair, source-destination pair and
so on, and `tail`, the events of the last day. Both can be written by day or by micro-batch and read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import ALL, DAY, DISTINCT, EXPRESSIONS, PAIRS, hour_columns, past_firsts
from ..operators.windows import distinct_in_window, stream_past, strict_past
from ..shared import fresh_path

FEATURES = ALL
REGISTRY = "kind string, a long, b long, n long, last_t long"
TAIL = "event_id long, t long, usr long, src long, dst long, logon_id int, success int, first_pair int"
#: What the registry knows, by kind: the columns that name it.
KINDS = {"pair": ("usr", "dst"), "hosts": ("src", "dst"), "logon": ("usr", "logon_id"), "route": ("usr", "src")}
#: A time before all windows: rows of the registry stand at the head of their keys.
BEFORE = -(1 << 60)


def empty_state(spark: SparkSession) -> dict[str, DataFrame]:
    return {"registry": spark.createDataFrame([], REGISTRY), "tail": spark.createDataFrame([], TAIL)}


def _kinds(events: DataFrame) -> DataFrame:
    name = lambda c: F.col(c).cast("long")
    rows = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), name(a).alias("a"), name(b).alias("b")) for kind, (a, b) in KINDS.items()])).alias("k")
    return events.select("t", rows).select("k.*", F.lit(1).cast("long").alias("n"), F.col("t").alias("last_t"))


def _known(registry: DataFrame, kind: str) -> DataFrame:
    """The registry's rows of a kind, as rows that stand before all events."""
    a, b = KINDS[kind]
    return registry.filter(F.col("kind") == kind).select(F.lit(BEFORE).alias("t"), F.col("a").alias(a), F.col("b").alias(b), F.col("kind").alias("_kind"), F.col("n").alias("_n"), F.col("last_t").alias("_last"))


def _of(kind: str, value: str = "_n") -> Column:
    """The value on events and on the registry's rows of a kind."""
    return F.when(F.col("_kind").isNull() | (F.col("_kind") == kind), F.col(value))


def _past(kind: str, *keys: str) -> Column:
    return F.coalesce(F.sum(_of(kind)).over(strict_past(*keys)), F.lit(0))


def _seen(kind: str) -> Column:
    return (_past(kind, *KINDS[kind]) > 0).cast("int")


def _since(*keys: str) -> Column:
    return F.coalesce(F.log1p((F.col("t") - F.max(_of("pair", "_last")).over(strict_past(*keys))).cast("double")), F.lit(0.0))


def _first(kind: str) -> Column:
    """1 on what the registry knows and on a new row that is the first of its keys."""
    none_before = F.coalesce(F.sum(_of(kind)).over(stream_past(*KINDS[kind])), F.lit(0)) == 0
    return F.when(F.col("_kind").isNull(), ((F.col("_n") == 1) & none_before).cast("int")).otherwise((F.col("_kind") == kind).cast("int"))


def _featured(events: DataFrame, state: dict[str, DataFrame]) -> DataFrame:
    """events with FEATURES and first_pair, after one shuffle for each of account, source and destination.

    What is known stands before the events of its key, in the same windows: a row of the registry counts as often as it was seen,
    a row of the tail only in windows of a day at most.
    """
    known, tail = state["registry"], state["tail"]
    n_parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    is_event = F.col("_kind").isNull()
    bounded = lambda made, names: {n: made[n](None) for n in names}

    def dealt(rows: DataFrame, key: str, *kinds: DataFrame) -> DataFrame:
        for k in kinds:
            rows = rows.unionByName(k, allowMissingColumns=True)
        return rows.repartition(n_parts, key)

    def counted(rows: DataFrame, key: str) -> DataFrame:
        return distinct_in_window(rows, key, [(partner, windows, is_event) for partner, windows in DISTINCT[key]], dealt=True).filter(is_event)

    own = {"_kind": F.lit(None).cast("string")}
    rows = events.withColumns({**own, "_n": F.lit(1).cast("long"), "_last": F.col("t"), "_held": F.lit(None).cast("int")})
    recent = tail.withColumnRenamed("first_pair", "_held").withColumns({**own, "_n": F.lit(0).cast("long"), "_last": F.lit(None).cast("long")})
    rows = dealt(rows.unionByName(recent, allowMissingColumns=True), "usr", *[_known(known, k) for k in ("pair", "logon", "route")])
    rows = rows.withColumn("user_src_seen_before", _seen("route"))
    rows = rows.withColumn("_first_logon", _first("logon")).withColumn("_past_logon", _past("logon", *KINDS["logon"]))
    rows = rows.withColumn("_new_pair", _first("pair"))
    rows = rows.withColumn("_first_pair", F.when(is_event, F.coalesce("_held", "_new_pair")))
    pair_past = _past("pair", *KINDS["pair"])
    rows = rows.withColumns({"pair_seen_before": _seen("pair"), "is_new_pair": 1 - _seen("pair"), "delta_pair_log": _since("usr", "dst"), "pair_rarity": 1 / F.sqrt(pair_past + 1.0), **bounded(PAIRS["usr"]["dst"], ["pair_frequency_1h"])})
    rows = counted(rows.withColumns({"_firsts_logon": past_firsts("_first_logon", "usr"), "_firsts_pair": past_firsts("_new_pair", "usr"), "_past_usr": _past("pair", "usr"), "delta_user_log": _since("usr")}), "usr")
    rows = rows.withColumns(
        {
            "user_seen_before": (F.col("_past_usr") > 0).cast("int"),
            "user_historical_degree": F.col("_firsts_pair"),
            "rare_logon_score": -F.log((F.col("_past_logon") + 1.0) / (F.col("_past_usr") + F.col("_firsts_logon") + 1.0)),
            **bounded(EXPRESSIONS["usr"], ["user_auth_rate_5m", "user_failure_rate_15m", "failures_before_success_15m", "user_new_dst_ratio_1h"]),
        }
    ).drop("_held", "_first_logon", "_past_logon", "_firsts_logon", "_firsts_pair", "_past_usr")
    rows = dealt(rows, "src", _known(known, "hosts")).withColumn("_first_hosts", _first("hosts")).withColumn("src_dst_seen_before", _seen("hosts"))
    rows = counted(rows.withColumn("src_host_historical_degree", past_firsts("_first_hosts", "src")), "src").drop("_first_hosts")
    # a destination's accounts come as one row
    reached = _known(known, "pair").groupBy("dst").agg(F.count("*").alias("_new_pair")).select("dst", F.lit(BEFORE).alias("t"), F.lit("pair").alias("_kind"), "_new_pair")
    rows = dealt(rows, "dst", reached).withColumn("dst_historical_degree", past_firsts("_new_pair", "dst"))
    rows = counted(rows, "dst").filter("_n = 1")
    rows = rows.withColumns({"destination_novelty": 1 / (F.col("dst_historical_degree") + 1.0), **hour_columns()})
    return rows.select(*events.columns, F.col("_first_pair").alias("first_pair"), *FEATURES)


def _after(rows: DataFrame, state: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The state with what rows, of _featured, add to it."""
    known, tail = state["registry"], state["tail"]
    registry = known.unionByName(_kinds(rows)).groupBy("kind", "a", "b").agg(F.sum("n").alias("n"), F.max("last_t").alias("last_t"))
    recent = tail.unionByName(rows.select([F.col(f.name).cast(f.dataType) for f in tail.schema.fields]))
    # of both, so that a batch without rows drops nothing
    edge = recent.agg(F.max("t").alias("edge"))
    return {"registry": registry, "tail": recent.join(F.broadcast(edge), F.col("t") > F.col("edge") - DAY).drop("edge")}


def advance_day(events: DataFrame, state: dict[str, DataFrame], cut: bool = True) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(events with FEATURES, the next state). events: later than all of the state. cut: whether the registry's lineage is."""
    rows = _featured(events, state)
    after = _after(rows, state)
    if cut and events.sparkSession.conf.get("spark.checkpoint.dir", None):
        # the registry reads the events, not their features
        after["registry"] = _after(events.withColumn("first_pair", F.lit(0)), state)["registry"].checkpoint()
    return rows.drop("first_pair"), after


def advance_days(events: DataFrame, state: dict[str, DataFrame] | None = None, step: int = 1) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(events with FEATURES, the last state) over every `step` days of events, each from the state that the days before left.

    Events are dealt by step once; a step's features, registry and tail are written to the shared folder before the next
    reads them, so no plan grows with the days. t must not be null.
    """
    spark = events.sparkSession
    root = fresh_path(spark, "days")
    state = state or empty_state(spark)
    day = F.floor(F.col("t") / (DAY * step)).alias("_day")
    events.select("*", day).write.partitionBy("_day").parquet(f"{root}/events")
    dealt = spark.read.schema(events.withColumn("_day", day).schema).parquet(f"{root}/events")
    days = sorted(r[0] for r in dealt.select("_day").distinct().collect())
    if not days:
        return advance_day(events, state)

    def stored(rows: DataFrame, path: str) -> DataFrame:
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    for d in days:
        own = spark.read.schema(events.schema).parquet(f"{root}/events/_day={d}")
        x = stored(_featured(own, state), f"{root}/features/day-{d}")
        after = _after(x, state)
        # nothing reads the state after the last step here, so it is left as a plan over what is stored
        state = after if d == days[-1] else {k: stored(v, f"{root}/{k}/day-{d}") for k, v in after.items()}
    return spark.read.schema(x.schema).parquet(*[f"{root}/features/day-{d}" for d in days]).drop("first_pair"), state
