"""Ingest as relational work: rejects with reasons, labels, order, ids, dictionaries, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import global_position


def profile_raw(raw: DataFrame, columns: list[str]) -> DataFrame:
    """column, rows, missing, distinct (approximate counts are not used): one aggregate over all columns."""
    aggs = [F.count("*").alias("rows")]
    for c in columns:
        aggs += [F.sum((F.col(c).isNull() | (F.col(c).cast("string") == "?")).cast("int")).cast("long").alias(f"m_{c}"), F.count_distinct(c).alias(f"d_{c}")]
    row = raw.agg(*aggs)
    return row.select("rows", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m_{c}").alias("missing"), F.col(f"d_{c}").alias("distinct_values")) for c in columns])).alias("x")).select("x.column", "rows", "x.missing", "x.distinct_values")


def reject_with_reason(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejects with `reason`) of raw rows with t, usr, success as text."""
    reason = F.when(~F.col("t_text").rlike(r"^\d+$"), "timestamp").when(~F.col("success_text").isin("Success", "Fail"), "success").when(F.col("usr_text") == "", "user")
    rows = raw.withColumn("reason", reason)
    return rows.filter("reason IS NULL").drop("reason"), rows.filter("reason IS NOT NULL")


def stride_sample(events: DataFrame, stride: int) -> DataFrame:
    """Labelled rows, and of all rows each stride-th by position in (t, event_id) order."""
    rows = global_position(events, ["t", "event_id"])
    return rows.filter((F.col("label") == 1) | (F.col("position") % stride == 0)).drop("position")


def label_events(events: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events with `hit`, labels without an event): exact match on t, usr, src, dst."""
    keys = ["t", "usr", "src", "dst"]
    marks = labels.select(*keys).distinct().withColumn("hit", F.lit(1))
    return events.join(marks, keys, "left").fillna({"hit": 0}), labels.select(*keys).distinct().join(events.select(*keys), keys, "left_anti")


def drop_exact_duplicates(events: DataFrame) -> DataFrame:
    """The first, in stream order, of rows with equal t, usr, src, dst, success."""
    w = Window.partitionBy("t", "usr", "src", "dst", "success").orderBy("event_id")
    return events.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def with_event_id(events: DataFrame, order: list[str], name: str = "dense_id") -> DataFrame:
    """events with a dense id from 0 in a total order."""
    return global_position(events, order, name)


def build_dictionary(values: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """value, id: dense ids from 1 by first appearance (value, t, event_id, role); ids of `existing` stay."""
    first = values.filter("value IS NOT NULL AND value NOT IN ('', '?')").groupBy("value").agg(F.min(F.struct("t", "event_id", "role")).alias("first"))
    offset = 0
    if existing is not None:
        offset = existing.agg(F.max("id")).first()[0] or 0
        first = first.join(existing.select("value"), "value", "left_anti")
    rows = global_position(first.select("value", "first.t", "first.event_id", "first.role"), ["t", "event_id", "role", "value"])
    fresh = rows.select("value", (F.col("position") + 1 + offset).cast("long").alias("id"))
    return fresh if existing is None else existing.select("value", "id").unionByName(fresh)


def encode(values: DataFrame, dictionary: DataFrame, column: str) -> DataFrame:
    """values with `<column>_id`, 0 if unknown."""
    named = dictionary.select(F.col("value").alias(column), F.col("id").alias(f"{column}_id"))
    return values.join(named, column, "left").fillna({f"{column}_id": 0})


def report(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count("*").alias("n_rows"),
        F.sum((F.col("src") == F.col("dst")).cast("int")).cast("long").alias("self_loops"),
        F.sum(F.when(F.col("src") == F.col("dst"), F.col("label")).otherwise(0)).cast("long").alias("labelled_self_loops"),
        F.sum("label").cast("long").alias("labelled"),
        F.sum(1 - F.col("success")).cast("long").alias("failures"),
        F.count_distinct("usr").alias("users"),
        F.min("t").alias("first_t"),
        F.max("t").alias("last_t"),
    )


def union_streams(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def stream_violations(events: DataFrame) -> DataFrame:
    """gaps and disorder of event_id and t: an event joins its successor by id, which needs no global window."""
    bounds = events.agg(F.count("*").alias("n"), F.min("event_id").alias("least"), F.max("event_id").alias("most"), F.count_distinct("event_id").alias("ids"))
    nxt = events.select((F.col("event_id") - 1).alias("event_id"), F.col("t").alias("next_t"))
    disorder = events.select("event_id", "t").join(nxt, "event_id").agg(F.sum((F.col("next_t") < F.col("t")).cast("int")).cast("long").alias("backwards"))
    return bounds.select((F.col("most") - F.col("least") + 1 - F.col("ids")).alias("gaps"), (F.col("n") - F.col("ids")).alias("repeated")).join(F.broadcast(disorder))
