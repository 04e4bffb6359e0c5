"""Authentication events derived from the driver's `events` table, for Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECONDS = F.unix_timestamp


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw columns that both projections use, from one narrow scan."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "props")
    t = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    k = F.get_json_object("props", "$.k").cast("int")
    return raw.select("event_id", t.alias("t_real"), "user_id", "event_type", k.alias("k"))


def _auth(rows: DataFrame, t, usr, src, dst) -> DataFrame:
    k = F.col("k")
    return rows.select(
        "event_id",
        t.cast("long").alias("t"),
        usr.cast("long").alias("usr"),
        src.cast("long").alias("src"),
        dst.cast("long").alias("dst"),
        (k % 4).alias("logon_id"),
        (F.col("event_type") != "error").cast("int").alias("success"),
        k.isin(7, 77).cast("int").alias("label"),
        F.when(k % 5 == 0, "NTLM").when(k % 5 == 1, "Negotiate").otherwise("Kerberos").alias("auth_name"),
        F.when(k % 7 == 0, "TGT").when(k % 7 == 1, "TGS").otherwise("LogOn").alias("orient_name"),
    )


def auth_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day-scale events: few users, real times."""
    u, k = F.col("user_id"), F.col("k")
    return _auth(events(spark, sf_dir), F.col("t_real"), u, u % 20, 20 + k)


def auth_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two events every five seconds: ties, short windows, chains. Self-loops are dropped."""
    e, u, k = F.col("event_id"), F.col("user_id"), F.col("k")
    rows = _auth(events(spark, sf_dir), 1_700_000_000 + F.floor(e / 2) * 5, u % 60, (u * 7 + k * 3) % 97, (k * 13 + u) % 97)
    return rows.filter("src <> dst")


_RAW_SQL = """raw AS (
    SELECT event_id, epoch_us(ts) // 1000000 AS t_real, user_id, event_type, CAST(props->>'$.k' AS INTEGER) AS k FROM events
)"""
_COMMON_SQL = """k % 4 AS logon_id, CAST(event_type <> 'error' AS INTEGER) AS success, CAST(k IN (7, 77) AS INTEGER) AS label,
        CASE k % 5 WHEN 0 THEN 'NTLM' WHEN 1 THEN 'Negotiate' ELSE 'Kerberos' END AS auth_name,
        CASE k % 7 WHEN 0 THEN 'TGT' WHEN 1 THEN 'TGS' ELSE 'LogOn' END AS orient_name"""
#: CTEs that end in `e`, the events; a query goes on with a comma or a SELECT.
SPARSE_SQL = f"""WITH RECURSIVE {_RAW_SQL}, e AS (
    SELECT event_id, CAST(t_real AS BIGINT) AS t, CAST(user_id AS BIGINT) AS usr, CAST(user_id % 20 AS BIGINT) AS src, CAST(20 + k AS BIGINT) AS dst, {_COMMON_SQL} FROM raw
)"""
DENSE_SQL = f"""WITH RECURSIVE {_RAW_SQL}, e AS (
    SELECT * FROM (
        SELECT event_id, CAST(1700000000 + (event_id // 2) * 5 AS BIGINT) AS t, CAST(user_id % 60 AS BIGINT) AS usr,
            CAST((user_id * 7 + k * 3) % 97 AS BIGINT) AS src, CAST((k * 13 + user_id) % 97 AS BIGINT) AS dst, {_COMMON_SQL} FROM raw
    ) WHERE src <> dst
)"""
