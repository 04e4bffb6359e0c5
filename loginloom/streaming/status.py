"""What a running ingest has taken: counts for each source, observed by Spark as rows flow and kept as a table by a listener."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

STATUS = "query string, batch long, source string, received long, rejected long, accepted long, late long, last_t long"
NEEDED = ("event_id", "t", "usr", "src", "dst")


def _place(sources: list[str]):
    """The place of a row's source among the declared ones; that behind them for any other."""
    out = F.lit(len(sources))
    for i, s in enumerate(sources):
        out = F.when(F.col("source") == s, i).otherwise(out)
    return out


def accepted(stream: DataFrame, sources: list[str], late: str = "1 hour") -> DataFrame:
    """Rows with all of NEEDED, each (source, event_id) once within the watermark; metrics `received` and `kept` are observed on the way."""
    ok = F.lit(True)
    for c in NEEDED:
        ok = ok & F.col(c).isNotNull()
    marked = stream.withColumns({"_at": _place(sources), "_ok": ok})
    at = range(len(sources) + 1)
    came = [F.count_if(F.col("_at") == i).alias(f"received_{i}") for i in at] + [F.count_if((F.col("_at") == i) & ~F.col("_ok")).alias(f"rejected_{i}") for i in at]
    kept = [F.count_if(F.col("_at") == i).alias(f"accepted_{i}") for i in at] + [F.max(F.when(F.col("_at") == i, F.col("t"))).alias(f"last_{i}") for i in at]
    rows = marked.observe("received", *came).filter("_ok").withColumn("ts", F.timestamp_seconds("t")).withWatermark("ts", late)
    return rows.dropDuplicatesWithinWatermark(["source", "event_id"]).observe("kept", *kept).drop("_at", "_ok", "ts")


class StatusListener(StreamingQueryListener):
    """Writes the observed counts of each batch under `status_dir`; a batch that is reported again replaces its rows.

    A row that arrived whole and wasn't accepted was a repetition, or came behind the watermark: Spark counts the latter for all
    sources together, so `late` stands in the row of the source ''.
    """

    def __init__(self, spark: SparkSession, sources: list[str], status_dir: str):
        self.spark, self.sources, self.status_dir = spark, sources, status_dir

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        seen = progress.observedMetrics
        if "received" not in seen or "kept" not in seen:
            return
        came, kept = seen["received"].asDict(), seen["kept"].asDict()
        query, batch = str(progress.id), int(progress.batchId)
        rows = [(query, batch, name, came[f"received_{i}"], came[f"rejected_{i}"], kept[f"accepted_{i}"], None, kept[f"last_{i}"]) for i, name in enumerate([*self.sources, None])]
        dropped = sum(s.numRowsDroppedByWatermark for s in progress.stateOperators)
        rows.append((query, batch, "", 0, 0, 0, dropped, None))
        self.spark.createDataFrame(rows, STATUS).coalesce(1).write.mode("overwrite").parquet(f"{self.status_dir}/run={query}/part={batch}")


def status(spark: SparkSession, status_dir: str) -> DataFrame:
    """source (null: not declared), received, rejected, accepted, repeated_or_late, last_t over all batches of all queries."""
    rows = spark.read.schema(STATUS).parquet(f"{status_dir}/run=*/part=*").filter("late IS NULL")
    total = rows.groupBy("source").agg(*[F.sum(c).alias(c) for c in ("received", "rejected", "accepted")], F.max("last_t").alias("last_t"))
    return total.select("source", "received", "rejected", "accepted", (F.col("received") - F.col("rejected") - F.col("accepted")).alias("repeated_or_late"), "last_t")


def start_counted(stream: DataFrame, sources: list[str], out_dir: str, checkpoint: str, late: str = "1 hour"):
    """Accepted rows to Parquet. The listener is the caller's to add, as it outlives the query."""
    return accepted(stream, sources, late).writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
