"""Structured Streaming: ingest with receipts, features and alerts by micro-batch, the chain rule with keyed state, counts.

Tables of state are versioned by batch id, so that a batch that is run again writes the same version and reads the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import fusion, graph
from . import incremental

EVENT = "event_id long, t long, usr long, src long, dst long, logon_id int, success int, label int"


def events_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Day or batch files of JSON events, oldest file first, `files` at a time: also a replay of history."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files).json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def start_features(stream: DataFrame, state_dir: str, out_dir: str, checkpoint: str):
    """Score-before-update features of each micro-batch, from the state of the batch before; late rows go to quarantine.

    A row is late if its time isn't after the last accepted batch's. Rows of a batch are written once for each batch id.
    """
    spark = stream.sparkSession

    def one(batch: DataFrame, batch_id: int) -> None:
        before = f"{state_dir}/v={batch_id - 1}"
        known = batch_id > 0 and _exists(spark, before)
        state = {k: spark.read.parquet(f"{before}/{k}") for k in ("registry", "tail")} if known else incremental.empty_state(spark)
        last = state["tail"].agg(F.max("t")).first()[0] if known else None
        fresh = batch if last is None else batch.filter(F.col("t") > last)
        if last is not None:
            batch.filter(F.col("t") <= last).write.mode("overwrite").parquet(f"{out_dir}/quarantine/batch={batch_id}")
        x, after = incremental.advance_day(fresh, state)
        x.write.mode("overwrite").parquet(f"{out_dir}/features/batch={batch_id}")
        for k, table in after.items():
            table.write.mode("overwrite").parquet(f"{state_dir}/v={batch_id}/{k}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_receipts(batches: DataFrame, receipts: str, accepted: str, checkpoint: str):
    """Batches (batch_key, payload): the same key with the same content is taken once; with other content it is rejected."""
    spark = batches.sparkSession

    def one(batch: DataFrame, batch_id: int) -> None:
        digests = batch.groupBy("batch_key").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("payload")), "\n"), 256).alias("digest"))
        # what this very batch id wrote before a failure is written again
        known = spark.read.parquet(receipts).filter(F.col("batch") != batch_id) if _exists(spark, receipts) else spark.createDataFrame([], "batch_key string, digest string, status string, batch long")
        held = known.filter("status = 'accepted'").select("batch_key", F.col("digest").alias("old"))
        status = F.when(F.col("old").isNull(), "accepted").when(F.col("old") == F.col("digest"), "repeated").otherwise("rejected")
        marked = digests.join(held, "batch_key", "left").withColumn("status", status).drop("old")
        marked.write.mode("overwrite").parquet(f"{receipts}/batch={batch_id}")
        stored = spark.read.parquet(f"{receipts}/batch={batch_id}").filter("status = 'accepted'")
        batch.join(stored.select("batch_key"), "batch_key", "left_semi").write.mode("overwrite").parquet(f"{accepted}/batch={batch_id}")

    return batches.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_alert_paths(scored: DataFrame, state_dir: str, out_dir: str, checkpoint: str, threshold: float = fusion.ALERT, window: int = graph.WINDOW, max_edges: int = graph.MAX_EDGES, min_risk: float = graph.MIN_RISK):
    """Alerts and suspicious paths of each micro-batch: out_dir/paths and out_dir/alerts, partitioned by batch.

    scored: event_id, t, usr, src, dst, risk, is_new, support. The tail of edges that may go on is a version of state_dir for each
    batch; known paths are those that earlier batches wrote. A batch that is run again reads the version before it and
    overwrites its own parts, so it adds nothing. An alert names the best of the new paths that hold its event.
    """
    spark = scored.sparkSession
    edge = ("event_id", "t", "src", "dst", "risk", "is_new", "support")

    def one(batch: DataFrame, batch_id: int) -> None:
        batch = graph.cut_lineage(batch, "scored")
        before = f"{state_dir}/v={batch_id - 1}"
        tail = spark.read.parquet(before) if batch_id and _exists(spark, before) else batch.select(*edge).limit(0)
        known = spark.createDataFrame([], "path_id string")
        if _exists(spark, f"{out_dir}/paths"):
            known = spark.read.parquet(f"{out_dir}/paths").filter(F.col("batch") < batch_id).select("path_id")
        paths, after = graph.advance_paths(batch.select(*edge), tail, known, window, max_edges, min_risk)
        graph.score_paths(paths, top_k=None).write.mode("overwrite").parquet(f"{out_dir}/paths/batch={batch_id}")
        after.write.mode("overwrite").parquet(f"{state_dir}/v={batch_id}")
        new = spark.read.parquet(f"{out_dir}/paths/batch={batch_id}")
        best = new.select(F.explode("events").alias("event_id"), "path_id", "score", "first_t").groupBy("event_id").agg(F.min_by("path_id", F.struct(-F.col("score"), "first_t", "path_id")).alias("path_id"))
        batch.filter(F.col("risk") >= threshold).join(best, "event_id", "left").write.mode("overwrite").parquet(f"{out_dir}/alerts/batch={batch_id}")

    return scored.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class ChainState(StatefulProcessor):
    """The chain rule of one account: hosts reached with their last times, and the times of hops.

    Hosts that were reached before the window are let go of after each batch; novelty needs `known` for good.
    """

    def __init__(self, window: int = 1_800, prior: int = 3):
        self.window, self.prior = window, prior

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.reached = handle.getMapState("reached", "host long", "t long")
        self.known = handle.getMapState("known", "host long", "t long")
        self.hops = handle.getValueState("hops", "times array<long>")

    def handleInputRows(self, key, rows, timer_values):
        import pandas as pd

        frame = pd.concat(list(rows)).sort_values(["t", "event_id"])
        hops = list(self.hops.get()[0]) if self.hops.exists() else []
        out = []
        for t, group in frame.groupby("t", sort=True):
            hops = [x for x in hops if x >= t - self.window]
            for r in group.itertuples():
                last = self.reached.getValue((r.src,))[0] if self.reached.containsKey((r.src,)) else None
                goes = last is not None and last >= t - self.window and len(hops) >= self.prior
                new = not self.known.containsKey((r.dst,))
                out.append((r.event_id, r.usr, int(goes), int(goes and new and r.success == 1)))
            for r in group.itertuples():
                if r.success != 1:
                    continue
                last = self.reached.getValue((r.src,))[0] if self.reached.containsKey((r.src,)) else None
                new = not self.known.containsKey((r.dst,))
                if new and last is not None and last >= t - self.window:
                    hops.append(int(t))
                self.reached.updateValue((r.dst,), (int(t),))
                if new:
                    self.known.updateValue((r.dst,), (int(t),))
        self.hops.update((hops,))
        newest = int(frame["t"].max())
        for host, (t,) in list(self.reached.iterator()):
            if t < newest - self.window:
                self.reached.removeKey(host)
        yield pd.DataFrame(out, columns=["event_id", "usr", "chain_continues", "chain_hop"])

    def close(self) -> None:
        pass


def start_chain_rule(stream: DataFrame, out_dir: str, checkpoint: str, window: int = 1_800, prior: int = 3):
    """Flags of the chain rule, state keyed by account."""
    flags = stream.groupBy("usr").transformWithStateInPandas(statefulProcessor=ChainState(window, prior), outputStructType="event_id long, usr long, chain_continues long, chain_hop long", outputMode="Append", timeMode="None")
    return flags.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """start_t, events, failures of each hour; late rows are taken up to the watermark."""
    rows = stream.withColumn("ts", F.timestamp_seconds("t")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("events"), F.sum(1 - F.col("success")).alias("failures")).select(F.unix_seconds("w.start").alias("start_t"), "events", "failures")


def start_counts(stream: DataFrame, out_dir: str, checkpoint: str):
    return windowed_counts(stream).writeStream.format("parquet").outputMode("append").option("path", out_dir).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_alerts(scored: DataFrame, out_dir: str, checkpoint: str, threshold: float = fusion.ALERT):
    """Scored rows at or above the threshold, appended."""
    return fusion.alerts(scored, threshold).writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
