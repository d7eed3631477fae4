"""Structured Streaming jobs: launch windows, anchors, checkpoints, alerts, rolling narratives.

Windows, joins and deduplication use built-in operators with watermarks. Running results per key
need no stream state: every micro-batch lands its partial aggregates as one partition named by the
batch, and reading the table adds the partials up. A replayed batch overwrites its own partition,
and a restarted job finds all earlier ones, so results are exact after any failure.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapelens.functions.columns import narrative_status
from tapelens.session import ensure_checkpoint_dir

# Seconds after the anchor at which a coin is looked at again.
CHECKPOINTS = [30, 60, 90, 120, 210, 300, 390, 480, 600, 720, 900, 1200, 2400]


def run_folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/streams/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:8]}"


def file_stream(spark: SparkSession, folder: str, table: str, files_per_batch: int | None = None) -> DataFrame:
    """A landed table as a stream of files (production swaps this for a message topic)."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:  # a folder of files that arrive one after another
        return reader.option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{table}.parquet")
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def event_swaps(events: DataFrame) -> DataFrame:
    """Swap rows of the event stream with an event time for watermarks."""
    us = F.expr("unix_micros(cast(ts as timestamp)) - unix_micros(cast(timestamp_ntz'2024-01-01 00:00:00' as timestamp))")
    return events.filter(F.col("event_type").isin("error", "purchase", "signup")).select(
        F.get_json_object("props", "$.k").alias("token_mint"), F.col("user_id").cast("string").alias("signer"),
        F.when(F.col("event_type") == "error", "sell").otherwise("buy").alias("side"), F.col("value").alias("sol_amount"),
        (F.col("event_id") % 97 + 1).cast("double").alias("token_amount"), F.floor(us / 600000000).cast("long").alias("ts"),
        F.col("event_id").cast("string").alias("tx_signature"), F.col("ts").cast("timestamp").alias("event_time"))


class BatchTable:
    """Partial results of micro-batches, one Parquet partition each; `reduce` shrinks a batch before it lands."""

    def __init__(self, spark: SparkSession, path: str, schema: str, reduce: Callable[[DataFrame], DataFrame] = lambda batch: batch):
        self.spark, self.path, self.schema, self.reduce = spark, path, schema, reduce

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.reduce(batch).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def read(self) -> DataFrame:
        """All landed partials; empty before the first batch."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)


def run_available(df: DataFrame, folder: str, sink: Callable | None = None, mode: str = "append") -> None:
    """Processes everything available, then stops; offsets and state live in the shared folder."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    w = w.foreachBatch(sink) if sink else w.format("parquet").option("path", f"{folder}/out")
    q = w.start()
    q.awaitTermination()


def launch_buys(creates: DataFrame, buys: DataFrame, window: str = "60 seconds", delay: str = "10 minutes") -> DataFrame:
    """Buys inside the window a create event opens: a watermarked interval join.

    Repeats of a wallet stay in the landed rows; `launch_windows` counts each wallet once.
    """
    c = creates.select("token_mint", F.col("event_time").alias("created_time")).withWatermark("created_time", delay)
    b = buys.select(F.col("token_mint").alias("m"), "signer", "sol_amount", "event_time").withWatermark("event_time", delay)
    j = b.join(c, F.expr(f"m = token_mint AND event_time >= created_time AND event_time <= created_time + INTERVAL {window}"))
    return j.select("token_mint", "signer", "created_time")


def launch_windows(buys: DataFrame, min_buyers: int = 3) -> DataFrame:
    """Launches with enough distinct buyers, from the landed buys."""
    return buys.distinct().groupBy("token_mint", "created_time").agg(F.count("*").alias("n_buyers")).filter(F.col("n_buyers") >= min_buyers)


ANCHORS = "token_mint string, graduated_at long, reports long"


def anchor_partials(feeds: DataFrame) -> DataFrame:
    """Earliest time and number of reports per coin of one micro-batch."""
    return feeds.groupBy("token_mint").agg(F.min("graduated_at").alias("graduated_at"), F.count("*").alias("reports"))


def first_anchors(partials: DataFrame) -> DataFrame:
    """One anchor per coin over all batches, the earliest whichever feed or batch brought it."""
    return partials.groupBy("token_mint").agg(F.min("graduated_at").alias("graduated_at"), F.sum("reports").alias("reports"))


FEATURES = "token_mint string, checkpoint_s int, n_trades long, n_buys long, net_sol decimal(28,6), max_sol double"


def checkpoint_partials(swaps: DataFrame) -> DataFrame:
    """Features per (coin, checkpoint) of one micro-batch of trades with `graduated_at`.

    A trade feeds the checkpoints after it, so a feature can never see later rows. Trades after
    the last checkpoint are dropped before the others are spread over checkpoints.
    """
    off = F.col("ts") - F.col("graduated_at")
    s = swaps.filter((off >= 0) & (off < CHECKPOINTS[-1]))
    s = s.withColumn("checkpoint_s", F.explode(F.array(*map(F.lit, CHECKPOINTS)))).filter(off < F.col("checkpoint_s"))
    buy = F.col("side") == "buy"
    net = F.when(buy, F.col("sol_amount")).otherwise(-F.col("sol_amount")).cast("decimal(18,6)")
    return s.groupBy("token_mint", "checkpoint_s").agg(
        F.count("*").alias("n_trades"), F.count_if(buy).alias("n_buys"), F.sum(net).cast("decimal(28,6)").alias("net_sol"), F.max("sol_amount").alias("max_sol"))


def checkpoint_features(partials: DataFrame) -> DataFrame:
    return partials.groupBy("token_mint", "checkpoint_s").agg(
        F.sum("n_trades").alias("n_trades"), F.sum("n_buys").alias("n_buys"), F.sum("net_sol").cast("double").alias("net_sol"), F.max("max_sol").alias("max_sol"))


def rolling_narratives(mentions: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Mentions per narrative in a one-hour window every five minutes."""
    w = F.window("event_time", "1 hour", "5 minutes")
    g = mentions.withWatermark("event_time", delay).groupBy(w, "label").agg(F.count("*").alias("velocity"))
    return g.select("label", F.col("window.start").alias("start"), "velocity")


def narrative_states(landed: DataFrame) -> DataFrame:
    """Status of every landed window from its velocity and the highest one so far."""
    w = Window.partitionBy("label").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    peak = landed.withColumn("peak", F.max("velocity").over(w))
    return peak.select("label", "start", "velocity", narrative_status("velocity", "peak").alias("status"))


def watched_buys(swaps: DataFrame, watched: DataFrame, delay: str = "1 hour") -> DataFrame:
    """New buys of watched wallets, each signature once."""
    return (swaps.filter("side = 'buy'").join(watched.select(F.col("wallet").alias("signer")), "signer", "left_semi")
            .withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["tx_signature"]))


def tagged_flow(swaps: DataFrame, team: DataFrame) -> DataFrame:
    """Live trades with their wallet tag from the current (static) team table."""
    tm = team.select("token_mint", F.col("wallet").alias("signer"), F.lit("team").alias("t"))
    return swaps.join(tm, ["token_mint", "signer"], "left").withColumn("tag", F.coalesce("t", F.lit("unknown"))).drop("t")


def first_exit_alerts(swaps: DataFrame, team: DataFrame, anchors: DataFrame) -> DataFrame:
    """Team sells after the anchor; the earliest of a coin is its alert."""
    return (swaps.filter("side = 'sell'").join(team.select("token_mint", F.col("wallet").alias("signer")), ["token_mint", "signer"], "left_semi")
            .join(anchors, "token_mint").filter("ts >= graduated_at").select("token_mint", F.col("ts").alias("alert_ts")))


def feed_watchdog(heartbeats: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """One row per quiet-bounded activity session of a feed; each session end starts a stall episode."""
    s = heartbeats.withWatermark("event_time", delay).groupBy(F.session_window("event_time", gap), "feed").agg(F.count("*").alias("events"))
    return s.select("feed", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stalled_at"), "events")
