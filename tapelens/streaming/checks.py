"""Timed outcome checks of every coin: keyed streaming state with event-time timers.

A coin enters the state with its first print after the anchor and leaves it with the last check. The
state is a fixed handful of numbers: the first print and, for each check still to come, the last print
up to it. A timer stands at the next check; when the watermark passes it, the check is emitted once.
Prints are reduced to one row per coin and task before the shuffle, so a coin with a third of all
prints sends no more than one row from each task.

Rows behind the watermark are dropped, also those of a coin whose state has expired; state and offsets
lie in the checkpoint folder, so a restart neither repeats nor loses a check.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HOURS = (1, 4, 24)
CHECKS = "token_mint string, check_offset_h int, price double, launch_price double, final boolean"
_LASTS = ", ".join(f"ts_{h} long, px_{h} double" for h in HOURS)
PARTIAL = f"token_mint string, graduated_at long, event_time timestamp, ts_0 long, px_0 double, {_LASTS}"
STATE = f"graduated_at long, done int, ts_0 long, px_0 double, {_LASTS}"


def partials(hour_s: int):
    """One row per coin of a task's prints: the first print and the last one up to each check."""
    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if rows.empty:
                continue
            rows = rows.sort_values(["ts", "price_usd"])
            by = rows.groupby("token_mint", sort=False)
            out = by.agg(graduated_at=("graduated_at", "first"), event_time=("event_time", "max"), ts_0=("ts", "first"), px_0=("price_usd", "first"))
            for h in HOURS:
                last = rows[rows.ts - rows.graduated_at <= h * hour_s].groupby("token_mint", sort=False)[["ts", "price_usd"]].last()
                out[f"ts_{h}"], out[f"px_{h}"] = last["ts"].astype("Int64"), last["price_usd"]
            yield out.reset_index()
    return reduce


def due_ms(graduated_at: int, h: int, hour_s: int, second_ms: int, epoch_ms: int) -> int:
    """When a check is complete: the end of its last tape second."""
    return epoch_ms + (graduated_at + h * hour_s + 1) * second_ms


def merged(state: dict, rows: pd.DataFrame) -> dict:
    """The state with further partial rows: earliest first print, latest last prints."""
    for r in rows.itertuples(index=False):
        for h in (0, *HOURS):
            ts, px = getattr(r, f"ts_{h}"), getattr(r, f"px_{h}")
            if pd.isna(ts):
                continue
            new, old = (int(ts), float(px)), (state[f"ts_{h}"], state[f"px_{h}"])
            if old[0] is None or (new < old if h == 0 else new > old):
                state[f"ts_{h}"], state[f"px_{h}"] = new
    return state


def timed_checks(prints: DataFrame, delay: str, hour_s: int, second_ms: int, epoch_ms: int) -> DataFrame:
    """CHECKS as they fall due. `prints`: token_mint, ts, price_usd, graduated_at and event_time of a stream.

    `second_ms` and `epoch_ms` place a tape second on the event-time axis.
    """
    off = F.col("ts") - F.col("graduated_at")
    own = prints.filter((off >= 0) & (off <= HOURS[-1] * hour_s)).select("token_mint", "ts", "price_usd", "graduated_at", "event_time")
    small = own.mapInPandas(partials(hour_s), PARTIAL).withWatermark("event_time", delay)
    names = [c.split()[0] for c in STATE.split(", ")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = dict(zip(names, state.get)) if state.exists else dict.fromkeys(names) | {"done": 0}
        for rows in batches:
            if len(rows):
                now["graduated_at"] = int(rows.graduated_at.iloc[0])
                now = merged(now, rows)
        if now["graduated_at"] is None:
            return
        watermark, out = state.getCurrentWatermarkMs(), []
        due = [due_ms(now["graduated_at"], h, hour_s, second_ms, epoch_ms) for h in HOURS]
        while now["done"] < len(HOURS) and due[now["done"]] <= watermark:
            h = HOURS[now["done"]]
            if now[f"ts_{h}"] is not None:
                out.append((key[0], h, now[f"px_{h}"], now["px_0"], h == HOURS[-1]))
            now["done"] += 1
        if now["done"] == len(HOURS):
            state.remove()
        else:
            state.update(tuple(now[n] for n in names))
            state.setTimeoutTimestamp(due[now["done"]])
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CHECKS.split(", ")])

    return small.groupBy("token_mint").applyInPandasWithState(step, CHECKS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def labelled(checks: DataFrame) -> DataFrame:
    """Outcome rows of landed checks."""
    from tapelens.functions.columns import outcome_label, quotient

    ratio = quotient(F.col("price"), F.col("launch_price"))
    return checks.select("token_mint", "check_offset_h", "price", "launch_price", ((ratio - 1) * 100).alias("price_change_pct"), outcome_label(ratio).alias("classified"))


def finalised(checks: DataFrame, post: DataFrame, team: DataFrame) -> DataFrame:
    """Trajectories of record: recomputed from the stored tape for the coins whose last check has run."""
    from tapelens.operators.labels import trajectory

    over = checks.filter("final").select("token_mint").distinct()
    return trajectory(post.join(over, "token_mint", "left_semi"), team.join(over, "token_mint", "left_semi"))


ALERTS = "token_mint string, alert_ts long, p double, model_version long"


class Prewarnings:
    """Sink that scores newly anchored coins by the stored model and raises at most one alert per coin.

    Each micro-batch lands its alerts as one partition and leaves out coins that an earlier batch has
    alerted; a replayed batch overwrites its own partition with the same rows, so neither a replay nor
    a restart alerts again. `snapshot` is the frozen feature table, `score` adds p, alert and
    model_version to its rows.
    """

    def __init__(self, spark: SparkSession, path: str, snapshot: DataFrame, score):
        self.spark, self.path, self.snapshot, self.score = spark, path, snapshot, score

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        anchors = batch.groupBy("token_mint").agg(F.min("graduated_at").alias("alert_ts"))
        told = self.read().filter(F.col("batch") < batch_id).select("token_mint")
        rows = self.score(self.snapshot.join(anchors, "token_mint").join(told, "token_mint", "left_anti"))
        rows.filter("alert = 1").select("token_mint", "alert_ts", "p", "model_version").write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def read(self) -> DataFrame:
        """All alerts with the number of their batch; empty before the first one."""
        schema = ALERTS + ", batch long"
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)
