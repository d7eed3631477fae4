"""Audit checks as (stage, name, n, bad, ok) rows, operations checks, and repair jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def check(df: DataFrame, stage: str, name: str, bad: Column, limit: float, at_most: bool = True) -> DataFrame:
    """One row: share of rows with `bad` true against a limit (or at least it, with at_most=False)."""
    share = F.when(F.col("n") > 0, F.col("bad") / F.col("n")).otherwise(0.0)
    ok = (share <= limit) if at_most else (share >= limit)
    g = df.agg(F.count("*").alias("n"), F.count_if(F.coalesce(bad, F.lit(False))).alias("bad"))
    return g.select(F.lit(stage).alias("stage"), F.lit(name).alias("name"), "n", "bad", ok.cast("int").alias("ok"))


def run(checks: list[DataFrame]) -> DataFrame:
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def base_rate_bands(heads: DataFrame, bands: dict[str, tuple[float, float]], min_n: int) -> DataFrame:
    """Label base rate of each head against its band; thin heads are suspended, not failed."""
    long = heads.select(F.inline(F.array(*[F.struct(F.lit(h).alias("head"), F.col(h).alias("y")) for h in bands]))).filter("y IS NOT NULL")
    g = long.groupBy("head").agg(F.count("*").alias("n"), (F.sum("y") / F.count("*")).alias("rate"))
    lo = F.coalesce(*[F.when(F.col("head") == h, F.lit(float(b[0]))) for h, b in bands.items()])
    hi = F.coalesce(*[F.when(F.col("head") == h, F.lit(float(b[1]))) for h, b in bands.items()])
    state = F.when(F.col("n") < min_n, "suspended").when(F.col("rate").between(lo, hi), "ok").otherwise("failed")
    return g.select("head", "n", "rate", state.alias("state"))


def gap_alarm(events: DataFrame, ts: str, now: int, hour_s: int) -> DataFrame:
    """Silence since the last event against a limit that depends on the last day's flow."""
    g = events.agg(F.max(ts).alias("last"), F.count_if(F.col(ts) > now - 24 * hour_s).alias("day_n"))
    limit = F.when(F.col("day_n") >= 50, 4 * hour_s).otherwise(12 * hour_s)
    return g.select("last", "day_n", ((F.lit(now) - F.col("last")) > limit).cast("int").alias("alarm"))


def backlog_state(backlog: Column, total: Column, was_open: Column, least: float = 15.0, share: float = 0.2) -> Column:
    """Opens above max(least, share), closes below 60 % of that limit, otherwise keeps its state."""
    limit = F.greatest(F.lit(least), total * share)
    return F.when(backlog > limit, 1).when(backlog < limit * 0.6, 0).otherwise(was_open)


def budget_pace(daily: DataFrame, day: str, n: str, cycle_day: int, cycle_days: int, budget: float) -> DataFrame:
    used = daily.agg(F.sum(n).alias("used"))
    pace = F.col("used") / F.lit(cycle_day) * cycle_days
    return used.select("used", F.round(pace, 4).alias("projected"), (pace > budget).cast("int").alias("over"))


def alert_episodes(results: DataFrame, cooldown: int) -> DataFrame:
    """alert / realert / recovered / quiet per ordered check result of one key.

    An alert opens an episode; it repeats only after the cooldown, and the first passing
    result closes it. Failing spans are found with windows per (check, span), so the fold
    never collects a check's history.
    """
    w = Window.partitionBy("name").orderBy("ts")
    r = results.withColumn("prev", F.lag("ok").over(w)).withColumn("new", ((F.col("ok") == 0) & F.coalesce(F.col("prev") == 1, F.lit(True))).cast("int"))
    r = r.withColumn("span", F.sum("new").over(w)).withColumn("start", F.min(F.when(F.col("ok") == 0, F.col("ts"))).over(Window.partitionBy("name", "span")))
    slot = F.floor((F.col("ts") - F.col("start")) / cooldown)
    first_in_slot = F.row_number().over(Window.partitionBy("name", "span", "ok", F.col("slot")).orderBy("ts")) == 1
    r = r.withColumn("slot", F.when(F.col("ok") == 0, slot)).withColumn("lead", first_in_slot)
    action = (F.when((F.col("ok") == 0) & (F.col("new") == 1), "alert").when((F.col("ok") == 0) & F.col("lead"), "realert")
              .when((F.col("ok") == 1) & (F.col("prev") == 0), "recovered").otherwise("quiet"))
    return r.select("name", "ts", "ok", action.alias("action"))


def rescale_supply(holders: DataFrame, used: Column, real: Column) -> DataFrame:
    """Percentages of coins above 102 % are rescaled by used over real supply."""
    total = holders.groupBy("token_mint").agg(F.sum(F.col("pct").cast("decimal(28,9)")).cast("double").alias("total_pct"))
    j = holders.join(total, "token_mint")
    return j.withColumn("pct", F.when(F.col("total_pct") > 102, F.round(F.col("pct") * used / real, 4)).otherwise(F.col("pct")))


def purge(table: DataFrame, bad_keys: DataFrame, key: str = "token_mint") -> DataFrame:
    return table.join(bad_keys.select(key), key, "left_anti")
