"""Outcome patterns per bucket, variable insights and tape flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SIGNIFICANT, MIN_BUCKET, MIN_TOTAL = 30, 5, 20


def _bucketed(df: DataFrame, topic: str, bucket: Column, labels: list[str], hit: Column) -> DataFrame:
    """Counts per bucket in one aggregation; buckets without rows come from the fixed label list."""
    g = df.withColumn("label", bucket).groupBy("label").agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))
    base = df.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    return _result(base.join(g, "label", "left"), topic)


def _result(df: DataFrame, topic: str) -> DataFrame:
    n = F.coalesce("n", F.lit(0))
    return df.select(
        F.lit(topic).alias("topic"), "label", n.alias("sample_size"),
        F.round(F.when(n > 0, F.col("hits") / n).otherwise(0.0), 4).alias("value"), (n >= MIN_SIGNIFICANT).cast("int").alias("is_significant"))


def by_supply(df: DataFrame, bands: list[tuple[int, int]]) -> DataFrame:
    s = F.col("supply_pct")
    bucket = F.coalesce(*[F.when((s >= lo) & (s < hi), f"{lo}-{hi}") for lo, hi in bands])
    return _bucketed(df, "team_supply", bucket, [f"{lo}-{hi}" for lo, hi in bands], F.col("classified") == "rug")


def by_sniper(df: DataFrame) -> DataFrame:
    bucket = F.when(F.col("is_bc_sniper") == 1, "is_bc_sniper").otherwise("not_bc_sniper")
    return _bucketed(df, "sniper", bucket, ["is_bc_sniper", "not_bc_sniper"], F.col("classified") == "rug")


def by_smart_count(df: DataFrame) -> DataFrame:
    c = F.col("smart_money_count")
    bucket = F.when(c >= 3, "3+").otherwise(c.cast("string"))
    return _bucketed(df, "smart_money", bucket, ["0", "1", "2", "3+"], F.col("classified") == "moon")


def by_signal(df: DataFrame) -> DataFrame:
    names = ["ACCUMULATING", "HOLDING", "DISTRIBUTING", "DUMPED"]
    return _bucketed(df, "signal", F.col("signal"), names, F.col("classified").isin("moon", "ok"))


def by_funder(reputation: DataFrame, min_coins: int = 30) -> DataFrame:
    """Share of well-sampled funders per rug-rate band; every band reports the same total."""
    r = F.col("rug_rate")
    band = F.when(r >= 0.65, "high").when(r >= 0.35, "mid").otherwise("low")
    big = reputation.filter(F.col("n") >= min_coins)
    total = big.agg(F.count("*").alias("n"))
    hits = big.groupBy(band.alias("label")).agg(F.count("*").alias("hits"))
    base = reputation.sparkSession.createDataFrame([("high",), ("mid",), ("low",)], "label string")
    j = base.join(hits, "label", "left").join(F.broadcast(total)).withColumn("hits", F.coalesce("hits", F.lit(0)))
    return _result(j, "funder_rug")


def mean_lag(lags: DataFrame) -> DataFrame:
    g = lags.agg(F.count("*").alias("n"), F.sum("lag").alias("hits")).withColumn("label", F.lit("avg_detection_lag_seconds"))
    return _result(g, "detection_lag")


def insight_buckets(feed: DataFrame) -> DataFrame:
    """Unpivots the variables into buckets and counts outcomes per (variable, bucket) in one pass."""
    s, f, sm = F.col("supply_pct"), F.col("funder_rug_rate"), F.coalesce("smart_money_count", F.lit(0))
    exprs = {
        "team_supply": F.when(s < 20, "0-20%").when(s < 35, "20-35%").when(s < 50, "35-50%").when(s >= 50, "50%+"),
        "smart_money": F.when(sm == 0, "0").when(sm == 1, "1").otherwise("2+"),
        "sniper": F.when(F.col("is_bc_sniper") == 1, "sniper").when(F.col("is_bc_sniper") == 0, "not sniper"),
        "signal_1h": F.col("signal_1h"), "signal_4h": F.col("signal_4h"), "verdict": F.col("verdict"),
        "funder_rug": F.when(f < 0.2, "0-20%").when(f < 0.5, "20-50%").when(f < 0.8, "50-80%").when(f >= 0.8, "80-100%"),
        "detection": F.when(F.col("detection_lag_seconds") < 0, "REST poll").otherwise("WebSocket"),
    }
    cells = F.array(*[F.struct(F.lit(k).alias("variable"), v.alias("bucket")) for k, v in exprs.items()])
    long = feed.filter("outcome IS NOT NULL").select("outcome", F.inline(cells)).filter("bucket IS NOT NULL")
    rate = lambda o: (F.count_if(F.col("outcome") == o) / F.count("*"))
    return long.groupBy("variable", "bucket").agg(F.count("*").alias("n"), rate("rug").alias("rug_rate"), rate("moon").alias("moon_rate"))


def insight_strength(buckets: DataFrame) -> DataFrame:
    """Spread of rug rates over buckets with enough rows, graded strong to insufficient."""
    ok = F.when(F.col("n") >= MIN_BUCKET, F.col("rug_rate"))
    g = buckets.groupBy("variable").agg(
        F.sum("n").alias("total_n"), F.when(F.count(ok) >= 2, F.max(ok) - F.min(ok)).otherwise(0.0).alias("spread"))
    grade = (F.when(F.col("total_n") < MIN_TOTAL, "insufficient").when(F.col("spread") >= 0.30, "strong")
             .when(F.col("spread") >= 0.15, "moderate").otherwise("weak"))
    return g.withColumn("predictive", grade)


def stamp_flags(tape: DataFrame, team: DataFrame, snipers: DataFrame, smart: DataFrame) -> DataFrame:
    """Recomputes is_team, is_sniper and is_smart_money on the tape from the current sets."""
    key = ["token_mint", "signer"]
    mark = lambda df, name: df.select("token_mint", F.col("wallet").alias("signer"), F.lit(1).alias(name))
    j = (tape.drop("is_team", "is_sniper", "is_smart_money").join(mark(team, "is_team"), key, "left")
         .join(mark(snipers, "is_sniper"), key, "left")
         .join(smart.select(F.col("wallet").alias("signer"), F.lit(1).alias("is_smart_money")), "signer", "left"))
    return j.fillna(0, ["is_team", "is_sniper", "is_smart_money"])


def verified_account(verified, followers):
    """A verified account with at least 5,000 followers."""
    return F.coalesce(verified, F.lit(False)) & (F.coalesce(followers, F.lit(0)) >= 5000)


def summary_metadata(coins: DataFrame, red: list, green: list) -> DataFrame:
    """Confidence and suggested position of a coin from its red and green signs."""
    total = lambda signs: sum((F.coalesce(s.cast("int"), F.lit(0)) for s in signs), F.lit(0))
    r, g = F.col("red"), F.col("green")
    # one red sign without a green one is medium: low needs none at all, or two against none
    conf = F.when((r == 0) & (g >= 2), "high").when((g == 0) & (r != 1), "low").otherwise("med")
    return coins.select("token_mint", total(red).alias("red"), total(green).alias("green")).select(
        "token_mint", conf.alias("confidence"), F.round(F.greatest(F.lit(0.5), F.least(F.lit(5.0), 3.0 + g * 0.5 - r)), 1).alias("position_pct"))
