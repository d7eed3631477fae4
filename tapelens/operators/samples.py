"""Evaluation samples: frozen snapshots joined with the labels that came after them, behind population gates.

Every gate is a keyed join or a predicate on one row per coin; nothing is grouped across coins. The
feature side is the snapshot at the anchor alone, labels are separate columns per horizon.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelens.functions.columns import quotient

HORIZONS = (1, 4, 24)
#: Seconds within which the first print must follow the anchor, else every label has a wrong zero.
MAX_ANCHOR_LAG_S = 120
CLASSIC, MAYHEM = ("pump.fun",), ("mayhem",)
BOTH = CLASSIC + MAYHEM
SELLING = ("DISTRIBUTING", "DUMPED")
#: Snapshot columns that are results or identity, never features.
OUTPUTS = ("token_mint", "graduated_at", "verdict", "confidence", "score", "signal", "hard_skip", "factors")


def eligible(coins: DataFrame, platform: DataFrame, manufactured: DataFrame, first_prices: DataFrame, platforms: tuple[str, ...] = BOTH,
             max_lag_s: int = MAX_ANCHOR_LAG_S) -> DataFrame:
    """(token_mint, grad, platform) of the coins that may be labelled.

    Only a positively verified platform counts, a manufactured launch has no market to label, and the
    tape must open at the anchor that it claims.
    """
    known = coins.select("token_mint", F.col("graduated_at").alias("grad")).join(platform.filter(F.col("platform").isin(*platforms)), "token_mint")
    opened = first_prices.select("token_mint", "first_ts")
    real = manufactured.filter("is_manufactured = 1").select("token_mint")
    lag = F.col("first_ts") - F.col("grad")
    return known.join(opened, "token_mint").filter(lag.between(0, max_lag_s)).join(real, "token_mint", "left_anti").select("token_mint", "grad", "platform")


def labels_by_horizon(behavior: DataFrame, outcomes: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """One row per coin: dist_h (insiders are selling), out_h and multiple_h of every check that has run."""
    at = lambda h, c: F.max(F.when(F.col("check_offset_h") == h, c))
    selling = F.col("signal").isin(*SELLING).cast("int")
    d = behavior.groupBy("token_mint").agg(*[at(h, selling).alias(f"dist_{h}") for h in horizons])
    o = outcomes.groupBy("token_mint").agg(
        *[at(h, F.col("classified")).alias(f"out_{h}") for h in horizons], *[at(h, quotient(F.col("price"), F.col("launch_price"))).alias(f"multiple_{h}") for h in horizons])
    return d.join(o, "token_mint", "full")


def labelled(snapshot: DataFrame, coins: DataFrame, labels: DataFrame) -> DataFrame:
    """Eligible coins that have a snapshot, with all its columns; a label is null until its check has run."""
    return coins.join(snapshot.drop("graduated_at"), "token_mint").join(labels, "token_mint", "left")


def at_horizon(samples: DataFrame, h: int) -> DataFrame:
    """Samples whose checks at +h hours have run, with y (insiders sell), outcome and multiple."""
    gone = [f"{p}_{k}" for p in ("dist", "out", "multiple") for k in HORIZONS]
    named = samples.withColumns({"y": F.col(f"dist_{h}"), "outcome": F.col(f"out_{h}"), "multiple": F.col(f"multiple_{h}")})
    return named.drop(*gone).filter("y IS NOT NULL AND outcome IS NOT NULL")


def feature_names(snapshot: DataFrame, drop: tuple[str, ...] = ()) -> list[str]:
    """Numeric columns of a snapshot in order of name, found from its schema."""
    numeric = ("int", "bigint", "double", "float", "smallint", "tinyint")
    return sorted(n for n, kind in snapshot.dtypes if (kind in numeric or kind.startswith("decimal")) and n not in OUTPUTS and n not in drop)
