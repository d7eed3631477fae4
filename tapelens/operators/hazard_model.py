"""The pair of discrete-time hazards: first team sell (A) and collapse (B), fitted, composed and stored.

Both are logistic models on person-period rows with statics of the snapshot. Folds are cut by coin in
order of the anchor, so no coin has rows on both sides. At the anchor (T0) the covariates that vary in
time stand at the training medians of their interval, and the incidence of A is composed with B as
the competing risk; at a checkpoint the landmark row gives both hazards of the next interval.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelens.operators import evaluation as ev
from tapelens.operators import hazard, models
from tapelens.session import stored
from tapelens.sources.model_store import ModelStore

STATICS = ["team_supply_pct", "unique_bc_buyers", "top3_holder_pct", "graph_rug_hits", "launches_24h", "smart_money_count"]
TV = ["tv_trades", "tv_wallets", "tv_price_vs_first", "tv_drawdown", "tv_net_flow_recent", "tv_log_t"]
B_EXTRA = ["b_team_exited", "b_log_t_since_exit", "b_team_sellers", "b_log_prints"]
HORIZONS_S = (300, 600, 1200, 2400, 3600)
#: Gates: coins of the first training block and of a test block, events of a fit, coins of a quoted
#: horizon, and what a stored pair needs.
MIN_TRAIN_COINS, MIN_TEST_COINS, MIN_EVENTS, MIN_AT_RISK, MIN_EVENTS_A, MIN_COINS = 60, 10, 15, 30, 100, 150


@dataclass
class Pair:
    exit: models.Head
    collapse: models.Head
    medians: DataFrame  # interval_idx, TV and b_log_prints: one row an interval


def design(periods: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Person-period rows with the statics of their coin."""
    return periods.join(snapshot.select("token_mint", *STATICS), "token_mint", "left")


def interval_medians(a_rows: DataFrame) -> DataFrame:
    """Medians of the covariates of each interval; an interval without rows stands at zero."""
    named = a_rows.groupBy("interval_idx").agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, 10_000).alias(c) for c in (*TV, "b_log_prints")])
    grid = a_rows.sparkSession.range(hazard.N_INT).select(F.col("id").cast("int").alias("interval_idx"))
    return grid.join(named, "interval_idx", "left").fillna(0.0)


def fit_pair(rows: DataFrame, min_events: int = MIN_EVENTS) -> Pair | None:
    """Both hazards of a block of coins, or None when one of them has too few events."""
    events = {r.model: r.n for r in rows.groupBy("model").agg(F.sum("event").alias("n")).collect()}
    if min(events.get("A") or 0, events.get("B") or 0) < min_events:
        return None
    a, b = rows.filter("model = 'A'"), rows.filter("model = 'B'")
    head_a, head_b = models.fit(a, STATICS + TV, "event", indicators=[]), models.fit(b, STATICS + TV + B_EXTRA, "event", indicators=[])
    head_a.meta = {"events": int(events["A"]), "events_per_column": events["A"] / len(head_a.columns())}
    head_b.meta = {"events": int(events["B"]), "events_per_column": events["B"] / len(head_b.columns())}
    return Pair(head_a, head_b, stored(interval_medians(a), "interval-medians"))


def t0_rows(statics: DataFrame, medians: DataFrame) -> DataFrame:
    """The design of coins at their anchor: every interval at its training medians, the team still in."""
    starts = F.array(*map(F.lit, hazard.GRID))
    grid = medians.withColumn("t_start", F.element_at(starts, F.col("interval_idx") + 1)).withColumns({c: F.lit(0.0) for c in B_EXTRA if c != "b_log_prints"})
    every = F.explode(F.sequence(F.lit(0), F.lit(hazard.N_INT - 1))).alias("interval_idx")
    return statics.select("token_mint", *STATICS, every).join(F.broadcast(grid), "interval_idx")  # one row an interval of the fixed grid


def t0_incidence(pair: Pair, statics: DataFrame, horizons: tuple[int, ...] = HORIZONS_S) -> DataFrame:
    """(token_mint, horizon_s, cif): chance at the anchor that the team sells before the horizon."""
    rows = t0_rows(statics, pair.medians)
    both = pair.collapse.score(pair.exit.score(rows, "ha", "ha_cal").drop("ha_cal"), "hd", "hd_cal").select("token_mint", "t_start", "ha", "hd")
    both = stored(both, "t0-hazards")
    return reduce(DataFrame.unionByName, [hazard.cumulative_incidence(both, h).select("token_mint", F.lit(h).alias("horizon_s"), "cif") for h in horizons])


def exits_by_horizon(periods: DataFrame, horizons: tuple[int, ...] = HORIZONS_S) -> DataFrame:
    """(token_mint, horizon_s, exited) of the coins whose tape tells: they sold before, or were seen that long."""
    a = F.col("model") == "A"
    seen = periods.groupBy("token_mint").agg(F.max("t_end").alias("span"), F.min(F.when(a & (F.col("event") == 1), F.col("t_start"))).alias("x"), F.max(a.cast("int")).alias("at_risk")).filter("at_risk = 1")
    at = seen.select("*", F.explode(F.array(*map(F.lit, horizons))).alias("horizon_s"))
    exited = F.coalesce(F.col("x") < F.col("horizon_s"), F.lit(False))
    return at.filter(exited | (F.col("span") >= F.col("horizon_s"))).select("token_mint", "horizon_s", exited.cast("int").alias("exited"))


def walk_forward(rows: DataFrame, coins: DataFrame, folds: int = 5, min_train_coins: int = MIN_TRAIN_COINS) -> tuple[DataFrame, DataFrame] | None:
    """(interval predictions, T0 incidences) of the test coins of every fold that meets the gates.

    `coins`: token_mint, grad and the statics. Each fold is fitted on the coins before it alone.
    """
    placed = stored(ev.walk_forward_folds(coins, "grad", "token_mint", 30, folds=folds), "hazard-coins")
    n = {r.fold: r["count"] for r in placed.groupBy("fold").count().collect()}
    own = stored(rows.join(placed.select("token_mint", "fold"), "token_mint"), "hazard-rows")
    intervals, t0 = [], []
    for k in range(folds):
        if sum(v for f, v in n.items() if f < k) < min_train_coins or n.get(k, 0) < MIN_TEST_COINS:
            continue
        pair = fit_pair(own.filter(F.col("fold") < k))
        if pair is None:
            continue
        test = own.filter((F.col("fold") == k) & (F.col("model") == "A"))
        intervals.append(stored(pair.exit.score(test).select("fold", "token_mint", "interval_idx", "p", "event"), "hazard-intervals"))
        t0.append(stored(t0_incidence(pair, placed.filter(F.col("fold") == k).join(test.select("token_mint").distinct(), "token_mint", "left_semi")).withColumn("fold", F.lit(k)), "hazard-t0"))
    if not intervals:
        return None
    return reduce(DataFrame.unionByName, intervals), reduce(DataFrame.unionByName, t0)


def t0_report(t0: DataFrame, observed: DataFrame, min_at_risk: int = MIN_AT_RISK) -> DataFrame:
    """(horizon_s, n, base_rate, auc); a horizon with too few coins is listed but not quoted."""
    j = stored(t0.join(observed, ["token_mint", "horizon_s"]), "t0-observed")
    g = j.groupBy("horizon_s").agg(F.count("*").alias("n"), F.avg("exited").alias("base_rate"))
    a = ev.roc_auc(j, ["horizon_s"], "cif", "exited").select("horizon_s", "auc")
    return g.join(a, "horizon_s", "left").withColumn("auc", F.when(F.col("n") >= min_at_risk, F.col("auc")))


def save_pair(store: ModelStore, version: int, rows: DataFrame, min_events: int = MIN_EVENTS_A, min_coins: int = MIN_COINS) -> Pair | None:
    """Fit on all coins and write the artifact, if the gates on events and coins are met."""
    coins = rows.select("token_mint").distinct().count()
    events = rows.filter("model = 'A'").agg(F.sum("event")).first()[0] or 0
    if events < min_events or coins < min_coins or (pair := fit_pair(rows)) is None:
        return None
    medians = [r.asDict() for r in pair.medians.orderBy("interval_idx").collect()]  # one row an interval
    store.save(version, {"exit": pair.exit, "collapse": pair.collapse}, kind="hazard-pair", grid=hazard.GRID, medians=medians, coins=coins)
    return pair


def load_pair(store: ModelStore) -> Pair | None:
    """The pair in force, from the stored artifact alone."""
    meta = store.meta()
    if meta is None:
        return None
    heads = store.heads()
    frame = store.spark.createDataFrame([tuple(m[c] for c in ("interval_idx", *TV, "b_log_prints")) for m in meta["medians"]],
                                        "interval_idx int, " + ", ".join(f"{c} double" for c in (*TV, "b_log_prints")))
    return Pair(heads["exit"], heads["collapse"], frame)


def score_landmark(pair: Pair, landmark: DataFrame, snapshot: DataFrame, checkpoint_s: int, version: int) -> DataFrame:
    """(token_mint, mode, checkpoint_s, p_exit, p_collapse, team_exited, model_version) of coins at a checkpoint."""
    rows = landmark.join(snapshot.select("token_mint", *STATICS), "token_mint", "left")
    both = pair.collapse.score(pair.exit.score(rows, "ha", "ha_cal"), "hb", "hb_cal")
    return both.select("token_mint", F.lit("LANDMARK").alias("mode"), F.lit(checkpoint_s).alias("checkpoint_s"), F.round("ha", 4).alias("p_exit"), F.round("hb", 4).alias("p_collapse"),
                       F.col("b_team_exited").alias("team_exited"), F.lit(version).cast("long").alias("model_version"))


def persist(predictions: DataFrame, folder: str) -> None:
    """Replace the rows of each (mode, checkpoint) by new ones; other checkpoints keep their files."""
    predictions.repartition("mode", "checkpoint_s").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("mode", "checkpoint_s").parquet(folder)
