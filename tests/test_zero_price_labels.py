"""A print at price zero is a print for the label heads, the hazard rows and the trajectories of record."""

from pyspark.sql import functions as F

from tapelens.operators import hazard, labels
from tapelens.streaming import checks


def market(tape):
    """Forty seconds of steady prints; only those at price zero lie below half of the first one."""
    return tape([(s, "buy", f"w{s}", 1, 0 if s in (20, 21, 22) else 1) for s in range(40)])


def team_of(spark):
    return spark.createDataFrame([("m", "none", 1.0)], "token_mint string, wallet string, amount double")


def test_label_heads_count_zero_prices(spark, tape):
    r = labels.label_heads(labels.anchor_gated(labels.trajectory(market(tape), team_of(spark)))).first()
    assert (r.survive60, r.fastrug, r.survive60_censored) == (0, 1, 0)


def test_person_periods_count_zero_prices(spark, tape):
    df, team = market(tape), team_of(spark)
    anchors = hazard.robust_anchor(df)
    events = labels.trajectory(df, team).join(hazard.collapse_events(df, anchors), "token_mint", "left").select(
        "token_mint", F.col("time_to_team_exit_s").alias("exit_s"), F.col("collapse_s").cast("double").alias("collapse_s"), F.col("tape_span_s").alias("span_s"))
    rows = hazard.person_periods(hazard.edge_covariates(df, team, anchors), events).collect()
    assert [(r.model, r.t_start, r.event) for r in rows] == [("B", 0, 1)]


def test_final_trajectory_counts_zero_prices(spark, tape):
    done = spark.createDataFrame([("m", 24, 1.0, 1.0, True)], checks.CHECKS)
    r = checks.finalised(done, market(tape), team_of(spark)).first()
    assert (r.n_price_points, r.time_to_collapse_s, r.collapsed) == (40, 20.0, 1)
