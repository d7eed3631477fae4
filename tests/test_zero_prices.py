"""Prints at price zero are prints, and a rate of nothing is no error."""

import math

from tapelens.functions.ordered import grouped_median
from tapelens.operators import evaluation as ev
from tapelens.operators import hazard, labels
from tapelens.plans import audits
from tapelens.plans import evaluation as pe
from tapelens.plans.registry import QUERIES


def team_of(spark, *wallets):
    return spark.createDataFrame([("m", w, 1.0) for w in wallets] or [("none", "none", 1.0)], "token_mint string, wallet string, amount double")


def test_trajectory_counts_zero_prices(spark, tape):
    r = labels.trajectory(tape([(0, "buy", "a", 1, 1), (5, "buy", "b", 0, 0), (9, "buy", "c", 1, 1)]), team_of(spark)).first()
    assert (r.n_price_points, r.time_to_collapse_s, r.peak_price) == (3, 5.0, 0.0)
    r = labels.trajectory(tape([(0, "buy", "a", 0, 0), (5, "buy", "b", 1, 2), (6, "buy", "b", 1, 2), (9, "buy", "c", 1, 2)]), team_of(spark)).first()
    assert (r.first_price, r.peak_price, r.time_to_collapse_s) == (0.0, 0.0, None) and math.isnan(r.peak_multiple)


def test_hazard_counts_zero_prices(spark, tape):
    df = tape([(0, "buy", "a", 1, 1), (1, "buy", "b", 0, 0), (2, "buy", "c", 1, 3), (40, "buy", "d", 0, 0), (41, "buy", "d", 0, 0)])
    anchors = hazard.robust_anchor(df)
    assert anchors.first().anchor == 1.0
    assert hazard.collapse_events(df, anchors).first().collapse_s == 1
    at60 = next(r for r in hazard.edge_covariates(df, team_of(spark), anchors).collect() if r.t_start == 60)
    assert (at60.tv_price_vs_first, at60.tv_drawdown, at60.b_log_prints) == (0.0, 1.0, round(math.log(6), 9))


def test_alarm_at_price_zero(spark, tape):
    prints = tape([(0, "sell", "a", 0, 0), (50, "buy", "b", 1, 2), (200, "buy", "b", 1, 2)]).select("token_mint", "ts", "tx_signature", "price_usd")
    alarms = spark.createDataFrame([("m", 0)], "token_mint string, alert_ts long")
    r = ev.grade_exit_alarms(alarms, prints, 100).first()
    assert (r.outcome, r.price_ratio, r.saved_pct) == ("ungradable", math.inf, -math.inf)
    rows = spark.createDataFrame([(v,) for v in (-math.inf, 1.0, 3.0, math.inf, math.nan)], "v double").selectExpr("1 AS g", "v")
    assert grouped_median(rows, ["g"], "v", "m").first().m == 3.0


def test_audits_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(pe, "risk", lambda t: spark.createDataFrame([], "p double"))
    r = QUERIES["audit_prewarn_fire_rate"].build(None).first()
    assert (r.n, math.isnan(r.fire_rate), r.ok) == (0, True, 0)
    monkeypatch.setattr(audits.pe, "alarm_grades", lambda t: spark.createDataFrame([], "saved_pct double"))
    assert [tuple(r) for r in QUERIES["audit_exit_value"].build(None).collect()] == [(0, None, None)]
