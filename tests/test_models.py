"""Model heads, their store, the hazard pair and evaluation samples against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapelens.operators import evaluation as ev
from tapelens.operators import hazard, hazard_model, models
from tapelens.operators import samples as S
from tapelens.plans import evaluation as pe
from tapelens.sources.model_store import ModelStore, artifact_checks
from tapelens.sources.tables import Tables


def rows_of(spark, n=300, seed=1):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        a, b = rng.random(), rng.choice([None, rng.random() * 100])
        data.append((f"c{i:04d}", i // 2, a, b, None, int(rng.random() < 1 / (1 + math.exp(-6 * (a - 0.5))))))
    return spark.createDataFrame(data, "sample_id string, grad long, a double, b double, never double, y int"), data


@pytest.fixture
def fits(monkeypatch):
    """(ids, kind, trees) of each fit; boosted trees are replaced by a logistic model to keep the test short."""
    seen, fit = [], models.fit

    def record(df, features, label, kind="logistic", trees=300, indicators=None):
        seen.append((sorted(r.sample_id for r in df.select("sample_id").collect()), kind, trees))
        return fit(df, features, label, indicators=indicators)

    monkeypatch.setattr(models, "fit", record)
    return seen


def test_folds_calibrate_on_the_last_fifth_in_time(spark, fits):
    df, data = rows_of(spark)
    placed = ev.walk_forward_folds(df, "grad", "sample_id", 30, folds=5)
    pred = models.walk_forward(placed, ["a", "b", "never"], "y", "gbm", 5, "platt").collect()
    order = [d[0] for d in sorted(data, key=lambda d: (d[1], d[0]))]
    sizes = [120 + 36 * k for k in range(5)]
    assert {(r.sample_id, r.fold) for r in pred} == {(s, k) for k in range(5) for s in order[sizes[k] : sizes[k] + 36]}
    want = sorted([(sorted(order[:n]), "gbm", 300) for n in sizes] + [(sorted(order[: int(n * 0.8)]), "gbm", 300) for n in sizes])
    assert sorted(fits) == want
    assert all(0 <= r.p_cal <= 1 for r in pred) and ev.roc_auc(spark.createDataFrame(pred), [], "p", "y").first().auc > 0.7


def test_short_folds_are_left_out(spark, fits):
    df, _ = rows_of(spark, 60)
    placed = ev.walk_forward_folds(df, "grad", "sample_id", 30, folds=5)
    assert models.walk_forward(placed, ["a"], "y", "logistic", 5).count() == 0 and fits == []


def test_columns_are_filled_scaled_and_cut(spark):
    df, data = rows_of(spark)
    head = models.fitted_columns(df, ["a", "b", "never"], "logistic")
    assert head.features == ["a", "b"] and head.columns() == ["a", "b", "a_missing", "b_missing"]
    b = sorted(d[3] for d in data if d[3] is not None)
    assert head.median[1] in b and abs(head.median[1] - np.median(b)) < 3
    filled = np.array([head.median[1] if d[3] is None else d[3] for d in data])
    assert head.mean[1] == pytest.approx(filled.mean()) and head.sd[1] == pytest.approx(filled.std())
    from pyspark.ml.functions import vector_to_array
    far = spark.createDataFrame([(1e9, -1e9), (None, None)], "a double, b double").select(vector_to_array(head.vector()).alias("v")).collect()
    assert far[0].v[:2] == [5.0, -5.0] and far[1].v[3] == pytest.approx((1 - head.mean[3]) / head.sd[3])


def test_boosted_head_and_threshold(spark):
    df, _ = rows_of(spark, 200)
    assert models.train_head(df, ["a", "b"], "y", trees=3, min_rows=201) is None
    head = models.train_head(df, ["a", "b"], "y", trees=3, min_rows=200, precision=0.6)
    assert head.model.getNumTrees == 3 and head.meta["n"] == 200 and 0 <= head.threshold <= 1


def test_store_scores_from_the_artifact_and_moves_only_on_a_clean_audit(spark, tmp_path):
    df, _ = rows_of(spark)
    store = ModelStore(spark, str(tmp_path / "models"))
    assert store.current() is None and store.scored(df).filter("model_version IS NOT NULL").count() == 0
    clean, damaged = (spark.createDataFrame([(1,), (ok,)], "ok int") for ok in (1, 0))
    first = models.train_head(df.filter("grad < 100"), ["a", "b"], "y", kind="logistic", min_rows=100, precision=0.5)
    store.save(1, {"risk": first}, population=["x"])
    assert store.current() is None and store.promote(1, clean) and store.current() == 1
    store.save(2, {"risk": models.train_head(df, ["a"], "y", kind="logistic", min_rows=100)})
    assert not store.promote(2, damaged)
    again = ModelStore(spark, str(tmp_path / "models"))
    assert again.current() == 1 and again.meta()["heads"]["risk"]["features"] == ["a", "b"]
    want = {r.sample_id: round(r.p_cal, 4) for r in first.score(df).collect()}
    got = again.scored(df).collect()
    assert {r.sample_id: r.p_risk for r in got} == want and {r.model_version for r in got} == {1}
    assert all(r.alert_risk == int(r.p_risk >= first.threshold) for r in got)
    assert again.promote(2, clean) and again.current() == 2


def test_artifact_checks_find_forbidden_heads_and_features(spark):
    meta = {"heads": {"rug": {"features": ["a", "e5_flow"]}}}
    got = {r.check: r.ok for r in artifact_checks(meta, {"heads": {"pump": {"features": []}}}, spark).collect()}
    assert got == {"model_present": 1, "no_late_features": 0, "early_heads_allowed": 0}


def test_hazard_folds_share_no_coin_and_compose_as_stated(spark):
    rng = random.Random(4)
    periods, coins = [], []
    for c in range(100):
        risk = rng.random()
        coins.append((f"m{c:02d}", c * 10) + (risk * 50, 5.0, 20.0, 0, 0, 0))
        gone = False
        for i in range(12):
            event = int(not gone and rng.random() < 0.02 + 0.2 * risk)
            if not gone:
                periods.append(("A", f"m{c:02d}", i, hazard.GRID[i], hazard.GRID[i + 1], event, i, 2, 1.0, 0.1, 0.0, float(i), 0, 0.0, 0, 1.0))
            periods.append(("B", f"m{c:02d}", i, hazard.GRID[i], hazard.GRID[i + 1], int(rng.random() < 0.1), i, 2, 1.0, 0.1, 0.0, float(i), int(gone), 0.0, 0, 1.0))
            gone |= bool(event)
    names = "model string, token_mint string, interval_idx int, t_start int, t_end int, event int, tv_trades int, tv_wallets int, tv_price_vs_first double, tv_drawdown double, tv_net_flow_recent double, tv_log_t double, b_team_exited int, b_log_t_since_exit double, b_team_sellers int, b_log_prints double"
    statics = spark.createDataFrame(coins, "token_mint string, grad long, team_supply_pct double, unique_bc_buyers double, top3_holder_pct double, graph_rug_hits int, launches_24h int, smart_money_count int")
    rows = hazard_model.design(spark.createDataFrame(periods, names), statics)
    intervals, t0 = hazard_model.walk_forward(rows, statics, min_train_coins=30)
    tested = {(r.fold, r.token_mint) for r in intervals.select("fold", "token_mint").distinct().collect()}
    assert {f for f, _ in tested} == {0, 1, 2, 3, 4} and all(int(m[1:]) >= 40 + 12 * f for f, m in tested) and len(tested) == len({m for _, m in tested})
    assert ev.roc_auc(intervals, [], "p", "event").first().auc > 0.6
    by_coin = {}
    for r in t0.collect():
        by_coin.setdefault(r.token_mint, {})[r.horizon_s] = r.cif
    assert all(0 <= v[300] <= v[600] <= v[3600] <= 1 for v in by_coin.values())
    pair = hazard_model.fit_pair(rows)
    one = hazard_model.t0_rows(statics.filter("token_mint = 'm05'"), pair.medians)
    h = sorted((r.t_start, r.ha, r.hd) for r in pair.collapse.score(pair.exit.score(one, "ha", "x"), "hd", "z").collect())
    surv, cif = 1.0, 0.0
    for t, a, d in h:
        if t < 600:
            cif, surv = cif + surv * a, surv * (1 - a - d)
    assert hazard_model.t0_incidence(pair, statics.filter("token_mint = 'm05'"), (600,)).first().cif == pytest.approx(cif)


def test_hazard_pair_gates_and_artifact(spark, tmp_path):
    t = Tables(spark, "/root/testdata/sf0.01", "e")
    rows = hazard_model.design(pe.periods(t), pe.context(t))
    store = ModelStore(spark, str(tmp_path / "pair"))
    assert hazard_model.save_pair(store, 1, rows, min_coins=10**6) is None and hazard_model.load_pair(store) is None
    pair = hazard_model.save_pair(store, 1, rows, min_events=1, min_coins=1)
    store.promote(1, spark.createDataFrame([(1,)], "ok int"))
    statics = pe.context(t).limit(20)
    a, b = ({(r.token_mint, r.horizon_s): r.cif for r in hazard_model.t0_incidence(p, statics).collect()} for p in (pair, hazard_model.load_pair(store)))
    assert a == pytest.approx(b) and len(a) > 0


def test_persisted_scores_replace_only_their_checkpoint(spark, tmp_path):
    make = lambda c, p: spark.createDataFrame([("m", "LANDMARK", c, p)], "token_mint string, mode string, checkpoint_s int, p_exit double")
    out = str(tmp_path / "scores")
    hazard_model.persist(make(120, 0.1), out)
    hazard_model.persist(make(300, 0.2), out)
    hazard_model.persist(make(120, 0.3), out)
    assert {(r.checkpoint_s, r.p_exit) for r in spark.read.parquet(out).collect()} == {(120, 0.3), (300, 0.2)}


def test_gates_of_the_evaluation_set(spark):
    coins = spark.createDataFrame([(m, 100) for m in "abcdef"], "token_mint string, graduated_at long")
    platform = spark.createDataFrame([("a", "pump.fun"), ("b", "mayhem"), ("c", None), ("d", "other"), ("e", "pump.fun"), ("f", "pump.fun")], "token_mint string, platform string")
    made = spark.createDataFrame([("a", 0), ("b", 0), ("e", 1), ("f", 0)], "token_mint string, is_manufactured int")
    first = spark.createDataFrame([("a", 100), ("b", 220), ("e", 101), ("f", 221)], "token_mint string, first_ts long")
    assert {r.token_mint for r in S.eligible(coins, platform, made, first).collect()} == {"a", "b"}
    assert {r.token_mint for r in S.eligible(coins, platform, made, first, S.CLASSIC).collect()} == {"a"}


def test_labels_stay_apart_and_wait_for_their_check(spark):
    behavior = spark.createDataFrame([("a", 1, "HOLDING"), ("a", 4, "DUMPED"), ("b", 1, "DISTRIBUTING")], "token_mint string, check_offset_h int, signal string")
    outcomes = spark.createDataFrame([("a", 4, 0.2, 1.0, "rug")], "token_mint string, check_offset_h int, price double, launch_price double, classified string")
    snap = spark.createDataFrame([("a", 1, 2.5, "x"), ("b", 1, None, "y")], "token_mint string, graduated_at long, f double, name string")
    coins = spark.createDataFrame([("a", 1, "pump.fun"), ("b", 1, "pump.fun")], "token_mint string, grad long, platform string")
    rows = S.labelled(snap, coins, S.labels_by_horizon(behavior, outcomes))
    got = {r.token_mint: r for r in rows.collect()}
    assert (got["a"].dist_1, got["a"].dist_4, got["a"].dist_24, got["a"].out_4, got["a"].multiple_4) == (0, 1, None, "rug", 0.2)
    assert got["b"].dist_1 == 1 and got["b"].out_4 is None
    assert [(r.token_mint, r.y, r.outcome) for r in S.at_horizon(rows, 4).collect()] == [("a", 1, "rug")]
    assert S.feature_names(snap) == ["f"]


def test_twins_name_the_features_of_the_snapshot(spark):
    assert S.feature_names(pe.context(Tables(spark, "/root/testdata/sf0.001", "t"))) == pe.FEATURES
