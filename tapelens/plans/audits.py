"""Registered audit, operations, repair and model queries with SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelens.functions.columns import quotient
from tapelens.operators import evaluation as ev
from tapelens.operators import flow, hazard, hazard_model, labels, memory, models, quality
from tapelens.plans import evaluation as pe
from tapelens.plans.features import attribution
from tapelens.plans.ingest import matches  # noqa: F401
from tapelens.plans.memory import context, graded
from tapelens.plans.registry import cte, dsum, query
from tapelens.plans.teams import scored
from tapelens.session import cut, shared_path, stored
from tapelens.sources.model_store import ModelStore, artifact_checks
from tapelens.sources.tables import ANCHOR_DELAY, Tables
from tapelens.streaming import checks, jobs

q = quality.check


# Recorded rows with a fixed share of damage, so that every check has something to find.
cte("t_rec_post", "SELECT * REPLACE (CASE WHEN CAST(split_part(tx_signature, '-', 1) AS BIGINT) % 97 = 0 THEN graduated_at - 61 ELSE ts END AS ts) FROM t_post")
cte("t_rec_coins", "SELECT * REPLACE (CASE WHEN CAST(token_mint AS BIGINT) % 50 = 0 THEN graduated_at + 1 ELSE created_at END AS created_at) FROM t_coins")
cte("t_rec_held", "SELECT * REPLACE (CASE WHEN CAST(token_mint AS BIGINT) % 40 = 0 THEN pct * 1.5::DOUBLE ELSE pct END AS pct) FROM t_held")


def recorded(t: Tables):
    """(post rows, coins, holders) with rows before the anchor, late creation times and shares over 100 %."""
    order, mint = F.split("tx_signature", "-")[0].cast("long"), F.col("token_mint").cast("long")
    post = t.post.withColumn("ts", F.when(order % 97 == 0, F.col("graduated_at") - 61).otherwise(F.col("ts")))
    coins = t.coins.withColumn("created_at", F.when(mint % 50 == 0, F.col("graduated_at") + 1).otherwise(F.col("created_at")))
    held = t.held.withColumn("pct", F.when(mint % 40 == 0, F.col("pct") * 1.5).otherwise(F.col("pct")))
    return post, coins, held


def audit_rows(t: Tables):
    post, coins, held = recorded(t)
    day = t.coins.join(context(t).select("token_mint", F.lit(1).alias("snap")), "token_mint", "left")
    sums = held.groupBy("token_mint").agg(F.sum(F.col("pct").cast("decimal(28,9)")).cast("double").alias("s"))
    traj = t.trajectory
    choreo = flow.exit_choreography(t.post, t.team).filter("exit_order IS NOT NULL")
    stray = choreo.join(held.filter("pct >= 1").select("token_mint", "wallet", F.lit(1).alias("h")), ["token_mint", "wallet"], "left")
    traced = t.coin_funder.join(t.team.join(t.funding.select("wallet", "funder"), "wallet").select("token_mint", "funder").distinct().withColumn("x", F.lit(1)),
                                ["token_mint", "funder"], "left")
    att = attribution(t)
    return quality.run([
        q(day, "data", "snapshot_coverage", F.col("snap").isNotNull(), 0.90, at_most=False),
        q(post, "data", "rows_before_anchor", F.col("ts") < F.col("graduated_at") - 60, 0.001),
        q(coins, "data", "future_created_at", F.col("created_at") > F.col("graduated_at"), 0.0),
        q(sums, "structure", "supply_over_102", F.col("s") > 102, 0.0), q(t.team_clusters, "structure", "team_size_over_40", F.col("member_count") > 40, 0.0),
        q(stray, "structure", "behavior_row_not_member", F.col("h").isNull(), 0.05),
        q(traced, "structure", "funder_traces_to_member", F.col("x").isNotNull(), 0.80, at_most=False),
        q(att, "labels", "attribution_uncertain", F.col("state") == "uncertain", 0.15),
        q(traj.join(att, "token_mint", "left"), "labels", "attribution_coverage", F.col("state").isNotNull(), 0.95, at_most=False),
        q(traj, "labels", "sustain_rule", (F.col("reached_10x") == 1) & (F.col("n_price_points") < 3), 0.0),
        q(traj, "labels", "thin_tape", F.col("n_price_points") < 30, 0.0),
    ])


@query("audit_checks", sql=f"""SELECT stage, name, n, bad, CASE WHEN (CASE WHEN least_mode = 1 THEN (CASE WHEN n > 0 THEN bad / n ELSE 0 END) <= lim ELSE (CASE WHEN n > 0 THEN bad / n ELSE 0 END) >= lim END) THEN 1 ELSE 0 END AS ok FROM (
SELECT 'data' AS stage, 'snapshot_coverage' AS name, (SELECT count(*) FROM t_coins) AS n, (SELECT count(*) FROM t_ctx) AS bad, 0.9 AS lim, 0 AS least_mode
UNION ALL SELECT 'data', 'rows_before_anchor', (SELECT count(*) FROM t_rec_post), (SELECT count(*) FROM t_rec_post WHERE ts < graduated_at - 60), 0.001, 1
UNION ALL SELECT 'data', 'future_created_at', (SELECT count(*) FROM t_rec_coins), (SELECT count(*) FROM t_rec_coins WHERE created_at > graduated_at), 0, 1
UNION ALL SELECT 'structure', 'supply_over_102', (SELECT count(DISTINCT token_mint) FROM t_rec_held), (SELECT count(*) FROM (SELECT token_mint FROM t_rec_held GROUP BY 1 HAVING {dsum('pct')} > 102)), 0, 1
UNION ALL SELECT 'structure', 'team_size_over_40', (SELECT count(*) FROM t_team_clusters), (SELECT count(*) FROM t_team_clusters WHERE member_count > 40), 0, 1
UNION ALL SELECT 'structure', 'behavior_row_not_member', (SELECT count(*) FROM t_choreo WHERE exit_order IS NOT NULL), (SELECT count(*) FROM t_choreo c WHERE exit_order IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t_rec_held h WHERE h.token_mint = c.token_mint AND h.wallet = c.wallet AND h.pct >= 1)), 0.05, 1
UNION ALL SELECT 'structure', 'funder_traces_to_member', (SELECT count(*) FROM t_coin_funder), (SELECT count(*) FROM t_coin_funder c WHERE EXISTS (SELECT 1 FROM t_team m JOIN t_funding f USING (wallet) WHERE m.token_mint = c.token_mint AND f.funder = c.funder)), 0.8, 0
UNION ALL SELECT 'labels', 'attribution_uncertain', (SELECT count(*) FROM t_attribution), (SELECT count(*) FROM t_attribution WHERE state = 'uncertain'), 0.15, 1
UNION ALL SELECT 'labels', 'attribution_coverage', (SELECT count(*) FROM t_traj), (SELECT count(*) FROM t_traj JOIN t_attribution USING (token_mint)), 0.95, 0
UNION ALL SELECT 'labels', 'sustain_rule', (SELECT count(*) FROM t_traj), (SELECT count(*) FROM t_traj WHERE reached_10x = 1 AND n_price_points < 3), 0, 1
UNION ALL SELECT 'labels', 'thin_tape', (SELECT count(*) FROM t_traj), (SELECT count(*) FROM t_traj WHERE n_price_points < 30), 0, 1)""")
def _(t):
    return audit_rows(t)


@query("audit_member_gate", "e", """SELECT 'structure' AS stage, 'member_gate' AS name, count(*) AS n, count(*) FILTER (gated = 0) AS bad, CASE WHEN count(*) FILTER (gated = 0) / count(*) <= 0.02 THEN 1 ELSE 0 END AS ok
FROM t_scored WHERE score >= 0.35""")
def _(t):
    from tapelens.functions.columns import member_gate

    members = scored(t).filter("score >= 0.35")  # whoever the score alone would admit
    gate = member_gate("overlap", F.col("edge_sources").isNotNull().cast("int"), "funding", "slot_offset")
    return q(members, "structure", "member_gate", ~gate, 0.02)


@query("audit_json_contract", sql="SELECT 'data' AS stage, 'props_is_json_object' AS name, count(*) AS n, count(*) FILTER (NOT json_valid(props) OR json_type(props) <> 'OBJECT') AS bad, 1 AS ok FROM events")
def _(t):
    v = F.try_parse_json("props")
    return q(t.raw("events"), "data", "props_is_json_object", v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), 0.0)


@query("audit_base_rates", "e", """SELECT head, n, rate, CASE WHEN n < 30 THEN 'suspended' WHEN rate BETWEEN lo AND hi THEN 'ok' ELSE 'failed' END AS state FROM (
SELECT 'survive60' AS head, count(survive60) AS n, sum(survive60) / count(survive60) AS rate, 0.02 AS lo, 0.6 AS hi FROM t_heads UNION ALL SELECT 'moon10x', count(moon10x), sum(moon10x) / count(moon10x), 0.005, 0.9 FROM t_heads
UNION ALL SELECT 'fastrug', count(fastrug), sum(fastrug) / count(fastrug), 0.05, 0.95 FROM t_heads UNION ALL SELECT 'team_exit10', count(team_exit10), sum(team_exit10) / count(team_exit10), 0.05, 0.95 FROM t_heads)""")
def _(t):
    heads = labels.label_heads(labels.anchor_gated(t.trajectory))
    return quality.base_rate_bands(heads, {"survive60": (0.02, 0.6), "moon10x": (0.005, 0.9), "fastrug": (0.05, 0.95), "team_exit10": (0.05, 0.95)}, 30)


@query("audit_calibration_gap", sql="""SELECT bin, n, CASE WHEN n >= 30 AND abs(mean_score - hit_rate) > 0.20 THEN 0 ELSE 1 END AS ok FROM (SELECT CAST(least(floor(s * 10), 9) AS INTEGER) AS bin, round(CAST(sum(CAST(s AS DECIMAL(38,12))) AS DOUBLE) / count(*), 9) AS mean_score, sum(y) / count(*) AS hit_rate, count(*) AS n
FROM (SELECT least(score, 1.0) AS s, y FROM t_samples) GROUP BY 1)""")
def _(t):
    b = ev.calibration_bins(pe.samples(t).withColumn("s", F.least("score", F.lit(1.0))), [], "s", "y")
    return b.select("bin", "n", (~((F.col("n") >= 30) & (F.abs(F.col("mean_score") - F.col("hit_rate")) > 0.20))).cast("int").alias("ok"))


@query("audit_prewarn_fire_rate", "e", "SELECT count(*) AS n, count(*) FILTER (p >= 0.3) / count(*) AS fire_rate, CASE WHEN count(*) FILTER (p >= 0.3) / count(*) BETWEEN 0.03 AND 0.40 THEN 1 ELSE 0 END AS ok FROM t_risk")
def _(t):
    rate = quotient(F.count_if(F.col("p") >= 0.3), F.count("*"))  # every coin may have left before the checkpoint
    return pe.risk(t).agg(F.count("*").alias("n"), rate.alias("fire_rate"), rate.between(0.03, 0.40).cast("int").alias("ok"))


@query("audit_exit_value", "e", "SELECT count(saved_pct) AS n, median(saved_pct) AS median_saved, count(*) FILTER (saved_pct > 0) / nullif(count(saved_pct), 0) AS better_off FROM t_graded_alarm")
def _(t):
    g = pe.alarm_grades(t).withColumn("g", F.lit(1))
    from tapelens.functions.ordered import grouped_median

    med = grouped_median(g, ["g"], "saved_pct", "median_saved")
    a = g.agg(F.lit(1).alias("g"), F.count("saved_pct").alias("n"), F.try_divide(F.count_if(F.col("saved_pct") > 0), F.count("saved_pct")).alias("better_off"))
    return a.join(med, "g", "left").select("n", "median_saved", "better_off")


# ── operations ───────────────────────────────────────────────────────────────
@query("ops_feed_gap", "e", "SELECT max(graduated_at) AS last, count(*) FILTER (graduated_at > 4000 - 2400) AS day_n, CASE WHEN 4000 - max(graduated_at) > CASE WHEN count(*) FILTER (graduated_at > 4000 - 2400) >= 50 THEN 400 ELSE 1200 END THEN 1 ELSE 0 END AS alarm FROM t_coins")
def _(t):
    return quality.gap_alarm(t.coins, "graduated_at", 4000, 100)


@query("ops_backlog_hysteresis", sql="""SELECT d, backlog, total, coalesce(last_value(step IGNORE NULLS) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING), 0) AS open FROM (
SELECT *, CASE WHEN backlog > greatest(2.0, total * 0.04) THEN 1 WHEN backlog < greatest(2.0, total * 0.04) * 0.6 THEN 0 END AS step
FROM (SELECT CAST(o_orderdate AS DATE) AS d, count(*) FILTER (o_orderstatus = 'P') AS backlog, count(*) AS total FROM orders GROUP BY 1))""")
def _(t):
    """Opens above the limit, closes below 60 % of it, and keeps the state of the last decisive day between."""
    from tapelens.functions.ordered import split_fill

    o = t.raw("orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count_if(F.col("o_orderstatus") == "P").alias("backlog"), F.count("*").alias("total"))
    o = cut(o.withColumn("step", quality.backlog_state(F.col("backlog"), F.col("total"), F.lit(None), 2.0, 0.04)).withColumn("g", F.lit(1)))
    filled = split_fill(o, ["g"], [F.col("d")], F.year("d"), F.col("step"), "open")
    return filled.select("d", "backlog", "total", F.coalesce("open", F.lit(0)).alias("open"))


@query("ops_budget_pace", sql="SELECT CAST(count(*) AS BIGINT) AS used, round(count(*) / 10 * 30, 4) AS projected, CASE WHEN count(*) / 10 * 30 > 5000 THEN 1 ELSE 0 END AS over FROM events WHERE ts < TIMESTAMP '2024-01-11 00:00:00'")
def _(t):
    d = t.raw("events").filter(F.col("ts") < F.lit("2024-01-11 00:00:00").cast("timestamp_ntz")).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return quality.budget_pace(d, "day", "n", 10, 30, 5000)


cte("t_hb", "SELECT event_type AS name, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS ts, CASE WHEN count(*) % 3 = 0 THEN 0 ELSE 1 END AS ok FROM events GROUP BY 1, 2")


@query("ops_alert_episodes", sql="""SELECT name, ts, ok, CASE WHEN ok = 0 AND new = 1 THEN 'alert' WHEN ok = 0 AND row_number() OVER (PARTITION BY name, span, ok, slot ORDER BY ts) = 1 THEN 'realert' WHEN ok = 1 AND prev = 0 THEN 'recovered' ELSE 'quiet' END AS action FROM (
SELECT *, CASE WHEN ok = 0 THEN floor((ts - min(CASE WHEN ok = 0 THEN ts END) OVER (PARTITION BY name, span)) / 4) END AS slot FROM (SELECT *, sum(new) OVER (PARTITION BY name ORDER BY ts) AS span FROM (
SELECT *, lag(ok) OVER (PARTITION BY name ORDER BY ts) AS prev, CASE WHEN ok = 0 AND coalesce(lag(ok) OVER (PARTITION BY name ORDER BY ts) = 1, true) THEN 1 ELSE 0 END AS new FROM t_hb)))""")
def _(t):
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)
    base = t.raw("events").groupBy(F.col("event_type").alias("name"), hour.alias("ts")).agg(F.when(F.count("*") % 3 == 0, 0).otherwise(1).alias("ok"))
    return quality.alert_episodes(base, 4)


# ── repairs ──────────────────────────────────────────────────────────────────
@query("repair_supply_denominator", sql="""SELECT token_mint, wallet, CASE WHEN s * 1.5 > 102 THEN round(pct * 1.5 * 2.0 / 3.0, 4) ELSE pct * 1.5 END AS pct FROM t_holders JOIN (SELECT token_mint, """ + dsum("pct") + """ AS s FROM t_holders GROUP BY 1) USING (token_mint)""")
def _(t):
    bad = t.holders.select("token_mint", "wallet", (F.col("pct") * 1.5).alias("pct"))
    return quality.rescale_supply(bad, F.lit(2.0), F.lit(3.0)).select("token_mint", "wallet", "pct")


@query("repair_synthetic_anchors", sql="SELECT count(*) AS kept FROM t_swaps WHERE token_mint NOT IN (SELECT token_mint FROM t_first_prices WHERE first_ts - graduated_at > 60)")
def _(t):
    bad = t.first_prices.filter(F.col("first_ts") - F.col("graduated_at") > 60)
    return quality.purge(t.swaps, bad).agg(F.count("*").alias("kept"))


@query("repair_outcome_backfill", sql="""SELECT classified, count(*) AS n FROM (SELECT CASE WHEN price * 1e6 / 69000 >= 3 THEN 'moon' WHEN price * 1e6 / 69000 <= 0.30 THEN 'rug' ELSE 'ok' END AS classified FROM t_outcomes WHERE check_offset_h = 4) GROUP BY 1""")
def _(t):
    from tapelens.functions.columns import outcome_label

    o = t.outcomes.filter("check_offset_h = 4").select(outcome_label(F.col("price") * 1e6 / 69000).alias("classified"))
    return o.groupBy("classified").agg(F.count("*").alias("n"))


@query("rebuild_funder_lineage", sql="SELECT f.funder, f.n, f.rug_count, p.avg_cluster_size, p.sample_count FROM t_frep f JOIN t_fp p USING (funder)")
def _(t):
    from tapelens.plans.memory import prints

    return memory.funder_reputation(graded(t)).select("funder", "n", "rug_count").join(prints(t).select("funder", "avg_cluster_size", "sample_count"), "funder")



# ── models (no SQL twin: iterative fits) ─────────────────────────────────────
FOLDS = 5


def model_frame(t: Tables):
    def make():
        s = ev.walk_forward_folds(pe.samples(t), "grad", "sample_id", 30, folds=FOLDS)
        return s.select("sample_id", "grad", "fold", "rank", "y", "outcome", *pe.features(t))
    return t.store("model_frame", make)


@query("model_logistic_walk_forward")
def _(t):
    pred = models.walk_forward(model_frame(t), pe.features(t), "y", "logistic", FOLDS)
    return models.head_report(pred, "y", ["fold"])


@query("model_gbm_isotonic_walk_forward")
def _(t):
    pred = models.walk_forward(model_frame(t), pe.features(t), "y", "gbm", FOLDS, "isotonic")
    return models.head_report(pred, "y", ["fold"])


@query("model_coefficients")
def _(t):
    return models.coefficients(models.fit(model_frame(t), pe.features(t), "y"), t.spark).orderBy(F.desc("size"))


#: Heads of the verdict model as predicates on trajectory and outcome labels; the early model has only the first.
HEADS = {"survive60": "CASE WHEN time_to_collapse_s IS NULL OR time_to_collapse_s > 3600 THEN 1 ELSE 0 END", "moon10x": "CAST(reached_10x AS INT)",
         "fastrug": "CASE WHEN time_to_collapse_s <= 900 THEN 1 ELSE 0 END", "distribute": "dist_4", "rug": "CASE WHEN out_4 IS NOT NULL THEN CAST(out_4 = 'rug' AS INT) END"}
MIN_HEAD = 200


def head_frame(t: Tables):
    """Classic samples with one label column per head."""
    def make():
        rows = pe.labelled(t).filter("platform = 'pump.fun'").join(
            t.trajectory.select(F.col("token_mint").alias("sample_id"), "time_to_collapse_s", "reached_10x"), "sample_id", "left")
        seen = F.col("reached_10x").isNotNull()
        ys = [(F.expr(e) if name in ("distribute", "rug") else F.when(seen, F.expr(e))).alias(f"y_{name}") for name, e in HEADS.items()]
        return rows.select("sample_id", "grad", *pe.features(t), *ys)
    return t.store("head_frame", make)


def train(t: Tables, store: ModelStore, version: int, rows, heads=tuple(HEADS), **options) -> dict:
    """Fit the heads that meet the data gate and save them as a candidate with their population."""
    fitted = {n: h for n in heads if (h := models.train_head(rows, pe.features(t), f"y_{n}", min_rows=MIN_HEAD, **options)) is not None}
    store.save(version, fitted, population=list(pe.samples_op.CLASSIC), horizon_h=pe.HORIZON)
    return store.meta(version)


def opening(t: Tables):
    """The first three fifths of the samples in time train, the others are scored."""
    ranked = t.store("head_ranked", lambda: ev.time_ranked(head_frame(t), "grad", "sample_id", 30))
    n = ranked.count()
    return ranked.filter(F.col("rank") <= int(n * 0.6)).drop("rank"), ranked.filter(F.col("rank") > int(n * 0.6)).drop("rank")


@query("model_stored_scores")
def _(t):
    """Heads trained on the opening block, put in force by an audit of the artifact, then read back to score what came later."""
    store = ModelStore(t.spark, shared_path(t.spark, "verdict-model"))
    past, later = opening(t)
    meta = train(t, store, 1, past, ("distribute", "rug"), kind="logistic")
    store.promote(1, artifact_checks(meta, None, t.spark))
    out = store.scored(later)
    parts = [out.filter(f"y_{n} IS NOT NULL").select(F.lit(n).alias("head"), "model_version", F.col(f"p_{n}").alias("p"), F.col(f"y_{n}").alias("y"), F.col(f"alert_{n}").alias("alert")) for n in meta["heads"]]
    if not parts:
        return t.spark.createDataFrame([], "head string, model_version long, n long, alerts long, auc double")
    long = stored(reduce(DataFrame.unionByName, parts), "stored-scores")
    g = long.groupBy("head", "model_version").agg(F.count("*").alias("n"), F.sum("alert").alias("alerts"))
    return g.join(ev.roc_auc(long, ["head"], "p", "y").select("head", "auc"), "head")


@query("audit_model_artifact")
def _(t):
    """Forbidden heads and features, read from the metadata of stored models (one early model is planted with a forbidden head)."""
    store, early = (ModelStore(t.spark, shared_path(t.spark, n)) for n in ("verdict-model", "early-model"))
    past, _ = opening(t)
    meta = train(t, store, 1, past, ("distribute",), kind="logistic")
    good, bad = ({"heads": {n: {"features": []} for n in names}} for names in (("survive60",), ("survive60", "moon10x")))
    clean = artifact_checks(meta, good, t.spark).withColumn("artifact", F.lit("clean"))
    return clean.unionByName(artifact_checks(meta, bad, t.spark).withColumn("artifact", F.lit("damaged")))


#: The event tape holds 100 coins, so its gates are lower than those of a full artifact.
HAZARD_EVENTS, HAZARD_COINS = 15, 60


def hazard_rows(t: Tables):
    return t.store("hazard_design", lambda: hazard_model.design(pe.periods(t), context(t)))


def hazard_coins(t: Tables):
    at_risk = hazard_rows(t).filter("model = 'A'").select("token_mint").distinct()
    return context(t).join(at_risk, "token_mint", "left_semi").select("token_mint", F.col("graduated_at").alias("grad"), *hazard_model.STATICS)


def hazard_forward(t: Tables):
    """Out-of-time predictions of the pair, stored once for both reports."""
    made = {}

    def run():
        if not made:
            found = hazard_model.walk_forward(hazard_rows(t), hazard_coins(t), min_train_coins=30)
            made["i"] = found[0] if found else t.spark.createDataFrame([], "fold int, token_mint string, interval_idx int, p double, event int")
            made["t"] = found[1] if found else t.spark.createDataFrame([], "token_mint string, horizon_s int, cif double, fold int")
        return made
    return t.store("hazard_intervals", lambda: run()["i"]), t.store("hazard_t0", lambda: run()["t"])


@query("model_hazard_intervals", "e")
def _(t):
    """Interval AUC of the exit hazard per fold, on coins that the fit has not seen."""
    rows, _ = hazard_forward(t)
    g = rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("event").alias("events"), F.countDistinct("token_mint").alias("coins"))
    return g.join(ev.roc_auc(rows, ["fold"], "p", "event").select("fold", "auc"), "fold", "left")


@query("model_hazard_t0", "e")
def _(t):
    """Incidence of a team exit at the anchor by horizon, from both fitted hazards, against what happened."""
    _, t0 = hazard_forward(t)
    return hazard_model.t0_report(t0, hazard_model.exits_by_horizon(hazard_rows(t)))


@query("model_hazard_landmark", "e")
def _(t):
    """Landmark scores of two checkpoints from the stored pair, written by checkpoint and read back."""
    store, out = ModelStore(t.spark, shared_path(t.spark, "hazard-model")), shared_path(t.spark, "hazard-predictions")
    schema = "token_mint string, p_exit double, p_collapse double, team_exited int, model_version long, mode string, checkpoint_s int"
    if hazard_model.save_pair(store, 1, hazard_rows(t), HAZARD_EVENTS, HAZARD_COINS) is None:
        return t.spark.createDataFrame([], schema)
    store.promote(1, t.spark.createDataFrame([(1,)], "ok int"))
    pair = hazard_model.load_pair(store)
    for checkpoint_s in (120, 300):
        rows = hazard.landmark_rows(t.post, t.team, checkpoint_s)
        hazard_model.persist(hazard_model.score_landmark(pair, rows, context(t), checkpoint_s, store.current()), out)
    return t.spark.read.schema(schema).parquet(out)


@query("stream_prewarn", "e")
def _(t):
    """Coins whose incidence of a team exit within 40 minutes, by the stored pair, is in the upper fifth; one alert a coin."""
    store = ModelStore(t.spark, shared_path(t.spark, "hazard-model"))
    folder = jobs.run_folder(t.spark, "prewarn")
    if hazard_model.save_pair(store, 1, hazard_rows(t), HAZARD_EVENTS, HAZARD_COINS) is None:
        return t.spark.createDataFrame([], checks.ALERTS)
    store.promote(1, t.spark.createDataFrame([(1,)], "ok int"))
    pair, version = hazard_model.load_pair(store), store.current()
    # the threshold belongs to the stored pair: its scores on the coins it was fitted on
    bar = ev.exact_quantiles(hazard_model.t0_incidence(pair, hazard_coins(t), (2400,)), [], "cif", [0.8]).first().q[0]

    def score(rows):
        p = hazard_model.t0_incidence(pair, rows, (2400,)).select("token_mint", F.col("cif").alias("p"))
        return rows.join(p, "token_mint").withColumn("alert", (F.col("p") >= bar).cast("int")).withColumn("model_version", F.lit(version).cast("long"))

    sink = checks.Prewarnings(t.spark, f"{folder}/alerts", context(t).drop("graduated_at"), score)
    anchors = jobs.event_swaps(jobs.file_stream(t.spark, t.folder, "events")).select("token_mint", (F.col("ts") + ANCHOR_DELAY["e"]).alias("graduated_at"))
    jobs.run_available(anchors, folder, sink)
    return sink.read().drop("batch")


@query("model_promotion_gate")
def _(t):
    """Retrain twice: a candidate behind a clean audit comes into force, one behind a damaged audit leaves the old version."""
    store = ModelStore(t.spark, shared_path(t.spark, "retrained-model"))
    past, later = opening(t)
    rows = []
    damaged = t.store("audit_rows", lambda: audit_rows(t)).select("name", "ok")
    clean = damaged.withColumn("ok", F.lit(1))
    for version, data, audit in ((1, past, clean), (2, past.unionByName(later), damaged), (3, past.unionByName(later), clean)):
        train(t, store, version, data, ("distribute",), kind="logistic")
        ok = store.promote(version, audit)
        rows.append((version, int(ok), store.current(), store.heads()["distribute"].meta["n"] if store.heads() else None))
    return t.spark.createDataFrame(rows, "candidate long, promoted int, in_force long, trained_rows long")
