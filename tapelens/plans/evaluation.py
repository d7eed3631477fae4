"""Registered hazard and evaluation queries with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapelens.operators import evaluation as ev
from tapelens.operators import flow, hazard, labels, resample, verdict
from tapelens.plans.graph import shape_frame
from tapelens.operators import samples as samples_op
from tapelens.plans.memory import ask_f, behavior, context, verdict_sql
from tapelens.plans.registry import QUERIES, cte, dsum, query
from tapelens.sources.tables import HOUR_S, Tables, exact_sum

# ── hazard ───────────────────────────────────────────────────────────────────
cte("t_anchor", """SELECT token_mint, list_sort(list(price_usd))[2] AS anchor FROM (SELECT token_mint, price_usd, row_number() OVER (PARTITION BY token_mint ORDER BY ts, tx_signature) AS rn FROM t_post)
WHERE rn <= 3 GROUP BY 1 HAVING count(*) = 3""")
_S = "{{'open': {o}, 'cand': {c}, 'conf': {n}, 'rec': {r}, 'res': {x}}}"


def _st(o, c, n, r, x):
    return _S.format(o=o, c=c, n=n, r=r, x=x)


_live = "(s.open = 1 AND x.cand <= s.cand + 120)"
cte("t_collapse", f"""SELECT token_mint, st.res AS collapse_s FROM (SELECT token_mint, list_reduce(line, lambda s, x:
  CASE WHEN s.res IS NOT NULL THEN s
       WHEN x.open = 1 THEN {_st("1::BIGINT", f"CASE WHEN {_live} THEN s.cand ELSE x.cand END", f"CASE WHEN {_live} THEN s.conf + 1 ELSE 1::BIGINT END", "0::BIGINT", f"CASE WHEN {_live} AND s.conf + 1 >= 3 THEN s.cand END")}
       WHEN {_live} AND s.rec + 1 < 3 THEN {_st("1::BIGINT", "s.cand", "s.conf", "s.rec + 1", "NULL::BIGINT")}
       ELSE {_st("0::BIGINT", "0::BIGINT", "0::BIGINT", "0::BIGINT", "NULL::BIGINT")} END, {_st("0::BIGINT", "0::BIGINT", "0::BIGINT", "0::BIGINT", "NULL::BIGINT")}) AS st
 FROM (SELECT p.token_mint, list({_st("CASE WHEN price_usd < 0.5 * anchor THEN 1::BIGINT ELSE 0::BIGINT END", "ts - graduated_at", "0::BIGINT", "0::BIGINT", "NULL::BIGINT")} ORDER BY ts, tx_signature) AS line
   FROM t_post p JOIN t_anchor USING (token_mint) WHERE ts - graduated_at <= 3720 GROUP BY 1)) WHERE st.res IS NOT NULL""")


@query("robust_anchor", sql="SELECT * FROM t_anchor")
def _(t):
    return hazard.robust_anchor(t.post)


def collapse(t: Tables):
    return t.store("collapse", lambda: hazard.collapse_events(t.post, hazard.robust_anchor(t.post)))


@query("collapse_confirmed", sql="SELECT * FROM t_collapse")
def _(t):
    return collapse(t)


@query("collapse_confirmed_events", "e", "SELECT * FROM t_collapse")
def _(t):
    return collapse(t)


_edges = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(zip(hazard.GRID, hazard.GRID[1:])))
cte("t_grid", f"SELECT * FROM (VALUES {_edges}) g(i, t_start, t_end)")
cte("t_cov", f"""SELECT c.token_mint, g.i AS interval_idx, g.t_start, g.t_end, count(p.ts) AS tv_trades, count(DISTINCT p.signer) AS tv_wallets,
  CASE WHEN any_value(anchor) IS NOT NULL AND count(p.ts) > 0 THEN least(arg_max(price_usd, (p.ts, p.tx_signature)) / any_value(anchor), 50.0) ELSE 1.0 END AS tv_price_vs_first,
  CASE WHEN any_value(anchor) IS NOT NULL AND count(p.ts) > 0 THEN greatest(0.0, 1.0 - arg_max(price_usd, (p.ts, p.tx_signature)) / max(price_usd)) ELSE 0.0 END AS tv_drawdown,
  coalesce({dsum("CASE WHEN p.ts - p.graduated_at >= pg.t_start THEN CASE WHEN side = 'buy' THEN sol_amount ELSE -sol_amount END ELSE 0 END")}, 0) AS tv_net_flow_recent,
  round(ln(1 + g.t_start), 9) AS tv_log_t, count(DISTINCT CASE WHEN side = 'sell' AND tm.wallet IS NOT NULL THEN p.signer END) AS b_team_sellers, round(ln(1 + count(p.ts)), 9) AS b_log_prints
FROM (SELECT DISTINCT token_mint FROM t_post) c CROSS JOIN t_grid g LEFT JOIN t_grid pg ON pg.i = g.i - 1 LEFT JOIN t_post p ON p.token_mint = c.token_mint AND p.ts - p.graduated_at < g.t_start
LEFT JOIN t_team tm ON tm.token_mint = p.token_mint AND tm.wallet = p.signer LEFT JOIN t_anchor a ON a.token_mint = c.token_mint GROUP BY 1, 2, 3, 4""")


def covariates(t: Tables):
    return t.store("edge_covariates", lambda: hazard.edge_covariates(t.post, t.team, hazard.robust_anchor(t.post)))


@query("interval_covariates", "e", "SELECT * FROM t_cov")
def _(t):
    return covariates(t)


cte("t_events_h", "SELECT t.token_mint, time_to_team_exit_s AS exit_s, CAST(collapse_s AS DOUBLE) AS collapse_s, tape_span_s AS span_s, n_price_points FROM t_traj t LEFT JOIN t_collapse USING (token_mint)")


def events(t: Tables):
    return t.trajectory.join(collapse(t), "token_mint", "left").select(
        "token_mint", F.col("time_to_team_exit_s").alias("exit_s"), F.col("collapse_s").cast("double").alias("collapse_s"),
        F.col("tape_span_s").alias("span_s"), "n_price_points")


_base = "token_mint, interval_idx, t_start, t_end, tv_trades, tv_wallets, tv_price_vs_first, tv_drawdown, tv_net_flow_recent, tv_log_t"
cte("t_pp", f"""SELECT 'A' AS model, {_base}, CASE WHEN a_event THEN 1 ELSE 0 END AS event, 0 AS b_team_exited, 0.0::DOUBLE AS b_log_t_since_exit, 0 AS b_team_sellers, b_log_prints FROM t_ppx
WHERE a_alive AND (a_event OR (span >= t_end AND NOT b_event))
UNION ALL SELECT 'B', {_base}, CASE WHEN b_event THEN 1 ELSE 0 END, CASE WHEN exited THEN 1 ELSE 0 END, CASE WHEN exited THEN round(ln(1 + t_start - exit_s), 9) ELSE 0::DOUBLE END, b_team_sellers, b_log_prints FROM t_ppx
WHERE (collapse_s IS NULL OR collapse_s >= t_start) AND (b_event OR span >= t_end)""")
cte("t_ppx", """SELECT c.*, e.exit_s, e.collapse_s, least(span_s, 3600) AS span, coalesce(exit_s >= t_start AND exit_s < t_end, false) AND (collapse_s IS NULL OR exit_s <= collapse_s) AS a_event,
  coalesce(collapse_s >= t_start AND collapse_s < t_end, false) AS b_event, (exit_s IS NULL OR exit_s >= t_start) AND (collapse_s IS NULL OR collapse_s >= t_start) AS a_alive, coalesce(exit_s < t_start, false) AS exited
FROM t_cov c JOIN t_events_h e USING (token_mint) WHERE e.n_price_points >= 30""")


def periods(t: Tables):
    return t.store("person_periods", lambda: hazard.person_periods(covariates(t), events(t).filter("n_price_points >= 30")))


@query("person_periods", "e", "SELECT * FROM t_pp")
def _(t):
    return periods(t)


@query("landmark_rows_300", "e", """SELECT l.token_mint, 8 AS interval_idx, count(*) AS tv_trades, count(DISTINCT signer) AS tv_wallets,
  count(DISTINCT CASE WHEN side = 'sell' AND m.wallet IS NOT NULL THEN signer END) AS b_team_sellers, max(CASE WHEN side = 'sell' AND m.wallet IS NOT NULL THEN 1 ELSE 0 END) AS b_team_exited
FROM t_post l LEFT JOIN t_team m ON m.token_mint = l.token_mint AND m.wallet = l.signer WHERE ts - graduated_at < 300 GROUP BY 1""")
def _(t):
    return hazard.landmark_rows(t.post, t.team, 300).select("token_mint", "interval_idx", "tv_trades", "tv_wallets", "b_team_sellers", "b_team_exited")


cte("t_haz", "SELECT token_mint, t_start, 0.01 + 0.002 * least(tv_trades, 30) AS ha, 0.01 + 0.05 * tv_drawdown AS hd FROM t_cov")


def toy_hazards(t):
    return covariates(t).select("token_mint", "t_start", (0.01 + 0.002 * F.least("tv_trades", F.lit(30))).alias("ha"), (0.01 + 0.05 * F.col("tv_drawdown")).alias("hd"))


@query("cumulative_incidence", "e", """SELECT token_mint, round(sum(ha * surv), 6) AS cif FROM (SELECT *, coalesce(exp(sum(ln(1 - ha - hd)) OVER (PARTITION BY token_mint ORDER BY t_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS surv
FROM (SELECT token_mint, t_start, CAST(ha AS DOUBLE) AS ha, CAST(hd AS DOUBLE) AS hd FROM t_haz WHERE t_start < 600)) GROUP BY 1""")
def _(t):
    return hazard.cumulative_incidence(toy_hazards(t), 600).withColumn("cif", F.round("cif", 6))


@query("interval_medians", "e", "SELECT interval_idx, median(tv_trades) AS tv_trades, median(tv_drawdown) AS tv_drawdown FROM t_pp WHERE model = 'A' GROUP BY 1")
def _(t):
    from tapelens.functions.ordered import grouped_median

    a = periods(t).filter("model = 'A'")
    return grouped_median(a, ["interval_idx"], "tv_trades", "tv_trades").join(grouped_median(a, ["interval_idx"], "tv_drawdown", "tv_drawdown"), "interval_idx")


cte("t_risk", """SELECT s.token_mint, s.p, CASE WHEN x.time_to_team_exit_s >= 300 AND x.time_to_team_exit_s < 390 THEN 1 ELSE 0 END AS label
FROM (SELECT token_mint, tv_trades / (tv_trades + 10.0::DOUBLE) AS p FROM t_cov WHERE t_start = 300) s JOIN t_traj x USING (token_mint) WHERE x.time_to_team_exit_s IS NULL OR x.time_to_team_exit_s >= 300""")


def risk(t: Tables):
    s = covariates(t).filter("t_start = 300").select("token_mint", (F.col("tv_trades") / (F.col("tv_trades") + 10.0)).alias("p"))
    return hazard.at_risk_rows(s, t.trajectory, 300)


@query("exit_alarm_at_risk", "e", "SELECT * FROM t_risk")
def _(t):
    return risk(t).select("token_mint", "p", "label")


# ── samples ──────────────────────────────────────────────────────────────────
#: What the snapshot holds; the Spark side finds these from its schema, the twins name them.
FEATURES = sorted("""team_supply_pct team_is_bc_sniper team_size team_first_buy_offset_s funder_n funder_rug_rate funder_moon_rate creator_n creator_rug_rate
smart_money_count proven_wallet_count top_holder_pct top3_holder_pct bc_duration_seconds unique_bc_buyers launches_24h launches_7d fingerprint_distance
launch_slot_snipe_count leader_consistency choreography_n graph_rug_hits graph_soft_hits""".split())
HORIZON, DRIFT_DAYS = 4, 30
#: Flags from which a launch counts as manufactured. At the landed scale every curve is short and has
#: few, concentrated buyers, so four of the five flags hold everywhere.
MANUFACTURED_AT = 5

cte("t_platform", "SELECT CAST(p_partkey AS VARCHAR) AS token_mint, CASE p_size % 3 WHEN 0 THEN 'mayhem' WHEN 1 THEN 'pump.fun' END AS platform FROM part", "t")
cte("t_platform", "SELECT token_mint, CASE CAST(token_mint AS BIGINT) % 3 WHEN 0 THEN 'mayhem' WHEN 1 THEN 'pump.fun' END AS platform FROM t_coins", "e")
cte("t_manufactured", QUERIES["manufactured_flags"].sql)
cte("t_labelled", f"""SELECT c.token_mint AS sample_id, c.graduated_at AS grad, p.platform, {', '.join('x.' + f for f in FEATURES)}, {', '.join(f'd.dist_{h}, o.out_{h}, o.multiple_{h}' for h in samples_op.HORIZONS)}
FROM t_coins c JOIN t_platform p ON p.token_mint = c.token_mint AND p.platform IN ('pump.fun', 'mayhem') JOIN t_ctx x ON x.token_mint = c.token_mint
JOIN t_first_prices f ON f.token_mint = c.token_mint AND f.first_ts - c.graduated_at BETWEEN 0 AND {samples_op.MAX_ANCHOR_LAG_S}
JOIN t_manufactured m ON m.token_mint = c.token_mint AND len(string_split(m.flags, ',')) < {MANUFACTURED_AT}
LEFT JOIN (SELECT token_mint, {', '.join(f"max(CASE WHEN signal IN ('DISTRIBUTING', 'DUMPED') THEN 1 ELSE 0 END) FILTER (check_offset_h = {h}) AS dist_{h}" for h in samples_op.HORIZONS)} FROM t_behavior GROUP BY 1) d ON d.token_mint = c.token_mint
LEFT JOIN (SELECT token_mint, {', '.join(f"max(classified) FILTER (check_offset_h = {h}) AS out_{h}, max(price / launch_price) FILTER (check_offset_h = {h}) AS multiple_{h}" for h in samples_op.HORIZONS)} FROM t_outcomes GROUP BY 1) o ON o.token_mint = c.token_mint""")
_sample_cols = f"sample_id, grad, platform, CAST(floor(grad / {DRIFT_DAYS}) AS BIGINT) AS fold_day, coalesce(top3_holder_pct, 0) / 100 AS score, {', '.join(FEATURES)}"
cte("t_both", f"SELECT {_sample_cols}, dist_{HORIZON} AS y, out_{HORIZON} AS outcome, multiple_{HORIZON} AS multiple FROM t_labelled WHERE dist_{HORIZON} IS NOT NULL AND out_{HORIZON} IS NOT NULL")
cte("t_samples", "SELECT * FROM t_both WHERE platform = 'pump.fun'")


def platforms(t: Tables):
    """Verified platform of each coin; null where the program keys name none."""
    if t.tape == "e":
        s, coin = F.col("token_mint").cast("long"), t.coins.select("token_mint")
    else:
        s, coin = F.col("p_size"), t.raw("part").select(F.col("p_partkey").cast("string").alias("token_mint"), "p_size")
    return coin.select("token_mint", F.when(s % 3 == 0, "mayhem").when(s % 3 == 1, "pump.fun").alias("platform"))


def labelled(t: Tables):
    """Snapshot of every eligible coin of both populations with its labels by horizon."""
    def make():
        flags = QUERIES["manufactured_flags"].build(t).select("token_mint", (F.size(F.split("flags", ",")) >= MANUFACTURED_AT).cast("int").alias("is_manufactured"))
        coins = samples_op.eligible(t.coins, platforms(t), flags, t.first_prices)
        rows = samples_op.labelled(context(t), coins, samples_op.labels_by_horizon(behavior(t), t.outcomes))
        # the share of the three largest holders is the plain score that learned and rule scores are held against
        return rows.withColumnRenamed("token_mint", "sample_id").withColumns({
            "fold_day": F.floor(F.col("grad") / DRIFT_DAYS).cast("long"), "score": F.coalesce("top3_holder_pct", F.lit(0.0)) / 100})
    return t.store("labelled_samples", make)


def samples(t: Tables, population: tuple[str, ...] = samples_op.CLASSIC, horizon: int = HORIZON):
    """Evaluation set: coins of one population whose checks at the horizon have run."""
    return samples_op.at_horizon(labelled(t).filter(F.col("platform").isin(*population)), horizon)


def features(t: Tables) -> list[str]:
    return samples_op.feature_names(context(t))


@query("labelled_samples", sql="SELECT * FROM (SELECT *, CAST(floor(grad / 30) AS BIGINT) AS fold_day, coalesce(top3_holder_pct, 0) / 100 AS score FROM t_labelled)")
def _(t):
    return labelled(t)


@query("labelled_samples_events", "e", "SELECT * FROM (SELECT *, CAST(floor(grad / 30) AS BIGINT) AS fold_day, coalesce(top3_holder_pct, 0) / 100 AS score FROM t_labelled)")
def _(t):
    return labelled(t)


@query("sample_gates", sql="""SELECT c.platform, CASE WHEN f.token_mint IS NULL THEN 'no tape' WHEN f.first_ts - k.graduated_at NOT BETWEEN 0 AND 120 THEN 'tape opens late' WHEN len(string_split(m.flags, ',')) >= 5 THEN 'manufactured'
  WHEN l.dist_4 IS NULL OR l.out_4 IS NULL THEN 'unlabelled' ELSE 'sample' END AS gate, count(*) AS n
FROM t_coins k JOIN t_platform c USING (token_mint) LEFT JOIN t_first_prices f USING (token_mint) LEFT JOIN t_manufactured m USING (token_mint) LEFT JOIN t_labelled l ON l.sample_id = k.token_mint GROUP BY 1, 2""")
def _(t):
    """Where each coin stops on its way into the evaluation set."""
    flags = QUERIES["manufactured_flags"].build(t).select("token_mint", F.size(F.split("flags", ",")).alias("n_flags"))
    l = labelled(t).select(F.col("sample_id").alias("token_mint"), "dist_4", "out_4")
    j = (t.coins.select("token_mint", "graduated_at").join(platforms(t), "token_mint").join(t.first_prices.select("token_mint", "first_ts"), "token_mint", "left")
         .join(flags, "token_mint", "left").join(l, "token_mint", "left"))
    lag = F.col("first_ts") - F.col("graduated_at")
    gate = (F.when(F.col("first_ts").isNull(), "no tape").when(~lag.between(0, samples_op.MAX_ANCHOR_LAG_S), "tape opens late")
            .when(F.col("n_flags") >= MANUFACTURED_AT, "manufactured").when(F.col("dist_4").isNull() | F.col("out_4").isNull(), "unlabelled").otherwise("sample"))
    return j.groupBy("platform", gate.alias("gate")).agg(F.count("*").alias("n"))


cte("t_sv", verdict_sql("SELECT * EXCLUDE (score), CAST(NULL AS VARCHAR) AS signal FROM t_samples"))
_ds = "CASE WHEN verdict = 'SKIP' THEN 0.5::DOUBLE + 0.5::DOUBLE * confidence WHEN verdict = 'STRUCTURALLY_SOUND' THEN 0.5::DOUBLE - 0.5::DOUBLE * confidence ELSE 0.5::DOUBLE END"
cte("t_sd", f"SELECT *, round({_ds}, 6) AS ds, CASE WHEN verdict = 'SKIP' THEN 1 ELSE 0 END AS pred FROM t_sv")


def judged(t: Tables):
    from tapelens.functions.columns import distribute_score

    def make():
        v = t.store("sample_verdicts", lambda: verdict.structural_verdict(samples(t).drop("score")))
        return v.withColumn("ds", F.round(distribute_score("verdict", "confidence"), 6)).withColumn("pred", (F.col("verdict") == "SKIP").cast("int"))
    return t.store("judged_samples", make)


@query("sample_verdicts", sql="SELECT sample_id, hard_skip, score, factors, verdict, confidence FROM (" + verdict_sql("SELECT * EXCLUDE (score), CAST(NULL AS VARCHAR) AS signal FROM t_samples") + ")")
def _(t):
    return verdict.structural_verdict(samples(t).drop("score")).select("sample_id", "hard_skip", "score", "factors", "verdict", "confidence")


cte("t_rk", "SELECT *, rank() OVER (PARTITION BY outcome ORDER BY score) + (count(*) OVER (PARTITION BY outcome, score) - 1) / 2 AS r FROM t_samples")


def auc_sql(src: str, key: str, score: str, label: str) -> str:
    part = f"PARTITION BY {key}" if key else ""
    tie = f"PARTITION BY {key + ',' if key else ''} {score}"
    return f"""SELECT {key + ',' if key else ''} CASE WHEN p > 0 AND n > p THEN (2 * sr - p * (p + 1)) / (2 * p * (n - p)) END AS auc, CAST(n AS BIGINT) AS n FROM (
  SELECT {key + ',' if key else ''} sum(CASE WHEN {label} = 1 THEN r ELSE 0 END) AS sr, CAST(sum({label}) AS DOUBLE) AS p, CAST(count(*) AS DOUBLE) AS n FROM (
    SELECT *, rank() OVER ({part} ORDER BY {score}) + (count(*) OVER ({tie}) - 1) / 2 AS r FROM {src}) {'GROUP BY ' + key if key else ''})"""


def ap_sql(src: str, key: str, score: str, label: str) -> str:
    k = key + "," if key else ""
    part = f"PARTITION BY {key}" if key else ""
    return f"""SELECT {k} CAST(sum(CAST(tp / (tp + fp) * pos / nullif(pt, 0) AS DECIMAL(38,12))) AS DOUBLE) AS ap FROM (
  SELECT *, sum(pos) OVER ({part} ORDER BY s DESC) AS tp, sum(neg) OVER ({part} ORDER BY s DESC) AS fp, sum(pos) OVER ({part}) AS pt FROM (
    SELECT {k} {score} AS s, sum({label}) AS pos, sum(1 - {label}) AS neg FROM {src} GROUP BY ALL)) {'GROUP BY ' + key if key else ''}"""


@query("roc_auc_by_group", sql=auc_sql("t_samples", "outcome", "score", "y"))
def _(t):
    return ev.roc_auc(samples(t), ["outcome"], "score", "y")


@query("roc_auc_rule", sql=auc_sql("t_sd", "", "ds", "y"))
def _(t):
    return ev.roc_auc(judged(t), [], "ds", "y")


@query("average_precision_by_group", sql="SELECT outcome, round(ap, 9) AS ap FROM (" + ap_sql("t_samples", "outcome", "score", "y") + ")")
def _(t):
    return ev.average_precision(samples(t), ["outcome"], "score", "y").withColumn("ap", F.round("ap", 9))


cte("t_horizons", "SELECT sample_id, h, y FROM (" + " UNION ALL ".join(f"SELECT sample_id, {h} AS h, dist_{h} AS y FROM t_labelled WHERE platform = 'pump.fun'" for h in samples_op.HORIZONS) + ") WHERE y IS NOT NULL")
cte("t_sd_h", "SELECT h.h, h.y, s.ds, s.pred FROM t_horizons h JOIN t_sd_all s USING (sample_id)")
cte("t_sd_all", f"SELECT sample_id, round({_ds}, 6) AS ds, CASE WHEN verdict = 'SKIP' THEN 1 ELSE 0 END AS pred FROM (" + verdict_sql("SELECT *, CAST(NULL AS VARCHAR) AS signal FROM t_labelled WHERE platform = 'pump.fun'") + ")")


@query("rule_report_by_horizon", sql="""SELECT h, count(*) AS n, round(sum(y) / count(*), 9) AS base_rate, round(count(*) FILTER (pred = 1 AND y = 1) / nullif(count(*) FILTER (pred = 1), 0), 9) AS precision,
  round(count(*) FILTER (pred = 1 AND y = 1) / nullif(sum(y), 0), 9) AS recall, round(CAST(sum(CAST((ds - y) * (ds - y) AS DECIMAL(38,12))) AS DOUBLE) / count(*), 9) AS brier FROM t_sd_h GROUP BY 1""")
def _(t):
    from tapelens.functions.columns import distribute_score

    own = labelled(t).filter(F.col("platform").isin(*samples_op.CLASSIC))
    v = verdict.structural_verdict(own.drop("score")).withColumn("ds", F.round(distribute_score("verdict", "confidence"), 6)).withColumn("pred", (F.col("verdict") == "SKIP").cast("int"))
    by_h = F.inline(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"dist_{h}").alias("y")) for h in samples_op.HORIZONS]))
    j = v.select("ds", "pred", by_h).filter("y IS NOT NULL")
    p = ev.prf(j, ["h"], "pred", "y")
    b = ev.brier(j, ["h"], "ds", "y")
    base = j.groupBy("h").agg((F.sum("y") / F.count("*")).alias("base_rate"))
    r = lambda c: F.round(c, 9).alias(c)
    return p.join(b, "h").join(base, "h").select("h", "n", r("base_rate"), r("precision"), r("recall"), r("brier"))


@query("rule_pr_auc_by_day", sql="SELECT fold_day, round(ap, 9) AS ap FROM (" + ap_sql("t_sd", "fold_day", "ds", "y") + ") WHERE ap IS NOT NULL")
def _(t):
    return ev.average_precision(judged(t), ["fold_day"], "ds", "y").filter("ap IS NOT NULL").withColumn("ap", F.round("ap", 9))


@query("calibration_bins", sql="""SELECT CAST(least(floor(s * 10), 9) AS INTEGER) AS bin, round(CAST(sum(CAST(s AS DECIMAL(38,12))) AS DOUBLE) / count(*), 9) AS mean_score, sum(y) / count(*) AS hit_rate, count(*) AS n
FROM (SELECT least(score, 1.0) AS s, y FROM t_samples) GROUP BY 1""")
def _(t):
    return ev.calibration_bins(samples(t).withColumn("s", F.least("score", F.lit(1.0))), [], "s", "y")


@query("classification_scores_documents", sql="""SELECT lang, round(CAST(sum(CAST((s - quality) * (s - quality) AS DECIMAL(38,12))) AS DOUBLE) / count(*), 9) AS brier, count(*) AS n
FROM (SELECT d.lang, least(n_chars / 20000.0::DOUBLE, 1) AS s, quality FROM documents d JOIN labels USING (doc_id)) GROUP BY 1""")
def _(t):
    d = t.raw("documents").select("doc_id", "lang", F.least(F.col("n_chars") / 20000.0, F.lit(1.0)).alias("s")).join(t.raw("labels").select("doc_id", "quality"), "doc_id")
    return ev.brier(d, ["lang"], "s", "quality").withColumn("brier", F.round("brier", 9))


PATCHES = {
    "top_holder_concentration": {"top_holder_pct": 0.0, "top3_holder_pct": 0.0}, "bc_speed": {"bc_duration_seconds": 3600}, "thin_participation": {"unique_bc_buyers": 999},
    "smart_money": {"smart_money_count": 0}, "team_supply": {"team_supply_pct": 10.0, "team_is_bc_sniper": 0}, "funder_reputation": {"funder_n": 0, "funder_rug_rate": None, "funder_moon_rate": None},
    "creator_reputation": {"creator_n": 0, "creator_rug_rate": None}, "wallet_graph": {"graph_rug_hits": 0, "graph_soft_hits": 0}, "pump_ring_velocity": {"launches_24h": 0, "launches_7d": 0},
    "fingerprint_match": {"fingerprint_distance": None}, "launch_slot_snipe": {"launch_slot_snipe_count": 0}, "proven_wallets": {"proven_wallet_count": 0},
    "exit_leader_ring": {"leader_consistency": None, "choreography_n": None},
}


def _patched_sql() -> str:
    def value(col):
        arms = " ".join(f"WHEN '{p}' THEN {'NULL' if v[col] is None else v[col]}" for p, v in PATCHES.items() if col in v)
        return f"CASE patch {arms} ELSE {col} END AS {col}" if arms else None
    cols = [c for c in FEATURES if any(c in v for v in PATCHES.values())]
    names = ", ".join(f"('{p}')" for p in ["baseline", *PATCHES])
    return f"SELECT s.* REPLACE ({', '.join(value(c) for c in cols)}), CAST(NULL AS VARCHAR) AS signal, patch FROM (SELECT * EXCLUDE (score) FROM t_samples) s CROSS JOIN (VALUES {names}) q(patch)"


cte("t_abl", "SELECT *, " + _ds + " AS ds0, CASE WHEN verdict = 'SKIP' THEN 1 ELSE 0 END AS pred FROM (" + verdict_sql(_patched_sql()) + ")")
cte("t_abl_r", "SELECT *, round(ds0, 6) AS ds FROM t_abl")


@query("rule_ablation", sql="""SELECT p.patch, round(ap, 9) AS ap, round(precision, 9) AS precision FROM (""" + ap_sql("t_abl_r", "patch", "ds", "y") + """) a
JOIN (SELECT patch, count(*) FILTER (pred = 1 AND y = 1) / nullif(count(*) FILTER (pred = 1), 0) AS precision FROM t_abl GROUP BY 1) p ON p.patch = a.patch""")
def _(t):
    """Every sample meets the fixed patch list once; all patches are judged in one grouped job."""
    from tapelens.functions.columns import distribute_score

    s = samples(t).drop("score").withColumn("patch", F.explode(F.array(*map(F.lit, ["baseline", *PATCHES]))))
    types = dict(s.dtypes)
    ov = {}
    for col in {c for v in PATCHES.values() for c in v}:
        e = F.col(col)
        for name, v in PATCHES.items():
            if col in v:
                e = F.when(F.col("patch") == name, F.lit(v[col]).cast(types[col])).otherwise(e)
        ov[col] = e
    patched = t.store("patched_samples", lambda: s.withColumns(ov))
    j = t.store("ablated_verdicts", lambda: verdict.structural_verdict(patched).select("sample_id", "patch", "y", "verdict", "confidence"))
    j = j.withColumn("ds", F.round(distribute_score("verdict", "confidence"), 6)).withColumn("pred", (F.col("verdict") == "SKIP").cast("int"))
    ap = ev.average_precision(j, ["patch"], "ds", "y")
    return ap.join(ev.prf(j, ["patch"], "pred", "y"), "patch").select("patch", F.round("ap", 9).alias("ap"), F.round("precision", 9).alias("precision"))


@query("economic_portfolios", sql="""SELECT portfolio, count(*) AS n, round(count(*) FILTER (outcome = 'rug') / count(*), 6) AS rug_rate, median(multiple) AS median_multiple FROM (
SELECT 'all' AS portfolio, outcome, multiple FROM t_sd UNION ALL SELECT 'rule', outcome, multiple FROM t_sv_s WHERE verdict = 'STRUCTURALLY_SOUND'
UNION ALL SELECT 'random', outcome, multiple FROM t_samples WHERE CAST(concat('0x', substr(md5(CAST(sample_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE < 0.25) GROUP BY 1""".replace("FROM t_sd UNION", "FROM t_samples UNION"))
def _(t):
    from tapelens.functions.ordered import grouped_median

    v = judged(t).select("sample_id", "outcome", "verdict").join(samples(t).select("sample_id", F.col("multiple").alias("m")), "sample_id")
    inside = F.array_compact(F.array(F.lit("all"), F.when(F.col("verdict") == "STRUCTURALLY_SOUND", "rule"),
                                     F.when(ev.hash_uniform(F.col("sample_id")) < 0.25, "random")))
    p = v.select("outcome", "m", F.explode(inside).alias("portfolio"))
    med = grouped_median(p, ["portfolio"], "m", "median_multiple")
    return p.groupBy("portfolio").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("outcome") == "rug") / F.count("*"), 6).alias("rug_rate")).join(med, "portfolio")


cte("t_sv_s", "SELECT v.outcome, v.verdict, s.multiple FROM t_sv v JOIN t_samples s USING (sample_id)")


@query("selector_table", sql="""SELECT share, count(*) AS n, count(*) FILTER (outcome = 'rug') AS rugs FROM (SELECT outcome, row_number() OVER (ORDER BY score, sample_id) / count(*) OVER () AS pr FROM t_samples) JOIN (VALUES (0.05), (0.10), (0.20), (1.0)) s(share) ON pr <= share GROUP BY 1""")
def _(t):
    from tapelens.functions.ordered import magnitude_cell, split_row_number

    s = samples(t).withColumn("g", F.lit(1))
    r = split_row_number(s, ["g"], [F.col("score"), F.col("sample_id")], magnitude_cell("score"), "rk")
    n = samples(t).agg(F.count("*").alias("total"))
    j = r.join(F.broadcast(n)).withColumn("share", F.explode(F.array(*map(F.lit, [0.05, 0.10, 0.20, 1.0])))).filter(F.col("rk") / F.col("total") <= F.col("share"))
    return j.groupBy("share").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "rug").alias("rugs"))


@query("walk_forward_folds", sql="""SELECT fold, count(*) AS n, min(grad) AS lo, max(grad) AS hi FROM (SELECT grad, CASE WHEN rk <= floor(total * 0.4) THEN -1 ELSE least(CAST(floor((rk - 1 - floor(total * 0.4)) / ((total - floor(total * 0.4)) / 5)) AS BIGINT), 4) END AS fold
FROM (SELECT grad, row_number() OVER (ORDER BY grad, sample_id) AS rk, count(*) OVER () AS total FROM t_samples)) GROUP BY 1""")
def _(t):
    return ev.walk_forward_folds(samples(t).select("grad", "sample_id"), "grad", "sample_id", 30).groupBy("fold").agg(
        F.count("*").alias("n"), F.min("grad").alias("lo"), F.max("grad").alias("hi"))


@query("label_drift_windows", sql="SELECT CAST(floor((grad - (SELECT min(grad) FROM t_samples)) / 30) AS INTEGER) AS w, count(*) AS n, round(sum(y) / count(*), 9) AS base_rate FROM t_samples GROUP BY 1")
def _(t):
    w = ev.day_windows(samples(t).select("grad", "y"), "grad", DRIFT_DAYS, 1)
    return w.groupBy(F.col("window").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("y") / F.count("*"), 9).alias("base_rate"))


cte("t_feat", f"SELECT sample_id, grad, feature, value FROM (SELECT sample_id, grad, {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in FEATURES)} FROM t_samples) UNPIVOT (value FOR feature IN ({', '.join(FEATURES)}))")
cte("t_half", "SELECT quantile_cont(grad, 0.5) AS half FROM t_samples")
cte("t_ref", "SELECT feature, value FROM t_feat, t_half WHERE grad < half")
cte("t_cur", "SELECT feature, value FROM t_feat, t_half WHERE grad >= half AND feature IN (SELECT feature FROM t_feat, t_half WHERE grad >= half GROUP BY 1 HAVING count(*) >= 20)")
cte("t_qe", "SELECT feature, list_distinct(quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS e0 FROM t_ref GROUP BY 1 HAVING count(*) >= 20")
cte("t_q", "SELECT feature, list_sort(e0) AS e FROM t_qe WHERE len(e0) >= 3 AND feature IN (SELECT feature FROM t_cur)")


def _hist(src: str, name: str) -> str:
    return f"""SELECT feature, b, count(*) AS {name} FROM (SELECT s.feature, CASE WHEN value = e[-1] THEN len(e) - 1 ELSE len(list_filter(e, lambda x: x <= value)) END AS b FROM {src} s JOIN t_q USING (feature) WHERE value BETWEEN e[1] AND e[-1]) GROUP BY 1, 2"""


def long_features(t):
    s = samples(t)
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features(t)])
    return s.select("sample_id", "grad", F.inline(cells)).filter("value IS NOT NULL")


@query("feature_psi", sql=f"""SELECT feature, round(CAST(sum(CAST((c - r) * ln(c / r) AS DECIMAL(38,12))) AS DOUBLE), 6) AS psi FROM (
SELECT g.feature, greatest(coalesce(h.r, 0) / greatest(sum(coalesce(h.r, 0)) OVER (PARTITION BY g.feature), 1), 1e-4::DOUBLE) AS r, greatest(coalesce(k.c, 0) / greatest(sum(coalesce(k.c, 0)) OVER (PARTITION BY g.feature), 1), 1e-4::DOUBLE) AS c
FROM (SELECT feature, unnest(range(1, len(e))) AS b FROM t_q) g LEFT JOIN ({_hist('t_ref', 'r')}) h USING (feature, b) LEFT JOIN ({_hist('t_cur', 'c')}) k USING (feature, b)) GROUP BY 1""")
def _(t):
    f = t.store("sample_features_long", lambda: long_features(t))
    half = ev.exact_quantiles(samples(t), [], "grad", [0.5]).select(F.col("q")[0].alias("half"))
    f = f.join(F.broadcast(half))  # one row
    return ev.psi(f.filter("grad < half").drop("half"), f.filter("grad >= half").drop("half"), "feature", "value")


@query("feature_auc_canary", sql=auc_sql("(SELECT f.feature, f.value, s.y FROM t_feat f JOIN t_samples s USING (sample_id))", "feature", "value", "y"))
def _(t):
    f = long_features(t).join(samples(t).select("sample_id", "y"), "sample_id")
    return ev.roc_auc(f, ["feature"], "value", "y")


@query("feature_missing_matrix", sql="SELECT feature, count(*) AS present, (SELECT count(*) FROM t_samples) - count(*) AS missing, round(CAST(sum(CAST(value AS DECIMAL(38,9))) AS DOUBLE) / (SELECT count(*) FROM t_samples), 9) AS mean_zero_filled FROM t_feat GROUP BY 1")
def _(t):
    f = long_features(t).groupBy("feature").agg(F.count("*").alias("present"), F.sum(F.col("value").cast("decimal(38,9)")).cast("double").alias("s"))
    n = samples(t).agg(F.count("*").alias("n"))
    return f.join(F.broadcast(n)).select("feature", "present", (F.col("n") - F.col("present")).alias("missing"), F.round(F.col("s") / F.col("n"), 9).alias("mean_zero_filled"))


# ── bootstrap, lift, equivalence ─────────────────────────────────────────────
DRAWS = 3000
AUC_DRAWS = 500
PARITY_DRAWS = 2000
_u = "CAST(concat('0x', substr(md5(concat_ws('|', CAST({d} AS VARCHAR), CAST({c} AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE"
_cuts = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]


def weights_sql(cluster_src: str, cluster: str, draws: int = DRAWS) -> str:
    u = _u.format(d="draw", c=cluster)
    return f"SELECT {cluster}, draw, " + " + ".join(f"(CASE WHEN u >= {c}::DOUBLE THEN 1 ELSE 0 END)" for c in _cuts) + f" AS w FROM (SELECT {cluster}, draw, {u} AS u FROM (SELECT DISTINCT {cluster} FROM {cluster_src}) CROSS JOIN (SELECT unnest(range(0, {draws})) AS draw))"


@query("top_quintile_lift", "e", """SELECT n, n_top, base_rate, CASE WHEN n >= 20 AND n_top >= 5 AND k > 0 AND k < n THEN k_top / n_top - base_rate END AS lift FROM (
SELECT count(*) AS n, count(*) FILTER (p >= thr) AS n_top, sum(label) / count(*) AS base_rate, sum(label) AS k, sum(label) FILTER (p >= thr) AS k_top FROM t_risk CROSS JOIN (SELECT quantile_cont(p, 0.8) AS thr FROM t_risk))""")
def _(t):
    return ev.top_lift(risk(t), [], "p", "label")


cte("t_wl", f"SELECT s.outcome, w.draw, s.score, s.y, unnest(range(0, w.w)) AS rep FROM t_samples s JOIN ({weights_sql('t_samples', 'sample_id')}) w USING (sample_id) WHERE w.w > 0")


@query("lift_bootstrap", sql=f"""SELECT b.outcome, b.n, b.base_rate, round(b.lift, 6) AS lift, round(lo, 6) AS lo, round(hi, 6) AS hi FROM (
 SELECT outcome, count(*) AS n, sum(y) / count(*) AS base_rate, sum(y) FILTER (score >= thr) / count(*) FILTER (score >= thr) - sum(y) / count(*) AS lift FROM t_samples JOIN (SELECT outcome, quantile_cont(score, 0.8) AS thr FROM t_samples GROUP BY 1) USING (outcome) GROUP BY 1) b
JOIN (SELECT outcome, quantile_cont(lift, 0.025) AS lo, quantile_cont(lift, 0.975) AS hi FROM (
 SELECT outcome, draw, sum(y) FILTER (score >= thr) / count(*) FILTER (score >= thr) - sum(y) / count(*) AS lift FROM t_wl JOIN (SELECT outcome, draw, quantile_cont(score, 0.8) AS thr FROM t_wl GROUP BY 1, 2) USING (outcome, draw) GROUP BY 1, 2) GROUP BY 1) q USING (outcome)""")
def _(t):
    return ev.bootstrap_lift(samples(t), ["outcome"], "sample_id", "score", "y", DRAWS)


@query("auc_cluster_bootstrap", sql=f"""SELECT count(*) AS draws, round(quantile_cont(auc, 0.025), 6) AS lo, round(quantile_cont(auc, 0.5), 6) AS mid, round(quantile_cont(auc, 0.975), 6) AS hi FROM (
 SELECT draw, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (2 * cneg + neg)) / (2 * sum(pos) * sum(neg)) END AS auc FROM (
  SELECT draw, score, pos, neg, coalesce(sum(neg) OVER (PARTITION BY draw ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cneg FROM (
   SELECT w.draw, score, CAST(sum(CASE WHEN y = 1 THEN w.w ELSE 0 END) AS DOUBLE) AS pos, CAST(sum(CASE WHEN y = 0 THEN w.w ELSE 0 END) AS DOUBLE) AS neg FROM (SELECT c, score, y FROM t_scl) s JOIN ({weights_sql('t_scl', 'c', AUC_DRAWS)}) w USING (c) GROUP BY 1, 2)) GROUP BY 1) WHERE auc IS NOT NULL""")
def _(t):
    s = samples(t).select((F.col("grad") % 211).alias("c"), "score", "y")
    return ev.cluster_bootstrap_auc(s, "c", "score", "y", AUC_DRAWS)


cte("t_scl", "SELECT grad % 211 AS c, score, y FROM t_samples")


@query("equivalence_test", sql=f"""SELECT na, nb, CASE WHEN NOT (na >= 1600 AND nb >= 1600 AND la IS NOT NULL AND lb IS NOT NULL) THEN 'INSUFFICIENT_DATA' WHEN abs(lo) <= 0.1 AND abs(hi) <= 0.1 AND la >= 0.1 AND lb >= 0.1 THEN 'POOL' ELSE 'KEEP_SEPARATE' END AS decision FROM (
SELECT max(n) FILTER (arm = 0) AS na, max(n) FILTER (arm = 1) AS nb, max(lift) FILTER (arm = 0) AS la, max(lift) FILTER (arm = 1) AS lb FROM (
 SELECT arm, count(*) AS n, sum(y) FILTER (score >= thr) / count(*) FILTER (score >= thr) - sum(y) / count(*) AS lift FROM t_arm JOIN (SELECT arm, quantile_cont(score, 0.8) AS thr FROM t_arm GROUP BY 1) USING (arm) GROUP BY 1)),
(SELECT quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi FROM (SELECT draw, max(lift) FILTER (arm = 1) - max(lift) FILTER (arm = 0) AS d FROM (
 SELECT arm, draw, sum(y) FILTER (score >= thr) / count(*) FILTER (score >= thr) - sum(y) / count(*) AS lift FROM t_warm JOIN (SELECT arm, draw, quantile_cont(score, 0.8) AS thr FROM t_warm GROUP BY 1, 2) USING (arm, draw) GROUP BY 1, 2) GROUP BY 1))""")
def _(t):
    s = samples(t, samples_op.BOTH).withColumn("arm", (F.col("platform") == "mayhem").cast("int"))
    per = resample.draw_lift(s, ["arm"], "sample_id", "score", "y", DRAWS).groupBy("draw").agg(
        (F.max(F.when(F.col("arm") == 1, F.col("lift"))) - F.max(F.when(F.col("arm") == 0, F.col("lift")))).alias("d"))
    q = ev.exact_quantiles(per, [], "d", [0.025, 0.975]).select(F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    p = ev.top_lift(s, ["arm"], "score", "y")
    pick = lambda c, a: F.max(F.when(F.col("arm") == a, F.col(c)))
    g = p.agg(pick("n", 0).alias("na"), pick("n", 1).alias("nb"), pick("lift", 0).alias("la"), pick("lift", 1).alias("lb"))
    j = g.join(F.broadcast(q))
    return j.select("na", "nb", ev.equivalence_verdict(F.col("lo"), F.col("hi"), F.col("la"), F.col("lb"), F.col("na"), F.col("nb")).alias("decision"))


cte("t_arm", "SELECT CASE WHEN platform = 'mayhem' THEN 1 ELSE 0 END AS arm, * FROM t_both")
cte("t_warm", f"SELECT s.arm, w.draw, s.score, s.y, unnest(range(0, w.w)) AS rep FROM t_arm s JOIN ({weights_sql('t_both', 'sample_id')}) w USING (sample_id) WHERE w.w > 0")

# ── funder-conditioned returns, parity, row loss, graph signal ───────────────
cte("t_fe", """SELECT c.token_mint, c.funder, c.graduated_at, t.time_to_team_exit_s AS tx FROM t_ask_f c JOIN t_traj t USING (token_mint) WHERE t.n_price_points >= 30 AND t.time_to_team_exit_s IS NOT NULL""")
cte("t_fe_p", """SELECT a.token_mint, a.funder, a.graduated_at, count(b.token_mint) AS n_prior, median(b.tx) AS prior_median FROM t_fe a LEFT JOIN t_fe b ON b.funder = a.funder AND b.graduated_at < a.graduated_at GROUP BY 1, 2, 3""")
cte("t_fe_b", "SELECT median(tx) AS boundary FROM (SELECT tx, row_number() OVER (ORDER BY graduated_at, token_mint) AS rn, count(*) OVER () AS n FROM t_fe) WHERE rn <= n // 2")
cte("t_fe_arm", """SELECT p.funder, CASE WHEN prior_median >= boundary THEN 'slow' ELSE 'fast' END AS arm, realised_multiple FROM t_fe_p p CROSS JOIN t_fe_b JOIN t_follow f USING (token_mint) WHERE n_prior >= 1""")


def funder_arms(t: Tables):
    """Return rows of coins whose funder has earlier exits, split by the median of those exits."""
    from tapelens.functions.ordered import grouped_median, split_row_number, time_cell

    fe = ask_f(t).join(t.trajectory.filter("n_price_points >= 30 AND time_to_team_exit_s IS NOT NULL").select(
        "token_mint", F.col("time_to_team_exit_s").alias("tx")), "token_mint")
    fe = t.store("funder_exits", lambda: fe)
    total = fe.agg(F.count("*").alias("n"))
    rk = split_row_number(fe.withColumn("g", F.lit(1)), ["g"], [F.col("graduated_at"), F.col("token_mint")], time_cell("graduated_at", 60), "rn")
    half = rk.join(F.broadcast(total)).filter(F.col("rn") <= F.floor(F.col("n") / 2))
    bound = grouped_median(half, ["g"], "tx", "boundary").select("boundary")
    prior = ev.prior_median_at_least(fe.join(F.broadcast(bound)), "funder", "graduated_at", "tx", "boundary")
    coins = fe.join(prior, ["funder", "graduated_at"])
    arm = F.when(F.col("at_least"), "slow").otherwise("fast")
    r = labels.follow_returns(t.post, t.team).select("token_mint", "realised_multiple")
    return coins.filter("n_prior >= 1").select("token_mint", "funder", arm.alias("arm")).join(r, "token_mint")


@query("funder_conditioned_returns", "e", f"""
SELECT b.arm, b.n, b.clusters, round(b.mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi, round(p_low, 6) AS p_low FROM (SELECT arm, CAST(sum(CAST(realised_multiple AS DECIMAL(38,12))) AS DOUBLE) / count(*) AS mean, count(*) AS n, count(DISTINCT funder) AS clusters FROM t_fe_arm GROUP BY 1) b
JOIN (SELECT arm, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi, count(*) FILTER (m <= 1) / count(*) AS p_low FROM (
  SELECT arm, draw, CAST(sum(s * w) AS DOUBLE) / sum(k * w) AS m FROM (SELECT arm, funder, sum(CAST(realised_multiple AS DECIMAL(38,12))) AS s, count(*) AS k FROM t_fe_arm GROUP BY 1, 2)
  JOIN ({weights_sql('t_fe_arm', 'funder')}) USING (funder) WHERE w > 0 GROUP BY 1, 2) GROUP BY 1) q USING (arm)""")
def _(t):
    return ev.cluster_bootstrap_mean(funder_arms(t), ["arm"], "funder", "realised_multiple", DRAWS)


cte("t_par", "SELECT token_mint, CASE WHEN CAST(token_mint AS BIGINT) % 4 = 0 THEN 'poll' ELSE 'websocket' END AS src, collapsed, CASE WHEN time_to_team_exit_s IS NOT NULL THEN 1 ELSE 0 END AS exited, n_price_points FROM t_traj WHERE first_ts - graduated_at BETWEEN 0 AND 120")


def parity_rows(t):
    src = F.when(F.col("token_mint").cast("long") % 4 == 0, "poll").otherwise("websocket")
    return t.trajectory.filter((F.col("first_ts") - F.col("graduated_at")).between(0, 120)).select(
        "token_mint", src.alias("src"), "collapsed", F.col("time_to_team_exit_s").isNotNull().cast("int").alias("exited"), "n_price_points")


@query("source_parity", sql=f"""SELECT metric, n_ws, n_poll, round(ws, 6) AS ws, round(poll, 6) AS poll, CASE WHEN n_ws < 60 OR n_poll < 60 THEN 'SUSPENDED' WHEN lo > 0 OR hi < 0 THEN CASE WHEN abs(poll - ws) >= 0.2 THEN 'DIVERGENT' ELSE 'SMALL' END ELSE 'NONE' END AS verdict FROM (
SELECT metric, count(*) FILTER (src = 'websocket') AS n_ws, count(*) FILTER (src = 'poll') AS n_poll, sum(v) FILTER (src = 'websocket') / count(*) FILTER (src = 'websocket') AS ws, sum(v) FILTER (src = 'poll') / count(*) FILTER (src = 'poll') AS poll FROM t_parl GROUP BY 1)
JOIN (SELECT metric, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi FROM (SELECT metric, draw, sum(v * w) FILTER (src = 'poll') / sum(w) FILTER (src = 'poll') - sum(v * w) FILTER (src = 'websocket') / sum(w) FILTER (src = 'websocket') AS d
 FROM t_parl JOIN ({weights_sql('t_par', 'token_mint', PARITY_DRAWS)}) USING (token_mint) GROUP BY 1, 2) GROUP BY 1) USING (metric)""")
def _(t):
    p = parity_rows(t)
    long = p.select("token_mint", "src", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("collapsed", "exited")])))
    means = resample.draw_means(long.withColumn("one", F.lit(1)), ["metric", "src"], "token_mint", "v", "one", PARITY_DRAWS)
    arm = lambda s: F.max(F.when(F.col("src") == s, F.col("m")))
    d = means.groupBy("metric", "draw").agg((arm("poll") - arm("websocket")).alias("d"))
    q = ev.exact_quantiles(d, ["metric"], "d", [0.025, 0.975]).select("metric", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    n = lambda s: F.count_if(F.col("src") == s)
    mean = lambda s: F.sum(F.when(F.col("src") == s, F.col("v"))) / n(s)
    g = long.groupBy("metric").agg(n("websocket").alias("n_ws"), n("poll").alias("n_poll"), mean("websocket").alias("ws"), mean("poll").alias("poll")).join(q, "metric")
    v = (F.when((F.col("n_ws") < 60) | (F.col("n_poll") < 60), "SUSPENDED")
         .when((F.col("lo") > 0) | (F.col("hi") < 0), F.when(F.abs(F.col("poll") - F.col("ws")) >= 0.2, "DIVERGENT").otherwise("SMALL")).otherwise("NONE"))
    return g.select("metric", "n_ws", "n_poll", F.round("ws", 6).alias("ws"), F.round("poll", 6).alias("poll"), v.alias("verdict"))


cte("t_parl", "SELECT token_mint, src, 'collapsed' AS metric, collapsed AS v FROM t_par UNION ALL SELECT token_mint, src, 'exited', exited FROM t_par")

CAUSE_SQL = """CASE WHEN CAST(c.token_mint AS BIGINT) % 10 = 3 THEN 'platform_unverified' WHEN f.token_mint IS NULL THEN 'no_tape_stored' WHEN f.first_ts - c.graduated_at NOT BETWEEN 0 AND 120 THEN 'tape_opens_late'
 WHEN c.graduated_at < 250 THEN 'scored_before_checkpoint_existed' WHEN l.token_mint IS NULL AND x.token_mint IS NULL THEN 'no_snapshot_for_statics' WHEN l.token_mint IS NULL AND f.first_ts - c.graduated_at > 30 THEN 'analysis_started_after_checkpoint'
 WHEN l.token_mint IS NULL THEN 'unexplained' WHEN l.ex = 1 THEN 'has_row_but_team_already_gone' ELSE 'has_usable_at_risk_row' END"""
cte("t_loss", f"""SELECT c.token_mint, {CAUSE_SQL} AS cause FROM t_coins c LEFT JOIN t_first_prices f USING (token_mint) LEFT JOIN t_team_clusters x USING (token_mint)
LEFT JOIN (SELECT p.token_mint, max(CASE WHEN m.wallet IS NOT NULL AND side = 'sell' THEN 1 ELSE 0 END) AS ex FROM t_post p LEFT JOIN t_team m ON m.token_mint = p.token_mint AND m.wallet = p.signer WHERE ts - graduated_at < 30 GROUP BY 1) l USING (token_mint)""")


@query("row_loss_waterfall", sql="SELECT cause, count(*) AS n, min(token_mint) AS sample FROM t_loss GROUP BY 1")
def _(t):
    """First matching cause per coin from one pass over pre-aggregated sides."""
    tm = t.team.select("token_mint", F.col("wallet").alias("signer"), F.lit(1).alias("tm"))
    l = t.post.filter(F.col("ts") - F.col("graduated_at") < 30).join(tm, ["token_mint", "signer"], "left").groupBy("token_mint").agg(
        F.max(F.when((F.col("tm") == 1) & (F.col("side") == "sell"), 1).otherwise(0)).alias("ex"))
    j = (t.coins.join(t.first_prices.select("token_mint", "first_ts"), "token_mint", "left")
         .join(t.team_clusters.select("token_mint", F.lit(1).alias("snap")), "token_mint", "left").join(l, "token_mint", "left"))
    lag = F.col("first_ts") - F.col("graduated_at")
    none = F.col("ex").isNull()
    cause = (F.when(F.col("token_mint").cast("long") % 10 == 3, "platform_unverified").when(F.col("first_ts").isNull(), "no_tape_stored")
             .when(~lag.between(0, 120), "tape_opens_late").when(F.col("graduated_at") < 250, "scored_before_checkpoint_existed")
             .when(none & F.col("snap").isNull(), "no_snapshot_for_statics").when(none & (lag > 30), "analysis_started_after_checkpoint")
             .when(none, "unexplained").when(F.col("ex") == 1, "has_row_but_team_already_gone").otherwise("has_usable_at_risk_row"))
    return j.groupBy(cause.alias("cause")).agg(F.count("*").alias("n"), F.min("token_mint").alias("sample"))


@query("graph_signal_correlation", "e", """SELECT 'n_components' AS feature, round(corr(rx, ry), 6) AS rho FROM (SELECT rank() OVER (ORDER BY n_components) + (count(*) OVER (PARTITION BY n_components) - 1) / 2 AS rx, rank() OVER (ORDER BY peak_multiple) + (count(*) OVER (PARTITION BY peak_multiple) - 1) / 2 AS ry FROM t_gshape JOIN t_traj USING (token_mint))
UNION ALL SELECT 'funder_edges', round(corr(rx, ry), 6) FROM (SELECT rank() OVER (ORDER BY funder_edges) + (count(*) OVER (PARTITION BY funder_edges) - 1) / 2 AS rx, rank() OVER (ORDER BY peak_multiple) + (count(*) OVER (PARTITION BY peak_multiple) - 1) / 2 AS ry FROM t_gshape JOIN t_traj USING (token_mint))""")
def _(t):
    j = shape_frame(t).join(t.trajectory.select("token_mint", "peak_multiple"), "token_mint")
    return ev.partial_spearman(j, ["n_components", "funder_edges"], "peak_multiple", "n_buys").select("feature", "rho")


@query("graph_signal_partial", "e")
def _(t):
    j = shape_frame(t).join(t.trajectory.select("token_mint", "peak_multiple"), "token_mint")
    return ev.partial_spearman(j, ["n_components", "largest_comp_share", "sel_density", "max_degree_ratio", "funder_edges"], "peak_multiple", "n_buys")


# ── alert grading ────────────────────────────────────────────────────────────
cte("t_alarms", "SELECT token_mint, CAST(graduated_at + time_to_team_exit_s AS BIGINT) AS alert_ts FROM t_traj WHERE time_to_team_exit_s IS NOT NULL AND (time_to_collapse_s IS NULL OR time_to_team_exit_s < time_to_collapse_s)")
cte("t_graded_alarm", f"""SELECT token_mint, alert_ts, CASE WHEN p0 > 0 AND last_ts >= alert_ts + {HOUR_S} THEN CASE WHEN p1 / p0 < 1 THEN 'correct' ELSE 'wrong' END WHEN last_ts >= alert_ts + {HOUR_S} THEN 'ungradable' ELSE 'pending' END AS outcome,
  CASE WHEN last_ts >= alert_ts + {HOUR_S} THEN round(p1 / p0, 6) END AS price_ratio, CASE WHEN last_ts >= alert_ts + {HOUR_S} THEN round((1 - p1 / p0) * 100, 4) END AS saved_pct FROM (
SELECT a.token_mint, a.alert_ts, arg_max(price_usd, (ts, tx_signature)) FILTER (ts <= alert_ts) AS p0, arg_max(price_usd, (ts, tx_signature)) FILTER (ts <= alert_ts + {HOUR_S}) AS p1, max(ts) AS last_ts FROM t_alarms a JOIN t_post p USING (token_mint) GROUP BY 1, 2)""")


def alarm_grades(t: Tables):
    x, c = F.col("time_to_team_exit_s"), F.col("time_to_collapse_s")
    alarms = t.trajectory.filter(x.isNotNull() & (c.isNull() | (x < c))).select("token_mint", (F.col("graduated_at") + x).cast("long").alias("alert_ts"))
    return ev.grade_exit_alarms(alarms, t.post.select("token_mint", "ts", "tx_signature", "price_usd"), HOUR_S)


@query("exit_alarm_grades", "e", "SELECT * FROM t_graded_alarm")
def _(t):
    return alarm_grades(t)


cte("t_pw", "SELECT token_mint, CASE WHEN time_to_team_exit_s IS NOT NULL THEN CASE WHEN time_to_team_exit_s <= 600 THEN 'correct' ELSE 'wrong' END WHEN tape_span_s >= 1800 THEN 'wrong' ELSE 'ungradable' END AS outcome FROM t_traj")
_summ = "count(*) AS fired, count(*) FILTER (outcome IN ('correct', 'wrong')) AS graded, count(*) FILTER (outcome = 'correct') AS correct, round(count(*) FILTER (outcome = 'correct') / nullif(count(*) FILTER (outcome IN ('correct', 'wrong')), 0), 3) AS precision, count(*) FILTER (outcome = 'pending') AS pending, count(*) FILTER (outcome = 'ungradable') AS ungradable"


@query("alert_track_record", "e", f"SELECT kind, {_summ} FROM (SELECT 'exit_alarm' AS kind, outcome FROM t_graded_alarm UNION ALL SELECT 'prewarn', outcome FROM t_pw) GROUP BY 1")
def _(t):
    pw = t.trajectory.select(F.lit("prewarn").alias("kind"), ev.grade_prewarn(F.col("time_to_team_exit_s"), F.col("tape_span_s")).alias("outcome"))
    return ev.grade_summary(alarm_grades(t).select(F.lit("exit_alarm").alias("kind"), "outcome").union(pw), ["kind"])


@query("alert_threshold", sql="SELECT min(s) AS threshold FROM (SELECT s, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp FROM (SELECT score AS s, sum(y) AS pos, sum(1 - y) AS neg FROM t_samples GROUP BY 1)) WHERE tp + fp >= 20 AND tp / (tp + fp) >= 0.35")
def _(t):
    return ev.alert_threshold(samples(t), "score", "y", precision=0.35)
