"""Registered feature and label queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapelens.functions import columns as C
from tapelens.operators import flow, labels
from tapelens.plans.registry import cte, dsum, query
from tapelens.sources.tables import exact_sum

BUY, SELL = "side = 'buy'", "side = 'sell'"

cte("t_traj", """
SELECT f.token_mint, f.graduated_at, f.first_ts, f.first_price, p.peak_price,
  round(p.peak_price / f.first_price, 4) AS peak_multiple,
  CAST(h.peak_ts - f.graduated_at AS DOUBLE) AS time_to_peak_s,
  CAST(h.coll_ts - f.graduated_at AS DOUBLE) AS time_to_collapse_s,
  CASE WHEN h.coll_ts IS NULL THEN 0 ELSE 1 END AS collapsed,
  CASE WHEN h.n_moon >= 3 THEN 1 ELSE 0 END AS reached_10x,
  CAST(x.exit_ts - f.graduated_at AS DOUBLE) AS time_to_team_exit_s,
  CASE WHEN x.exit_ts IS NOT NULL AND h.coll_ts IS NOT NULL THEN CASE WHEN x.exit_ts < h.coll_ts THEN 1 ELSE 0 END END AS team_leads_collapse,
  f.n_price_points, CAST(f.last_ts - f.graduated_at AS DOUBLE) AS tape_span_s
FROM t_first_prices f
JOIN (SELECT q.token_mint, least(min(q.price_usd), any_value(f2.first_price) * 1000) AS peak_price
      FROM (SELECT token_mint, price_usd, row_number() OVER (PARTITION BY token_mint ORDER BY price_usd DESC) AS rn FROM t_post) q
      JOIN t_first_prices f2 USING (token_mint) WHERE rn <= 3 GROUP BY 1) p USING (token_mint)
JOIN (SELECT t.token_mint, min(CASE WHEN t.price_usd >= pk.peak_price THEN ts END) AS peak_ts,
             count(*) FILTER (t.price_usd >= 10 * ff.first_price) AS n_moon,
             min(CASE WHEN t.price_usd < 0.5 * ff.first_price THEN ts END) AS coll_ts
      FROM t_post t JOIN t_first_prices ff USING (token_mint)
      JOIN (SELECT q.token_mint, least(min(q.price_usd), any_value(f2.first_price) * 1000) AS peak_price
            FROM (SELECT token_mint, price_usd, row_number() OVER (PARTITION BY token_mint ORDER BY price_usd DESC) AS rn FROM t_post) q
            JOIN t_first_prices f2 USING (token_mint) WHERE rn <= 3 GROUP BY 1) pk USING (token_mint)
      GROUP BY 1) h USING (token_mint)
LEFT JOIN (SELECT token_mint, min(ts) AS exit_ts FROM t_post p JOIN t_team tm ON tm.token_mint = p.token_mint AND tm.wallet = p.signer
           WHERE side = 'sell' GROUP BY ALL) x USING (token_mint)""".replace("SELECT token_mint, min(ts) AS exit_ts", "SELECT p.token_mint, min(ts) AS exit_ts"))
cte("t_accum", f"""
SELECT *, CASE WHEN bc_buy_count = 0 THEN NULL WHEN bc_buy_count >= 2 THEN 'gradual' WHEN first_buy_offset_s <= 30 THEN 'sniped' ELSE 'single' END AS accumulation_style
FROM (SELECT token_mint, signer AS wallet,
  CAST(min(CASE WHEN {BUY} THEN greatest(ts - created_at, 0) END) AS DOUBLE) AS first_buy_offset_s,
  count(*) FILTER ({BUY}) AS bc_buy_count, count(*) FILTER ({SELL}) AS bc_sell_count,
  {dsum(f"CASE WHEN {BUY} THEN sol_amount ELSE 0 END", 4)} AS total_sol_in
  FROM t_bc GROUP BY 1, 2)""")
cte("t_flow", f"""
SELECT b.token_mint, n_trades, CAST(n_buyers AS BIGINT) AS n_buyers, CAST(n_sellers AS BIGINT) AS n_sellers, buys_first_60s,
  coalesce(same_second_bundle_count, 0) AS same_second_bundle_count,
  coalesce(top5_buyer_share, 0) AS top5_buyer_share, coalesce(gini_buy_size, 0) AS gini_buy_size, sol_in, sol_out
FROM (SELECT token_mint, count(*) AS n_trades, count(*) FILTER ({BUY} AND ts - created_at BETWEEN 0 AND 60) AS buys_first_60s,
        count(DISTINCT CASE WHEN {BUY} THEN signer END) AS n_buyers, count(DISTINCT CASE WHEN {SELL} THEN signer END) AS n_sellers,
        {dsum(f"CASE WHEN {BUY} THEN sol_amount ELSE 0 END", 4)} AS sol_in,
        {dsum(f"CASE WHEN {SELL} THEN sol_amount ELSE 0 END", 4)} AS sol_out
      FROM t_bc GROUP BY 1) b
LEFT JOIN (SELECT token_mint, count(*) AS same_second_bundle_count FROM (
        SELECT token_mint, ts FROM t_bc WHERE {BUY} GROUP BY 1, 2 HAVING count(DISTINCT signer) >= 2) GROUP BY 1) s USING (token_mint)
LEFT JOIN (SELECT token_mint, round({dsum("CASE WHEN rd <= 5 THEN sol_amount ELSE 0 END")} / {dsum("sol_amount")}, 4) AS top5_buyer_share,
        CASE WHEN count(*) >= 2 THEN round(2 * {dsum("ra * sol_amount")} / (count(*) * {dsum("sol_amount")}) - (count(*) + 1) / count(*), 4) ELSE 0 END AS gini_buy_size
      FROM (SELECT *, row_number() OVER (PARTITION BY token_mint ORDER BY sol_amount) AS ra,
                   row_number() OVER (PARTITION BY token_mint ORDER BY sol_amount DESC, wallet) AS rd FROM t_buyers) GROUP BY 1) g USING (token_mint)""")


@query("flow_bonding_curve", sql="SELECT * FROM t_flow")
def _(t):
    return flow.bc_flow(t.bc)


@query("flow_bonding_curve_events", "e", "SELECT * FROM t_flow")
def _(t):
    return flow.bc_flow(t.bc)


@query("dedup_swaps_first", "e", """
SELECT token_mint, signer, slot10 AS slot, side, sol_amount, token_amount, ts, tx_signature FROM (
  SELECT *, slot // 10 AS slot10, row_number() OVER (PARTITION BY token_mint, signer, slot // 10, side ORDER BY ts, tx_signature) AS rn
  FROM t_swaps) WHERE rn = 1""")
def _(t):
    coarse = t.swaps.withColumn("slot", F.expr("slot div 10"))
    return flow.dedup_swaps(coarse).select(
        "token_mint", "signer", "slot", "side", "sol_amount", "token_amount", "ts", "tx_signature")


@query("window_filter_post_anchor", sql="""
SELECT token_mint, count(*) AS n, CAST(sum(ts) AS BIGINT) AS ts_sum FROM t_post WHERE ts <= graduated_at + 600 GROUP BY 1""")
def _(t):
    return t.post.filter(F.col("ts") <= F.col("graduated_at") + 600).groupBy("token_mint").agg(
        F.count("*").alias("n"), F.sum("ts").alias("ts_sum"))


@query("unit_price_extremes", sql="""
SELECT token_mint, min(CASE WHEN token_amount > 0 THEN sol_amount / token_amount END) AS lo,
       max(CASE WHEN token_amount > 0 THEN sol_amount / token_amount END) AS hi FROM t_swaps GROUP BY 1""")
def _(t):
    p = C.unit_price()
    return t.swaps.groupBy("token_mint").agg(F.min(p).alias("lo"), F.max(p).alias("hi"))


@query("accumulation_style", sql="SELECT * FROM t_accum")
def _(t):
    return flow.accumulation(t.bc)


@query("reconstruction_window", sql="""
SELECT c.token_mint, least(tk.created_at, c.created_at) AS effective_created, count(*) AS n_swaps, count(DISTINCT signer) AS n_wallets
FROM t_bc c JOIN t_tokens tk USING (token_mint) WHERE signer NOT IN (SELECT wallet FROM t_cex) GROUP BY 1, 2""")
def _(t):
    kept = t.bc.join(t.cex_wallets, F.col("signer") == F.col("wallet"), "left_anti")
    per = kept.groupBy("token_mint", "signer", "created_at").agg(F.count("*").alias("n"))
    tk = t.tokens.select("token_mint", F.col("created_at").alias("declared"))
    return per.join(tk, "token_mint").groupBy(
        "token_mint", F.least("declared", "created_at").alias("effective_created")).agg(
        F.sum("n").alias("n_swaps"), F.count("*").alias("n_wallets"))


@query("token_buyers", sql="""SELECT token_mint, wallet, bought_at, round(sol_amount, 6) AS sol_amount, round(tokens_received, 6) AS tokens_received FROM t_buyers""")
def _(t):
    return t.buyers.select("token_mint", "wallet", "bought_at", F.round("sol_amount", 6).alias("sol_amount"),
                           F.round("tokens_received", 6).alias("tokens_received"))


@query("holders_top20", sql="SELECT token_mint, wallet, CAST(rank AS BIGINT) AS rank, amount, pct FROM t_holders")
def _(t):
    return t.holders.select("token_mint", "wallet", F.col("rank").cast("long").alias("rank"), "amount", "pct")


@query("structural_exclusion", sql="""
SELECT token_mint, count(*) AS holders, """ + dsum("amount") + """ AS amount FROM t_balances b
WHERE wallet NOT IN (SELECT wallet FROM t_cex)
  AND NOT EXISTS (SELECT 1 FROM t_tokens k WHERE k.token_mint = b.token_mint AND k.token_mint = b.wallet) GROUP BY 1""")
def _(t):
    pools = t.tokens.select("token_mint", F.col("token_mint").alias("wallet"))
    kept = t.balances.join(t.cex_wallets, "wallet", "left_anti").join(pools, ["token_mint", "wallet"], "left_anti")
    return kept.groupBy("token_mint").agg(F.count("*").alias("holders"), exact_sum("amount").alias("amount"))


@query("tape_flow_totals", sql=f"""
SELECT token_mint, count(*) FILTER ({BUY}) AS buys, count(*) FILTER ({SELL}) AS sells,
  count(DISTINCT CASE WHEN {BUY} THEN signer END) AS unique_buyers,
  {dsum(f"CASE WHEN is_team THEN 0 WHEN {BUY} THEN sol_amount ELSE -sol_amount END")} AS retail_net_sol
FROM (SELECT p.*, tm.wallet IS NOT NULL AS is_team FROM t_post p LEFT JOIN t_team tm ON tm.token_mint = p.token_mint AND tm.wallet = p.signer)
GROUP BY 1""")
def _(t):
    marks = t.team.select("token_mint", F.col("wallet").alias("signer"), F.lit(True).alias("tm"))
    per = t.post.join(marks, ["token_mint", "signer"], "left").groupBy("token_mint", "signer").agg(
        F.count_if(F.expr(BUY)).alias("b"), F.count_if(F.expr(SELL)).alias("s"),
        exact_sum(F.when(F.col("tm"), 0.0).when(F.expr(BUY), F.col("sol_amount")).otherwise(-F.col("sol_amount"))).alias("r"))
    return per.groupBy("token_mint").agg(
        F.sum("b").alias("buys"), F.sum("s").alias("sells"), F.count_if(F.col("b") > 0).alias("unique_buyers"),
        exact_sum("r").alias("retail_net_sol"))


cte("t_sells", "SELECT * FROM t_post WHERE side = 'sell'")
cte("t_team_sells", "SELECT s.* FROM t_sells s JOIN t_team m ON m.token_mint = s.token_mint AND m.wallet = s.signer")


def anchored_cte(name: str, source: str, width: int, col: str = "ts") -> None:
    """Recursive twin of the anchored fold: {name}(token_mint, anchor) and {name}_g(token_mint, t, anchor)."""
    cte(f"{name}", f"""COLUMNS(token_mint, anchor) AS
  SELECT token_mint, min({col}) FROM {source} GROUP BY 1
  UNION ALL
  SELECT a.token_mint, min(s.{col}) FROM {name} a JOIN {source} s ON s.token_mint = a.token_mint AND s.{col} > a.anchor + {width} GROUP BY a.token_mint""")
    cte(f"{name}_g", f"""SELECT s.token_mint, s.{col} AS t, max(a.anchor) AS anchor FROM (SELECT DISTINCT token_mint, {col} FROM {source}) s
  JOIN {name} a ON a.token_mint = s.token_mint AND a.anchor <= s.{col} GROUP BY 1, 2""")


anchored_cte("t_anch300", "t_sells", 300)
anchored_cte("t_anch300tm", "t_team_sells", 300)


@query("coordinated_sell_windows", sql="""
SELECT s.token_mint, g.anchor, count(DISTINCT signer) AS n_wallets, count(*) AS n_sells, max(ts) AS window_end
FROM t_sells s JOIN t_anch300_g g ON g.token_mint = s.token_mint AND g.t = s.ts GROUP BY 1, 2 HAVING count(DISTINCT signer) >= 2""")
def _(t):
    return flow.coordinated_windows(t.post.filter(SELL))


cte("t_team_swaps", "SELECT s.* FROM t_post s JOIN t_team m ON m.token_mint = s.token_mint AND m.wallet = s.signer")
cte("t_team_metrics", f"""
SELECT b.token_mint, team_buy_count, team_sell_count, team_net_sol,
  CASE WHEN held > 0 THEN round(least(sold / held * 100, 100), 2) END AS snipers_sold_pct,
  coalesce(n, 0) AS coordinated_sell_count
FROM (SELECT token_mint, count(*) FILTER ({BUY}) AS team_buy_count, count(*) FILTER ({SELL}) AS team_sell_count,
        {dsum(f"CASE WHEN {SELL} THEN sol_amount ELSE -sol_amount END", 4)} AS team_net_sol,
        {dsum(f"CASE WHEN {SELL} THEN token_amount ELSE 0 END")} AS sold FROM t_team_swaps GROUP BY 1) b
LEFT JOIN (SELECT token_mint, {dsum("amount")} AS held FROM t_team GROUP BY 1) h USING (token_mint)
LEFT JOIN (SELECT token_mint, count(*) AS n FROM (
   SELECT s.token_mint, g.anchor FROM t_team_sells s JOIN t_anch300tm_g g ON g.token_mint = s.token_mint AND g.t = s.ts
   GROUP BY 1, 2 HAVING count(DISTINCT signer) >= 2) GROUP BY 1) w USING (token_mint)""")


def team_swaps(t):
    return t.post.join(t.team.select("token_mint", F.col("wallet").alias("signer")), ["token_mint", "signer"], "left_semi")


@query("team_swap_metrics", sql="SELECT * FROM t_team_metrics")
def _(t):
    return flow.team_swap_metrics(team_swaps(t), t.team)


cte("t_attention", f"""
SELECT w.token_mint, n_trades, n_wallets, n_buys / n_trades AS buy_ratio, n_trades / greatest(n_wallets, 1) AS trades_per_wallet,
  buy_sol, net_sol, peak / first AS price_run, n_late / greatest(n_early, 1) AS accel,
  n_fresh / greatest(n_wallets, 1) AS new_wallet_rate, max_buy_sol, retail_net_sol, team_sold
FROM (SELECT p.token_mint, count(*) AS n_trades, count(*) FILTER ({BUY}) AS n_buys,
    {dsum(f"CASE WHEN {BUY} THEN sol_amount ELSE 0 END")} AS buy_sol,
    {dsum(f"CASE WHEN {BUY} THEN sol_amount ELSE -sol_amount END")} AS net_sol,
    coalesce(max(CASE WHEN {BUY} THEN sol_amount END), 0) AS max_buy_sol,
    {dsum(f"CASE WHEN tm.wallet IS NOT NULL THEN 0 WHEN {BUY} THEN sol_amount ELSE -sol_amount END")} AS retail_net_sol,
    max(CASE WHEN tm.wallet IS NOT NULL AND {SELL} THEN 1 ELSE 0 END) AS team_sold,
    max(price_usd) AS peak, arg_min(price_usd, (ts, tx_signature)) AS first,
    count(*) FILTER (ts - graduated_at >= 150) AS n_late, count(*) FILTER (ts - graduated_at < 150) AS n_early
  FROM t_post p LEFT JOIN t_team tm ON tm.token_mint = p.token_mint AND tm.wallet = p.signer
  WHERE ts <= graduated_at + 300 GROUP BY 1) w
JOIN (SELECT token_mint, count(*) AS n_wallets, count(*) FILTER (first_ts - g >= 150) AS n_fresh FROM (
  SELECT token_mint, signer, min(ts) AS first_ts, any_value(graduated_at) AS g FROM t_post WHERE ts <= graduated_at + 300 GROUP BY 1, 2) GROUP BY 1) x USING (token_mint)
WHERE n_trades >= 3""")


@query("early_attention", sql="SELECT * FROM t_attention")
def _(t):
    return flow.early_attention(t.post, t.team)


@query("early_attention_events", "e", "SELECT * FROM t_attention")
def _(t):
    return flow.early_attention(t.post, t.team)


cte("t_choreo", f"""
SELECT m.token_mint, m.wallet, e.exit_order, CAST(e.first_sell - c.graduated_at AS DOUBLE) AS first_sell_offset_s,
  CASE WHEN m.amount > 0 THEN round(least(coalesce(e.sold, 0) / m.amount, 1) * 100, 2) END AS sold_pct,
  CASE WHEN e.exit_order = 1 THEN 1 ELSE 0 END AS is_first_seller,
  CASE WHEN k.signer IS NOT NULL THEN 1 ELSE 0 END AS participated_coordinated_sell
FROM t_team m JOIN t_coins c USING (token_mint)
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY token_mint ORDER BY first_sell, wallet) AS exit_order FROM (
    SELECT token_mint, signer AS wallet, min(ts) AS first_sell, {dsum("token_amount")} AS sold FROM t_team_sells GROUP BY 1, 2)) e
  USING (token_mint, wallet)
LEFT JOIN (SELECT DISTINCT s.token_mint, s.signer FROM t_team_sells s JOIN t_anch300tm_g g ON g.token_mint = s.token_mint AND g.t = s.ts
  JOIN (SELECT s2.token_mint, g2.anchor FROM t_team_sells s2 JOIN t_anch300tm_g g2 ON g2.token_mint = s2.token_mint AND g2.t = s2.ts
        GROUP BY 1, 2 HAVING count(DISTINCT s2.signer) >= 2) ok ON ok.token_mint = g.token_mint AND ok.anchor = g.anchor) k
  ON k.token_mint = m.token_mint AND k.signer = m.wallet""")
cte("t_choreo_sum", """
SELECT token_mint, arg_min(wallet, exit_order) AS leader_wallet,
  CASE WHEN count(*) >= 2 THEN max(first_sell_offset_s) - min(first_sell_offset_s) END AS exit_spread_s, count(*) AS n_sellers
FROM t_choreo WHERE exit_order IS NOT NULL GROUP BY 1""")


@query("exit_choreography", sql="SELECT * FROM t_choreo")
def _(t):
    return flow.exit_choreography(t.post, t.team)


@query("exit_choreography_summary", sql="SELECT * FROM t_choreo_sum")
def _(t):
    return flow.choreography_summary(flow.exit_choreography(t.post, t.team))


@query("choreography_by_check", sql=f"""
SELECT token_mint, wallet, max(CASE WHEN h = 1 THEN p END) AS sold_pct_1h, max(CASE WHEN h = 4 THEN p END) AS sold_pct_4h,
       max(CASE WHEN h = 24 THEN p END) AS sold_pct_24h
FROM (SELECT m.token_mint, m.wallet, h, round(least(coalesce({dsum("s.token_amount")}, 0) / any_value(m.amount), 1) * 100, 2) AS p
      FROM t_team m CROSS JOIN (VALUES (1), (4), (24)) hh(h)
      LEFT JOIN t_team_sells s ON s.token_mint = m.token_mint AND s.signer = m.wallet AND s.ts <= s.graduated_at + h * 100
      GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def _(t):
    hours = [1, 4, 24]
    s = team_swaps(t).filter(SELL).withColumn("h", F.explode(F.array(*map(F.lit, hours))))
    s = s.filter(F.col("ts") <= F.col("graduated_at") + F.col("h") * 100)
    sold = s.groupBy("token_mint", F.col("signer").alias("wallet")).pivot("h", hours).agg(exact_sum("token_amount"))
    j = t.team.join(sold, ["token_mint", "wallet"], "left")
    pct = lambda h: F.round(F.least(F.coalesce(F.col(str(h)), F.lit(0.0)) / F.col("amount"), F.lit(1.0)) * 100, 2)
    return j.select("token_mint", "wallet", *[pct(h).alias(f"sold_pct_{h}h") for h in hours])


cte("t_sellstruct", f"""
SELECT *, CASE WHEN n_sellers >= 3 AND still_selling = 1 THEN 'CRITICAL'
               WHEN n_sellers >= 3 OR (still_selling = 1 AND share_of_sells > 0.3) THEN 'ELEVATED' ELSE 'LOW' END AS severity
FROM (SELECT s.token_mint, count(*) FILTER (m.wallet IS NOT NULL) AS n_sells,
        count(DISTINCT CASE WHEN m.wallet IS NOT NULL THEN signer END) AS n_sellers,
        {dsum("CASE WHEN m.wallet IS NOT NULL THEN sol_amount ELSE 0 END")} / {dsum("sol_amount")} AS share_of_sells,
        max(CASE WHEN m.wallet IS NOT NULL AND ts - graduated_at >= 1200 THEN 1 ELSE 0 END) AS still_selling
      FROM t_sells s LEFT JOIN t_team m ON m.token_mint = s.token_mint AND m.wallet = s.signer
      WHERE ts <= graduated_at + 1800 GROUP BY 1) WHERE n_sells > 0""")


@query("sell_structure_severity", sql="SELECT * FROM t_sellstruct")
def _(t):
    return flow.sell_structure(t.post, t.team, 1800)


@query("trajectory_labels", sql="SELECT * FROM t_traj")
def _(t):
    return labels.trajectory(t.post, t.team)


@query("trajectory_labels_events", "e", "SELECT * FROM t_traj")
def _(t):
    return labels.trajectory(t.post, t.team)


@query("trajectory_recompute_diff", sql="""
SELECT count(*) AS n_coins, count(*) FILTER (a.time_to_team_exit_s IS DISTINCT FROM b.v) AS n_changed
FROM t_traj a LEFT JOIN (SELECT p.token_mint, CAST(min(ts) - any_value(graduated_at) AS DOUBLE) AS v FROM t_sells p
  WHERE EXISTS (SELECT 1 FROM t_holders h WHERE h.token_mint = p.token_mint AND h.wallet = p.signer AND h.rank <= 5) GROUP BY 1) b USING (token_mint)""")
def _(t):
    """Stored labels (top-five team) against recomputation (full team), null-safe."""
    stored = (t.post.filter(SELL).join(
        t.holders.filter("rank <= 5").select("token_mint", F.col("wallet").alias("signer")), ["token_mint", "signer"], "left_semi")
        .groupBy("token_mint").agg((F.min("ts") - F.first("graduated_at")).cast("double").alias("v")))
    j = labels.trajectory(t.post, t.team).join(stored, "token_mint", "left")
    return j.agg(F.count("*").alias("n_coins"), F.count_if(~F.col("time_to_team_exit_s").eqNullSafe(F.col("v"))).alias("n_changed"))


cte("t_heads", """
SELECT token_mint, graduated_at, CASE WHEN time_to_collapse_s IS NULL OR time_to_collapse_s > 3600 THEN 1 ELSE 0 END AS survive60,
  CASE WHEN time_to_team_exit_s IS NOT NULL THEN CASE WHEN time_to_team_exit_s <= 600 THEN 1 ELSE 0 END END AS team_exit10,
  reached_10x AS moon10x, CASE WHEN time_to_collapse_s <= 900 THEN 1 ELSE 0 END AS fastrug,
  CASE WHEN time_to_collapse_s IS NOT NULL THEN CASE WHEN time_to_collapse_s >= 3600 THEN 1 ELSE 0 END
       WHEN tape_span_s >= 3600 THEN 1 END AS survive60_censored
FROM t_gated""")
cte("t_gated", "SELECT * FROM t_traj WHERE first_ts - graduated_at BETWEEN 0 AND 120 AND n_price_points >= 30")


@query("label_heads", "e", "SELECT * FROM t_heads")
def _(t):
    return labels.label_heads(labels.anchor_gated(t.trajectory))


@query("outcome_labels", sql="SELECT token_mint, check_offset_h, price, price_change_pct, classified FROM t_outcomes")
def _(t):
    return t.outcomes.select("token_mint", "check_offset_h", "price", "price_change_pct", "classified")


cte("t_prints", "SELECT token_mint, ts, price_usd FROM t_post")
cte("t_follow", """
SELECT * FROM (
SELECT b.signer AS wallet, b.token_mint, b.ts AS bought_at, b.tx_signature,
  (CASE WHEN (SELECT count(*) FROM t_prints p WHERE p.token_mint = b.token_mint AND p.ts > b.ts + 5 AND p.ts <= b.ts + 605 AND p.price_usd >= fi.fill * 1.2) >= 3
        THEN 1.2 ELSE fo.fill / fi.fill END) * (1 - 0.015) AS realised_multiple
FROM t_team_swaps b
JOIN t_fills fi ON fi.token_mint = b.token_mint AND fi.t = b.ts + 5
LEFT JOIN t_fills fo ON fo.token_mint = b.token_mint AND fo.t = b.ts + 605
WHERE b.side = 'buy' AND b.token_mint IN (SELECT token_mint FROM t_prints GROUP BY 1 HAVING count(*) >= 30))
WHERE realised_multiple IS NOT NULL""")
cte("t_fills", """
SELECT * FROM (SELECT a.token_mint, a.t, coalesce(
   (SELECT median(p.price_usd) FROM t_prints p WHERE p.token_mint = a.token_mint AND p.ts BETWEEN a.t AND a.t + 15),
   (SELECT arg_min(p.price_usd, (p.ts, p.price_usd)) FROM t_prints p WHERE p.token_mint = a.token_mint AND p.ts >= a.t)) AS fill
FROM (SELECT token_mint, ts + 5 AS t FROM t_team_swaps WHERE side = 'buy' UNION SELECT token_mint, ts + 605 FROM t_team_swaps WHERE side = 'buy') a)
WHERE fill IS NOT NULL""")
cte("t_follow_stats", """
SELECT wallet, count(*) AS n_trades, count(DISTINCT token_mint) AS n_coins,
  CAST(sum(CAST(realised_multiple AS DECIMAL(28,12))) AS DOUBLE) / count(*) AS mean_multiple,
  median(realised_multiple) AS median_multiple, count(*) FILTER (realised_multiple > 1) / count(*) AS win_rate
FROM t_follow GROUP BY 1""")


@query("follow_returns", "e", "SELECT * FROM t_follow")
def _(t):
    return labels.follow_returns(t.post, t.team)


@query("follow_stats", "e", "SELECT * FROM t_follow_stats")
def _(t):
    return labels.follow_stats(labels.follow_returns(t.post, t.team))


@query("follow_returns_rebuild", sql="""
SELECT f.token_mint, count(*) AS n, count(*) FILTER (realised_multiple > 1) AS wins FROM t_follow f
WHERE token_mint IN (SELECT token_mint FROM t_first_prices WHERE first_ts - graduated_at BETWEEN 0 AND 120) GROUP BY 1""")
def _(t):
    ok = t.first_prices.filter((F.col("first_ts") - F.col("graduated_at")).between(0, 120))
    r = labels.follow_returns(t.post.join(ok.select("token_mint"), "token_mint", "left_semi"), t.team)
    return r.groupBy("token_mint").agg(F.count("*").alias("n"), F.count_if(F.col("realised_multiple") > 1).alias("wins"))


cte("t_attribution", """
SELECT token_mint, state, CASE WHEN state = 'uncertain' THEN n_sold ELSE 0 END AS n_ungated_sellers FROM (
SELECT t.token_mint, coalesce(n_sold, 0) AS n_sold, CASE WHEN time_to_team_exit_s IS NOT NULL THEN 'observed' WHEN coalesce(supply_pct, 0) >= 10 THEN 'held'
   WHEN coalesce(n_sold, 0) > 0 THEN 'uncertain' ELSE 'held' END AS state
FROM t_traj t LEFT JOIN t_team_clusters USING (token_mint) LEFT JOIN (
  SELECT b.token_mint, count(DISTINCT b.wallet) AS n_sold FROM t_buyers b JOIN t_sells s ON s.token_mint = b.token_mint AND s.signer = b.wallet
  WHERE NOT EXISTS (SELECT 1 FROM t_team m WHERE m.token_mint = b.token_mint AND m.wallet = b.wallet) GROUP BY 1) n USING (token_mint))""")


def attribution(t):
    return labels.attribution(t.trajectory, t.team_clusters, t.team, t.buyers, t.post)


@query("attribution_state", sql="SELECT * FROM t_attribution")
def _(t):
    return attribution(t)


@query("attribution_tally", sql="SELECT state, count(*) AS n, CAST(sum(n_ungated_sellers) AS BIGINT) AS sellers FROM t_attribution GROUP BY 1")
def _(t):
    return attribution(t).groupBy("state").agg(F.count("*").alias("n"), F.sum("n_ungated_sellers").alias("sellers"))


cte("t_exits", f"""
SELECT s.*, b.bought_at, CASE WHEN first_sell - bought_at >= 0 THEN CAST(first_sell - bought_at AS DOUBLE) END AS hold_duration_s,
  CASE WHEN sold > 0 THEN round(largest / sold, 4) END AS one_shot_frac
FROM (SELECT token_mint, signer AS wallet, {dsum("token_amount")} AS sold, max(token_amount) AS largest, min(ts) AS first_sell FROM t_sells GROUP BY 1, 2) s
LEFT JOIN t_buyers b USING (token_mint, wallet)""")
cte("t_habits", f"""
SELECT a.wallet, n_coins_bc, sniper_rate, so / no AS avg_first_buy_offset_s,
  round(sqrt(greatest(so2 / no - (so / no) * (so / no), 0)), 4) AS std_first_buy_offset_s, sz / nz AS avg_buy_size_sol,
  round(sqrt(greatest(sz2 / nz - (sz / nz) * (sz / nz), 0)) / (sz / nz), 3) AS cv_buy_size, pct_sniped, pct_gradual, pct_single,
  avg_hold_duration_s, exit_one_shot_frac, coalesce(n_coins_exit, 0) AS n_coins_exit
FROM (SELECT wallet, count(*) AS n_coins_bc,
   round(count(*) FILTER (accumulation_style = 'sniped' OR first_buy_offset_s <= 120) / count(*), 4) AS sniper_rate,
   round(count(*) FILTER (accumulation_style = 'sniped') / count(*), 4) AS pct_sniped,
   round(count(*) FILTER (accumulation_style = 'gradual') / count(*), 4) AS pct_gradual,
   round(count(*) FILTER (accumulation_style = 'single') / count(*), 4) AS pct_single,
   nullif(count(first_buy_offset_s), 0) AS no, {dsum("first_buy_offset_s")} AS so,
   CAST(sum(CAST(CAST(first_buy_offset_s AS DECIMAL(18,6)) * CAST(first_buy_offset_s AS DECIMAL(18,6)) AS DECIMAL(38,6))) AS DOUBLE) AS so2,
   nullif(count(*) FILTER (total_sol_in > 0), 0) AS nz, {dsum("CASE WHEN total_sol_in > 0 THEN total_sol_in END")} AS sz,
   CAST(sum(CAST(CAST(CASE WHEN total_sol_in > 0 THEN total_sol_in END AS DECIMAL(18,6)) * CAST(total_sol_in AS DECIMAL(18,6)) AS DECIMAL(38,6))) AS DOUBLE) AS sz2
   FROM t_accum GROUP BY 1) a
LEFT JOIN (SELECT wallet, avg(hold_duration_s) AS avg_hold_duration_s, {dsum("one_shot_frac")} / nullif(count(one_shot_frac), 0) AS exit_one_shot_frac,
   count(*) AS n_coins_exit FROM t_exits GROUP BY 1) e USING (wallet)""")


def habits(t):
    return flow.wallet_habits(flow.accumulation(t.bc), flow.exit_summaries(t.post, t.buyers))


@query("wallet_exit_summaries", sql="SELECT token_mint, wallet, hold_duration_s, one_shot_frac FROM t_exits")
def _(t):
    return flow.exit_summaries(t.post, t.buyers)


@query("wallet_behavior", sql="SELECT * FROM t_habits")
def _(t):
    return habits(t)


def _vec(c, d):
    return f"greatest(0, least(coalesce({c}, 0) / {d}, 1))"


cte("t_vectors", "SELECT wallet, n_coins_bc, " + ", ".join(
    f"{_vec(c, d)} AS v{i}" for i, (c, d) in enumerate(flow.VECTOR_FIELDS)) +
    ", greatest(0, least(log10(1 + coalesce(avg_buy_size_sol, 0)) / 2, 1)) AS v8 FROM t_habits")


@query("behavior_vectors", sql="SELECT wallet, n_coins_bc, v0, v1, v2, v3, v4, v5, v6, v7, round(v8, 6) AS v8 FROM t_vectors WHERE n_coins_bc >= 3")
def _(t):
    v = flow.behavior_vector(habits(t)).filter("n_coins_bc >= 3")
    return v.withColumn("v8", F.round("v8", 6))


@query("manufactured_flags", sql="""
SELECT *, CASE WHEN len(string_split(flags, ',')) >= 2 THEN 1 ELSE 0 END AS is_manufactured FROM (
SELECT c.token_mint, concat_ws(',', CASE WHEN c.graduated_at - c.created_at > 0 AND c.graduated_at - c.created_at < 300 THEN 'lightning_curve' END,
   CASE WHEN n_buyers > 0 AND n_buyers < 25 THEN 'few_buyers' END, CASE WHEN top5_buyer_share >= 0.6 THEN 'bundled_buying' END,
   CASE WHEN least(supply_pct, 100) >= 50 THEN 'team_majority' END, CASE WHEN g >= 8 THEN 'slot_bundle' END) AS flags
FROM t_coins c LEFT JOIN t_flow f USING (token_mint) LEFT JOIN t_team_clusters tc USING (token_mint)
LEFT JOIN (SELECT token_mint, max(n) AS g FROM (SELECT token_mint, slot, count(*) AS n FROM t_bc WHERE side = 'buy' GROUP BY 1, 2) GROUP BY 1) m USING (token_mint))""")
def _(t):
    slots = (t.bc.filter(BUY).groupBy("token_mint", "slot").agg(F.count("*").alias("n"))
             .groupBy("token_mint").agg(F.max("n").alias("g")))
    j = (t.coins.join(flow.bc_flow(t.bc).select("token_mint", "n_buyers", "top5_buyer_share"), "token_mint", "left")
         .join(t.team_clusters.select("token_mint", "supply_pct"), "token_mint", "left").join(slots, "token_mint", "left"))
    fl = C.manufactured_flags(F.col("graduated_at") - F.col("created_at"), "n_buyers", "top5_buyer_share", "supply_pct", "g")
    return j.withColumn("f", fl).select(
        "token_mint", F.concat_ws(",", "f").alias("flags"), (F.size("f") >= 2).cast("int").alias("is_manufactured"))


@query("flow_and_labels", sql="""
SELECT f.token_mint, n_trades, n_buyers, gini_buy_size, sol_in, sol_out, peak_multiple, time_to_collapse_s, reached_10x, time_to_team_exit_s
FROM t_flow f JOIN t_traj USING (token_mint)""")
def _(t):
    return flow.bc_flow(t.bc).join(t.trajectory, "token_mint").select(
        "token_mint", "n_trades", "n_buyers", "gini_buy_size", "sol_in", "sol_out", "peak_multiple",
        "time_to_collapse_s", "reached_10x", "time_to_team_exit_s")
