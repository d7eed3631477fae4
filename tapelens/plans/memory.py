"""Registered cross-coin memory, verdict and pattern queries with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapelens.operators import flow, memory, patterns, team, verdict
from tapelens.plans.registry import cte, dsum, query
from tapelens.plans.teams import micro
from tapelens.sources.tables import HOUR_S, Tables, exact_sum

RESOLVE_S = 4 * HOUR_S
AS_OF, DAY_S, VELOCITY_DAY = 2600, 30, 240

cte("t_out4", "SELECT token_mint, classified FROM t_outcomes WHERE check_offset_h = 4")


def out4(t: Tables):
    return t.outcomes.filter("check_offset_h = 4").select("token_mint", "classified")


cte("t_wstats", """
SELECT *, total_calls AS graduated_calls, CASE WHEN total_calls >= 15 THEN wins / greatest(wins + losses, 1) END AS win_rate FROM (
SELECT wallet, count(*) AS total_calls, count(*) FILTER (classified = 'moon') AS wins, count(*) FILTER (classified = 'rug') AS losses
FROM t_buyers JOIN t_out4 USING (token_mint) GROUP BY 1)""")


def wstats(t: Tables):
    return t.store("wallet_stats", lambda: memory.wallet_stats(t.buyers, out4(t)))


@query("wallet_stats", sql="SELECT * FROM t_wstats")
def _(t):
    return memory.wallet_stats(t.buyers, out4(t))


@query("wallet_stats_events", "e", "SELECT * FROM t_wstats")
def _(t):
    return wstats(t)


cte("t_trades", "SELECT signer AS wallet, count(*) AS total_trades FROM t_swaps GROUP BY 1")
cte("t_smart", f"""
SELECT wallet, win_rate_90d, total_trades, round(greatest(0, least(0.60::DOUBLE * win_rate_90d + 0.25::DOUBLE * least(coalesce(total_trades, 0) / 500.0::DOUBLE, 1)
   + 0.15::DOUBLE * greatest(0, 1.0::DOUBLE - (({AS_OF} - last_ts) / {DAY_S}) / 90.0::DOUBLE), 1)), 4) AS score
FROM (SELECT wallet, count(*) FILTER (classified IN ('moon', 'ok')) / count(*) AS win_rate_90d FROM t_buyers JOIN t_out4 USING (token_mint)
      WHERE bought_at >= {AS_OF - 90 * DAY_S} GROUP BY 1)
JOIN (SELECT wallet, max(bought_at) AS last_ts FROM t_buyers GROUP BY 1) USING (wallet) LEFT JOIN t_trades USING (wallet)""")


def smart(t: Tables):
    def make():
        trades = t.all_trades.groupBy("wallet").agg(F.count("*").alias("total_trades"))
        return memory.smart_scores(t.buyers, out4(t), trades, AS_OF, DAY_S)
    return t.store("smart_scores", make)


@query("smart_money_scores", sql="SELECT * FROM t_smart")
def _(t):
    return smart(t)


SMART_SCORE = 0.4   # the landed tapes are short, so the 0.7 gate would leave the list empty
cte("t_smart_list", f"SELECT wallet, score FROM t_smart WHERE score >= {SMART_SCORE}")


@query("smart_money_in_buyers", sql="SELECT b.token_mint, b.wallet, s.score FROM t_buyers b JOIN t_smart_list s USING (wallet)")
def _(t):
    return t.buyers.select("token_mint", "wallet").join(smart(t).filter(F.col("score") >= SMART_SCORE).select("wallet", "score"), "wallet")


@query("smart_money_seed", sql="""
SELECT wallet, CASE WHEN label LIKE '%smart%' THEN greatest(s, 0.72) ELSE s END AS score FROM (
SELECT w.wallet, CASE WHEN CAST(w.wallet AS BIGINT) % 3 = 0 THEN 'smart_degen' ELSE 'other' END AS label, round(0.70::DOUBLE * win_rate_90d + 0.30::DOUBLE * least(total_trades / 500.0::DOUBLE, 1), 4) AS s
FROM t_smart w WHERE win_rate_90d >= 0.5 AND total_trades >= 20 AND w.wallet NOT IN (SELECT wallet FROM t_cex))""")
def _(t):
    label = F.when(F.col("wallet").cast("long") % 3 == 0, "smart_degen").otherwise("other")
    p = smart(t).select("wallet", F.col("win_rate_90d").alias("win_rate"), F.col("total_trades").alias("trades"))
    p = p.join(t.cex_wallets, "wallet", "left_anti").withColumn("label", label)
    return memory.external_scores(p, 0.5, 20).select("wallet", "score")


cte("t_graded", """SELECT f.token_mint, f.funder, o.classified, tc.supply_pct, c.graduated_at FROM t_coin_funder f JOIN t_out4 o USING (token_mint)
LEFT JOIN t_team_clusters tc USING (token_mint) JOIN t_coins c USING (token_mint)""")
cte("t_graded_c", """SELECT f.token_mint, f.creator, o.classified, tc.supply_pct, c.graduated_at FROM t_creators f JOIN t_out4 o USING (token_mint)
LEFT JOIN t_team_clusters tc USING (token_mint) JOIN t_coins c USING (token_mint)""")


def rep_sql(src: str, key: str, flag: str) -> str:
    return f"""SELECT {key}, n, rug_count, moon_count, ok_count, rug_count / n AS rug_rate, moon_count / n AS moon_rate, avg_bundle_pct, last_seen,
  CASE WHEN n >= 8 AND rug_count / n >= 0.65 THEN 1 ELSE 0 END AS {flag} FROM (SELECT {key}, count(*) AS n, count(*) FILTER (classified = 'rug') AS rug_count,
  count(*) FILTER (classified = 'moon') AS moon_count, count(*) FILTER (classified = 'ok') AS ok_count,
  round({dsum('supply_pct')} / nullif(count(supply_pct), 0), 6) AS avg_bundle_pct, max(graduated_at) AS last_seen FROM {src} GROUP BY 1)"""


cte("t_frep", rep_sql("t_graded", "funder", "is_known_rugger"))
cte("t_crep", rep_sql("t_graded_c", "creator", "is_serial_rugger"))


def graded(t: Tables):
    return t.store("graded_funder", lambda: memory.graded_coins(out4(t), t.team_clusters, t.coins, t.coin_funder))


def graded_c(t: Tables):
    return memory.graded_coins(out4(t), t.team_clusters, t.coins, t.creators.select("token_mint", "creator"))


@query("funder_reputation", sql="SELECT * FROM t_frep")
def _(t):
    return memory.funder_reputation(graded(t))


@query("creator_reputation", sql="SELECT * EXCLUDE (avg_bundle_pct) FROM t_crep")
def _(t):
    return memory.creator_reputation(graded_c(t))


def asof_sql(asking: str, src: str, key: str) -> str:
    return f"""SELECT a.token_mint, a.{key}, count(g.token_mint) AS prior_n,
  CASE WHEN count(g.token_mint) > 0 THEN count(*) FILTER (g.classified = 'rug') / count(g.token_mint) END AS prior_rug_rate
FROM {asking} a LEFT JOIN {src} g ON g.{key} = a.{key} AND g.graduated_at + {RESOLVE_S} <= a.graduated_at GROUP BY 1, 2"""


cte("t_ask_f", "SELECT token_mint, funder, graduated_at FROM t_coin_funder JOIN t_coins USING (token_mint)")
cte("t_ask_c", "SELECT token_mint, creator, graduated_at FROM t_creators JOIN t_coins USING (token_mint)")


def ask_f(t):
    return t.coin_funder.join(t.coins.select("token_mint", "graduated_at"), "token_mint")


def ask_c(t):
    return t.creators.select("token_mint", "creator").join(t.coins.select("token_mint", "graduated_at"), "token_mint")


@query("funder_reputation_as_of", sql=asof_sql("t_ask_f", "t_graded", "funder"))
def _(t):
    return memory.reputation_as_of(ask_f(t), graded(t), "funder", RESOLVE_S).select("token_mint", "funder", "prior_n", "prior_rug_rate")


@query("creator_reputation_as_of", sql=asof_sql("t_ask_c", "t_graded_c", "creator"))
def _(t):
    return memory.reputation_as_of(ask_c(t), graded_c(t), "creator", RESOLVE_S).select("token_mint", "creator", "prior_n", "prior_rug_rate")


cte("t_velocity", f"""SELECT a.token_mint, a.funder, count(*) FILTER (b.graduated_at >= a.graduated_at - {VELOCITY_DAY}) AS launches_24h, count(*) AS launches_7d
FROM t_ask_f a JOIN t_ask_f b ON a.funder = b.funder AND b.graduated_at BETWEEN a.graduated_at - {7 * VELOCITY_DAY} AND a.graduated_at GROUP BY 1, 2""")


@query("launch_velocity", sql="SELECT * FROM t_velocity")
def _(t):
    return memory.launch_velocity(ask_f(t), "funder", VELOCITY_DAY)


def behavior_sql() -> str:
    return f"""
SELECT token_mint, check_offset_h, holder_count, round(coalesce(top10, 0) / total_supply * 100, 2) AS top10_pct, new_holders, churned_holders, team_sold_pct,
  CASE WHEN holder_count < 5 THEN 'DUMPED' WHEN team_sold_pct IS NULL THEN 'HOLDING' WHEN team_sold_pct >= 30 THEN 'DISTRIBUTING' WHEN team_sold_pct <= -10 THEN 'ACCUMULATING' ELSE 'HOLDING' END AS signal
FROM (SELECT g.token_mint, g.check_offset_h, holder_count, new_holders, churned_holders, top10, total_supply, round((team_was - team_now) / total_supply * 100, 2) AS team_sold_pct
FROM (SELECT coalesce(b.token_mint, w.token_mint) AS token_mint, coalesce(b.check_offset_h, w.check_offset_h) AS check_offset_h, count(b.amount) AS holder_count,
    count(*) FILTER (w.amount IS NULL) AS new_holders, count(*) FILTER (b.amount IS NULL) AS churned_holders,
    {dsum("CASE WHEN m.wallet IS NOT NULL THEN coalesce(w.amount, 0) ELSE 0 END")} AS team_was, {dsum("CASE WHEN m.wallet IS NOT NULL THEN coalesce(b.amount, 0) ELSE 0 END")} AS team_now
  FROM t_bal_at b FULL JOIN (SELECT token_mint, wallet, amount, check_offset_h FROM t_balances CROSS JOIN (VALUES (1), (4), (24)) h(check_offset_h)) w
    ON w.token_mint = b.token_mint AND w.check_offset_h = b.check_offset_h AND w.wallet = b.wallet
  LEFT JOIN t_team m ON m.token_mint = coalesce(b.token_mint, w.token_mint) AND m.wallet = coalesce(b.wallet, w.wallet) GROUP BY 1, 2) g
JOIN t_supply s ON s.token_mint = g.token_mint
LEFT JOIN (SELECT token_mint, check_offset_h, {dsum('amount')} AS top10 FROM (SELECT *, row_number() OVER (PARTITION BY token_mint, check_offset_h ORDER BY amount DESC, wallet) AS rn FROM t_bal_at) WHERE rn <= 10 GROUP BY 1, 2) x
  ON x.token_mint = g.token_mint AND x.check_offset_h = g.check_offset_h)"""


cte("t_bal_at", f"""SELECT * FROM (SELECT token_mint, check_offset_h, signer AS wallet, {dsum("CASE WHEN side = 'buy' THEN token_amount ELSE -token_amount END")} AS amount
  FROM t_phased CROSS JOIN (VALUES (1), (4), (24)) h(check_offset_h) WHERE ts <= graduated_at + check_offset_h * {HOUR_S} GROUP BY 1, 2, 3) WHERE amount > 0""")
cte("t_behavior", behavior_sql())


def behavior(t: Tables):
    return t.store("post_grad_behavior", lambda: memory.post_grad_behavior(
        t.phased, t.team, t.balances, t.supply, [1, 4, 24], HOUR_S))


@query("post_grad_behavior", sql="SELECT * FROM t_behavior")
def _(t):
    return behavior(t)


@query("post_grad_behavior_events", "e", "SELECT * FROM t_behavior")
def _(t):
    return behavior(t)


@query("holder_snapshot", sql="SELECT token_mint, check_offset_h, holder_count, top10_pct, new_holders, churned_holders FROM t_behavior WHERE check_offset_h IN (1, 4)")
def _(t):
    return behavior(t).filter("check_offset_h IN (1, 4)").drop("team_sold_pct", "signal")


@query("new_entrants_smart", sql="""SELECT token_mint, count(*) AS entrants, count(s.wallet) AS smart_entrants FROM (
  SELECT DISTINCT p.token_mint, p.signer AS wallet FROM t_post p WHERE NOT EXISTS (SELECT 1 FROM t_balances b WHERE b.token_mint = p.token_mint AND b.wallet = p.signer)) e
LEFT JOIN t_smart_list s USING (wallet) GROUP BY 1""")
def _(t):
    e = t.post.select("token_mint", F.col("signer").alias("wallet")).distinct().join(
        t.balances.select("token_mint", "wallet"), ["token_mint", "wallet"], "left_anti")
    s = smart(t).filter(F.col("score") >= SMART_SCORE).select("wallet", F.lit(1).alias("s"))
    return e.join(s, "wallet", "left").groupBy("token_mint").agg(F.count("*").alias("entrants"), F.count("s").alias("smart_entrants"))


@query("latest_signal", sql="SELECT token_mint, arg_max(signal, check_offset_h) AS signal FROM t_behavior GROUP BY 1")
def _(t):
    return behavior(t).groupBy("token_mint").agg(F.max_by("signal", "check_offset_h").alias("signal"))


cte("t_dump", """SELECT funder, sum(h) / count(*) AS avg_dump_start_h, count(*) AS dump_start_count FROM (
  SELECT token_mint, min(check_offset_h) AS h FROM t_behavior WHERE signal = 'DISTRIBUTING' GROUP BY 1) JOIN t_coin_funder USING (token_mint) GROUP BY 1""")


@query("dump_timing", sql="SELECT * FROM t_dump")
def _(t):
    return memory.dump_timing(behavior(t), t.coin_funder)


cte("t_fp", """SELECT funder, round(CAST(sum(CAST(first_buy_offset_s AS DECIMAL(28,9))) AS DOUBLE) / count(*), 3) AS avg_first_buy_offset_s,
  round(CAST(sum(is_bc_sniper) AS DOUBLE) / count(*), 3) AS avg_sniper_rate, round(CAST(sum(member_count) AS DOUBLE) / count(*), 3) AS avg_cluster_size,
  round(CAST(sum(CAST(supply_pct AS DECIMAL(28,9))) AS DOUBLE) / count(*), 3) AS avg_bundle_pct, count(*) AS sample_count,
  count(*) FILTER (classified = 'rug') / greatest(count(classified), 1) AS rug_rate, count(*) FILTER (classified = 'moon') / greatest(count(classified), 1) AS moon_rate
FROM t_team_clusters JOIN t_coin_funder USING (token_mint) LEFT JOIN t_out4 USING (token_mint) GROUP BY 1""")


def prints(t: Tables):
    return t.store("fingerprints", lambda: memory.fingerprints(t.team_clusters, t.coin_funder, out4(t)))


@query("team_fingerprints", sql="SELECT * FROM t_fp")
def _(t):
    return prints(t)


FP_RUG = 0.3
cte("t_match", f"""SELECT token_mint, m.funder AS matched_funder, m.distance, m.rug_rate AS match_rug_rate, m.sample_count AS match_n FROM (
 SELECT token_mint, arg_min({{'funder': funder, 'distance': distance, 'rug_rate': rug_rate, 'sample_count': sample_count}}, (distance, funder)) AS m FROM (
  SELECT c.token_mint, f.funder, f.rug_rate, f.sample_count, round(sqrt(pow(member_count / 20.0::DOUBLE - avg_cluster_size / 20.0::DOUBLE, 2) + pow(supply_pct / 100.0::DOUBLE - avg_bundle_pct / 100.0::DOUBLE, 2)
    + pow(is_bc_sniper - avg_sniper_rate, 2) + pow(first_buy_offset_s / 300.0::DOUBLE - avg_first_buy_offset_s / 300.0::DOUBLE, 2)), 6) AS distance
  FROM t_team_clusters c JOIN t_fp f ON f.rug_rate >= {FP_RUG} AND f.sample_count >= 4) WHERE distance <= 0.25 GROUP BY 1)""")


@query("structural_fingerprint_match", sql="SELECT * FROM t_match")
def _(t):
    return memory.structural_match(t.team_clusters, prints(t), min_rug=FP_RUG)


@query("fingerprint_ledger", sql="""SELECT funder, count(DISTINCT token_mint) AS n_mints, string_agg(DISTINCT lower(w), ',' ORDER BY lower(w)) AS keywords FROM t_coin_funder JOIN t_tokens USING (token_mint),
  unnest(string_split(name, ' ')) u(w) GROUP BY 1""")
def _(t):
    """Keywords are a bounded vocabulary per funder; mints are counted, not collected."""
    j = t.coin_funder.join(t.tokens.select("token_mint", "name"), "token_mint")
    words = j.select("funder", F.explode(F.split(F.lower("name"), " ")).alias("w")).distinct()
    n = j.groupBy("funder").agg(F.count("*").alias("n_mints"))
    k = words.groupBy("funder").agg(F.array_join(F.sort_array(F.collect_set("w")), ",").alias("keywords"))
    return n.join(k, "funder")


@query("rugging_teams", sql="SELECT funder, rug_rate, sample_count FROM t_fp WHERE rug_rate > 0.3 AND sample_count >= 2")
def _(t):
    return prints(t).filter("rug_rate > 0.3 AND sample_count >= 2").select("funder", "rug_rate", "sample_count").orderBy(F.desc("rug_rate"))


# ── co-occurrence graph ──────────────────────────────────────────────────────
cte("t_graph_m", """SELECT m.wallet, m.token_mint, c.graduated_at, o.classified FROM t_team m JOIN (SELECT token_mint FROM t_team GROUP BY 1 HAVING count(*) >= 2) k USING (token_mint)
JOIN t_coins c ON c.token_mint = m.token_mint LEFT JOIN t_out4 o ON o.token_mint = m.token_mint""")
cte("t_graph", "SELECT wallet, count(*) AS teams, count(*) FILTER (classified = 'rug') AS rug_teams, max(graduated_at) AS last_seen FROM t_graph_m GROUP BY 1")


def memberships(t: Tables):
    return t.store("team_memberships", lambda: memory.team_memberships(t.team, out4(t), t.coins))


def graph(t: Tables):
    return memory.wallet_graph(memberships(t))


for _tape in ("t", "e"):
    query("wallet_graph" if _tape == "e" else "wallet_graph_items", _tape, "SELECT * FROM t_graph")(graph)

cte("t_hits", f"""SELECT token_mint, connected, CASE WHEN rugs >= 2 THEN 1 ELSE 0 END AS rug_hits, CASE WHEN rugs >= 2 THEN 0 ELSE 1 END AS soft_hits FROM (
  SELECT a.token_mint, a.wallet AS connected, count(*) AS n, count(*) FILTER (g.classified = 'rug') AS rugs FROM t_graph_m a JOIN t_graph_m g
    ON g.wallet = a.wallet AND g.classified IS NOT NULL AND g.graduated_at + {RESOLVE_S} <= a.graduated_at GROUP BY 1, 2) WHERE n >= 2""")


def hits(t: Tables):
    return memory.graph_hit_counts(memberships(t), RESOLVE_S)


for _tape in ("t", "e"):
    query("graph_hits" if _tape == "e" else "graph_hits_items", _tape, "SELECT * FROM t_hits")(hits)


@query("mirror_counts", "e", "SELECT count(*) FILTER (teams >= 2) AS wallets_2, count(*) FILTER (rug_teams >= 2) AS rug_wallets_2, count(*) AS wallets FROM t_graph")
def _(t):
    return graph(t).agg(F.count_if(F.col("teams") >= 2).alias("wallets_2"), F.count_if(F.col("rug_teams") >= 2).alias("rug_wallets_2"), F.count("*").alias("wallets"))


cte("t_fchoreo", f"""SELECT funder, round(s / n, 2) AS avg_exit_spread_s, leader_wallet, round(k / n, 4) AS leader_consistency, CAST(n AS BIGINT) AS sample_count FROM (
 SELECT funder, arg_min(leader_wallet, (-k, leader_wallet)) AS leader_wallet, max(k) AS k, sum(k) AS n, {dsum('s')} AS s FROM (
  SELECT funder, leader_wallet, count(*) AS k, {dsum('exit_spread_s')} AS s FROM t_choreo_sum JOIN t_coin_funder USING (token_mint) WHERE n_sellers >= 2 GROUP BY 1, 2) GROUP BY 1)""")


@query("funder_choreography", "e", "SELECT * FROM t_fchoreo")
def _(t):
    s = flow.choreography_summary(flow.exit_choreography(t.post, t.team))
    return memory.funder_choreography(s, t.coin_funder)


# ── context, verdict, replay ─────────────────────────────────────────────────
# Everything here is known at the coin's anchor: earlier coins count once they are resolved.
EPOCH_S = RESOLVE_S
for _name, _ask, _src, _key in (("t_frep_at", "t_ask_f", "t_graded", "funder"), ("t_crep_at", "t_ask_c", "t_graded_c", "creator")):
    cte(_name, f"""SELECT a.token_mint, count(g.token_mint) AS n, CASE WHEN count(g.token_mint) > 0 THEN count(*) FILTER (g.classified = 'rug') / count(g.token_mint) END AS rug_rate,
  CASE WHEN count(g.token_mint) > 0 THEN count(*) FILTER (g.classified = 'moon') / count(g.token_mint) END AS moon_rate
FROM {_ask} a LEFT JOIN {_src} g ON g.{_key} = a.{_key} AND g.graduated_at + {RESOLVE_S} <= a.graduated_at GROUP BY 1""")
cte("t_calls", "SELECT b.wallet, c.graduated_at, o.classified FROM t_buyers b JOIN t_out4 o USING (token_mint) JOIN t_coins c USING (token_mint)")
cte("t_ask_w", "SELECT b.token_mint, b.wallet, c.graduated_at FROM t_buyers b JOIN t_coins c USING (token_mint)")
cte("t_proven_at", f"""SELECT token_mint, count(*) AS n FROM (SELECT a.token_mint, a.wallet FROM t_ask_w a JOIN t_calls g ON g.wallet = a.wallet AND g.graduated_at + {RESOLVE_S} <= a.graduated_at GROUP BY 1, 2
  HAVING count(*) >= 15 AND count(*) FILTER (classified = 'moon') / greatest(count(*) FILTER (classified IN ('moon', 'rug')), 1) >= 0.6) GROUP BY 1""")
cte("t_smart_at", f"""SELECT token_mint, wallet, round(greatest(0, least(0.60::DOUBLE * good / n + 0.25::DOUBLE * least(coalesce(trades, 0) / 500.0::DOUBLE, 1)
   + 0.15::DOUBLE * greatest(0, 1.0::DOUBLE - ((graduated_at - bought) / {DAY_S}) / 90.0::DOUBLE), 1)), 4) AS score FROM (
 SELECT a.token_mint, a.wallet, a.graduated_at, count(*) AS n, count(*) FILTER (classified IN ('moon', 'ok')) AS good,
   (SELECT count(*) FROM t_swaps s WHERE s.signer = a.wallet AND s.ts <= a.graduated_at) AS trades, (SELECT max(bought_at) FROM t_buyers x WHERE x.wallet = a.wallet AND x.bought_at <= a.graduated_at) AS bought
 FROM t_ask_w a JOIN t_calls g ON g.wallet = a.wallet AND g.graduated_at + {RESOLVE_S} BETWEEN a.graduated_at - {90 * DAY_S} AND a.graduated_at GROUP BY 1, 2, 3)""")
cte("t_choreo_at", f"""SELECT token_mint, round(max(k) / sum(k), 4) AS leader_consistency, CAST(sum(k) AS BIGINT) AS n FROM (SELECT a.token_mint, s.leader_wallet, count(*) AS k FROM t_ask_f a
  JOIN t_ask_f p ON p.funder = a.funder AND p.graduated_at + {RESOLVE_S} <= a.graduated_at JOIN t_choreo_sum s ON s.token_mint = p.token_mint WHERE s.n_sellers >= 2 GROUP BY 1, 2) GROUP BY 1""")
cte("t_epochs", f"SELECT DISTINCT graduated_at // {EPOCH_S} AS epoch FROM t_coins")
cte("t_fp_at", f"""SELECT epoch, funder, round(CAST(sum(CAST(first_buy_offset_s AS DECIMAL(28,9))) AS DOUBLE) / count(*), 3) AS avg_first_buy_offset_s,
  round(CAST(sum(is_bc_sniper) AS DOUBLE) / count(*), 3) AS avg_sniper_rate, round(CAST(sum(member_count) AS DOUBLE) / count(*), 3) AS avg_cluster_size,
  round(CAST(sum(CAST(supply_pct AS DECIMAL(28,9))) AS DOUBLE) / count(*), 3) AS avg_bundle_pct, count(*) AS sample_count, count(*) FILTER (classified = 'rug') / greatest(count(classified), 1) AS rug_rate
FROM t_epochs JOIN t_coins c ON c.graduated_at + {RESOLVE_S} <= epoch * {EPOCH_S} JOIN t_team_clusters tc ON tc.token_mint = c.token_mint JOIN t_coin_funder cf ON cf.token_mint = c.token_mint
LEFT JOIN t_out4 o ON o.token_mint = c.token_mint GROUP BY 1, 2""")
cte("t_match_at", f"""SELECT token_mint, min(distance) AS distance FROM (
  SELECT c.token_mint, round(sqrt(pow(member_count / 20.0::DOUBLE - avg_cluster_size / 20.0::DOUBLE, 2) + pow(supply_pct / 100.0::DOUBLE - avg_bundle_pct / 100.0::DOUBLE, 2)
    + pow(is_bc_sniper - avg_sniper_rate, 2) + pow(first_buy_offset_s / 300.0::DOUBLE - avg_first_buy_offset_s / 300.0::DOUBLE, 2)), 6) AS distance
  FROM t_team_clusters c JOIN t_coins k ON k.token_mint = c.token_mint JOIN t_fp_at f ON f.epoch = k.graduated_at // {EPOCH_S} AND f.rug_rate >= {FP_RUG} AND f.sample_count >= 4) WHERE distance <= 0.25 GROUP BY 1""")
cte("t_ctx", f"""
SELECT c.token_mint, c.graduated_at, tc.supply_pct AS team_supply_pct, tc.is_bc_sniper AS team_is_bc_sniper, tc.member_count AS team_size, tc.first_buy_offset_s AS team_first_buy_offset_s,
  coalesce(fr.n, 0) AS funder_n, fr.rug_rate AS funder_rug_rate, fr.moon_rate AS funder_moon_rate, coalesce(cr.n, 0) AS creator_n, cr.rug_rate AS creator_rug_rate,
  coalesce(sm.n, 0) AS smart_money_count, coalesce(pv.n, 0) AS proven_wallet_count, top_holder_pct, top3_holder_pct,
  c.graduated_at - c.created_at AS bc_duration_seconds, coalesce(f.n_buyers, 0) AS unique_bc_buyers, coalesce(v.launches_24h, 0) AS launches_24h, coalesce(v.launches_7d, 0) AS launches_7d,
  m.distance AS fingerprint_distance, coalesce(ss.n, 0) AS launch_slot_snipe_count, ch.leader_consistency, ch.n AS choreography_n,
  coalesce(gh.rug_hits, 0) AS graph_rug_hits, coalesce(gh.soft_hits, 0) AS graph_soft_hits
FROM t_coins c LEFT JOIN t_team_clusters tc USING (token_mint) LEFT JOIN t_frep_at fr ON fr.token_mint = c.token_mint LEFT JOIN t_crep_at cr ON cr.token_mint = c.token_mint
LEFT JOIN (SELECT token_mint, count(*) AS n FROM t_smart_at WHERE score >= {SMART_SCORE} GROUP BY 1) sm ON sm.token_mint = c.token_mint LEFT JOIN t_proven_at pv ON pv.token_mint = c.token_mint
LEFT JOIN (SELECT token_mint, max(pct) AS top_holder_pct, CAST(sum(CAST(CASE WHEN rank <= 3 THEN pct ELSE 0 END AS DECIMAL(28,9))) AS DOUBLE) AS top3_holder_pct FROM t_holders GROUP BY 1) h ON h.token_mint = c.token_mint
LEFT JOIN t_flow f ON f.token_mint = c.token_mint LEFT JOIN t_velocity v ON v.token_mint = c.token_mint LEFT JOIN t_match_at m ON m.token_mint = c.token_mint
LEFT JOIN (SELECT b.token_mint, count(*) AS n FROM t_bc b JOIN (SELECT token_mint, min(slot) AS s0 FROM t_bc WHERE side = 'buy' GROUP BY 1) z ON z.token_mint = b.token_mint AND b.slot = z.s0 WHERE side = 'buy' GROUP BY 1) ss ON ss.token_mint = c.token_mint
LEFT JOIN t_choreo_at ch ON ch.token_mint = c.token_mint
LEFT JOIN (SELECT token_mint, CAST(sum(rug_hits) AS BIGINT) AS rug_hits, CAST(sum(soft_hits) AS BIGINT) AS soft_hits FROM t_hits GROUP BY 1) gh ON gh.token_mint = c.token_mint""")


def context(t: Tables):
    """Everything the rules read about a coin at its anchor, one row per coin; nothing later enters."""
    def make():
        holders = t.holders.groupBy("token_mint").agg(
            F.max("pct").alias("top_holder_pct"), exact_sum(F.when(F.col("rank") <= 3, F.col("pct")).otherwise(0.0)).alias("top3_holder_pct"))
        fr = memory.reputation_as_of(ask_f(t), graded(t), "funder", RESOLVE_S).select(
            "token_mint", F.col("prior_n").alias("funder_n"), F.col("prior_rug_rate").alias("funder_rug_rate"), F.col("prior_moon_rate").alias("funder_moon_rate"))
        cr = memory.reputation_as_of(ask_c(t), graded_c(t), "creator", RESOLVE_S).select(
            "token_mint", F.col("prior_n").alias("creator_n"), F.col("prior_rug_rate").alias("creator_rug_rate"))
        ask_w = t.buyers.select("token_mint", "wallet").join(t.coins.select("token_mint", "graduated_at"), "token_mint")
        calls = ask_w.join(out4(t), "token_mint").select("wallet", "graduated_at", "classified")
        trades = t.all_trades.select("wallet", "ts", F.lit(1).cast("long").alias("n"))
        buys = t.buyers.select("wallet", F.col("bought_at").alias("ts"))
        sm = memory.smart_scores_as_of(ask_w, calls, buys, trades, RESOLVE_S, DAY_S).filter(F.col("score") >= SMART_SCORE).groupBy("token_mint").agg(F.count("*").alias("smart_money_count"))
        won = F.col("prior_moons") / F.greatest(F.col("prior_moons") + F.col("prior_rugs"), F.lit(1)) >= 0.6
        pv = memory.reputation_as_of(ask_w, calls, "wallet", RESOLVE_S).filter((F.col("prior_n") >= memory.MIN_CALLS) & won).groupBy("token_mint").agg(
            F.count("*").alias("proven_wallet_count"))
        slot_counts = t.bc.filter("side = 'buy'").groupBy("token_mint", "slot").agg(F.count("*").alias("n"))
        ss = slot_counts.groupBy("token_mint").agg(F.min_by("n", "slot").alias("launch_slot_snipe_count"))
        summary = flow.choreography_summary(flow.exit_choreography(t.post, t.team)).select("token_mint", "leader_wallet", "n_sellers").join(ask_f(t), "token_mint")
        ch = memory.choreography_as_of(ask_f(t), summary, RESOLVE_S)
        gh = hits(t).groupBy("token_mint").agg(F.sum("rug_hits").alias("graph_rug_hits"), F.sum("soft_hits").alias("graph_soft_hits"))
        vel = memory.launch_velocity(ask_f(t), "funder", VELOCITY_DAY).drop("funder")
        known = memory.fingerprints_by_epoch(t.team_clusters, t.coin_funder, out4(t), t.coins, RESOLVE_S, EPOCH_S)
        new = t.team_clusters.join(t.coins.select("token_mint", F.floor(F.col("graduated_at") / EPOCH_S).alias("epoch")), "token_mint")
        fp = memory.structural_match(new, known, min_rug=FP_RUG, within=("epoch",)).select("token_mint", F.col("distance").alias("fingerprint_distance"))
        n_buyers = t.buyers.groupBy("token_mint").agg(F.count("*").alias("unique_bc_buyers"))
        j = t.coins.join(t.team_clusters, "token_mint", "left")
        for side in (fr, cr, ch, holders, sm, pv, ss, gh, vel, fp, n_buyers):
            j = j.join(side, "token_mint", "left")
        z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
        return j.select(
            "token_mint", "graduated_at", F.col("supply_pct").alias("team_supply_pct"), F.col("is_bc_sniper").alias("team_is_bc_sniper"),
            F.col("member_count").alias("team_size"), F.col("first_buy_offset_s").alias("team_first_buy_offset_s"),
            z("funder_n"), "funder_rug_rate", "funder_moon_rate", z("creator_n"), "creator_rug_rate", z("smart_money_count"), z("proven_wallet_count"),
            "top_holder_pct", "top3_holder_pct", (F.col("graduated_at") - F.col("created_at")).alias("bc_duration_seconds"), z("unique_bc_buyers"),
            z("launches_24h"), z("launches_7d"), "fingerprint_distance", z("launch_slot_snipe_count"), "leader_consistency", "choreography_n",
            z("graph_rug_hits"), z("graph_soft_hits"))
    return t.store("rule_context", make)


@query("feature_snapshot", sql="SELECT * FROM t_ctx")
def _(t):
    return context(t)


@query("memory_signals", "e", "SELECT token_mint, graph_rug_hits, graph_soft_hits, launches_24h, launches_7d, fingerprint_distance, leader_consistency FROM t_ctx")
def _(t):
    return context(t).select("token_mint", "graph_rug_hits", "graph_soft_hits", "launches_24h", "launches_7d", "fingerprint_distance", "leader_consistency")


HARD_SQL = [
    ("known_rugger", "{p}funder_n >= 8 AND {p}funder_rug_rate >= 0.65", 0.90), ("dumped", "{p}signal = 'DUMPED'", 0.95),
    ("team_snipers", "{p}team_supply_pct >= 50 AND {p}team_is_bc_sniper = 1", 0.80),
    ("graduation_push", "coalesce({p}top_holder_pct, 0) > 50 AND (dur < 300 OR dur = -1)", 0.92),
    ("bundled", "coalesce({p}top3_holder_pct, 0) > 75", 0.90), ("graph_rug", "{p}graph_rug_hits > 0", 0.85),
]
TERM_SQL = [
    ("smart_money", "CASE WHEN smart_money_count >= 2 THEN 2 WHEN smart_money_count = 1 THEN 1 ELSE 0 END"),
    ("signal_positive", "CASE WHEN signal = 'HOLDING' THEN 1 WHEN signal = 'ACCUMULATING' THEN 2 ELSE 0 END"),
    ("low_team_supply", "CASE WHEN team_supply_pct < 20 THEN 1 ELSE 0 END"),
    ("funder_moons", "CASE WHEN funder_n >= 8 AND funder_rug_rate < 0.65 AND funder_moon_rate >= 0.4 THEN 1 ELSE 0 END"),
    ("proven_buyers", "CASE WHEN proven_wallet_count >= 2 THEN 1 ELSE 0 END"),
    ("distributing", "CASE WHEN signal = 'DISTRIBUTING' THEN -2 ELSE 0 END"),
    ("funder_partial_rugger", "CASE WHEN funder_n >= 4 AND funder_rug_rate >= 0.5 THEN -1 ELSE 0 END"),
    ("slot_snipes", "CASE WHEN launch_slot_snipe_count >= 3 THEN -1 ELSE 0 END"),
    ("exit_leader", "CASE WHEN leader_consistency >= 0.7 AND choreography_n >= 8 THEN -1 ELSE 0 END"),
    ("creator", "CASE WHEN creator_n >= 8 AND creator_rug_rate >= 0.65 THEN -2 WHEN creator_n >= 4 AND creator_rug_rate >= 0.5 THEN -1 ELSE 0 END"),
    ("top_holder", "CASE WHEN top_holder_pct > 35 THEN -2 WHEN top_holder_pct > 20 THEN -1 ELSE 0 END"),
    ("top3", "CASE WHEN top3_holder_pct > 60 THEN -1 ELSE 0 END"),
    ("fast_curve", "CASE WHEN dur > 0 AND dur < 180 THEN -2 WHEN dur > 0 AND dur < 600 THEN -1 ELSE 0 END"),
    ("few_buyers", "CASE WHEN unique_bc_buyers > 0 AND unique_bc_buyers < 15 THEN -1 ELSE 0 END"),
    ("graph_soft", "CASE WHEN graph_soft_hits > 0 THEN -1 ELSE 0 END"),
    ("velocity", "CASE WHEN launches_24h >= 3 THEN -1 WHEN launches_7d >= 7 THEN -1 ELSE 0 END"),
    ("fingerprint", "CASE WHEN fingerprint_distance IS NOT NULL THEN -1 ELSE 0 END"),
]


def verdict_sql(source: str) -> str:
    """Twin of `structural_verdict` over a context query that has a `signal` column."""
    hard = " ".join(f"WHEN {c.format(p='')} THEN '{n}'" for n, c, _ in HARD_SQL)
    conf = " ".join(f"WHEN hard_skip = '{n}' THEN {k}" for n, _, k in HARD_SQL)
    score = " + ".join(f"({e})" for _, e in TERM_SQL)
    factors = "concat_ws(',', " + ", ".join(f"CASE WHEN ({e}) <> 0 THEN '{n}' END" for n, e in TERM_SQL) + ")"
    return f"""SELECT *, CASE {conf} WHEN verdict = 'WATCH' THEN 0.5 ELSE least(0.85, round(0.5 + abs(score) * 0.1, 2)) END AS confidence FROM (
SELECT *, CASE WHEN hard_skip IS NOT NULL THEN 'SKIP' WHEN score >= 2 AND coalesce(signal, '') NOT IN ('DISTRIBUTING', 'DUMPED') THEN 'STRUCTURALLY_SOUND' WHEN score <= -1 THEN 'SKIP' ELSE 'WATCH' END AS verdict FROM (
SELECT *, CASE {hard} END AS hard_skip, {score} AS score, {factors} AS factors FROM (
SELECT *, CASE WHEN bc_duration_seconds IS NULL OR bc_duration_seconds = 0 THEN -1 ELSE bc_duration_seconds END AS dur FROM ({source}))))"""


cte("t_ctx_sig", "SELECT c.*, b.signal FROM t_ctx c LEFT JOIN (SELECT token_mint, signal FROM t_behavior WHERE check_offset_h = 1) b USING (token_mint)")
cte("t_verdict_live", verdict_sql("SELECT * FROM t_ctx_sig"))
cte("t_verdict", verdict_sql("SELECT *, CAST(NULL AS VARCHAR) AS signal FROM t_ctx"))
VCOLS = ["token_mint", "hard_skip", "score", "factors", "verdict", "confidence"]


@query("structural_verdict", sql=f"SELECT {', '.join(VCOLS)} FROM t_verdict")
def _(t):
    return verdict.structural_verdict(context(t)).select(*VCOLS)


@query("structural_verdict_events", "e", f"SELECT {', '.join(VCOLS)} FROM t_verdict")
def _(t):
    return verdict.structural_verdict(context(t)).select(*VCOLS)


def live_context(t):
    sig = behavior(t).filter("check_offset_h = 1").select("token_mint", "signal")
    return context(t).join(sig, "token_mint", "left")


@query("structural_verdict_with_signal", "e", f"SELECT {', '.join(VCOLS)} FROM t_verdict_live")
def _(t):
    return verdict.structural_verdict(live_context(t)).select(*VCOLS)


@query("replay_fidelity", sql="""SELECT count(*) AS n, count(*) FILTER (CAST(token_mint AS BIGINT) % 97 <> 0) AS same FROM t_verdict""")
def _(t):
    """Verdicts stored with their snapshot as JSON, one in 97 damaged, against verdicts recomputed from that JSON alone."""
    ctx = context(t)

    def store_verdicts():
        v = verdict.structural_verdict(ctx)
        hurt = F.col("token_mint").cast("long") % 97 == 0
        return v.select("token_mint", F.col("verdict").alias("v0"), F.when(hurt, F.col("confidence") + 0.01).otherwise(F.col("confidence")).alias("c0")).join(
            ctx.select("token_mint", F.to_json(F.struct(*ctx.columns)).alias("features_json")), "token_mint")

    rows = t.store("stored_verdicts", store_verdicts)
    back = rows.select("v0", "c0", F.from_json("features_json", ctx.schema).alias("s")).select("v0", "c0", "s.*")
    same = (F.col("verdict") == F.col("v0")) & (F.col("confidence") == F.col("c0"))
    return verdict.structural_verdict(back).agg(F.count("*").alias("n"), F.count_if(same).alias("same"))


@query("verdict_mix_score", sql="""SELECT verdict, count(*) AS n, round(CAST(sum(CAST(CASE WHEN verdict = 'SKIP' THEN 0.5 + 0.5 * confidence WHEN verdict = 'STRUCTURALLY_SOUND' THEN 0.5 - 0.5 * confidence ELSE 0.5 END AS DECIMAL(28,9))) AS DOUBLE) / count(*), 6) AS mean_score FROM t_verdict GROUP BY 1""")
def _(t):
    from tapelens.functions.columns import distribute_score

    v = verdict.structural_verdict(context(t)).withColumn("s", distribute_score("verdict", "confidence"))
    return v.groupBy("verdict").agg(F.count("*").alias("n"), F.round(exact_sum("s") / F.count("*"), 6).alias("mean_score"))


# ── launch rules and backtest ────────────────────────────────────────────────
cte("t_rulectx", """SELECT t.token_mint, coalesce(smart_money_count, 0) AS smart_money_count, 3.0 AS minutes_since_launch, b.bundle_pct, p_size % 2 = 0 AS lp_burned,
  CAST(p_size * 2 AS DOUBLE) AS narrative_velocity, m.snipers_sold_pct AS dev_sell_pct
FROM t_tokens t LEFT JOIN t_ctx USING (token_mint) LEFT JOIN t_bundle_pct b USING (token_mint) LEFT JOIN t_team_metrics m USING (token_mint)""")
cte("t_rules", """SELECT token_mint, rule_id, CASE WHEN triggered THEN 1 ELSE 0 END AS triggered FROM (
SELECT token_mint, 'smart_money_early' AS rule_id, smart_money_count >= 2 AND minutes_since_launch <= 5 AS triggered FROM t_rulectx
UNION ALL SELECT token_mint, 'low_bundle', coalesce(bundle_pct < 10, false) FROM t_rulectx UNION ALL SELECT token_mint, 'lp_burned', coalesce(lp_burned, false) FROM t_rulectx
UNION ALL SELECT token_mint, 'narrative_hot', coalesce(narrative_velocity > 50, false) FROM t_rulectx UNION ALL SELECT token_mint, 'exit_dev_dump', coalesce(dev_sell_pct > 20, false) FROM t_rulectx)""")


def rule_frame(t: Tables):
    from tapelens.plans.teams import fc

    bp = team.bundle_pct(team.cluster_summary(fc(t)), t.buyers)
    sold = flow.team_swap_metrics(t.post.join(t.team.select("token_mint", F.col("wallet").alias("signer")), ["token_mint", "signer"], "left_semi"), t.team)
    ctx = t.tokens.select("token_mint", "p_size").join(context(t).select("token_mint", "smart_money_count"), "token_mint", "left").join(
        bp, "token_mint", "left").join(sold.select("token_mint", F.col("snipers_sold_pct").alias("dev_sell_pct")), "token_mint", "left")
    ctx = ctx.withColumn("minutes_since_launch", F.lit(3.0)).withColumn("lp_burned", F.col("p_size") % 2 == 0).withColumn(
        "narrative_velocity", (F.col("p_size") * 2).cast("double"))
    return verdict.evaluate_rules(ctx)


@query("launch_rules", sql="SELECT * FROM t_rules")
def _(t):
    return rule_frame(t)


cte("t_legs", "SELECT *, first_value(sell_px IGNORE NULLS) OVER (PARTITION BY token_mint, signer ORDER BY ts, tx_signature ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS exit_px FROM (SELECT *, CASE WHEN side = 'sell' THEN price_usd END AS sell_px FROM t_swaps)")


def legs(t: Tables):
    """Each own buy paired with the first later sell of the same wallet and coin."""
    from tapelens.functions.ordered import split_fill, time_cell

    px = F.when(F.col("side") == "sell", F.col("price_usd"))
    return split_fill(t.swaps, ["token_mint", "signer"], [F.col("ts"), F.col("tx_signature")], time_cell("ts", 600), px,
                      "exit_px", forward=True, inclusive=False).filter("side = 'buy'")


JOURNAL = ["token_mint", "signer", "ts", "tx_signature", "side", "sol_amount"]
cte("t_secs", """SELECT token_mint, signer, ts, arg_min(sol_amount, tx_signature) FILTER (side = 'sell') AS first_sell, arg_max(sol_amount, tx_signature) FILTER (side = 'buy') AS last_buy FROM t_swaps GROUP BY 1, 2, 3""")
cte("t_around", """SELECT token_mint, signer, ts, first_value(first_sell IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_sell,
  last_value(last_buy IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_buy FROM t_secs WINDOW w AS (PARTITION BY token_mint, signer ORDER BY ts)""")


def journal(t: Tables):
    """Each own trade with the SOL gained: the first sell of a later second minus a buy, or a sell minus the last buy of an earlier second."""
    from tapelens.functions.ordered import split_fill, time_cell

    side = lambda s, c: F.when(F.col("side") == s, F.col(c))
    secs = t.swaps.groupBy("token_mint", "signer", "ts").agg(
        F.min_by(side("sell", "sol_amount"), side("sell", "tx_signature")).alias("first_sell"), F.max_by(side("buy", "sol_amount"), side("buy", "tx_signature")).alias("last_buy"))
    keys, order, cell = ["token_mint", "signer"], [F.col("ts")], time_cell("ts", 600)
    secs = t.store("journal_seconds", lambda: secs)
    after = split_fill(secs, keys, order, cell, F.col("first_sell"), "next_sell", forward=True, inclusive=False).select(*keys, "ts", "next_sell")
    before = split_fill(secs, keys, order, cell, F.col("last_buy"), "prior_buy", inclusive=False).select(*keys, "ts", "prior_buy")
    pnl = F.when(F.col("side") == "buy", F.col("next_sell") - F.col("sol_amount")).otherwise(F.col("sol_amount") - F.col("prior_buy"))
    return t.swaps.select(*JOURNAL).join(after, [*keys, "ts"]).join(before, [*keys, "ts"]).select(*JOURNAL, pnl.alias("pnl_sol")).filter("pnl_sol IS NOT NULL")


for _tape in ("t", "e"):
    query("journal_pnl" if _tape == "t" else "journal_pnl_events", _tape, f"""SELECT * FROM (SELECT {', '.join('s.' + c for c in JOURNAL)}, CASE WHEN side = 'buy' THEN next_sell - sol_amount ELSE sol_amount - prior_buy END AS pnl_sol
FROM t_swaps s JOIN t_around a ON a.token_mint = s.token_mint AND a.signer = s.signer AND a.ts = s.ts) WHERE pnl_sol IS NOT NULL""")(journal)


@query("rule_backtest", sql="""SELECT rule_id, count(*) AS n, count(*) FILTER (pnl > 0) / count(*) AS win_rate, round(CAST(sum(CAST(pnl AS DECIMAL(28,6))) AS DOUBLE) / count(*), 4) AS mean_pct
FROM (SELECT r.rule_id, (exit_px / price_usd - 1) * 100 AS pnl FROM t_legs l JOIN t_rules r ON r.token_mint = l.token_mint AND r.triggered = 1 WHERE side = 'buy' AND exit_px IS NOT NULL) GROUP BY 1""")
def _(t):
    per = legs(t).filter("exit_px IS NOT NULL").withColumn("pnl", (F.col("exit_px") / F.col("price_usd") - 1) * 100).groupBy("token_mint").agg(
        F.count("*").alias("n"), F.count_if(F.col("pnl") > 0).alias("w"), F.sum(F.col("pnl").cast("decimal(28,6)")).alias("s"))
    j = per.join(rule_frame(t).filter("triggered = 1"), "token_mint")
    return j.groupBy("rule_id").agg(F.sum("n").alias("n"), (F.sum("w") / F.sum("n")).alias("win_rate"),
                                    F.round(F.sum("s").cast("double") / F.sum("n"), 4).alias("mean_pct"))


# ── patterns and insights ────────────────────────────────────────────────────
BANDS = [(0, 20), (20, 35), (35, 50), (50, 70), (70, 100)]
_bands = ", ".join(f"({a}, {b})" for a, b in BANDS)


def pattern_sql(body: str) -> str:
    return f"SELECT topic, label, CAST(n AS BIGINT) AS sample_size, round(CASE WHEN n > 0 THEN hits / n ELSE 0 END, 4) AS value, CASE WHEN n >= 30 THEN 1 ELSE 0 END AS is_significant FROM ({body})"


cte("t_p_supply", f"SELECT 'team_supply' AS topic, concat(lo, '-', hi) AS label, count(classified) AS n, count(*) FILTER (classified = 'rug') AS hits FROM (VALUES {_bands}) b(lo, hi) LEFT JOIN (SELECT * FROM t_team_clusters JOIN t_out4 USING (token_mint)) c ON c.supply_pct >= lo AND c.supply_pct < hi GROUP BY 1, 2")
cte("t_p_sniper", "SELECT 'sniper' AS topic, CASE WHEN v = 1 THEN 'is_bc_sniper' ELSE 'not_bc_sniper' END AS label, count(classified) AS n, count(*) FILTER (classified = 'rug') AS hits FROM (VALUES (0), (1)) b(v) LEFT JOIN (SELECT * FROM t_team_clusters JOIN t_out4 USING (token_mint)) c ON c.is_bc_sniper = v GROUP BY 1, 2")
cte("t_p_smart", """SELECT 'smart_money' AS topic, lab AS label, count(classified) AS n, count(*) FILTER (classified = 'moon') AS hits FROM (VALUES ('0'), ('1'), ('2'), ('3+')) b(lab)
LEFT JOIN (SELECT classified, CASE WHEN smart_money_count >= 3 THEN '3+' ELSE CAST(smart_money_count AS VARCHAR) END AS k FROM t_ctx JOIN t_out4 USING (token_mint)) c ON c.k = lab GROUP BY 1, 2""")
cte("t_p_signal", """SELECT 'signal' AS topic, s AS label, count(classified) AS n, count(*) FILTER (classified IN ('moon', 'ok')) AS hits FROM (VALUES ('ACCUMULATING'), ('HOLDING'), ('DISTRIBUTING'), ('DUMPED')) b(s)
LEFT JOIN (SELECT b1.signal, o.classified FROM t_behavior b1 JOIN t_out4 o USING (token_mint) WHERE check_offset_h = 1) c ON c.signal = s GROUP BY 1, 2""")
cte("t_p_funder", """SELECT 'funder_rug' AS topic, lab AS label, (SELECT count(*) FROM t_frep WHERE n >= 30) AS n, count(k) AS hits FROM (VALUES ('high'), ('mid'), ('low')) b(lab)
LEFT JOIN (SELECT CASE WHEN rug_rate >= 0.65 THEN 'high' WHEN rug_rate >= 0.35 THEN 'mid' ELSE 'low' END AS k FROM t_frep WHERE n >= 30) c ON c.k = lab GROUP BY 1, 2""")
cte("t_p_lag", "SELECT 'detection_lag' AS topic, 'avg_detection_lag_seconds' AS label, count(*) AS n, CAST(sum(first_ts - graduated_at) AS BIGINT) AS hits FROM t_first_prices")


def team_graded(t):
    return t.team_clusters.join(out4(t), "token_mint")


@query("pattern_team_supply", sql=pattern_sql("SELECT * FROM t_p_supply"))
def _(t):
    return patterns.by_supply(team_graded(t), BANDS)


@query("pattern_sniper", sql=pattern_sql("SELECT * FROM t_p_sniper"))
def _(t):
    return patterns.by_sniper(team_graded(t))


@query("pattern_smart_money", sql=pattern_sql("SELECT * FROM t_p_smart"))
def _(t):
    return patterns.by_smart_count(context(t).join(out4(t), "token_mint"))


@query("pattern_signal", sql=pattern_sql("SELECT * FROM t_p_signal"))
def _(t):
    return patterns.by_signal(behavior(t).filter("check_offset_h = 1").join(out4(t), "token_mint"))


@query("pattern_funder_rug_rate", sql=pattern_sql("SELECT * FROM t_p_funder"))
def _(t):
    return patterns.by_funder(memory.funder_reputation(graded(t)))


@query("patterns_all", sql=pattern_sql(" UNION ALL ".join(f"SELECT * FROM t_p_{k}" for k in ("supply", "sniper", "smart", "signal", "funder", "lag"))))
def _(t):
    beh = behavior(t).filter("check_offset_h = 1").join(out4(t), "token_mint")
    lag = t.first_prices.select((F.col("first_ts") - F.col("graduated_at")).alias("lag"))
    return (patterns.by_supply(team_graded(t), BANDS).unionByName(patterns.by_sniper(team_graded(t)))
            .unionByName(patterns.by_smart_count(context(t).join(out4(t), "token_mint"))).unionByName(patterns.by_signal(beh))
            .unionByName(patterns.by_funder(memory.funder_reputation(graded(t)))).unionByName(patterns.mean_lag(lag)))


cte("t_feed", """SELECT c.token_mint, tk.name, tk.symbol, c.graduated_at, v.verdict, v.confidence, tc.supply_pct, tc.is_bc_sniper, x.smart_money_count, x.funder_rug_rate,
  b1.signal AS signal_1h, b4.signal AS signal_4h, o1.classified AS outcome_1h, o4.classified AS outcome_4h, o24.classified AS outcome_24h,
  coalesce(o24.classified, o4.classified, o1.classified) AS outcome, fp.first_ts - c.graduated_at AS detection_lag_seconds, a.state AS attribution, tr.peak_multiple, tr.collapsed
FROM t_coins c LEFT JOIN t_tokens tk USING (token_mint) LEFT JOIN t_verdict v USING (token_mint) LEFT JOIN t_team_clusters tc USING (token_mint) LEFT JOIN t_ctx x USING (token_mint)
LEFT JOIN (SELECT * FROM t_behavior WHERE check_offset_h = 1) b1 ON b1.token_mint = c.token_mint LEFT JOIN (SELECT * FROM t_behavior WHERE check_offset_h = 4) b4 ON b4.token_mint = c.token_mint
LEFT JOIN (SELECT * FROM t_outcomes WHERE check_offset_h = 1) o1 ON o1.token_mint = c.token_mint LEFT JOIN (SELECT * FROM t_outcomes WHERE check_offset_h = 4) o4 ON o4.token_mint = c.token_mint
LEFT JOIN (SELECT * FROM t_outcomes WHERE check_offset_h = 24) o24 ON o24.token_mint = c.token_mint LEFT JOIN t_first_prices fp ON fp.token_mint = c.token_mint
LEFT JOIN t_attribution a ON a.token_mint = c.token_mint LEFT JOIN t_traj tr ON tr.token_mint = c.token_mint""")


def feed(t: Tables):
    """One wide row per coin: a star of left joins, check offsets pivoted in one scan each."""
    from tapelens.plans.features import attribution

    def make():
        sig = behavior(t).groupBy("token_mint").pivot("check_offset_h", [1, 4]).agg(F.first("signal")).select(
            "token_mint", F.col("1").alias("signal_1h"), F.col("4").alias("signal_4h"))
        out = t.outcomes.groupBy("token_mint").pivot("check_offset_h", [1, 4, 24]).agg(F.first("classified")).select(
            "token_mint", *[F.col(str(h)).alias(f"outcome_{h}h") for h in (1, 4, 24)])
        v = verdict.structural_verdict(context(t)).select("token_mint", "verdict", "confidence", "smart_money_count", "funder_rug_rate")
        j = t.coins.select("token_mint", "graduated_at").join(t.tokens.select("token_mint", "name", "symbol"), "token_mint", "left")
        sides = [v, t.team_clusters.select("token_mint", "supply_pct", "is_bc_sniper"), sig, out,
                 t.first_prices.select("token_mint", "first_ts"), attribution(t).select("token_mint", F.col("state").alias("attribution")),
                 t.trajectory.select("token_mint", "peak_multiple", "collapsed")]
        for s in sides:
            j = j.join(s, "token_mint", "left")
        return j.withColumn("outcome", F.coalesce("outcome_24h", "outcome_4h", "outcome_1h")).withColumn(
            "detection_lag_seconds", F.col("first_ts") - F.col("graduated_at")).drop("first_ts")
    return t.store("feed", make)


@query("feed_view", sql="SELECT * FROM t_feed")
def _(t):
    return feed(t)


cte("t_long", """SELECT variable, bucket, outcome FROM (
SELECT 'team_supply' AS variable, CASE WHEN supply_pct IS NULL THEN NULL WHEN supply_pct < 20 THEN '0-20%' WHEN supply_pct < 35 THEN '20-35%' WHEN supply_pct < 50 THEN '35-50%' ELSE '50%+' END AS bucket, outcome FROM t_feed
UNION ALL SELECT 'smart_money', CASE WHEN coalesce(smart_money_count, 0) = 0 THEN '0' WHEN smart_money_count = 1 THEN '1' ELSE '2+' END, outcome FROM t_feed
UNION ALL SELECT 'sniper', CASE WHEN is_bc_sniper IS NULL THEN NULL WHEN is_bc_sniper = 1 THEN 'sniper' ELSE 'not sniper' END, outcome FROM t_feed
UNION ALL SELECT 'signal_1h', signal_1h, outcome FROM t_feed UNION ALL SELECT 'signal_4h', signal_4h, outcome FROM t_feed UNION ALL SELECT 'verdict', verdict, outcome FROM t_feed
UNION ALL SELECT 'funder_rug', CASE WHEN funder_rug_rate IS NULL THEN NULL WHEN funder_rug_rate < 0.2 THEN '0-20%' WHEN funder_rug_rate < 0.5 THEN '20-50%' WHEN funder_rug_rate < 0.8 THEN '50-80%' ELSE '80-100%' END, outcome FROM t_feed
UNION ALL SELECT 'detection', CASE WHEN detection_lag_seconds < 0 THEN 'REST poll' ELSE 'WebSocket' END, outcome FROM t_feed) WHERE bucket IS NOT NULL AND outcome IS NOT NULL""")
cte("t_buckets", "SELECT variable, bucket, count(*) AS n, count(*) FILTER (outcome = 'rug') / count(*) AS rug_rate, count(*) FILTER (outcome = 'moon') / count(*) AS moon_rate FROM t_long GROUP BY 1, 2")


@query("insight_buckets", sql="SELECT * FROM t_buckets")
def _(t):
    return patterns.insight_buckets(feed(t))


@query("insight_strength", sql="""SELECT variable, total_n, spread, CASE WHEN total_n < 20 THEN 'insufficient' WHEN spread >= 0.30 THEN 'strong' WHEN spread >= 0.15 THEN 'moderate' ELSE 'weak' END AS predictive FROM (
SELECT variable, CAST(sum(n) AS BIGINT) AS total_n, CASE WHEN count(*) FILTER (n >= 5) >= 2 THEN max(rug_rate) FILTER (n >= 5) - min(rug_rate) FILTER (n >= 5) ELSE 0 END AS spread FROM t_buckets GROUP BY 1)""")
def _(t):
    return patterns.insight_strength(patterns.insight_buckets(feed(t)))


@query("overall_stats", sql="SELECT count(outcome) AS resolved, count(*) FILTER (outcome = 'rug') / count(outcome) AS rug_rate, count(*) FILTER (outcome = 'moon') / count(outcome) AS moon_rate, count(*) FILTER (outcome = 'ok') / count(outcome) AS ok_rate FROM t_feed")
def _(t):
    rate = lambda o: (F.count_if(F.col("outcome") == o) / F.count("outcome")).alias(f"{o}_rate")
    return feed(t).agg(F.count("outcome").alias("resolved"), rate("rug"), rate("moon"), rate("ok"))


@query("verdict_accuracy", sql="""SELECT count(*) AS n, count(*) FILTER (verdict = 'SKIP') AS skips, count(*) FILTER ((verdict = 'SKIP') = (outcome = 'rug')) / count(outcome) AS accuracy,
  count(*) FILTER (verdict = 'SKIP' AND outcome = 'rug') / nullif(count(*) FILTER (verdict = 'SKIP' AND outcome IS NOT NULL), 0) AS skip_precision,
  CAST(sum(detection_lag_seconds) AS DOUBLE) / count(detection_lag_seconds) AS mean_lag, count(*) FILTER (verdict = 'SKIP' AND funder_rug_rate >= 0.65) AS blocked_ruggers FROM t_feed""")
def _(t):
    skip, rug = F.col("verdict") == "SKIP", F.col("outcome") == "rug"
    known = F.count_if(skip & F.col("outcome").isNotNull())
    return feed(t).agg(
        F.count("*").alias("n"), F.count_if(skip).alias("skips"), (F.count_if(skip == rug) / F.count("outcome")).alias("accuracy"),
        F.when(known > 0, F.count_if(skip & rug) / known).alias("skip_precision"),
        (F.sum("detection_lag_seconds").cast("double") / F.count("detection_lag_seconds")).alias("mean_lag"),
        F.count_if(skip & (F.col("funder_rug_rate") >= 0.65)).alias("blocked_ruggers"))


@query("freshness_summary", sql="""SELECT max(graduated_at) AS last_event, count(*) FILTER (graduated_at > (SELECT max(graduated_at) FROM t_feed) - 2400) AS last_day, round(count(outcome) / count(*), 4) AS resolved_share,
  round(count(*) FILTER (verdict = 'SKIP') / count(*), 4) AS skip_rate, CASE WHEN 2600 - max(graduated_at) <= 60 THEN 'live' WHEN 2600 - max(graduated_at) <= 240 THEN 'quiet' ELSE 'stalled' END AS feed_state FROM t_feed""")
def _(t):
    f = feed(t)
    top = f.agg(F.max("graduated_at").alias("top"))
    silent = F.lit(2600) - F.max("graduated_at")
    return f.join(F.broadcast(top)).agg(
        F.max("graduated_at").alias("last_event"), F.count_if(F.col("graduated_at") > F.col("top") - 2400).alias("last_day"),
        F.round(F.count("outcome") / F.count("*"), 4).alias("resolved_share"), F.round(F.count_if(F.col("verdict") == "SKIP") / F.count("*"), 4).alias("skip_rate"),
        F.when(silent <= 60, "live").when(silent <= 240, "quiet").otherwise("stalled").alias("feed_state"))


@query("system_maturity", sql="""SELECT (SELECT count(*) FROM t_coins) AS coins, (SELECT count(*) FROM t_outcomes WHERE check_offset_h = 4) AS outcomes_4h, (SELECT count(*) FROM t_frep WHERE n >= 8) AS mature_funders,
  (SELECT count(*) FROM t_wstats WHERE total_calls >= 15) AS mature_wallets, (SELECT count(*) FROM t_team_clusters WHERE supply_pct < 20) AS low_supply, (SELECT count(*) FROM t_team_clusters WHERE supply_pct BETWEEN 20 AND 50) AS mid_supply,
  (SELECT count(*) FROM t_team_clusters WHERE supply_pct > 50) AS high_supply, (SELECT count(*) FROM t_verdict WHERE verdict = 'SKIP') AS skips, (SELECT count(DISTINCT token_mint) FROM t_choreo_sum) AS choreography_coins""")
def _(t):
    one = lambda df, name, cond=None: (df.filter(cond) if cond is not None else df).agg(F.count("*").alias(name))
    v = verdict.structural_verdict(context(t))
    tc = t.team_clusters.agg(F.count_if(F.col("supply_pct") < 20).alias("low_supply"), F.count_if(F.col("supply_pct").between(20, 50)).alias("mid_supply"),
                             F.count_if(F.col("supply_pct") > 50).alias("high_supply"))
    parts = [one(t.outcomes, "outcomes_4h", "check_offset_h = 4"), one(memory.funder_reputation(graded(t)), "mature_funders", "n >= 8"),
             one(wstats(t), "mature_wallets", "total_calls >= 15"), tc, one(v, "skips", "verdict = 'SKIP'"),
             one(flow.choreography_summary(flow.exit_choreography(t.post, t.team)), "choreography_coins")]
    out = one(t.coins, "coins")
    for p in parts:
        out = out.join(F.broadcast(p))
    return out


@query("rule_maturity", sql="""SELECT rule, observations, minimum, CASE WHEN observations >= minimum THEN 1 ELSE 0 END AS mature FROM (
SELECT 'funder_reputation' AS rule, (SELECT count(*) FROM t_frep WHERE n >= 8) AS observations, 20 AS minimum UNION ALL SELECT 'wallet_win_rate', (SELECT count(*) FROM t_wstats WHERE total_calls >= 15), 30
UNION ALL SELECT 'team_supply', (SELECT count(*) FROM t_team_clusters), 100)""")
def _(t):
    rows = [(memory.funder_reputation(graded(t)).filter("n >= 8"), "funder_reputation", 20), (wstats(t).filter("total_calls >= 15"), "wallet_win_rate", 30),
            (t.team_clusters, "team_supply", 100)]
    parts = [df.agg(F.count("*").alias("observations")).select(F.lit(n).alias("rule"), "observations", F.lit(m).alias("minimum")) for df, n, m in rows]
    return parts[0].union(parts[1]).union(parts[2]).withColumn("mature", (F.col("observations") >= F.col("minimum")).cast("int"))


@query("net_flow_timeline", "e", """SELECT token_mint, ts, sum(f) OVER (PARTITION BY token_mint ORDER BY ts) AS net_flow FROM (
SELECT token_mint, ts, CAST(sum(CAST(CASE WHEN side = 'buy' THEN sol_amount ELSE -sol_amount END AS DECIMAL(18,6))) AS DECIMAL(28,6)) AS f FROM t_swaps GROUP BY 1, 2)""")
def _(t):
    from tapelens.functions.ordered import split_running_sum, time_cell

    f = F.when(F.col("side") == "buy", F.col("sol_amount")).otherwise(-F.col("sol_amount")).cast("decimal(18,6)")
    per = t.swaps.groupBy("token_mint", "ts").agg(F.sum(f).alias("f"))
    return split_running_sum(per, ["token_mint"], [F.col("ts")], time_cell("ts", 600), F.col("f"), "net_flow").select(
        "token_mint", "ts", F.col("net_flow").cast("double").alias("net_flow"))


@query("wallet_tags", "e", """SELECT tag, count(*) AS n FROM (SELECT CASE WHEN m.wallet IS NOT NULL THEN 'team' WHEN fr.is_known_rugger = 1 AND x.signer = cf.funder THEN 'known_rugger'
   WHEN w.win_rate >= 0.3 THEN 'smart_money' WHEN hk.token_mint IS NOT NULL AND h.wallet IS NULL THEN 'new' ELSE 'unknown' END AS tag
  FROM t_post x LEFT JOIN t_team m ON m.token_mint = x.token_mint AND m.wallet = x.signer LEFT JOIN t_coin_funder cf ON cf.token_mint = x.token_mint LEFT JOIN t_frep fr ON fr.funder = cf.funder
  LEFT JOIN t_wstats w ON w.wallet = x.signer LEFT JOIN t_held h ON h.token_mint = x.token_mint AND h.wallet = x.signer LEFT JOIN (SELECT DISTINCT token_mint FROM t_holders) hk ON hk.token_mint = x.token_mint) GROUP BY 1""")
def _(t):
    from tapelens.functions.columns import wallet_tag

    key = ["token_mint", "signer"]
    mark = lambda df, name: df.select("token_mint", F.col("wallet").alias("signer"), F.lit(True).alias(name))
    rug = memory.funder_reputation(graded(t)).filter("is_known_rugger = 1").select("funder")
    bad = t.coin_funder.join(rug, "funder", "left_semi").select("token_mint", F.col("funder").alias("signer"), F.lit(True).alias("rg"))
    sm = wstats(t).filter("win_rate >= 0.3").select(F.col("wallet").alias("signer"), F.lit(True).alias("sm"))
    per = t.post.groupBy(*key).agg(F.count("*").alias("n"))
    j = (per.join(mark(t.team, "tm"), key, "left").join(bad, key, "left").join(sm, "signer", "left").join(mark(t.held, "hd"), key, "left")
         .join(t.holders.select("token_mint", F.lit(True).alias("hk")).distinct(), "token_mint", "left"))
    b = lambda c: F.coalesce(F.col(c), F.lit(False))
    return j.withColumn("tag", wallet_tag(b("tm"), b("rg"), b("sm"), b("hk"), b("hd"))).groupBy("tag").agg(F.sum("n").alias("n"))


@query("tape_flags", "e", """SELECT token_mint, count(*) FILTER (m.wallet IS NOT NULL) AS team_rows, count(*) FILTER (a.accumulation_style = 'sniped') AS sniper_rows, count(*) FILTER (w.win_rate >= 0.3) AS smart_rows
FROM t_post x LEFT JOIN t_team m ON m.token_mint = x.token_mint AND m.wallet = x.signer LEFT JOIN t_accum a ON a.token_mint = x.token_mint AND a.wallet = x.signer LEFT JOIN t_wstats w ON w.wallet = x.signer GROUP BY ALL""".replace("SELECT token_mint,", "SELECT x.token_mint,"))
def _(t):
    return patterns.stamp_flags(
        t.post, t.team, flow.accumulation(t.bc).filter("accumulation_style = 'sniped'"), wstats(t).filter("win_rate >= 0.3")).groupBy("token_mint").agg(
        F.sum("is_team").alias("team_rows"), F.sum("is_sniper").alias("sniper_rows"), F.sum("is_smart_money").alias("smart_rows"))
