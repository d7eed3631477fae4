"""Registered link, entity and topology queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapelens.operators import entities, flow, links
from tapelens.plans.features import anchored_cte, habits
from tapelens.plans.registry import cte, dsum, query
from tapelens.sources.tables import Tables


def window(t: Tables):
    return t.store("coordination_window", lambda: entities.coordination_window(t.post))


cte("t_win", """SELECT p.* FROM t_post p JOIN (SELECT token_mint, count(*) FILTER (ts - graduated_at <= 600) AS early FROM t_post GROUP BY 1) USING (token_mint)
WHERE ts - graduated_at <= 600 OR early < 20""")
cte("t_win_buys", "SELECT * FROM t_win WHERE side = 'buy'")
cte("t_grp", f"SELECT token_mint, slot AS grp, signer AS wallet, {dsum('token_amount')} AS tokens, {dsum('sol_amount')} AS sol FROM t_win_buys GROUP BY 1, 2, 3")
anchored_cte("t_anch_slot", "t_win_buys", 1, "slot")
cte("t_grp1", f"SELECT s.token_mint, g.anchor AS grp, signer AS wallet, {dsum('token_amount')} AS tokens, {dsum('sol_amount')} AS sol FROM t_win_buys s JOIN t_anch_slot_g g ON g.token_mint = s.token_mint AND g.t = s.slot GROUP BY 1, 2, 3")


def bundles_sql(src: str) -> str:
    return f"SELECT token_mint, grp, count(*) AS n_wallets, {dsum('tokens')} AS token_amount, {dsum('sol')} AS sol_amount FROM {src} GROUP BY 1, 2 HAVING count(*) >= 2"


@query("slot_bundles", "e", bundles_sql("t_grp"))
def _(t):
    return links.bundles(links.slot_groups(window(t)))


@query("slot_bundles_window1", "e", bundles_sql("t_grp1"))
def _(t):
    return links.bundles(links.slot_groups(window(t), 1))


cte("t_bundle_stats", f"""
SELECT o.token_mint, least(round(coalesce(bundled, 0) / CASE WHEN total_supply > 0 THEN total_supply ELSE observed END * 100, 2), 100) AS bundled_supply_pct,
  coalesce(w, 0) AS bundle_wallet_count, coalesce(mx, 0) AS largest_bundle_size, coalesce(k, 0) AS bundle_count
FROM (SELECT token_mint, {dsum('tokens')} AS observed FROM t_grp GROUP BY 1) o LEFT JOIN t_supply USING (token_mint)
LEFT JOIN (SELECT token_mint, {dsum('token_amount')} AS bundled, max(n_wallets) AS mx, count(*) AS k FROM ({bundles_sql('t_grp')}) GROUP BY 1) b USING (token_mint)
LEFT JOIN (SELECT g.token_mint, count(DISTINCT wallet) AS w FROM t_grp g JOIN ({bundles_sql('t_grp')}) USING (token_mint, grp) GROUP BY 1) m USING (token_mint)""")


@query("bundle_stats", "e", "SELECT * FROM t_bundle_stats")
def _(t):
    return links.bundle_stats(links.slot_groups(window(t)), t.supply)


def group_edges_sql(members: str, label: str) -> str:
    """Star links of every group around its smallest wallet."""
    return f"""
SELECT token_mint, hub AS a, wallet AS b, '{label}' AS edge_type, CAST(grp AS VARCHAR) AS grp, n AS group_size
FROM {members} JOIN (SELECT token_mint, grp, count(*) AS n, min(wallet) AS hub FROM {members} GROUP BY 1, 2) USING (token_mint, grp) WHERE wallet <> hub"""


cte("t_fund_mem", """SELECT DISTINCT w.token_mint, f.funder AS grp, w.signer AS wallet FROM t_win w JOIN t_funding f ON f.wallet = w.signer
WHERE f.funder <> 'cex' AND f.funder NOT IN (SELECT wallet FROM t_cex)""")
cte("t_e_slot", group_edges_sql("t_grp", "same_slot"))
cte("t_e_fund", group_edges_sql("t_fund_mem", "funder"))
cte("t_amt", "SELECT token_mint, signer AS wallet, max(sol_amount) AS amt FROM t_win WHERE side = 'buy' AND sol_amount > 0 GROUP BY 1, 2")
cte("t_e_size", """SELECT token_mint, least(wallet, nw) AS a, greatest(wallet, nw) AS b, 'buy_size' AS edge_type, CAST(NULL AS VARCHAR) AS grp, 2 AS group_size FROM (
  SELECT *, lead(wallet) OVER w AS nw, lead(amt) OVER w AS na FROM t_amt WINDOW w AS (PARTITION BY token_mint ORDER BY amt, wallet)) WHERE na <= amt * 1.005::DOUBLE""")
cte("t_sec", "SELECT DISTINCT token_mint, ts, signer AS wallet FROM t_win WHERE side = 'sell'")
cte("t_hub", "SELECT token_mint, ts, min(wallet) AS hub, count(*) AS n FROM t_sec GROUP BY 1, 2")
cte("t_e_lock", """SELECT s.token_mint, hub AS a, wallet AS b, 'lockstep_sell' AS edge_type, CAST(s.ts AS VARCHAR) AS grp, n AS group_size FROM t_sec s JOIN t_hub h ON h.token_mint = s.token_mint AND h.ts = s.ts WHERE wallet <> hub
UNION ALL SELECT token_mint, least(hub, nh), greatest(hub, nh), 'lockstep_sell', CAST(ts AS VARCHAR), 2 FROM (
  SELECT *, lead(hub) OVER w AS nh, lead(ts) OVER w AS nt FROM t_hub WINDOW w AS (PARTITION BY token_mint ORDER BY ts)) WHERE nt - ts <= 2 AND nh <> hub""")


@query("edges_same_slot", "e", "SELECT * FROM t_e_slot")
def _(t):
    return links.group_edges(links.slot_members(window(t)), ["token_mint", "grp"], "same_slot")


@query("edges_buy_size", "e", "SELECT * FROM t_e_size")
def _(t):
    return links.size_edges(window(t))


@query("edges_lockstep_sell", "e", "SELECT * FROM t_e_lock")
def _(t):
    return links.lockstep_edges(window(t))


@query("edges_lockstep_sell_items", "t", "SELECT * FROM t_e_lock")
def _(t):
    return links.lockstep_edges(window(t))


@query("edges_shared_funder", "e", "SELECT * FROM t_e_fund")
def _(t):
    return links.group_edges(links.funder_members(window(t), t.funding, t.cex_wallets), ["token_mint", "grp"], "funder")


cte("t_unit", "SELECT wallet, [" + ",".join(f"v{i} / n" for i in range(9)) + "] AS u FROM (SELECT *, sqrt(" +
    " + ".join(f"v{i} * v{i}" for i in range(9)) + ") AS n FROM t_vectors WHERE n_coins_bc >= 3) WHERE n > 0.1")
cte("t_class_mem", "SELECT DISTINCT b.token_mint, b.signer AS wallet, u FROM t_bc b JOIN t_unit uu ON uu.wallet = b.signer")
cte("t_class", "SELECT token_mint, u, min(wallet) AS hub, count(*) AS n FROM t_class_mem GROUP BY 1, 2")


@query("edges_behavioral", "e", f"""
SELECT token_mint, least(a, b) AS a, greatest(a, b) AS b, 'behavioral' AS edge_type, CAST(NULL AS VARCHAR) AS grp, n AS group_size FROM (
  SELECT m.token_mint, hub AS a, wallet AS b, n FROM t_class_mem m JOIN t_class c ON c.token_mint = m.token_mint AND c.u = m.u WHERE wallet <> hub
  UNION ALL SELECT x.token_mint, x.hub, y.hub, 2 FROM t_class x JOIN t_class y ON x.token_mint = y.token_mint AND x.hub < y.hub
  WHERE list_dot_product(x.u, y.u) >= 0.92)""")
def _(t):
    vectors = flow.behavior_vector(habits(t)).filter("n_coins_bc >= 3")
    return links.behavioral_edges(t.bc, vectors)


cte("t_edges", "SELECT * FROM t_e_slot UNION ALL SELECT * FROM t_e_size UNION ALL SELECT * FROM t_e_lock UNION ALL SELECT * FROM t_e_fund")
cte("t_und", "SELECT DISTINCT token_mint, a, b FROM t_edges UNION SELECT DISTINCT token_mint, b, a FROM t_edges")
cte("t_reach", """COLUMNS(token_mint, wallet, r) AS
  SELECT DISTINCT token_mint, a, a FROM t_und
  UNION SELECT e.token_mint, e.b, c.r FROM t_reach c JOIN t_und e ON e.token_mint = c.token_mint AND e.a = c.wallet""")
cte("t_comp", "SELECT token_mint, wallet, min(r) AS comp FROM t_reach GROUP BY 1, 2")
cte("t_fresh", """
SELECT p.token_mint, p.wallet, CASE WHEN (now_ts - first_seen) * 1000 < 86400 THEN 'critical' WHEN (now_ts - first_seen) * 1000 < 259200 THEN 'warning'
  WHEN first_buy - base <= 120 THEN 'sniper' ELSE 'none' END AS flag
FROM (SELECT token_mint, signer AS wallet, min(CASE WHEN side = 'buy' THEN ts END) AS first_buy FROM t_win GROUP BY 1, 2) p
JOIN (SELECT token_mint, min(ts) AS base, max(ts) AS now_ts FROM t_win GROUP BY 1) s USING (token_mint)
JOIN t_funding f ON f.wallet = p.wallet WHERE first_seen IS NOT NULL""")
cte("t_wflow", f"""SELECT token_mint, signer AS wallet, {dsum("CASE WHEN side = 'buy' THEN token_amount ELSE 0 END")} AS bought,
  {dsum("CASE WHEN side = 'sell' THEN token_amount ELSE 0 END")} AS sold FROM t_win GROUP BY 1, 2""")
cte("t_entities", f"""
SELECT c.token_mint, substr(sha1(concat_ws('|', c.comp, count(*), sum(CAST(('0x' || substr(md5(c.wallet), 1, 15)) AS BIGINT)))), 1, 16) AS entity_id, c.comp, count(*) AS wallet_count,
  CASE WHEN any_value(denom) > 0 THEN least(round({dsum('bought')} / any_value(denom) * 100, 2), 100) ELSE 0 END AS supply_pct,
  round(count(*) FILTER (coalesce(flag, 'none') <> 'none') / count(*), 3) AS fresh_ratio,
  CASE WHEN {dsum('bought')} <= 0 THEN 'HOLDING' WHEN {dsum('sold')} / {dsum('bought')} >= 0.9 THEN 'DUMPED' WHEN {dsum('sold')} / {dsum('bought')} >= 0.3 THEN 'DISTRIBUTING'
       WHEN {dsum('sold')} = 0 THEN 'ACCUMULATING' ELSE 'HOLDING' END AS state, any_value(srcs) AS edge_sources
FROM t_comp c JOIN t_wflow w ON w.token_mint = c.token_mint AND w.wallet = c.wallet LEFT JOIN t_fresh f ON f.token_mint = c.token_mint AND f.wallet = c.wallet
JOIN (SELECT token_mint, {dsum('bought')} AS denom FROM t_wflow GROUP BY 1) d ON d.token_mint = c.token_mint
JOIN (SELECT e.token_mint, k.comp, string_agg(DISTINCT edge_type, ',' ORDER BY edge_type) AS srcs FROM t_edges e JOIN t_comp k ON k.token_mint = e.token_mint AND k.wallet = e.a GROUP BY 1, 2) s
  ON s.token_mint = c.token_mint AND s.comp = c.comp
GROUP BY c.token_mint, c.comp""")


def entity_frame(t: Tables):
    def make():
        w = window(t)
        return entities.assemble(w, links.typed_chains(w, t.funding, t.cex_wallets), entities.freshness(w, t.funding))
    return t.store("entities", make)


@query("fresh_flags", "e", "SELECT * FROM t_fresh")
def _(t):
    return entities.freshness(window(t), t.funding)


@query("wallet_edges", "e", "SELECT * FROM t_edges")
def _(t):
    return links.typed_edges(window(t), t.funding, t.cex_wallets)


@query("entities_assembled", "e", "SELECT * FROM t_entities")
def _(t):
    return entity_frame(t)


cte("t_rollup", """
SELECT token_mint, coalesce(entity_count, 0) AS entity_count, coalesce(l.supply_pct, 0) AS largest_entity_supply_pct,
  coalesce(l.wallet_count, 0) AS largest_entity_wallet_count, coalesce(l.fresh_ratio, 0) AS largest_entity_fresh_ratio, l.state AS largest_entity_state,
  coalesce(bundled_supply_pct, 0) AS bundled_supply_pct, coalesce(bundle_wallet_count, 0) AS bundle_wallet_count,
  coalesce(largest_bundle_size, 0) AS largest_bundle_size, coalesce(bundle_count, 0) AS bundle_count
FROM t_bundle_stats FULL JOIN (SELECT token_mint, count(*) AS entity_count,
  arg_max({'supply_pct': supply_pct, 'wallet_count': wallet_count, 'fresh_ratio': fresh_ratio, 'state': state}, (supply_pct, wallet_count, entity_id)) AS l FROM t_entities GROUP BY 1) USING (token_mint)""")


@query("coordination_rollup", "e", "SELECT * FROM t_rollup")
def _(t):
    return entities.rollup(entity_frame(t), links.bundle_stats(links.slot_groups(window(t)), t.supply))


@query("entity_components_items", "t", "SELECT token_mint, comp, count(*) AS n FROM t_comp GROUP BY 1, 2")
def _(t):
    from tapelens.operators.components import connected_components

    w = window(t)
    chains = links.typed_chains(w, t.funding, t.cex_wallets)
    return connected_components(chains, ["token_mint"]).groupBy("token_mint", "comp").agg(F.count("*").alias("n"))


# ── topology ─────────────────────────────────────────────────────────────────
cte("t_tb", "SELECT token_mint, wallet, total_sol_in FROM (SELECT *, count(*) OVER (PARTITION BY token_mint) AS n FROM t_accum) WHERE n >= 3")
cte("t_ts", "SELECT DISTINCT b.token_mint, b.signer AS wallet, CAST(slot AS VARCHAR) AS grp FROM t_bc b JOIN t_tb n ON n.token_mint = b.token_mint AND n.wallet = b.signer WHERE side = 'buy'")
cte("t_tf", "SELECT b.token_mint, b.wallet, f.funder AS grp FROM t_tb b JOIN t_funding f USING (wallet) WHERE f.funder <> 'cex'")
cte("t_tl", """SELECT x.token_mint, x.wallet AS a, y.wallet AS b, 'same_slot' AS label FROM t_ts x JOIN t_ts y USING (token_mint, grp) WHERE x.wallet < y.wallet
UNION ALL SELECT x.token_mint, x.wallet, y.wallet, 'funder' FROM t_tf x JOIN t_tf y USING (token_mint, grp) WHERE x.wallet < y.wallet
UNION ALL SELECT x.token_mint, least(x.wallet, y.wallet), greatest(x.wallet, y.wallet), 'size' FROM t_tb x JOIN t_tb y ON x.token_mint = y.token_mint AND x.total_sol_in > 0
  AND (y.total_sol_in > x.total_sol_in OR (y.total_sol_in = x.total_sol_in AND y.wallet > x.wallet)) AND y.total_sol_in <= x.total_sol_in * 1.02::DOUBLE""")
cte("t_tu", "SELECT token_mint, a, b FROM t_tl UNION ALL SELECT token_mint, b, a FROM t_tl")
cte("t_td", "SELECT n.token_mint, n.wallet, count(u.b) AS deg FROM t_tb n LEFT JOIN t_tu u ON u.token_mint = n.token_mint AND u.a = n.wallet GROUP BY 1, 2")
cte("t_treach", """COLUMNS(token_mint, wallet, r) AS SELECT token_mint, wallet, wallet FROM t_td
  UNION SELECT e.token_mint, e.b, c.r FROM t_treach c JOIN t_tu e ON e.token_mint = c.token_mint AND e.a = c.wallet""")
cte("t_topo", """
SELECT base.token_mint, n AS topo_nodes, CAST(d // 2 AS BIGINT) AS topo_edges, round(d / (n * (n - 1)), 6) AS topo_density, round(d / n, 6) AS topo_avg_degree,
  round(CASE WHEN d > 0 THEN mx / (d / n) ELSE 0 END, 6) AS topo_max_degree_ratio, round((n * mx - d) / ((n - 1) * (n - 2)), 6) AS topo_centralization,
  topo_components, round(big / n, 6) AS topo_largest_comp_share, coalesce(ks, 0) AS topo_same_slot_edges, coalesce(kf, 0) AS topo_funder_edges, coalesce(kz, 0) AS topo_size_edges
FROM (SELECT token_mint, count(*) AS n, CAST(sum(deg) AS BIGINT) AS d, max(deg) AS mx FROM t_td GROUP BY 1) base
JOIN (SELECT token_mint, count(*) AS topo_components, max(k) AS big FROM (SELECT token_mint, comp, count(*) AS k FROM (
   SELECT token_mint, wallet, min(r) AS comp FROM t_treach GROUP BY 1, 2) GROUP BY 1, 2) GROUP BY 1) USING (token_mint)
LEFT JOIN (SELECT token_mint, count(*) FILTER (label = 'same_slot') AS ks, count(*) FILTER (label = 'funder') AS kf, count(*) FILTER (label = 'size') AS kz FROM t_tl GROUP BY 1) USING (token_mint)""")


def topo_frame(t: Tables):
    return t.store("topology", lambda: entities.topology(t.bc, flow.accumulation(t.bc), t.funding))


@query("launch_topology", "e", "SELECT * FROM t_topo")
def _(t):
    return topo_frame(t)


cte("t_gsel", "SELECT * FROM t_edges WHERE edge_type IN ('funder', 'same_slot')")
cte("t_gmem", """SELECT token_mint, 'same_slot' AS kind, CAST(grp AS VARCHAR) AS grp, wallet, count(*) OVER (PARTITION BY token_mint, grp) AS k FROM t_grp
UNION ALL SELECT token_mint, 'funder', grp, wallet, count(*) OVER (PARTITION BY token_mint, grp) FROM t_fund_mem""")
cte("t_gu", "SELECT token_mint, a, b FROM t_gsel UNION SELECT token_mint, b, a FROM t_gsel")
cte("t_greach", """COLUMNS(token_mint, wallet, r) AS SELECT DISTINCT token_mint, a, a FROM t_gu
  UNION SELECT e.token_mint, e.b, c.r FROM t_greach c JOIN t_gu e ON e.token_mint = c.token_mint AND e.a = c.wallet""")
cte("t_gshape", """
SELECT token_mint, n_buys, n_wallets, coalesce(n_components, 0) AS n_components, round(coalesce(big, 0) / n_wallets, 6) AS largest_comp_share,
  round(coalesce(clustered, 0) / n_wallets, 6) AS clustered_share, round(coalesce(n_sel, 0) / greatest(n_wallets * (n_wallets - 1) / 2, 1), 6) AS sel_density,
  round(coalesce(mx / av, 0), 6) AS max_degree_ratio, coalesce(funder_edges, 0) AS funder_edges
FROM (SELECT token_mint, count(*) AS n_buys, count(DISTINCT signer) AS n_wallets FROM t_post WHERE side = 'buy' AND ts - graduated_at <= 600 GROUP BY 1 HAVING count(DISTINCT signer) >= 3)
LEFT JOIN (SELECT token_mint, count(*) AS n_components, max(k) AS big, CAST(sum(k) AS BIGINT) AS clustered FROM (SELECT token_mint, comp, count(*) AS k FROM (
   SELECT token_mint, wallet, min(r) AS comp FROM t_greach GROUP BY 1, 2) GROUP BY 1, 2) GROUP BY 1) USING (token_mint)
LEFT JOIN (SELECT token_mint, max(d) AS mx, sum(d) / count(*) AS av FROM (SELECT token_mint, wallet, sum(k - 1) AS d FROM t_gmem WHERE k > 1 GROUP BY 1, 2) GROUP BY 1) USING (token_mint)
LEFT JOIN (SELECT token_mint, sum(k - 1) / 2 AS n_sel, CAST(sum(CASE WHEN kind = 'funder' THEN k - 1 ELSE 0 END) // 2 AS BIGINT) AS funder_edges FROM t_gmem WHERE k > 1 GROUP BY 1) USING (token_mint)
WHERE token_mint IN (SELECT token_mint FROM t_edges)""")


def shape_frame(t: Tables):
    w = window(t)
    return t.store("graph_shape", lambda: entities.graph_shape(links.typed_edges(w, t.funding, t.cex_wallets), t.post, 3))


@query("graph_shape", "e", "SELECT * FROM t_gshape")
def _(t):
    return shape_frame(t)
