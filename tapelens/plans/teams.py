"""Registered funding-cluster, microstructure and team-scoring queries with SQL twins."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tapelens.operators import links, team
from tapelens.operators.components import connected_components
from tapelens.plans.features import anchored_cte
from tapelens.plans.registry import CTES, TAPE_CTES, cte, dsum, query
from tapelens.session import cut
from tapelens.sources.tables import Tables, exact_sum

CLUSTER_WIDTH = 300

cte("t_fc_m", """SELECT concat(b.token_mint, '~', funder) AS token_mint, b.token_mint AS mint, b.wallet, b.tokens_received, f.funder,
  coalesce(f.first_seen, 0) AS funded_at, f.sol_funded FROM t_buyers b JOIN t_funding f USING (wallet) WHERE f.funder IS NOT NULL AND f.funder <> 'cex'""")
anchored_cte("t_fc_a", "t_fc_m", CLUSTER_WIDTH, "funded_at")
cte("t_fc", "SELECT m.mint AS token_mint, m.funder, g.anchor, m.wallet, m.tokens_received, m.funded_at, m.sol_funded FROM t_fc_m m JOIN t_fc_a_g g ON g.token_mint = m.token_mint AND g.t = m.funded_at")
cte("t_fc_sum", f"""SELECT token_mint, funder, anchor, count(*) AS members, max(funded_at) AS window_end, {dsum('sol_funded')} AS total_sol_funded,
  {dsum('tokens_received')} AS tokens, substr(sha1(concat_ws('|', token_mint, funder, CAST(anchor AS VARCHAR))), 1, 16) AS cluster_id FROM t_fc GROUP BY 1, 2, 3""")


def fc(t: Tables):
    return t.store("funding_clusters", lambda: team.funding_clusters(t.buyers, t.funding, CLUSTER_WIDTH))


@query("funding_clusters", sql="SELECT * FROM t_fc_sum")
def _(t):
    return team.cluster_summary(fc(t))


cte("t_bundle_pct", f"""SELECT token_mint, CASE WHEN total > 0 THEN round(coalesce(top, 0) / total * 100, 2) ELSE 0 END AS bundle_pct
FROM (SELECT token_mint, {dsum('tokens_received')} AS total FROM t_buyers GROUP BY 1) LEFT JOIN (SELECT token_mint, max(tokens) AS top FROM t_fc_sum GROUP BY 1) USING (token_mint)""")


@query("funding_bundle_pct", sql="SELECT * FROM t_bundle_pct")
def _(t):
    return team.bundle_pct(team.cluster_summary(fc(t)), t.buyers)


cte("t_deployers", "SELECT token_mint, substr(creator, 2) AS deployer FROM t_creators")
cte("t_dev", "SELECT CAST(c_custkey AS VARCHAR) AS wallet FROM customer WHERE c_custkey % 50 = 7")
cte("t_launch_team", f"""SELECT token_mint, funder, anchor, has_deployer, has_dev, members, tokens FROM (
 SELECT *, row_number() OVER (PARTITION BY token_mint ORDER BY has_deployer DESC, has_dev DESC, members DESC, funder DESC, anchor DESC) AS rn FROM (
  SELECT c.token_mint, c.funder, c.anchor, max(CASE WHEN d.deployer IS NOT NULL THEN 1 ELSE 0 END) AS has_deployer,
    max(CASE WHEN v.wallet IS NOT NULL THEN 1 ELSE 0 END) AS has_dev, count(*) AS members, {dsum('tokens_received')} AS tokens
  FROM t_fc c LEFT JOIN t_deployers d ON d.token_mint = c.token_mint AND d.deployer = c.wallet LEFT JOIN t_dev v ON v.wallet = c.wallet GROUP BY 1, 2, 3)) WHERE rn = 1""")


def deployers(t):
    return t.creators.select("token_mint", F.expr("substring(creator, 2)").alias("deployer"))


def dev_labels(t):
    return t.raw("customer").filter("c_custkey % 50 = 7").select(F.col("c_custkey").cast("string").alias("wallet"))


@query("launch_team_pick", sql="SELECT * FROM t_launch_team")
def _(t):
    return team.launch_team(fc(t), deployers(t), dev_labels(t))


@query("dev_share_and_history", sql=f"""
SELECT l.token_mint, round(l.tokens / b.total * 100, 2) AS dev_pct, n.k - 1 AS past_deployments FROM t_launch_team l
JOIN (SELECT token_mint, {dsum('tokens_received')} AS total FROM t_buyers GROUP BY 1) b USING (token_mint)
JOIN t_creators c USING (token_mint) JOIN (SELECT creator, count(*) AS k FROM t_creators GROUP BY 1) n USING (creator)""")
def _(t):
    total = t.buyers.groupBy("token_mint").agg(exact_sum("tokens_received").alias("total"))
    n = t.creators.groupBy("creator").agg(F.count("*").alias("k"))
    return team.launch_team(fc(t), deployers(t), dev_labels(t)).join(total, "token_mint").join(
        t.creators.select("token_mint", "creator"), "token_mint").join(n, "creator").select(
        "token_mint", F.round(F.col("tokens") / F.col("total") * 100, 2).alias("dev_pct"), (F.col("k") - 1).alias("past_deployments"))


# ── microstructure ───────────────────────────────────────────────────────────
cte("t_micro", """
SELECT token_mint, wallet, tx_signature, slot, block_index, slot - min(slot) OVER (PARTITION BY token_mint) AS slot_offset,
  row_number() OVER (PARTITION BY token_mint, slot ORDER BY block_index, ts, tx_signature) - 1 AS same_slot_rank,
  count(*) OVER (PARTITION BY token_mint, slot) AS same_slot_group_size,
  CASE WHEN count(*) OVER (PARTITION BY token_mint, slot ORDER BY block_index RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) > 0
         OR count(*) OVER (PARTITION BY token_mint, slot ORDER BY block_index RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) > 0 THEN 1 ELSE 0 END AS is_bundled
FROM (SELECT token_mint, signer AS wallet, tx_signature, slot // 10 AS slot, ts, CAST(tx_signature AS BIGINT) // 20 AS block_index,
        row_number() OVER (PARTITION BY token_mint ORDER BY ts, tx_signature) AS rn FROM t_bc WHERE side = 'buy')""")
cte("t_micro_f", """
SELECT token_mint, count(*) FILTER (slot_offset = 0) AS launch_slot_snipe_count, count(*) FILTER (dr <= 3) AS buys_first_3_slots,
  count(DISTINCT CASE WHEN pos <= 20 THEN slot END) AS distinct_slots_first_20_buys, max(same_slot_group_size) AS max_same_slot_group,
  CAST(sum(is_bundled) AS BIGINT) AS bundled_adjacent_count
FROM (SELECT *, dense_rank() OVER (PARTITION BY token_mint ORDER BY slot) AS dr, row_number() OVER (PARTITION BY token_mint ORDER BY slot, same_slot_rank) AS pos FROM t_micro) GROUP BY 1""")


def micro(t: Tables):
    coarse = t.bc.withColumn("slot", F.expr("slot div 10"))
    return t.store("microstructure", lambda: team.microstructure(coarse, F.expr("cast(tx_signature as bigint) div 20")))


@query("slot_microstructure", "e", "SELECT * FROM t_micro")
def _(t):
    return micro(t)


@query("slot_microstructure_features", "e", "SELECT * FROM t_micro_f")
def _(t):
    return team.microstructure_features(micro(t))


# ── evidence scoring ─────────────────────────────────────────────────────────
_BC_TWINS = ["t_grp", "t_fund_mem", "t_e_slot", "t_e_fund", "t_amt", "t_e_size", "t_sec", "t_hub", "t_e_lock", "t_edges", "t_und", "t_reach", "t_comp", "t_win_buys", "t_win"]
for _n in _BC_TWINS[:-1]:
    _text = CTES[_n]
    for _m in _BC_TWINS:
        _text = re.sub(rf"\b{_m}\b", "t_bc" if _m == "t_win" else "t_b" + _m[1:], _text)
    cte("t_b" + _n[1:], _text)
cte("t_kinds", """SELECT k.token_mint, k.wallet, s.srcs AS edge_sources FROM t_b_comp k JOIN (
  SELECT e.token_mint, c.comp, string_agg(DISTINCT edge_type, ',' ORDER BY edge_type) AS srcs FROM t_b_edges e JOIN t_b_comp c ON c.token_mint = e.token_mint AND c.wallet = e.a GROUP BY 1, 2) s
  ON s.token_mint = k.token_mint AND s.comp = k.comp""")


def link_kinds(t: Tables):
    def make():
        chains = cut(links.typed_chains(t.bc, t.funding, t.cex_wallets).distinct())
        nodes = cut(connected_components(chains, ["token_mint"]).withColumnRenamed("node", "wallet"))
        kinds = chains.join(nodes.withColumnRenamed("wallet", "a"), ["token_mint", "a"]).groupBy("token_mint", "comp").agg(
            F.array_join(F.sort_array(F.collect_set("edge_type")), ",").alias("edge_sources"))
        return team.entity_link_kinds(nodes, kinds)
    return t.store("launch_link_kinds", make)


@query("launch_link_kinds", "e", "SELECT * FROM t_kinds")
def _(t):
    return link_kinds(t)


_miss = " * ".join(f"CASE WHEN list_contains(string_split(coalesce(edge_sources, ''), ','), '{k}') THEN {1.0 - w!r}::DOUBLE ELSE 1.0::DOUBLE END" for k, w in team.EDGE_WEIGHTS.items())
cte("t_scored", f"""
SELECT *, CAST(CASE WHEN overlap >= 1 OR (overlap >= 0.5 AND (edge_sources IS NOT NULL OR funding IS NOT NULL OR coalesce(slot_offset, 99) <= 3))
    OR (coalesce(funding = 'creator_linked', false) AND overlap > 0) THEN 1 ELSE 0 END AS INTEGER) AS gated FROM (
SELECT *, round(0.35::DOUBLE * overlap + 0.30::DOUBLE * coord + 0.20::DOUBLE * e_funding + 0.05::DOUBLE * fresh + 0.10::DOUBLE * snipe, 4) AS score FROM (
SELECT token_mint, wallet, overlap::DOUBLE AS overlap, CASE WHEN edge_sources IS NOT NULL THEN round(1 - ({_miss}), 4) ELSE 0 END AS coord, funding,
  CASE WHEN funding = 'creator_linked' THEN 1.0 WHEN funding = 'shared_funder' THEN 0.7 ELSE 0 END::DOUBLE AS e_funding,
  CASE WHEN first_seen IS NOT NULL THEN 0.5 * (CASE WHEN age < 86400 THEN 1.0 WHEN age < 259200 THEN 0.5 ELSE 0 END)
     + 0.5 * (CASE WHEN sig_count IS NULL THEN 0 WHEN sig_count < 10 THEN 1.0 WHEN sig_count < 50 THEN 0.5 ELSE 0 END) ELSE 0 END::DOUBLE AS fresh,
  CASE WHEN slot_offset IS NULL THEN 0 WHEN slot_offset = 0 THEN 1.0 WHEN slot_offset <= 3 THEN 0.7 ELSE 0 END::DOUBLE AS snipe, slot_offset, edge_sources
FROM (SELECT j.*, (graduated_at - first_seen) * 1000 AS age,
   CASE WHEN bought_at IS NOT NULL AND holding_pct IS NOT NULL THEN 1.0 WHEN holding_pct >= 10 THEN 1.0 WHEN rank <= 5 THEN 0.5
        WHEN bought_at - launch_ts <= 120 THEN 0.3 ELSE 0 END AS overlap,
   CASE WHEN funder IS NULL OR funder = 'cex' THEN NULL WHEN funder = creator OR funder = creator_funder THEN 'creator_linked' WHEN n_shared >= 2 THEN 'shared_funder' END AS funding
  FROM (SELECT c.token_mint, c.wallet, h.pct AS holding_pct, h.rank, b.bought_at, k.edge_sources, m.slot_offset, f.funder, f.first_seen, f.sig_count,
      cr.creator, cr.creator_funder, l.launch_ts, co.graduated_at,
      count(CASE WHEN f.funder <> 'cex' THEN 1 END) OVER (PARTITION BY c.token_mint, f.funder) AS n_shared
    FROM t_cand c LEFT JOIN t_held h USING (token_mint, wallet) LEFT JOIN t_buyers b USING (token_mint, wallet) LEFT JOIN t_kinds k USING (token_mint, wallet)
    LEFT JOIN (SELECT token_mint, wallet, min(slot_offset) AS slot_offset FROM t_micro GROUP BY 1, 2) m USING (token_mint, wallet)
    LEFT JOIN t_funding f USING (wallet) LEFT JOIN t_creators cr USING (token_mint)
    LEFT JOIN (SELECT token_mint, min(bought_at) AS launch_ts FROM t_buyers GROUP BY 1) l USING (token_mint) JOIN t_coins co USING (token_mint)) j)))
WHERE score > 0""")
cte("t_cand", """SELECT * FROM (SELECT token_mint, wallet FROM t_buyers UNION SELECT token_mint, wallet FROM t_held UNION SELECT token_mint, wallet FROM t_kinds)
WHERE wallet NOT IN (SELECT wallet FROM t_cex)""")


def scored(t: Tables):
    def make():
        offs = micro(t).groupBy("token_mint", "wallet").agg(F.min("slot_offset").alias("slot_offset"))
        return team.score_members(t.buyers, t.held, link_kinds(t), t.funding, t.creators, offs, t.coins, t.cex_wallets)
    return t.store("scored_members", make)


@query("team_evidence_scores", "e", "SELECT * FROM t_scored")
def _(t):
    return scored(t)


cte("t_hx", "SELECT * FROM t_held WHERE wallet NOT IN (SELECT wallet FROM t_cex)")
cte("t_members", """SELECT token_mint, wallet, 0 AS fallback FROM t_scored WHERE score >= 0.35 AND gated = 1 AND token_mint IN (SELECT token_mint FROM t_hx)
UNION ALL SELECT token_mint, wallet, 1 FROM (SELECT *, row_number() OVER (PARTITION BY token_mint ORDER BY amount DESC, wallet) AS rn FROM t_hx
  WHERE token_mint NOT IN (SELECT token_mint FROM t_scored WHERE score >= 0.35 AND gated = 1)) WHERE rn <= 5""")


@query("team_build", "e", f"""
SELECT m.token_mint, count(*) AS members, round(coalesce({dsum('pct')}, 0), 2) AS supply_pct,
  CAST(coalesce(min(bought_at - launch_ts), 0) AS DOUBLE) AS first_buy_offset_s, CASE WHEN min(bought_at - launch_ts) <= 30 THEN 1 ELSE 0 END AS is_bc_sniper, max(fallback) AS fallback
FROM t_members m LEFT JOIN t_hx h USING (token_mint, wallet) LEFT JOIN t_buyers b USING (token_mint, wallet)
LEFT JOIN (SELECT token_mint, min(bought_at) AS launch_ts FROM t_buyers GROUP BY 1) l USING (token_mint) GROUP BY 1""")
def _(t):
    return team.build_team(scored(t), t.held, t.buyers, t.cex_wallets)


@query("majority_funder", sql="SELECT * FROM t_coin_funder")
def _(t):
    named = t.team.join(t.funding.select("wallet", "funder"), "wallet").filter("funder <> 'cex'")
    return team.majority(named.select("token_mint", "funder"), ["token_mint"], "funder")


@query("majority_funder_buyers", sql="""
SELECT token_mint, funder FROM (SELECT token_mint, funder, row_number() OVER (PARTITION BY token_mint ORDER BY count(*) DESC, funder) AS rn
FROM t_buyers JOIN t_funding USING (wallet) WHERE funder <> 'cex' GROUP BY 1, 2) WHERE rn = 1""")
def _(t):
    named = t.buyers.join(t.funding.select("wallet", "funder"), "wallet").filter("funder <> 'cex'")
    return team.majority(named.select("token_mint", "funder"), ["token_mint"], "funder")


@query("member_gate_recheck", "e", """
SELECT gated, CASE WHEN score >= 0.35 THEN 1 ELSE 0 END AS above, count(*) AS n FROM t_scored GROUP BY 1, 2""")
def _(t):
    return scored(t).groupBy("gated", (F.col("score") >= 0.35).cast("int").alias("above")).agg(F.count("*").alias("n"))
