"""Insider teams: funding clusters, launch-slot microstructure, evidence scoring and the member gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapelens.functions.columns import member_gate
from tapelens.functions.ordered import anchored_groups
from tapelens.sources.tables import exact_sum

# Evidence weights and the weight of each link kind.
WEIGHTS = {"overlap": 0.35, "coord": 0.30, "funding": 0.20, "fresh": 0.05, "snipe": 0.10}
EDGE_WEIGHTS = {
    "funder": 0.9, "same_slot_real": 0.85, "same_slot": 0.7, "buy_size": 0.35, "lockstep_sell": 0.35,
    "behavioral": 0.5,
}
MEMBER_SCORE, UNEXPLAINED_PCT, EARLY_S = 0.35, 10.0, 120


def funding_clusters(buyers: DataFrame, funding: DataFrame, width: int) -> DataFrame:
    """(mint, funder, anchor, wallet, ...): buyers of a coin funded by one source in anchored windows."""
    f = funding.filter("funder IS NOT NULL AND funder <> 'cex'").select(
        "wallet", "funder", F.coalesce("first_seen", F.lit(0)).alias("funded_at"), "sol_funded")
    m = buyers.select("token_mint", "wallet", "tokens_received").join(f, "wallet")
    g = anchored_groups(m, ["token_mint", "funder"], "funded_at", width, "anchor")
    return m.join(g, ["token_mint", "funder", "funded_at"])


def cluster_summary(members: DataFrame) -> DataFrame:
    """One row per cluster with a deterministic id."""
    key = F.concat_ws("|", "token_mint", "funder", F.col("anchor").cast("string"))
    return members.groupBy("token_mint", "funder", "anchor").agg(
        F.count("*").alias("members"), F.max("funded_at").alias("window_end"),
        exact_sum("sol_funded").alias("total_sol_funded"), exact_sum("tokens_received").alias("tokens"),
    ).withColumn("cluster_id", F.substring(F.sha1(key.cast("binary")), 1, 16))


def bundle_pct(clusters: DataFrame, buyers: DataFrame) -> DataFrame:
    """Largest single-cluster share of the observed tokens per coin."""
    total = buyers.groupBy("token_mint").agg(exact_sum("tokens_received").alias("total"))
    top = clusters.groupBy("token_mint").agg(F.max("tokens").alias("top"))
    return total.join(top, "token_mint", "left").select(
        "token_mint", F.when(F.col("total") > 0, F.round(F.coalesce("top", F.lit(0.0)) / F.col("total") * 100, 2))
        .otherwise(0.0).alias("bundle_pct"))


def launch_team(members: DataFrame, deployers: DataFrame, dev_labels: DataFrame) -> DataFrame:
    """Cluster most likely to be the team: deployer inside, dev label inside, then size."""
    m = members.join(deployers.select("token_mint", F.col("deployer").alias("wallet"), F.lit(1).alias("dep")),
                     ["token_mint", "wallet"], "left")
    m = m.join(dev_labels.select("wallet", F.lit(1).alias("dev")), "wallet", "left")
    c = m.groupBy("token_mint", "funder", "anchor").agg(
        F.max(F.coalesce("dep", F.lit(0))).alias("has_deployer"), F.max(F.coalesce("dev", F.lit(0))).alias("has_dev"),
        F.count("*").alias("members"), exact_sum("tokens_received").alias("tokens"))
    rank = F.struct("has_deployer", "has_dev", "members", "funder", "anchor")
    best = c.groupBy("token_mint").agg(F.max_by(F.struct("funder", "anchor", "has_deployer", "has_dev", "members", "tokens"), rank).alias("b"))
    return best.select("token_mint", "b.*")


def microstructure(bc: DataFrame, block_index) -> DataFrame:
    """Slot offset, rank and size in slot, and adjacent-block flag of all launch buys.

    Sizes come from counts per slot and adjacency from the blocks of a slot, so a busy coin is
    never one task; only the rank orders the buys of one slot.
    """
    buys = bc.filter("side = 'buy' AND tx_signature IS NOT NULL").withColumn("block_index", block_index).select(
        "token_mint", F.col("signer").alias("wallet"), "tx_signature", "slot", "ts", "block_index")
    slots = buys.groupBy("token_mint", "slot").agg(F.count("*").alias("same_slot_group_size"))
    start = slots.groupBy("token_mint").agg(F.min("slot").alias("first_slot"))
    blocks = buys.select("token_mint", "slot", "block_index").distinct()
    near = blocks.select("token_mint", "slot", F.explode(F.array(F.col("block_index") - 1, F.col("block_index") + 1)).alias("block_index")).distinct()
    near = near.withColumn("is_bundled", F.lit(1))
    ranked = Window.partitionBy("token_mint", "slot").orderBy("block_index", "ts", "tx_signature")
    rows = buys.withColumn("same_slot_rank", (F.row_number().over(ranked) - 1).cast("long"))
    rows = rows.join(slots, ["token_mint", "slot"]).join(start, "token_mint").join(near, ["token_mint", "slot", "block_index"], "left")
    return rows.select(
        "token_mint", "wallet", "tx_signature", "slot", "block_index", (F.col("slot") - F.col("first_slot")).alias("slot_offset"),
        "same_slot_rank", "same_slot_group_size", F.coalesce("is_bundled", F.lit(0)).alias("is_bundled"))


def microstructure_features(rows: DataFrame) -> DataFrame:
    """First-slot and first-three-slot buys, slot spread of the first twenty, largest group, bundled count."""
    by_slot = Window.partitionBy("token_mint").orderBy("slot")
    slots = rows.groupBy("token_mint", "slot").agg(F.count("*").alias("n"))
    three = slots.withColumn("k", F.row_number().over(by_slot)).filter("k <= 3").groupBy("token_mint").agg(F.sum("n").alias("buys_first_3_slots"))
    in_order = Window.partitionBy("token_mint").orderBy("slot", "same_slot_rank")
    twenty = rows.withColumn("k", F.row_number().over(in_order)).filter("k <= 20").groupBy("token_mint").agg(
        F.count_distinct("slot").alias("distinct_slots_first_20_buys"))
    whole = rows.groupBy("token_mint").agg(
        F.count_if(F.col("slot_offset") == 0).alias("launch_slot_snipe_count"), F.max("same_slot_group_size").alias("max_same_slot_group"),
        F.sum("is_bundled").alias("bundled_adjacent_count"))
    return whole.join(three, "token_mint").join(twenty, "token_mint")


def entity_link_kinds(nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """(mint, wallet, edge_sources): the link kinds of the launch entity a wallet belongs to."""
    return nodes.join(entities.select("token_mint", "comp", "edge_sources"), ["token_mint", "comp"]).select(
        "token_mint", "wallet", "edge_sources")


def score_members(buyers, holders, link_kinds, funding, creators, slot_offsets, anchors, excluded, age_scale: int = 1000):
    """Evidence score in [0, 1] per candidate wallet of every coin, with the gate inputs."""
    keep = lambda df: df.join(excluded.select("wallet"), "wallet", "left_anti")
    h = keep(holders.select("token_mint", "wallet", F.col("pct").alias("holding_pct"), "rank"))
    b = keep(buyers.select("token_mint", "wallet", "bought_at"))
    k = keep(link_kinds)
    launch = buyers.groupBy("token_mint").agg(F.min("bought_at").alias("launch_ts"))
    cand = b.select("token_mint", "wallet").union(h.select("token_mint", "wallet")).union(
        k.select("token_mint", "wallet")).distinct()
    key = ["token_mint", "wallet"]
    j = (
        cand.join(h, key, "left").join(b, key, "left").join(k, key, "left").join(slot_offsets, key, "left")
        .join(funding.select("wallet", "funder", "first_seen", "sig_count"), "wallet", "left")
        .join(creators.select("token_mint", "creator", "creator_funder"), "token_mint", "left")
        .join(launch, "token_mint", "left").join(anchors.select("token_mint", "graduated_at"), "token_mint"))
    shared = j.filter("funder IS NOT NULL AND funder <> 'cex'").groupBy("token_mint", "funder").agg(
        F.count("*").alias("n_shared"))
    j = j.join(shared, ["token_mint", "funder"], "left")
    is_b, is_h = F.col("bought_at").isNotNull(), F.col("holding_pct").isNotNull()
    overlap = (
        F.when(is_b & is_h, 1.0).when(is_h & ~is_b & (F.col("holding_pct") >= UNEXPLAINED_PCT), 1.0)
        .when(is_h & (F.col("rank") <= 5), 0.5)
        .when(is_b & (F.col("bought_at") - F.col("launch_ts") <= EARLY_S), 0.3).otherwise(0.0))
    kinds = F.split(F.coalesce("edge_sources", F.lit("")), ",")
    miss = F.lit(1.0)
    for label, weight in EDGE_WEIGHTS.items():
        miss = miss * F.when(F.array_contains(kinds, label), F.lit(1.0 - weight)).otherwise(1.0)
    coord = F.when(F.col("edge_sources").isNotNull(), F.round(1 - miss, 4)).otherwise(0.0)
    linked = (F.col("funder") == F.col("creator")) | (F.col("funder") == F.col("creator_funder"))
    funding_kind = F.when(F.col("funder").isNull() | (F.col("funder") == "cex"), F.lit(None)).when(
        linked, "creator_linked").when(F.col("n_shared") >= 2, "shared_funder")
    funding_score = F.when(F.col("fk") == "creator_linked", 1.0).when(F.col("fk") == "shared_funder", 0.7).otherwise(0.0)
    age = (F.col("graduated_at") - F.col("first_seen")) * age_scale
    e_age = F.when(age < 86400, 1.0).when(age < 3 * 86400, 0.5).otherwise(0.0)
    sc = F.col("sig_count")
    narrow = F.when(sc.isNull(), 0.0).when(sc < 10, 1.0).when(sc < 50, 0.5).otherwise(0.0)
    fresh = F.when(F.col("first_seen").isNotNull(), 0.5 * e_age + 0.5 * narrow).otherwise(0.0)
    off = F.col("slot_offset")
    snipe = F.when(off.isNull(), 0.0).when(off == 0, 1.0).when(off <= 3, 0.7).otherwise(0.0)
    s = j.withColumn("fk", funding_kind).select(
        "token_mint", "wallet", overlap.alias("overlap"), coord.alias("coord"), F.col("fk").alias("funding"),
        funding_score.alias("e_funding"), fresh.alias("fresh"), snipe.alias("snipe"), "slot_offset", "edge_sources")
    score = F.round(
        WEIGHTS["overlap"] * F.col("overlap") + WEIGHTS["coord"] * F.col("coord") + WEIGHTS["funding"] * F.col("e_funding")
        + WEIGHTS["fresh"] * F.col("fresh") + WEIGHTS["snipe"] * F.col("snipe"), 4)
    gate = member_gate("overlap", F.col("edge_sources").isNotNull().cast("int"), "funding", "slot_offset")
    return s.withColumn("score", score).filter("score > 0").withColumn("gated", gate.cast("int"))


def build_team(scored: DataFrame, holders: DataFrame, buyers: DataFrame, excluded: DataFrame) -> DataFrame:
    """Members above the score and through the gate; otherwise the first five clean holders."""
    h = holders.join(excluded.select("wallet"), "wallet", "left_anti").select("token_mint", "wallet", "pct", "amount")
    eligible = h.select("token_mint").distinct()
    gated = scored.filter((F.col("score") >= MEMBER_SCORE) & (F.col("gated") == 1)).join(eligible, "token_mint", "left_semi")
    w = Window.partitionBy("token_mint").orderBy(F.desc("amount"), "wallet")
    first5 = (h.withColumn("rn", F.row_number().over(w)).filter("rn <= 5")
              .join(gated.select("token_mint").distinct(), "token_mint", "left_anti"))
    members = gated.select("token_mint", "wallet", F.lit(0).alias("fallback")).union(
        first5.select("token_mint", "wallet", F.lit(1)))
    launch = buyers.groupBy("token_mint").agg(F.min("bought_at").alias("launch_ts"))
    j = members.join(h.select("token_mint", "wallet", "pct"), ["token_mint", "wallet"], "left").join(
        buyers.select("token_mint", "wallet", "bought_at"), ["token_mint", "wallet"], "left").join(launch, "token_mint", "left")
    off = F.min(F.col("bought_at") - F.col("launch_ts"))
    return j.groupBy("token_mint").agg(
        F.count("*").alias("members"), F.round(F.coalesce(exact_sum("pct"), F.lit(0.0)), 2).alias("supply_pct"),
        F.coalesce(off, F.lit(0)).cast("double").alias("first_buy_offset_s"),
        F.coalesce((off <= 30).cast("int"), F.lit(0)).alias("is_bc_sniper"), F.max("fallback").alias("fallback"))


def majority(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent value per key; ties go to the smallest value."""
    votes = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return votes.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value))
