"""Coordinated entities per coin: components of the typed links with their position and state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelens.functions.columns import entity_state, fresh_flag
from tapelens.operators import links
from tapelens.operators.components import connected_components
from tapelens.session import cut
from tapelens.sources.tables import exact_sum

WINDOW_S, MIN_WINDOW_SWAPS = 600, 20


def coordination_window(post: DataFrame) -> DataFrame:
    """First ten minutes of a coin if they hold enough swaps, otherwise its whole tape."""
    early = (F.col("ts") - F.col("graduated_at")) <= WINDOW_S
    n = post.groupBy("token_mint").agg(F.count_if(early).alias("__early"))
    return post.join(n, "token_mint").filter(early | (F.col("__early") < MIN_WINDOW_SWAPS)).drop("__early")


def freshness(swaps: DataFrame, funding: DataFrame, age_scale: int = 1000) -> DataFrame:
    """Flag per (coin, wallet) from wallet age at the last print and first-buy offset."""
    span = swaps.groupBy("token_mint").agg(F.min("ts").alias("base"), F.max("ts").alias("now_ts"))
    per = swaps.groupBy("token_mint", F.col("signer").alias("wallet")).agg(
        F.min(F.when(F.col("side") == "buy", F.col("ts"))).alias("first_buy"))
    j = per.join(span, "token_mint").join(funding.select("wallet", "first_seen"), "wallet")
    j = j.filter("first_seen IS NOT NULL")
    age = (F.col("now_ts") - F.col("first_seen")) * age_scale
    return j.select("token_mint", "wallet", fresh_flag(age, F.col("first_buy") - F.col("base")).alias("flag"))


def assemble(swaps: DataFrame, chains: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row per entity: members, supply share, freshness, state and the edge kinds inside it."""
    chains = cut(chains.distinct())
    nodes = cut(connected_components(chains, ["token_mint"]).withColumnRenamed("node", "wallet"))
    flows = swaps.groupBy("token_mint", F.col("signer").alias("wallet")).agg(
        exact_sum(F.when(F.col("side") == "buy", F.col("token_amount")).otherwise(0.0)).alias("bought"),
        exact_sum(F.when(F.col("side") == "sell", F.col("token_amount")).otherwise(0.0)).alias("sold"))
    total = flows.groupBy("token_mint").agg(exact_sum("bought").alias("denom"))
    body = (
        nodes.join(flows, ["token_mint", "wallet"]).join(fresh, ["token_mint", "wallet"], "left")
        .groupBy("token_mint", "comp").agg(
            F.count("*").alias("wallet_count"), exact_sum("bought").alias("bought"), exact_sum("sold").alias("sold"),
            F.count_if(F.coalesce("flag", F.lit("none")) != "none").alias("n_fresh"),
            F.sum(member_number("wallet")).alias("checksum")))
    kinds = chains.join(nodes.withColumnRenamed("wallet", "a"), ["token_mint", "a"]).groupBy("token_mint", "comp").agg(
        F.array_join(F.sort_array(F.collect_set("edge_type")), ",").alias("edge_sources"))
    out = body.join(total, "token_mint").join(kinds, ["token_mint", "comp"])
    entity_id = F.substring(F.sha1(F.concat_ws("|", "comp", "wallet_count", F.col("checksum").cast("string")).cast("binary")), 1, 16)
    pct = F.when(F.col("denom") > 0, F.least(F.round(F.col("bought") / F.col("denom") * 100, 2), F.lit(100.0))).otherwise(0.0)
    return out.select(
        "token_mint", entity_id.alias("entity_id"), "comp", "wallet_count", pct.alias("supply_pct"),
        F.round(F.col("n_fresh") / F.col("wallet_count"), 3).alias("fresh_ratio"),
        entity_state("bought", "sold").alias("state"), "edge_sources")


def member_number(wallet: str) -> Column:
    """A wallet as a number; their sum tells member sets apart without collecting or sorting them."""
    return F.conv(F.substring(F.md5(F.col(wallet).cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")


def rollup(entities: DataFrame, stats: DataFrame) -> DataFrame:
    """Per coin: entity count, the largest entity, and the bundle statistics."""
    best = F.max_by(F.struct("supply_pct", "wallet_count", "fresh_ratio", "state"),
                    F.struct(F.col("supply_pct"), F.col("wallet_count"), F.col("entity_id")))
    e = entities.groupBy("token_mint").agg(F.count("*").alias("entity_count"), best.alias("l"))
    zero = lambda c, z: F.coalesce(F.col(c), F.lit(z))
    return stats.join(e, "token_mint", "full").select(
        "token_mint", zero("entity_count", 0).alias("entity_count"),
        zero("l.supply_pct", 0.0).alias("largest_entity_supply_pct"),
        zero("l.wallet_count", 0).alias("largest_entity_wallet_count"),
        zero("l.fresh_ratio", 0.0).alias("largest_entity_fresh_ratio"), F.col("l.state").alias("largest_entity_state"),
        zero("bundled_supply_pct", 0.0).alias("bundled_supply_pct"), zero("bundle_wallet_count", 0).alias("bundle_wallet_count"),
        zero("largest_bundle_size", 0).alias("largest_bundle_size"), zero("bundle_count", 0).alias("bundle_count"))


# ── launch topology ──────────────────────────────────────────────────────────
TOPO_TOL, TOPO_KINDS = 0.02, ("same_slot", "funder", "size")


def topology(bc: DataFrame, accum: DataFrame, funding: DataFrame) -> DataFrame:
    """Shape measures of the launch graph of every coin with at least three wallets.

    All measures follow from group memberships and band counts, so no pair of wallets is
    written: a wallet in a group of k has k - 1 partners there. A pair that shares several
    groups or kinds counts once for each.
    """
    enough = accum.groupBy("token_mint").agg(F.count("*").alias("n")).filter("n >= 3")
    nodes = cut(accum.join(enough, "token_mint", "left_semi").select("token_mint", "wallet", "total_sol_in"))
    node = nodes.select("token_mint", "wallet")
    slots = bc.filter("side = 'buy'").select("token_mint", F.col("signer").alias("wallet"), F.col("slot").cast("string").alias("grp"))
    slots = slots.distinct().join(node, ["token_mint", "wallet"], "left_semi")
    funders = node.join(funding.filter("funder <> 'cex'").select("wallet", F.col("funder").alias("grp")), "wallet").select("token_mint", "wallet", "grp")
    sized = nodes.filter("total_sol_in > 0")

    def partners(members: DataFrame, kind: str) -> DataFrame:
        sizes = members.groupBy("token_mint", "grp").agg(F.count("*").alias("k")).filter("k > 1")
        return members.join(sizes, ["token_mint", "grp"]).groupBy("token_mint", "wallet").agg(F.sum(F.col("k") - 1).alias("d")).withColumn("kind", F.lit(kind))

    bands = links.band_counts(sized, "total_sol_in", TOPO_TOL).select("token_mint", "wallet", (F.col("ahead") + F.col("behind")).alias("d"), F.lit("size").alias("kind"))
    degrees = cut(partners(slots, "same_slot").unionByName(partners(funders, "funder")).unionByName(bands))
    per = degrees.groupBy("token_mint", "wallet").agg(F.sum("d").alias("deg"), *[F.sum(F.when(F.col("kind") == k, F.col("d")).otherwise(0)).alias(k) for k in TOPO_KINDS])
    base = node.join(per, ["token_mint", "wallet"], "left").fillna(0).groupBy("token_mint").agg(
        F.count("*").alias("n"), F.sum("deg").alias("d"), F.max("deg").alias("mx"), *[F.sum(k).alias(k) for k in TOPO_KINDS])
    chain = links.size_links(sized, "total_sol_in", TOPO_TOL)
    star = links.stars(slots, ["token_mint", "grp"]).select("token_mint", "a", "b").union(links.stars(funders, ["token_mint", "grp"]).select("token_mint", "a", "b"))
    comp = connected_components(star.union(chain), ["token_mint"]).withColumnRenamed("node", "wallet")
    sizes = node.join(comp, ["token_mint", "wallet"], "left").withColumn("comp", F.coalesce("comp", "wallet")).groupBy("token_mint", "comp").agg(
        F.count("*").alias("k")).groupBy("token_mint").agg(F.count("*").alias("topo_components"), F.max("k").alias("big"))
    n, avg = F.col("n"), F.col("d") / F.col("n")
    r6 = lambda c, name: F.round(c, 6).alias(name)
    return base.join(sizes, "token_mint").select(
        "token_mint", n.alias("topo_nodes"), (F.col("d") / 2).cast("long").alias("topo_edges"), r6(F.col("d") / (n * (n - 1)), "topo_density"),
        r6(avg, "topo_avg_degree"), r6(F.when(avg > 0, F.col("mx") / avg).otherwise(0.0), "topo_max_degree_ratio"),
        r6((n * F.col("mx") - F.col("d")) / ((n - 1) * (n - 2)), "topo_centralization"), "topo_components",
        r6(F.col("big") / n, "topo_largest_comp_share"), *[(F.col(k) / 2).cast("long").alias(f"topo_{k}_edges") for k in TOPO_KINDS])


# ── graph shape with activity control ────────────────────────────────────────
def graph_shape(edges: DataFrame, post: DataFrame, min_wallets: int = 30) -> DataFrame:
    """Component shares, density and degree ratio over the selective edge kinds; pairs and degrees from group sizes."""
    act = post.filter((F.col("side") == "buy") & ((F.col("ts") - F.col("graduated_at")) <= WINDOW_S)).groupBy(
        "token_mint", "signer").agg(F.count("*").alias("n")).groupBy("token_mint").agg(
        F.sum("n").alias("n_buys"), F.count("*").alias("n_wallets")).filter(F.col("n_wallets") >= min_wallets)
    sel = cut(edges.filter("edge_type IN ('funder', 'same_slot')"))  # star links: k - 1 rows for a group of k
    comp = connected_components(sel, ["token_mint"]).groupBy("token_mint", "comp").agg(F.count("*").alias("k"))
    comps = comp.groupBy("token_mint").agg(
        F.count("*").alias("n_components"), F.max("k").alias("big"), F.sum("k").alias("clustered"))
    ends = sel.select("token_mint", F.col("a").alias("w"), F.lit(1).cast("long").alias("d")).union(sel.select("token_mint", "b", F.col("group_size") - 1))
    deg = ends.groupBy("token_mint", "w").agg(F.sum("d").alias("d")).groupBy("token_mint").agg(
        F.max("d").alias("mx"), (F.sum("d") / F.count("*")).alias("avg"))
    pairs = F.col("group_size") / 2
    n_sel = sel.groupBy("token_mint").agg(
        F.sum(pairs).alias("n_sel"), F.sum(F.when(F.col("edge_type") == "funder", pairs).otherwise(0.0)).cast("long").alias("funder_edges"))
    present = edges.select("token_mint").distinct()
    j = act.join(present, "token_mint", "left_semi").join(comps, "token_mint", "left").join(
        deg, "token_mint", "left").join(n_sel, "token_mint", "left")
    n = F.col("n_wallets")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select(
        "token_mint", "n_buys", "n_wallets", z("n_components").alias("n_components"),
        F.round(z("big") / n, 6).alias("largest_comp_share"), F.round(z("clustered") / n, 6).alias("clustered_share"),
        F.round(z("n_sel") / F.greatest(n * (n - 1) / 2, F.lit(1.0)), 6).alias("sel_density"),
        F.round(F.coalesce(F.col("mx") / F.col("avg"), F.lit(0.0)), 6).alias("max_degree_ratio"), z("funder_edges").alias("funder_edges"))
