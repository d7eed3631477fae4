"""Wallet links of one coin: same slot, matching size, lockstep selling, shared funder, habits.

Links have one linear form at every size. A group (slot, selling second, funder) is a star of its
members around the smallest wallet, with the group's size; the two band rules (matching size,
close seconds) link neighbours in order. The components are those of all pairs, and the numbers
of pairs and partners follow from group sizes and band counts (`band_counts`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelens.functions.ordered import anchored_groups, magnitude_cell, split_fill, split_row_number, time_cell
from tapelens.session import cut
from tapelens.sources.tables import exact_sum

SIZE_TOL = 0.005
LOCKSTEP_S = 2
COSINE = 0.92
EDGE_COLUMNS = ["token_mint", "a", "b", "edge_type", "grp", "group_size"]


def slot_groups(swaps: DataFrame, slot_window: int = 0) -> DataFrame:
    """(mint, grp, wallet, tokens, sol): buys grouped by slot, or greedily by anchored slots."""
    buys = swaps.filter("side = 'buy'")
    if slot_window == 0:
        placed = buys.withColumn("grp", F.col("slot"))
    else:
        g = anchored_groups(buys, ["token_mint"], "slot", slot_window, "grp")
        placed = buys.join(g, ["token_mint", "slot"])
    return placed.groupBy("token_mint", "grp", F.col("signer").alias("wallet")).agg(
        exact_sum("token_amount").alias("tokens"), exact_sum("sol_amount").alias("sol"))


def bundles(groups: DataFrame) -> DataFrame:
    """Slot groups with at least two distinct wallets."""
    return groups.groupBy("token_mint", "grp").agg(
        F.count("*").alias("n_wallets"), exact_sum("tokens").alias("token_amount"),
        exact_sum("sol").alias("sol_amount")).filter("n_wallets >= 2")


def bundle_stats(groups: DataFrame, supply: DataFrame | None = None) -> DataFrame:
    """Bundled share of supply (observed buys when unknown), wallets, largest size, count per coin."""
    b = bundles(groups)
    members = groups.join(b.select("token_mint", "grp"), ["token_mint", "grp"], "left_semi")
    wallets = members.select("token_mint", "wallet").distinct().groupBy("token_mint").agg(
        F.count("*").alias("bundle_wallet_count"))
    agg = b.groupBy("token_mint").agg(
        exact_sum("token_amount").alias("bundled"), F.max("n_wallets").alias("largest_bundle_size"),
        F.count("*").alias("bundle_count"))
    total = groups.groupBy("token_mint").agg(exact_sum("tokens").alias("observed"))
    j = total.join(agg, "token_mint", "left").join(wallets, "token_mint", "left")
    denom = F.col("observed")
    if supply is not None:
        j = j.join(supply, "token_mint", "left")
        denom = F.when(F.col("total_supply") > 0, F.col("total_supply")).otherwise(denom)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return j.select(
        "token_mint",
        F.least(F.round(F.coalesce("bundled", F.lit(0.0)) / denom * 100, 2), F.lit(100.0)).alias("bundled_supply_pct"),
        zero("bundle_wallet_count").alias("bundle_wallet_count"), zero("largest_bundle_size").alias("largest_bundle_size"),
        zero("bundle_count").alias("bundle_count"))


def stars(members: DataFrame, keys: list[str]) -> DataFrame:
    """Hub links of every group: each member to the smallest wallet of its group."""
    hubs = members.groupBy(*keys).agg(F.min("wallet").alias("a"), F.count("*").alias("group_size"))
    return members.join(hubs, keys).filter("wallet <> a").withColumnRenamed("wallet", "b")


def _edges(df: DataFrame, label: str, grp="grp", size="group_size") -> DataFrame:
    """EDGE_COLUMNS with a < b."""
    column = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select("token_mint", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(label).alias("edge_type"),
                     column(grp).cast("string").alias("grp"), column(size).cast("long").alias("group_size"))


def group_edges(members: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Star links of every group with its size, which states all its pairs."""
    return _edges(stars(members, keys), label, keys[-1])


def slot_members(swaps: DataFrame, slot_window: int = 0) -> DataFrame:
    return slot_groups(swaps, slot_window).select("token_mint", "grp", "wallet")


def largest_buys(swaps: DataFrame) -> DataFrame:
    return swaps.filter("side = 'buy' AND sol_amount > 0").groupBy(
        "token_mint", F.col("signer").alias("wallet")).agg(F.max("sol_amount").alias("amt"))


def size_links(values: DataFrame, amount: str, tol: float) -> DataFrame:
    """Neighbours in order of `amount` within the tolerance: the components of the full band."""
    nxt = split_fill(
        values.select("token_mint", "wallet", F.col(amount).alias("v")), ["token_mint"], [F.col("v"), F.col("wallet")], magnitude_cell("v", 16),
        F.struct("v", "wallet"), "nx", forward=True, inclusive=False)
    return nxt.filter(F.col("nx.v") <= F.col("v") * F.lit(1 + tol)).select(
        "token_mint", F.col("wallet").alias("a"), F.col("nx.wallet").alias("b"))


def size_edges(swaps: DataFrame, tol: float = SIZE_TOL) -> DataFrame:
    """Wallets next to each other in order of their largest buy, within `tol`."""
    return _edges(size_links(largest_buys(swaps), "amt", tol), "buy_size", F.lit(None), F.lit(2))


def band_counts(values: DataFrame, amount: str, tol: float) -> DataFrame:
    """(mint, wallet, ahead, behind): partners above and below within the band, without pairs.

    `ahead` counts wallets after x, in order of (amount, wallet), with amount <= x * (1 + tol). It is
    the rank of the band's upper end minus the rank of x; `behind` is the mirror image.
    """
    keys, cell = ["token_mint"], magnitude_cell("v", 16)
    v = values.select("token_mint", "wallet", F.col(amount).alias("v"))
    ranked = cut(split_row_number(v, keys, [F.col("v"), F.col("wallet")], cell, "rank"))
    upper = F.col("v") * F.lit(1 + tol)
    mark = lambda df, value, kind, rank: df.select("token_mint", "wallet", value.alias("v"), F.lit(kind).alias("kind"), rank.cast("long").alias("mark"))
    none = F.lit(None).cast("long")

    def last_rank(points: DataFrame, asks: DataFrame, out: str) -> DataFrame:
        line = cut(points.unionByName(asks))
        filled = split_fill(line, keys, [F.col("v"), F.col("kind"), F.coalesce("mark", F.lit(0)), F.col("wallet")], cell, F.col("mark"), out)
        return filled.filter("mark IS NULL").select("token_mint", "wallet", F.coalesce(out, F.lit(0)).alias(out))

    ends = last_rank(mark(ranked, F.col("v"), 0, F.col("rank")), mark(ranked, upper, 1, none), "top")
    starts = last_rank(mark(ranked, upper, 1, F.col("rank")), mark(ranked, F.col("v"), 0, none), "low")
    j = ranked.join(ends, ["token_mint", "wallet"]).join(starts, ["token_mint", "wallet"])
    return j.select("token_mint", "wallet", (F.col("top") - F.col("rank")).alias("ahead"), (F.col("rank") - 1 - F.col("low")).alias("behind"))


def sell_seconds(swaps: DataFrame) -> DataFrame:
    return swaps.filter("side = 'sell'").select("token_mint", "ts", F.col("signer").alias("wallet")).distinct()


def lockstep_edges(swaps: DataFrame, window_s: int = LOCKSTEP_S) -> DataFrame:
    """Star links inside each selling second plus hub-to-hub links between close seconds."""
    sells = sell_seconds(swaps)
    hubs = sells.groupBy("token_mint", "ts").agg(F.min("wallet").alias("hub"))
    nxt = split_fill(hubs, ["token_mint"], [F.col("ts")], time_cell("ts", 600),
                     F.struct("ts", "hub"), "nx", forward=True, inclusive=False)
    across = nxt.filter((F.col("nx.ts") - F.col("ts") <= window_s) & (F.col("nx.hub") != F.col("hub"))).select(
        "token_mint", F.col("hub").alias("a"), F.col("nx.hub").alias("b"), "ts", F.lit(2).alias("group_size"))
    inside = stars(sells, ["token_mint", "ts"]).select("token_mint", "a", "b", "ts", "group_size")
    return _edges(inside.union(across), "lockstep_sell", "ts")


def funder_members(swaps: DataFrame, funding: DataFrame, cex: DataFrame) -> DataFrame:
    """(mint, grp=funder, wallet) for participants with a funder that is no exchange."""
    named = funding.filter("funder IS NOT NULL AND funder <> 'cex'").select("wallet", F.col("funder").alias("grp"))
    named = named.join(cex.select(F.col("wallet").alias("grp")), "grp", "left_anti")
    people = swaps.select("token_mint", F.col("signer").alias("wallet")).distinct()
    return people.join(named, "wallet").select("token_mint", "grp", "wallet")


def behavioral_edges(participants: DataFrame, vectors: DataFrame, threshold: float = COSINE) -> DataFrame:
    """Participants of one coin whose habit vectors reach the cosine threshold.

    Wallets with the same vector form one class whose members hang on a hub. Classes are
    matched by a grid join: unit vectors at the threshold lie within sqrt(2-2*threshold)
    of each other, so their first three coordinates differ by at most one cell.
    """
    dims = [c for c in vectors.columns if c.startswith("v") and c[1:].isdigit()]
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in dims[1:]), F.col(dims[0]) * F.col(dims[0])))
    unit = vectors.withColumn("__n", norm).filter(F.col("__n") > 0.1)
    unit = unit.select("wallet", F.array(*[F.col(c) / F.col("__n") for c in dims]).alias("u"))
    people = participants.select("token_mint", F.col("signer").alias("wallet")).distinct().join(unit, "wallet")
    classes = people.groupBy("token_mint", "u").agg(F.min("wallet").alias("hub"), F.count("*").alias("n"))
    same = people.join(classes, ["token_mint", "u"]).filter("wallet <> hub").select(
        "token_mint", F.col("hub").alias("a"), F.col("wallet").alias("b"), F.col("n").alias("group_size"))
    width = (2 - 2 * threshold) ** 0.5 + 1e-9
    cell = [F.floor(F.col("u")[i] / width).alias(f"c{i}") for i in range(3)]
    right = classes.select("token_mint", F.col("hub").alias("b"), F.col("u").alias("ub"), *cell)
    step = lambda i: F.explode(F.array(*[F.col(f"c{i}") + d for d in (-1, 0, 1)]))
    left = classes.select("token_mint", F.col("hub").alias("a"), F.col("u").alias("ua"), *cell)
    for i in range(3):
        left = left.withColumn(f"c{i}", step(i))
    dot: Column = F.aggregate(F.zip_with("ua", "ub", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    across = left.join(right, ["token_mint", "c0", "c1", "c2"]).filter((F.col("a") < F.col("b")) & (dot >= threshold))
    return _edges(same.union(across.select("token_mint", "a", "b", F.lit(2))), "behavioral", F.lit(None))


def typed_edges(swaps: DataFrame, funding: DataFrame, cex: DataFrame, slot_label: str = "same_slot") -> DataFrame:
    """The typed links of every coin in one frame, linear in its wallets and seconds."""
    return (
        group_edges(slot_members(swaps), ["token_mint", "grp"], slot_label)
        .unionByName(size_edges(swaps)).unionByName(lockstep_edges(swaps))
        .unionByName(group_edges(funder_members(swaps, funding, cex), ["token_mint", "grp"], "funder")))


def typed_chains(swaps: DataFrame, funding: DataFrame, cex: DataFrame, slot_label: str = "same_slot") -> DataFrame:
    """(mint, a, b, edge_type) of `typed_edges`."""
    return typed_edges(swaps, funding, cex, slot_label).select("token_mint", "a", "b", "edge_type").distinct()
