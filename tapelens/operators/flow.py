"""Per-coin and per-wallet order-flow features over keyed tapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapelens.functions.columns import accumulation_style, clip, sell_severity
from tapelens.functions.ordered import anchored_groups, exact_quantile_ranks, split_row_number, time_cell
from tapelens.sources.tables import exact_sum

def is_buy():
    return F.col("side") == "buy"


def is_sell():
    return F.col("side") == "sell"


def dedup_swaps(swaps: DataFrame) -> DataFrame:
    """One row per (mint, signer, slot, side), the first by (ts, signature).

    A partial aggregation keeps the winner on the map side, so duplicates never travel.
    """
    keys = ["token_mint", "signer", "slot", "side"]
    rest = [c for c in swaps.columns if c not in keys]
    pick = F.min_by(F.struct(*rest), F.struct("ts", "tx_signature"))
    return swaps.groupBy(*keys).agg(pick.alias("__r")).select(*keys, *[f"__r.{c}" for c in rest])


def accumulation(bc: DataFrame) -> DataFrame:
    """Per (coin, wallet): buys, sells, first-buy offset and accumulation style before the anchor."""
    per = bc.groupBy("token_mint", F.col("signer").alias("wallet")).agg(
        F.count_if(is_buy()).alias("bc_buy_count"),
        F.count_if(is_sell()).alias("bc_sell_count"),
        exact_sum(F.when(is_buy(), F.col("sol_amount")).otherwise(0.0), 4).alias("total_sol_in"),
        F.min(F.when(is_buy(), F.greatest(F.col("ts") - F.col("created_at"), F.lit(0)))).cast("double")
        .alias("first_buy_offset_s"),
    )
    return per.select(
        "token_mint", "wallet", "first_buy_offset_s", "bc_buy_count", "bc_sell_count",
        "total_sol_in",
        accumulation_style("bc_buy_count", "first_buy_offset_s").alias("accumulation_style"))


def gini(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Gini of positive values per key, from the tie-collapsed value histogram."""
    h = exact_quantile_ranks(values.filter(F.col(value) > 0), keys, value)
    n, v = F.col("n"), F.col(value)
    rank_sum = n * F.col("cum_before") + n * (n + 1) / 2
    dec = lambda c: F.sum(c.cast("decimal(38,9)")).cast("double")
    return (
        h.groupBy(*keys).agg(F.sum("n").alias("__n"), dec(rank_sum * v).alias("__w"), dec(n * v).alias("__t"))
        .select(*keys, F.when(
            (F.col("__n") >= 2) & (F.col("__t") > 0),
            F.round(2 * F.col("__w") / (F.col("__n") * F.col("__t")) - (F.col("__n") + 1) / F.col("__n"), 4),
        ).otherwise(0.0).alias("gini"))
    )


def top_share(values: DataFrame, keys: list[str], value: str, k: int, tie: str, out: str) -> DataFrame:
    """Share of the k largest values in the total per key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value), F.asc(tie))
    top = (values.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k)
           .groupBy(*keys).agg(exact_sum(value).alias("__top")))
    total = values.groupBy(*keys).agg(exact_sum(value).alias("__all"))
    return total.join(top, keys).select(
        *keys, F.when(F.col("__all") > 0, F.round(F.col("__top") / F.col("__all"), 4)).otherwise(0.0).alias(out))


def bc_flow(bc: DataFrame) -> DataFrame:
    """Order-flow shape of the pre-anchor phase, one row per coin."""
    base = bc.groupBy("token_mint").agg(
        F.count("*").alias("n_trades"),
        F.count_if(is_buy() & (F.col("ts") - F.col("created_at")).between(0, 60)).alias("buys_first_60s"),
        exact_sum(F.when(is_buy(), F.col("sol_amount")).otherwise(0.0), 4).alias("sol_in"),
        exact_sum(F.when(is_sell(), F.col("sol_amount")).otherwise(0.0), 4).alias("sol_out"))
    wallets = bc.groupBy("token_mint", "signer").agg(
        F.max(is_buy().cast("int")).alias("b"), F.max(is_sell().cast("int")).alias("s"),
        exact_sum(F.when(is_buy(), F.col("sol_amount")).otherwise(0.0)).alias("sol"))
    counts = wallets.groupBy("token_mint").agg(F.sum("b").alias("n_buyers"), F.sum("s").alias("n_sellers"))
    seconds = (
        bc.filter(is_buy()).select("token_mint", "ts", "signer").distinct()
        .groupBy("token_mint", "ts").agg(F.count("*").alias("n")).filter("n >= 2")
        .groupBy("token_mint").agg(F.count("*").alias("same_second_bundle_count")))
    buyers = wallets.filter("b = 1").select("token_mint", "signer", "sol")
    shares = top_share(buyers, ["token_mint"], "sol", 5, "signer", "top5_buyer_share")
    ginis = gini(buyers, ["token_mint"], "sol").withColumnRenamed("gini", "gini_buy_size")
    out = base.join(counts, "token_mint").join(seconds, "token_mint", "left")
    out = out.join(shares, "token_mint", "left").join(ginis, "token_mint", "left")
    return out.select(
        "token_mint", "n_trades", "n_buyers", "n_sellers", "buys_first_60s",
        F.coalesce("same_second_bundle_count", F.lit(0)).alias("same_second_bundle_count"),
        F.coalesce("top5_buyer_share", F.lit(0.0)).alias("top5_buyer_share"),
        F.coalesce("gini_buy_size", F.lit(0.0)).alias("gini_buy_size"), "sol_in", "sol_out")


def coordinated_windows(sells: DataFrame, width: int = 300) -> DataFrame:
    """Anchored sell windows holding at least two wallets: (mint, anchor, n_wallets, n_sells)."""
    groups = anchored_groups(sells, ["token_mint"], "ts", width, "anchor")
    per_wallet = sells.groupBy("token_mint", "ts", "signer").agg(F.count("*").alias("n"))
    placed = per_wallet.join(groups, ["token_mint", "ts"]).groupBy("token_mint", "anchor", "signer").agg(
        F.sum("n").alias("n"), F.max("ts").alias("last"))
    return placed.groupBy("token_mint", "anchor").agg(
        F.count("*").alias("n_wallets"), F.sum("n").alias("n_sells"), F.max("last").alias("window_end"),
    ).filter("n_wallets >= 2")


def coordinated_wallets(sells: DataFrame, width: int = 300) -> DataFrame:
    groups = anchored_groups(sells, ["token_mint"], "ts", width, "anchor")
    placed = sells.select("token_mint", "ts", "signer").distinct().join(groups, ["token_mint", "ts"])
    pairs = placed.select("token_mint", "anchor", "signer").distinct()
    keep = pairs.groupBy("token_mint", "anchor").agg(F.count("*").alias("n")).filter("n >= 2")
    return pairs.join(keep, ["token_mint", "anchor"], "left_semi").select("token_mint", "signer").distinct()


def team_swap_metrics(team_swaps: DataFrame, positions: DataFrame) -> DataFrame:
    """Counts, net flow, coordinated windows and position-weighted sold share of marked wallets."""
    base = team_swaps.groupBy("token_mint").agg(
        F.count_if(is_buy()).alias("team_buy_count"), F.count_if(is_sell()).alias("team_sell_count"),
        exact_sum(F.when(is_sell(), F.col("sol_amount")).otherwise(-F.col("sol_amount")), 4)
        .alias("team_net_sol"),
        exact_sum(F.when(is_sell(), F.col("token_amount")).otherwise(0.0)).alias("sold"))
    held = positions.groupBy("token_mint").agg(exact_sum("amount").alias("held"))
    windows = coordinated_windows(team_swaps.filter(is_sell())).groupBy("token_mint").agg(
        F.count("*").alias("coordinated_sell_count"))
    return (
        base.join(held, "token_mint", "left").join(windows, "token_mint", "left")
        .select("token_mint", "team_buy_count", "team_sell_count", "team_net_sol",
                F.when(F.col("held") > 0, F.round(F.least(F.col("sold") / F.col("held") * 100, F.lit(100.0)), 2))
                .alias("snipers_sold_pct"),
                F.coalesce("coordinated_sell_count", F.lit(0)).alias("coordinated_sell_count")))


def early_attention(post: DataFrame, team: DataFrame, window_s: int = 300) -> DataFrame:
    """Twelve order-flow measures of the first `window_s` seconds after the anchor (both ends closed)."""
    off = F.col("ts") - F.col("graduated_at")
    win = (
        post.filter(off <= window_s)
        .join(team.select("token_mint", F.col("wallet").alias("signer"), F.lit(True).alias("tm")),
              ["token_mint", "signer"], "left")
        .select("token_mint", "signer", "side", "sol_amount", "price_usd", "ts", "tx_signature",
                (off >= window_s / 2).alias("late"), F.coalesce("tm", F.lit(False)).alias("tm")))
    zero = F.lit(0.0)
    base = win.groupBy("token_mint").agg(
        F.count("*").alias("n_trades"), F.count_if(is_buy()).alias("n_buys"),
        exact_sum(F.when(is_buy(), F.col("sol_amount")).otherwise(zero)).alias("buy_sol"),
        exact_sum(F.when(is_buy(), F.col("sol_amount")).otherwise(-F.col("sol_amount"))).alias("net_sol"),
        F.coalesce(F.max(F.when(is_buy(), F.col("sol_amount"))), zero).alias("max_buy_sol"),
        exact_sum(F.when(F.col("tm"), zero).when(is_buy(), F.col("sol_amount")).otherwise(-F.col("sol_amount")))
        .alias("retail_net_sol"),
        F.max((F.col("tm") & is_sell()).cast("int")).alias("team_sold"),
        F.max("price_usd").alias("peak"),
        F.min_by("price_usd", F.struct("ts", "tx_signature")).alias("first"),
        F.count_if("late").alias("n_late"), F.count_if(~F.col("late")).alias("n_early"))
    per_wallet = win.groupBy("token_mint", "signer").agg(F.min(F.col("late").cast("int")).alias("fresh"))
    wallets = per_wallet.groupBy("token_mint").agg(
        F.count("*").alias("n_wallets"), F.sum("fresh").alias("n_fresh"))
    return base.filter("n_trades >= 3").join(wallets, "token_mint").select(
        "token_mint", "n_trades", "n_wallets",
        (F.col("n_buys") / F.col("n_trades")).alias("buy_ratio"),
        (F.col("n_trades") / F.greatest("n_wallets", F.lit(1))).alias("trades_per_wallet"),
        "buy_sol", "net_sol", (F.col("peak") / F.col("first")).alias("price_run"),
        (F.col("n_late") / F.greatest("n_early", F.lit(1))).alias("accel"),
        (F.col("n_fresh") / F.greatest("n_wallets", F.lit(1))).alias("new_wallet_rate"),
        "max_buy_sol", "retail_net_sol", "team_sold")


def exit_choreography(post: DataFrame, team: DataFrame) -> DataFrame:
    """Exit order, first-sell offset, sold share and coordination per team member."""
    sells = post.filter(is_sell()).join(
        team.select("token_mint", F.col("wallet").alias("signer")), ["token_mint", "signer"], "left_semi")
    firsts = sells.groupBy("token_mint", F.col("signer").alias("wallet")).agg(
        F.min("ts").alias("first_sell"), exact_sum("token_amount").alias("sold"),
        F.first("graduated_at").alias("graduated_at"))
    ordered = split_row_number(
        firsts, ["token_mint"], [F.col("first_sell"), F.col("wallet")], time_cell("first_sell"), "exit_order")
    coord = coordinated_wallets(sells).select(
        "token_mint", F.col("signer").alias("wallet"), F.lit(1).alias("co"))
    return (
        team.join(ordered, ["token_mint", "wallet"], "left").join(coord, ["token_mint", "wallet"], "left")
        .select(
            "token_mint", "wallet", "exit_order",
            (F.col("first_sell") - F.col("graduated_at")).cast("double").alias("first_sell_offset_s"),
            F.when(F.col("amount") > 0,
                   F.round(F.least(F.coalesce("sold", F.lit(0.0)) / F.col("amount"), F.lit(1.0)) * 100, 2))
            .alias("sold_pct"),
            F.coalesce((F.col("exit_order") == 1).cast("int"), F.lit(0)).alias("is_first_seller"),
            F.coalesce("co", F.lit(0)).alias("participated_coordinated_sell")))


def choreography_summary(choreo: DataFrame) -> DataFrame:
    """Leader, spread and number of sellers per coin."""
    return choreo.filter("exit_order IS NOT NULL").groupBy("token_mint").agg(
        F.min_by("wallet", "exit_order").alias("leader_wallet"),
        F.when(F.count("*") >= 2, F.max("first_sell_offset_s") - F.min("first_sell_offset_s")).alias("exit_spread_s"),
        F.count("*").alias("n_sellers"))


def sell_structure(post: DataFrame, team: DataFrame, window_s: int) -> DataFrame:
    """Severity of team selling in the first window; coins without a team sell give no row."""
    off = F.col("ts") - F.col("graduated_at")
    sells = post.filter((off <= window_s) & is_sell()).join(
        team.select("token_mint", F.col("wallet").alias("signer"), F.lit(True).alias("tm")),
        ["token_mint", "signer"], "left")
    per_wallet = sells.groupBy("token_mint", "signer").agg(
        F.count("*").alias("n"), F.max(F.coalesce("tm", F.lit(False))).alias("tm"),
        exact_sum("sol_amount").alias("sol"), F.max((off >= window_s * 2 / 3)).alias("still"))
    g = per_wallet.groupBy("token_mint").agg(
        F.sum(F.when(F.col("tm"), F.col("n")).otherwise(0)).alias("n_sells"),
        F.count_if("tm").alias("n_sellers"),
        (exact_sum(F.when(F.col("tm"), F.col("sol")).otherwise(0.0)) / exact_sum("sol")).alias("share_of_sells"),
        F.max(F.col("tm") & F.col("still")).alias("still_selling"))
    return g.filter("n_sells > 0").select(
        "token_mint", "n_sells", "n_sellers", "share_of_sells", F.col("still_selling").cast("int").alias("still_selling"),
        sell_severity("n_sellers", "still_selling", "share_of_sells").alias("severity"))


def wallet_habits(accum: DataFrame, exits: DataFrame) -> DataFrame:
    """Cross-coin habits of each wallet from its accumulation rows and exit summaries."""
    n, off = F.col("n_coins_bc"), F.col("first_buy_offset_s")
    style = lambda s: F.count_if(F.col("accumulation_style") == s)
    rate = lambda c: F.round(c / n, 4)
    size = F.when(F.col("total_sol_in") > 0, F.col("total_sol_in"))
    sq = lambda c: F.sum((c.cast("decimal(18,6)") * c.cast("decimal(18,6)")).cast("decimal(38,6)")).cast("double")
    g = accum.groupBy("wallet").agg(
        F.count("*").alias("n_coins_bc"),
        F.count_if((F.col("accumulation_style") == "sniped") | (off <= 120)).alias("sn"),
        style("sniped").alias("a"), style("gradual").alias("b"), style("single").alias("c"),
        F.count(off).alias("no"), exact_sum(off).alias("so"), sq(off).alias("so2"),
        F.count(size).alias("nz"), exact_sum(size).alias("sz"), sq(size).alias("sz2"))
    mean = lambda s, k: F.col(s) / F.col(k)
    std = lambda s2, s, k: F.sqrt(F.greatest(F.col(s2) / F.col(k) - mean(s, k) * mean(s, k), F.lit(0.0)))
    e = exits.groupBy("wallet").agg(
        F.avg("hold_duration_s").alias("avg_hold_duration_s"),
        (exact_sum("one_shot_frac") / F.count("one_shot_frac")).alias("exit_one_shot_frac"),
        F.count("*").alias("n_coins_exit"))
    return g.join(e, "wallet", "left").select(
        "wallet", "n_coins_bc", rate(F.col("sn")).alias("sniper_rate"),
        mean("so", "no").alias("avg_first_buy_offset_s"), F.round(std("so2", "so", "no"), 4).alias("std_first_buy_offset_s"),
        mean("sz", "nz").alias("avg_buy_size_sol"), F.round(std("sz2", "sz", "nz") / mean("sz", "nz"), 3).alias("cv_buy_size"),
        rate(F.col("a")).alias("pct_sniped"), rate(F.col("b")).alias("pct_gradual"), rate(F.col("c")).alias("pct_single"),
        "avg_hold_duration_s", "exit_one_shot_frac", F.coalesce("n_coins_exit", F.lit(0)).alias("n_coins_exit"))


def exit_summaries(post: DataFrame, buyers: DataFrame) -> DataFrame:
    """Per (wallet, coin) exit: hold time from first buy, largest sale over total sold."""
    s = post.filter(is_sell()).groupBy("token_mint", F.col("signer").alias("wallet")).agg(
        exact_sum("token_amount").alias("sold"), F.max("token_amount").alias("largest"), F.min("ts").alias("first_sell"))
    hold = (F.col("first_sell") - F.col("bought_at")).cast("double")
    return s.join(buyers.select("token_mint", "wallet", "bought_at"), ["token_mint", "wallet"], "left").select(
        "token_mint", "wallet", F.when(hold >= 0, hold).alias("hold_duration_s"),
        F.when(F.col("sold") > 0, F.round(F.col("largest") / F.col("sold"), 4)).alias("one_shot_frac"))


VECTOR_FIELDS = [
    ("sniper_rate", 1.0), ("avg_first_buy_offset_s", 300.0), ("cv_buy_size", 2.0), ("pct_sniped", 1.0),
    ("pct_gradual", 1.0), ("pct_single", 1.0), ("avg_hold_duration_s", 86400.0), ("exit_one_shot_frac", 1.0),
]


def behavior_vector(habits: DataFrame) -> DataFrame:
    """Nine clipped components per wallet; unmeasured fields count as zero."""
    parts = [clip(F.coalesce(F.col(c), F.lit(0.0)) / d, 0, 1) for c, d in VECTOR_FIELDS]
    parts.append(clip(F.log10(1 + F.coalesce("avg_buy_size_sol", F.lit(0.0))) / 2.0, 0, 1))
    return habits.select("wallet", "n_coins_bc", *[p.alias(f"v{i}") for i, p in enumerate(parts)])
