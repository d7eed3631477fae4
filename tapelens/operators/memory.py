"""Cross-coin memory: wallet, funder and creator reputations, fingerprints, co-occurrence graph.

Everything is recomputed from coins and outcomes, never incremented, so a coin graded
twice counts once. Point-in-time forms only see coins already resolved at the asking time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapelens.functions.columns import clip, distribution_signal
from tapelens.session import stored
from tapelens.sources.tables import exact_sum

MIN_CALLS, MIN_SAMPLE, RUGGER_RATE = 15, 8, 0.65


def wallet_stats(buyers: DataFrame, outcomes4: DataFrame) -> DataFrame:
    """Calls, wins (moon), losses (rug) and the sample-gated win rate per wallet."""
    j = buyers.select("token_mint", "wallet").join(outcomes4.select("token_mint", "classified"), "token_mint")
    g = j.groupBy("wallet").agg(
        F.count("*").alias("total_calls"), F.count_if(F.col("classified") == "moon").alias("wins"),
        F.count_if(F.col("classified") == "rug").alias("losses"))
    rate = F.col("wins") / F.greatest(F.col("wins") + F.col("losses"), F.lit(1))
    return g.select("wallet", F.col("total_calls").alias("graduated_calls"), "wins", "losses", "total_calls",
                    F.when(F.col("total_calls") >= MIN_CALLS, rate).alias("win_rate"))


def smart_scores(buyers: DataFrame, outcomes4: DataFrame, trades: DataFrame, as_of: int, day_s: int) -> DataFrame:
    """Ninety-day win rate (moon or ok) and 0.60/0.25/0.15 score at an explicit time."""
    recent = buyers.filter(F.col("bought_at") >= as_of - 90 * day_s).join(
        outcomes4.select("token_mint", "classified"), "token_mint")
    wr = recent.groupBy("wallet").agg(
        (F.count_if(F.col("classified").isin("moon", "ok")) / F.count("*")).alias("win_rate_90d"))
    last = buyers.groupBy("wallet").agg(F.max("bought_at").alias("last_ts"))
    j = wr.join(last, "wallet").join(trades, "wallet", "left")
    idle = (F.lit(as_of) - F.col("last_ts")) / day_s
    raw = (0.60 * F.col("win_rate_90d") + 0.25 * F.least(F.coalesce("total_trades", F.lit(0)) / 500.0, F.lit(1.0))
           + 0.15 * F.greatest(F.lit(0.0), 1.0 - idle / 90.0))
    return j.select("wallet", "win_rate_90d", "total_trades", F.round(clip(raw, 0, 1), 4).alias("score"))


def external_scores(profiles: DataFrame, min_rate: float, min_trades: int) -> DataFrame:
    """Seed score .7/.3 of outside profiles, lifted for smart or key-opinion labels."""
    base = F.round(0.70 * F.col("win_rate") + 0.30 * F.least(F.col("trades") / 500.0, F.lit(1.0)), 4)
    low = F.lower(F.coalesce("label", F.lit("")))
    boosted = F.when(low.contains("smart") | low.contains("kol"), F.greatest(base, F.lit(0.72))).otherwise(base)
    return profiles.filter((F.col("win_rate") >= min_rate) & (F.col("trades") >= min_trades)).withColumn("score", boosted)


def _reputation(coins: DataFrame, key: str, flag: str) -> DataFrame:
    g = coins.groupBy(key).agg(
        F.count("*").alias("n"), *[F.count_if(F.col("classified") == c).alias(f"{c}_count") for c in ("rug", "moon", "ok")],
        F.round(exact_sum("supply_pct") / F.count("supply_pct"), 6).alias("avg_bundle_pct"), F.max("graduated_at").alias("last_seen"))
    rug = F.col("rug_count") / F.col("n")
    return g.select(
        key, "n", "rug_count", "moon_count", "ok_count", rug.alias("rug_rate"), (F.col("moon_count") / F.col("n")).alias("moon_rate"),
        "avg_bundle_pct", "last_seen", ((F.col("n") >= MIN_SAMPLE) & (rug >= RUGGER_RATE)).cast("int").alias(flag))


def graded_coins(outcomes4, clusters, anchors, keyed) -> DataFrame:
    """(mint, key, classified, supply_pct, graduated_at): one row per graded coin."""
    return (keyed.join(outcomes4.select("token_mint", "classified"), "token_mint")
            .join(clusters.select("token_mint", "supply_pct"), "token_mint", "left")
            .join(anchors.select("token_mint", "graduated_at"), "token_mint"))


def funder_reputation(graded: DataFrame) -> DataFrame:
    return _reputation(graded, "funder", "is_known_rugger")


def creator_reputation(graded: DataFrame) -> DataFrame:
    return _reputation(graded, "creator", "is_serial_rugger").drop("avg_bundle_pct")


def reputation_as_of(asking: DataFrame, graded: DataFrame, key: str, resolve_s: int) -> DataFrame:
    """Prior coins, rugs and moons per asking row, counting only coins resolved before its anchor.

    Coins collapse to (key, second) first; the running window sees one row per second.
    """
    zero = F.lit(0).cast("long")
    asks = asking.select(key, "graduated_at").distinct().select(key, "graduated_at", *[zero.alias(c) for c in ("n", "rugs", "moons")])
    known = graded.groupBy(key, (F.col("graduated_at") + resolve_s).alias("graduated_at")).agg(
        F.count("*").alias("n"), F.count_if(F.col("classified") == "rug").alias("rugs"), F.count_if(F.col("classified") == "moon").alias("moons"))
    line = asks.unionByName(known).groupBy(key, "graduated_at").agg(*[F.sum(c).alias(c) for c in ("n", "rugs", "moons")])
    w = Window.partitionBy(key).orderBy("graduated_at").rangeBetween(Window.unboundedPreceding, 0)
    prior = line.select(key, "graduated_at", *[F.sum(c).over(w).alias(f"prior_{c}") for c in ("n", "rugs", "moons")])
    rate = lambda c: F.when(F.col("prior_n") > 0, F.col(c) / F.col("prior_n"))
    return asking.join(prior, [key, "graduated_at"]).select(
        "token_mint", key, "prior_n", "prior_rugs", "prior_moons", rate("prior_rugs").alias("prior_rug_rate"), rate("prior_moons").alias("prior_moon_rate"))


def smart_scores_as_of(asking: DataFrame, calls: DataFrame, buys: DataFrame, trades: DataFrame, resolve_s: int, day_s: int) -> DataFrame:
    """Score of `smart_scores` for each (coin, wallet) from what was known at the coin's anchor.

    `calls`: (wallet, graduated_at, classified); `buys`: (wallet, ts); `trades`: (wallet, ts, n). All
    collapse to one row per (wallet, second), over which the counts run. Trades after a wallet's last
    question have no part in any answer and are left out before that.
    """
    last = asking.groupBy("wallet").agg(F.max("graduated_at").alias("last_ask"))
    trades = trades.join(last, "wallet").filter(F.col("ts") <= F.col("last_ask"))
    null = F.lit(None).cast("long")
    row = lambda df, at, n=null, good=null, trade=null, bought=null: df.select("wallet", at.alias("at"), n.alias("n"), good.alias("good"), trade.alias("trades"), bought.alias("bought"))
    good = F.col("classified").isin("moon", "ok").cast("long")
    line = (row(asking, F.col("graduated_at")).unionByName(row(calls, F.col("graduated_at") + resolve_s, F.lit(1).cast("long"), good))
            .unionByName(row(trades, F.col("ts"), trade=F.col("n"))).unionByName(row(buys, F.col("ts"), bought=F.col("ts"))))
    line = line.groupBy("wallet", "at").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("trades").alias("trades"), F.max("bought").alias("bought"))
    w = Window.partitionBy("wallet").orderBy("at")
    ever, recent = w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(-90 * day_s, 0)
    known = line.select("wallet", F.col("at").alias("graduated_at"), F.sum("n").over(recent).alias("n"), F.sum("good").over(recent).alias("good"),
                        F.sum("trades").over(ever).alias("trades"), F.max("bought").over(ever).alias("bought"))
    idle = (F.col("graduated_at") - F.col("bought")) / day_s
    raw = (0.60 * F.col("good") / F.col("n") + 0.25 * F.least(F.coalesce("trades", F.lit(0)) / 500.0, F.lit(1.0)) + 0.15 * F.greatest(F.lit(0.0), 1.0 - idle / 90.0))
    return asking.join(known, ["wallet", "graduated_at"]).filter("n > 0").select("token_mint", "wallet", F.round(clip(raw, 0, 1), 4).alias("score"))


def choreography_as_of(asking: DataFrame, summary: DataFrame, resolve_s: int, min_sellers: int = 2) -> DataFrame:
    """Leader consistency and sample of a funder's exits known at each coin's anchor.

    `summary`: (token_mint, funder, graduated_at, leader_wallet, n_sellers). A leader's count only
    grows, so the largest count so far is a running maximum of the leaders' running counts.
    """
    known = summary.filter(F.col("n_sellers") >= min_sellers).groupBy("funder", "leader_wallet", (F.col("graduated_at") + resolve_s).alias("graduated_at")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("funder", "leader_wallet").orderBy("graduated_at").rangeBetween(Window.unboundedPreceding, 0)
    per = known.withColumn("k", F.sum("c").over(w)).groupBy("funder", "graduated_at").agg(F.max("k").alias("k"), F.sum("c").alias("c"))
    null = F.lit(None).cast("long")
    line = per.unionByName(asking.select("funder", "graduated_at", null.alias("k"), null.alias("c")).distinct()).groupBy("funder", "graduated_at").agg(
        F.max("k").alias("k"), F.sum("c").alias("c"))
    ever = Window.partitionBy("funder").orderBy("graduated_at").rangeBetween(Window.unboundedPreceding, 0)
    prior = line.select("funder", "graduated_at", F.max("k").over(ever).alias("k"), F.sum("c").over(ever).alias("c"))
    return asking.join(prior, ["funder", "graduated_at"]).select(
        "token_mint", F.round(F.col("k") / F.col("c"), 4).alias("leader_consistency"), F.col("c").alias("choreography_n"))


def launch_velocity(coins: DataFrame, key: str, day_s: int) -> DataFrame:
    """Launches of the same funder in the last day and week, the coin itself included."""
    line = coins.groupBy(key, "graduated_at").agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy("graduated_at")
    v = line.select(key, "graduated_at", F.sum("n").over(w.rangeBetween(-day_s, 0)).alias("launches_24h"),
                    F.sum("n").over(w.rangeBetween(-7 * day_s, 0)).alias("launches_7d"))
    return coins.join(v, [key, "graduated_at"]).select("token_mint", key, "launches_24h", "launches_7d")


WALLET_PARTS = 4   # tasks over which the wallets of one coin are spread


def post_grad_behavior(swaps, team, grad_balances, supply, hours, hour_s: int) -> DataFrame:
    """Per (coin, check): holders, top-ten share, new and churned holders, team share sold, signal.

    Trades, balances and members of a (coin, wallet) meet in one grouping as one value and its kind
    (the first check that counts a trade, 0 a balance, -1 a member), so trades cross the network once
    and nothing is joined to them; those after the last check count nowhere. That table is stored by
    coin and wallet part; the sums by coin then leave each of its tasks as one row.
    """
    hours = sorted(hours)
    signed = F.when(F.col("side") == "buy", F.col("token_amount")).otherwise(-F.col("token_amount"))
    due = F.coalesce(*[F.when(F.col("ts") <= F.col("graduated_at") + h * hour_s, i) for i, h in enumerate(hours, 1)])
    trades = swaps.select("token_mint", F.col("signer").alias("wallet"), signed.alias("v"), due.alias("kind")).filter("kind IS NOT NULL")
    was = grad_balances.select("token_mint", "wallet", F.col("amount").alias("v"), F.lit(0).alias("kind"))
    tm = team.select("token_mint", "wallet", F.lit(None).cast("double").alias("v"), F.lit(-1).alias("kind"))
    part = F.pmod(F.hash("wallet"), F.lit(WALLET_PARTS)).alias("part")
    line = trades.unionByName(was).unionByName(tm).select("*", part).repartition("token_mint", "part")
    held = lambda h: F.when(F.col(f"a{h}") > 0, F.col(f"a{h}")).alias(f"a{h}")
    per = line.groupBy("token_mint", "part", "wallet").agg(
        *[exact_sum(F.when(F.col("kind").between(1, i), F.col("v"))).alias(f"a{h}") for i, h in enumerate(hours, 1)],
        F.max(F.when(F.col("kind") == 0, F.col("v"))).alias("was"), F.max(F.when(F.col("kind") == -1, 1)).alias("tm"))
    per = stored(per.select("token_mint", "wallet", *[held(h) for h in hours], "was", "tm"), "wallet-checks")
    own = F.col("tm") == 1
    some = lambda h: F.col(f"a{h}").isNotNull() | F.col("was").isNotNull()
    g = per.groupBy("token_mint").agg(
        exact_sum(F.when(own, F.coalesce("was", F.lit(0.0))).otherwise(0.0)).alias("team_was"), *[c for h in hours for c in (
            F.count_if(some(h)).alias(f"s{h}"), F.count(f"a{h}").alias(f"h{h}"), F.count_if(some(h) & F.col("was").isNull()).alias(f"n{h}"),
            F.count_if(some(h) & F.col(f"a{h}").isNull()).alias(f"c{h}"), exact_sum(F.when(own, F.coalesce(f"a{h}", F.lit(0.0))).otherwise(0.0)).alias(f"t{h}"))])
    g = g.select("token_mint", "team_was", F.inline(F.array(*[F.struct(
        F.lit(h).alias("check_offset_h"), F.col(f"s{h}").alias("n"), F.col(f"h{h}").alias("holder_count"), F.col(f"n{h}").alias("new_holders"),
        F.col(f"c{h}").alias("churned_holders"), F.col(f"t{h}").alias("team_now")) for h in hours]))).filter("n > 0")
    keys = ["token_mint", "check_offset_h"]
    bal = per.select("token_mint", "wallet", F.inline(F.array(*[F.struct(F.lit(h).alias("check_offset_h"), F.col(f"a{h}").alias("amount")) for h in hours]))).filter("amount > 0")
    w = Window.partitionBy(*keys).orderBy(F.desc("amount"), "wallet")
    top = bal.withColumn("rn", F.row_number().over(w)).filter("rn <= 10").groupBy(*keys).agg(exact_sum("amount").alias("top10"))
    j = g.join(top, keys, "left").join(supply, "token_mint")
    pct = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)) / F.col("total_supply") * 100, 2)
    j = j.withColumn("team_sold_pct", F.round((F.col("team_was") - F.col("team_now")) / F.col("total_supply") * 100, 2))
    return j.select(*keys, "holder_count", pct("top10").alias("top10_pct"), "new_holders", "churned_holders", "team_sold_pct",
                    distribution_signal("holder_count", "team_sold_pct").alias("signal"))


def dump_timing(behavior: DataFrame, coin_funder: DataFrame) -> DataFrame:
    """Mean first check at which a funder's coins distribute, with its count."""
    first = behavior.filter("signal = 'DISTRIBUTING'").groupBy("token_mint").agg(F.min("check_offset_h").alias("h"))
    return first.join(coin_funder, "token_mint").groupBy("funder").agg(
        (F.sum("h") / F.count("*")).alias("avg_dump_start_h"), F.count("*").alias("dump_start_count"))


def fingerprints(clusters: DataFrame, coin_funder: DataFrame, outcomes4: DataFrame) -> DataFrame:
    """Mean structure and outcome rates of each funder's teams."""
    j = clusters.join(coin_funder, "token_mint").join(outcomes4.select("token_mint", "classified"), "token_mint", "left")
    mean = lambda c: F.round(exact_sum(F.col(c).cast("double")) / F.count("*"), 3)
    labels = F.greatest(F.count("classified"), F.lit(1))
    return j.groupBy("funder").agg(
        mean("first_buy_offset_s").alias("avg_first_buy_offset_s"), mean("is_bc_sniper").alias("avg_sniper_rate"),
        mean("member_count").alias("avg_cluster_size"), mean("supply_pct").alias("avg_bundle_pct"),
        F.count("*").alias("sample_count"), (F.count_if(F.col("classified") == "rug") / labels).alias("rug_rate"),
        (F.count_if(F.col("classified") == "moon") / labels).alias("moon_rate"))


def fingerprints_by_epoch(clusters: DataFrame, coin_funder: DataFrame, outcomes4: DataFrame, anchors: DataFrame, resolve_s: int, epoch_s: int) -> DataFrame:
    """`fingerprints` at the start of each epoch, from coins resolved by then: (epoch, funder, ...).

    A coin enters all epochs that start after it was resolved, through sums per (funder, epoch)
    that run on; the number of epochs is the length of the tape over `epoch_s`.
    """
    j = (clusters.join(coin_funder, "token_mint").join(outcomes4.select("token_mint", "classified"), "token_mint", "left")
         .join(anchors.select("token_mint", "graduated_at"), "token_mint"))
    first = F.ceil((F.col("graduated_at") + resolve_s) / epoch_s)
    axes = ["first_buy_offset_s", "is_bc_sniper", "member_count", "supply_pct"]
    per = j.groupBy("funder", first.alias("epoch")).agg(
        F.count("*").alias("n"), F.count("classified").alias("c"), F.count_if(F.col("classified") == "rug").alias("rugs"),
        *[F.sum(F.col(a).cast("decimal(28,9)")).alias(a) for a in axes])
    top = anchors.agg(F.floor(F.max("graduated_at") / epoch_s).alias("top"))
    sums = ["n", "c", "rugs", *axes]
    spread = per.join(F.broadcast(top)).withColumn("epoch", F.explode(F.when(F.col("epoch") <= F.col("top"), F.sequence("epoch", "top"))))  # one row
    g = spread.groupBy("funder", "epoch").agg(*[F.sum(x).alias(x) for x in sums])
    mean = lambda a: F.round(F.col(a).cast("double") / F.col("n"), 3)
    return g.select("funder", "epoch", mean("first_buy_offset_s").alias("avg_first_buy_offset_s"), mean("is_bc_sniper").alias("avg_sniper_rate"),
                    mean("member_count").alias("avg_cluster_size"), mean("supply_pct").alias("avg_bundle_pct"), F.col("n").alias("sample_count"),
                    (F.col("rugs") / F.greatest(F.col("c"), F.lit(1))).alias("rug_rate"))


def structural_match(clusters: DataFrame, prints: DataFrame, min_rug: float = 0.6, min_n: int = 4, limit: float = 0.25, within: tuple = ()) -> DataFrame:
    """Nearest known rug structure within `limit`, through a grid join on three of the four axes.

    Both sides carry a cell of side `limit`; a match differs by at most one cell per axis, so
    the known side is spread over its neighbours and no pair outside them is formed. `within`
    names columns that must be equal on both sides, such as the epoch of a point-in-time match.
    """
    def axes(df, size, supply, sniper, offset):
        return df.select("*", (F.col(size) / 20.0).alias("x0"), (F.col(supply) / 100.0).alias("x1"),
                         F.col(sniper).cast("double").alias("x2"), (F.col(offset) / 300.0).alias("x3"))
    known = axes(prints.filter((F.col("rug_rate") >= min_rug) & (F.col("sample_count") >= min_n)),
                 "avg_cluster_size", "avg_bundle_pct", "avg_sniper_rate", "avg_first_buy_offset_s")
    known = known.select("funder", "rug_rate", "sample_count", *within, *[F.col(f"x{i}").alias(f"k{i}") for i in range(4)])
    new = axes(clusters, "member_count", "supply_pct", "is_bc_sniper", "first_buy_offset_s")
    for i in (0, 1, 3):
        c = F.floor(F.col(f"k{i}") / limit)
        known = known.withColumn(f"c{i}", F.explode(F.array(c - 1, c, c + 1)))
        new = new.withColumn(f"c{i}", F.floor(F.col(f"x{i}") / limit))
    d2 = sum((F.pow(F.col(f"x{i}") - F.col(f"k{i}"), 2) for i in range(1, 4)), F.pow(F.col("x0") - F.col("k0"), 2))
    j = new.join(known, ["c0", "c1", "c3", *within]).withColumn("distance", F.round(F.sqrt(d2), 6)).filter(F.col("distance") <= limit)
    best = j.groupBy("token_mint").agg(F.min_by(F.struct("funder", "distance", "rug_rate", "sample_count"), F.struct("distance", "funder")).alias("m"))
    return best.select("token_mint", F.col("m.funder").alias("matched_funder"), "m.distance", F.col("m.rug_rate").alias("match_rug_rate"),
                       F.col("m.sample_count").alias("match_n"))


def team_memberships(team: DataFrame, outcomes4: DataFrame, anchors: DataFrame) -> DataFrame:
    """(wallet, token_mint, graduated_at, classified) for teams of two or more wallets.

    The co-occurrence graph in two-mode form: wallets and teams, never pairs of wallets.
    """
    sizes = team.groupBy("token_mint").agg(F.count("*").alias("k")).filter("k >= 2").select("token_mint")
    return (team.select("token_mint", "wallet").join(sizes, "token_mint", "left_semi")
            .join(outcomes4.select("token_mint", "classified"), "token_mint", "left").join(anchors.select("token_mint", "graduated_at"), "token_mint"))


def wallet_graph(memberships: DataFrame) -> DataFrame:
    """Teams, rugged teams and last appearance of every wallet."""
    return memberships.groupBy("wallet").agg(
        F.count("*").alias("teams"), F.count_if(F.col("classified") == "rug").alias("rug_teams"), F.max("graduated_at").alias("last_seen"))


def graph_hit_counts(memberships: DataFrame, resolve_s: int) -> DataFrame:
    """(mint, connected, rug_hits, soft_hits): members that were on two or more earlier teams.

    Only teams resolved before the coin's anchor count; two rugged ones make it a rug hit.
    """
    prior = reputation_as_of(memberships.select("token_mint", "wallet", "graduated_at"), memberships.filter("classified IS NOT NULL"), "wallet", resolve_s)
    rug = (F.col("prior_rugs") >= 2).cast("int")
    return prior.filter("prior_n >= 2").select("token_mint", F.col("wallet").alias("connected"), rug.alias("rug_hits"), (1 - rug).alias("soft_hits"))


def funder_choreography(summary: DataFrame, coin_funder: DataFrame, min_sellers: int = 2) -> DataFrame:
    """Mean exit spread, most common leader and its consistency per funder."""
    j = summary.filter(F.col("n_sellers") >= min_sellers).join(coin_funder, "token_mint")
    per = j.groupBy("funder", "leader_wallet").agg(F.count("*").alias("k"), exact_sum("exit_spread_s").alias("s"))
    g = per.groupBy("funder").agg(
        F.min_by("leader_wallet", F.struct(-F.col("k"), F.col("leader_wallet"))).alias("leader_wallet"),
        F.max("k").alias("k"), F.sum("k").alias("n"), exact_sum("s").alias("s"))
    return g.select("funder", F.round(F.col("s") / F.col("n"), 2).alias("avg_exit_spread_s"), "leader_wallet",
                    F.round(F.col("k") / F.col("n"), 4).alias("leader_consistency"), F.col("n").alias("sample_count"))
