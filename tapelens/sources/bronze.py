"""Bronze to silver: row-level parsers of landed JSON as projections over `from_json`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRANSFER = "struct<fromUserAccount:string,toUserAccount:string,tokenAmount:double,decimals:int,mint:string>"
NATIVE = "struct<fromUserAccount:string,toUserAccount:string,amount:bigint>"
INNER = "struct<programId:string>"
ENRICHED_TX = (
    f"type string, source string, fee bigint, feePayer string, signature string, slot bigint, timestamp bigint,"
    f" tokenTransfers array<{TRANSFER}>, nativeTransfers array<{NATIVE}>,"
    f" instructions array<struct<programId:string,innerInstructions:array<{INNER}>>>")
INDEXED_TRADE = "wallet string, type string, amount double, volumeSol double, priceUsd double, time bigint, tx string, program string"
LISTING = ("mint string, name string, symbol string, description string, creator string, traderPublicKey string, created_timestamp bigint,"
           " timestamp bigint, twitter string, telegram string, website string, usd_market_cap double, marketCapSol double,"
           " image string, image_uri string, metadata struct<name:string,symbol:string,description:string,twitter:string,telegram:string,website:string,image:string>")
LAUNCH_TRADE = "mint string, user string, traderPublicKey string, sol_amount double, solAmount double, token_amount double, tokenAmount double, is_buy boolean, txType string, timestamp bigint"
MIGRATE = "mint string, token string, signature string, timestamp bigint, blockTime bigint, pool string, txType string"
WALLET_PROFILE = "code int, data struct<buy:bigint,sell:bigint,winrate:double,last_active_timestamp:bigint,tags:array<string>>"
TOKEN_PROFILE = "data struct<symbol:string,name:string,market_cap:double,holder_count:bigint,burn_status:string,top10_holder_rate:double,launchpad:string,open_timestamp:bigint>"
POOL = "struct<poolId:string,bondingCurve:string,curve:string,tokenAccount:string,quoteTokenAccount:string,baseVault:string,quoteVault:string,lpMint:string,openOrders:string,targetOrders:string,tokenSupply:double,market:string,liquidity:struct<usd:double>,marketCap:struct<usd:double>,price:struct<usd:double>,txns:struct<buys:bigint,sells:bigint,total:bigint>>"
TOKEN_INFO = (f"token struct<name:string,symbol:string,description:string,website:string,twitter:string,telegram:string,creation:struct<creator:string,created_time:bigint>,"
              f"socials:struct<website:string,twitter:string,telegram:string>,extensions:struct<description:string,website:string,twitter:string,telegram:string>>, holders bigint, pools array<{POOL}>")
POST = "id string, text string, created_at string, author string, followers bigint, likes bigint"
# Accepted venue labels, account keys of a pool, default supply.
SWAP_SOURCES = ["PUMP_FUN", "PUMP_AMM", "PUMPSWAP", "BAGS", "RAYDIUM", "JUPITER", "METEORA", "ORCA"]
POOL_KEYS = ["poolId", "bondingCurve", "curve", "tokenAccount", "quoteTokenAccount", "baseVault", "quoteVault", "lpMint", "openOrders", "targetOrders"]
DEFAULT_SUPPLY, SOL_USD, LAMPORTS = 1_000_000_000.0, 150.0, 1e9
PLACEHOLDER_CREATOR = "11111111111111111111111111111111"


def parsed(raw: DataFrame, schema: str, col: str = "raw", *keep: str) -> DataFrame:
    return raw.select(*keep, F.from_json(col, schema).alias("j")).select(*keep, "j.*")


def to_seconds(c: Column, limit: float = 1e10) -> Column:
    """Milliseconds become seconds when the value is too large for seconds."""
    return F.when(c > limit, F.floor(c / 1000)).otherwise(c).cast("long")


def swaps_from_transactions(raw: DataFrame, programs: list[str]) -> DataFrame:
    """Enriched transactions to swaps: the first token transfer touching the fee payer sets side and amount."""
    j = parsed(raw, ENRICHED_TX)
    known = F.array(*[F.lit(p) for p in programs])
    outer = F.exists("instructions", lambda i: F.array_contains(known, i["programId"]))
    inner = F.exists("instructions", lambda i: F.exists(i["innerInstructions"], lambda x: F.array_contains(known, x["programId"])))
    ok = (F.col("type") == "SWAP") | F.col("source").isin(SWAP_SOURCES) | F.coalesce(outer | inner, F.lit(False))
    payer = F.col("feePayer")
    touch = F.filter("tokenTransfers", lambda x: (x["mint"] != "") & ((x["toUserAccount"] == payer) | (x["fromUserAccount"] == payer)))
    j = j.filter(ok).withColumn("t", F.try_element_at(touch, F.lit(1))).filter("t IS NOT NULL")
    buy = F.col("t.toUserAccount") == payer
    out_l = F.aggregate(F.filter("nativeTransfers", lambda n: n["fromUserAccount"] == payer), F.lit(0).cast("long"), lambda a, n: a + n["amount"])
    in_l = F.aggregate(F.filter("nativeTransfers", lambda n: n["toUserAccount"] == payer), F.lit(0).cast("long"), lambda a, n: a + n["amount"])
    return j.select(
        F.when(buy, "buy").otherwise("sell").alias("side"), F.col("t.mint").alias("token_mint"),
        (F.when(buy, out_l).otherwise(in_l) / LAMPORTS).alias("sol_amount"), (F.col("t.tokenAmount") / F.pow(F.lit(10.0), F.coalesce("t.decimals", F.lit(0)))).alias("token_amount"),
        payer.alias("signer"), F.col("timestamp").alias("ts"), "slot", F.col("signature").alias("tx_signature"))


def buys_from_transactions(raw: DataFrame, programs: list[str]) -> DataFrame:
    return swaps_from_transactions(raw, programs).filter("side = 'buy'")


def swaps_from_indexed(raw: DataFrame, mint: str = "token_mint") -> DataFrame:
    """Indexed trades: side and wallet required, milliseconds folded, slot defaults to the second."""
    j = parsed(raw, INDEXED_TRADE, "raw", mint).filter(F.col("type").isin("buy", "sell") & F.col("wallet").isNotNull())
    ts = to_seconds(F.col("time"))
    return j.select(F.col("type").alias("side"), mint, F.col("volumeSol").alias("sol_amount"), F.col("amount").alias("token_amount"),
                    F.col("wallet").alias("signer"), ts.alias("ts"), ts.alias("slot"), F.col("tx").alias("tx_signature"), F.col("priceUsd").alias("price_usd"))


def history(swaps: DataFrame, since: int, until: int) -> DataFrame:
    """Bounded history scan: a range predicate the scan can prune on."""
    return swaps.filter(F.col("ts").between(since, until))


def listings(raw: DataFrame) -> DataFrame:
    """New listings with alternate field names and the dollar cap derived from the SOL cap."""
    j = parsed(raw, LISTING)
    nz = lambda c: F.nullif(F.trim(c), F.lit(""))
    text = lambda *names: F.coalesce(*[nz(F.col(n)) for n in names])  # blanks and zeros count as missing
    some = lambda name: F.nullif(F.col(name), F.lit(0))
    return j.filter("mint IS NOT NULL").select(
        "mint", F.coalesce(nz(F.col("name")), nz(F.col("metadata.name"))).alias("name"), F.coalesce(nz(F.col("symbol")), nz(F.col("metadata.symbol"))).alias("symbol"),
        text("description", "metadata.description").alias("description"), text("traderPublicKey", "creator").alias("creator"),
        to_seconds(F.coalesce(some("timestamp"), some("created_timestamp"))).alias("created_at"),
        F.coalesce(some("usd_market_cap"), F.col("marketCapSol") * SOL_USD).alias("market_cap_usd"),
        *[text(c, f"metadata.{c}").alias(c) for c in ("twitter", "telegram", "website")], text("image_uri", "image", "metadata.image").alias("image"))


def launch_trades(raw: DataFrame) -> DataFrame:
    """Launch trades: the lamport field becomes SOL, side from the flag or txType."""
    j = parsed(raw, LAUNCH_TRADE)
    sol = F.coalesce(F.col("solAmount"), F.coalesce("sol_amount", F.lit(0.0)) / LAMPORTS)
    side = F.coalesce(F.when(F.col("is_buy"), "buy").when(~F.col("is_buy"), "sell"), F.lower("txType"))
    return j.filter("mint IS NOT NULL").select(
        "mint", F.coalesce("traderPublicKey", "user").alias("signer"), side.alias("side"), sol.alias("sol_amount"),
        F.coalesce("tokenAmount", "token_amount").alias("token_amount"), to_seconds(F.col("timestamp")).alias("ts")).filter(
        "side IN ('buy', 'sell') AND signer IS NOT NULL AND signer <> ''")


def graduations(raw: DataFrame, received_at: Column) -> DataFrame:
    j = parsed(raw, MIGRATE, "raw", "received_at")
    return j.select(F.coalesce("mint", "token").alias("mint"), "signature", to_seconds(F.coalesce(F.col("timestamp"), F.col("blockTime"), received_at)).alias("graduated_at"), "pool").filter("mint IS NOT NULL")


def wallet_profiles(raw: DataFrame) -> DataFrame:
    j = parsed(raw, WALLET_PROFILE, "raw", "wallet")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select("wallet", F.col("data.winrate").alias("win_rate_90d"), (z("data.buy") + z("data.sell")).alias("total_trades"),
                    F.try_element_at("data.tags", F.lit(1)).alias("label"))


def token_profiles(raw: DataFrame) -> DataFrame:
    j = parsed(raw, TOKEN_PROFILE, "raw", "mint")
    pad = F.lower(F.coalesce("data.launchpad", F.lit("")))
    rate = F.col("data.top10_holder_rate")
    return j.select("mint", F.col("data.symbol").alias("symbol"), F.col("data.holder_count").alias("holder_count"),
                    F.when(pad.contains("pump"), "pump.fun").when(pad.contains("bag"), "bags").otherwise("unknown").alias("launchpad"),
                    F.lower(F.coalesce("data.burn_status", F.lit(""))).isin("burned", "true").cast("int").alias("lp_burned"),
                    F.when(rate <= 1, rate * 100).otherwise(rate).alias("top10_pct"))


def token_meta(raw: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Metadata with precedence top level, socials, extensions; a second feed fills what is missing."""
    j = parsed(raw, TOKEN_INFO, "raw", "mint")
    nz = lambda c: F.nullif(F.col(c), F.lit(""))
    pick = lambda f: F.coalesce(nz(f"token.{f}"), nz(f"token.socials.{f}"), nz(f"token.extensions.{f}"))
    m = j.select("mint", F.coalesce("token.name", F.lit("")).alias("name"), F.coalesce("token.symbol", F.lit("")).alias("symbol"),
                 F.coalesce("token.description", "token.extensions.description").alias("description"), *[pick(f).alias(f) for f in ("website", "twitter", "telegram")])
    if fallback is None:
        return m
    f = fallback.select("mint", *[F.col(c).alias(f"f_{c}") for c in ("website", "twitter", "telegram")])
    bare = F.col("website").isNull() & F.col("twitter").isNull() & F.col("telegram").isNull()
    fill = lambda c: F.when(bare, F.coalesce(c, f"f_{c}")).otherwise(F.col(c)).alias(c)
    return m.join(f, "mint", "left").select("mint", "name", "symbol", "description", fill("website"), fill("twitter"), fill("telegram"))


def creation(raw: DataFrame) -> DataFrame:
    j = parsed(raw, TOKEN_INFO, "raw", "mint")
    c = F.col("token.creation.creator")
    return j.select("mint", F.when((F.length(c) >= 30) & (c != PLACEHOLDER_CREATOR), c).alias("creator"),
                    to_seconds(F.nullif(F.col("token.creation.created_time"), F.lit(0)), 1e12).alias("created_at"))


def pool_accounts(raw: DataFrame) -> DataFrame:
    """(mint, account): distinct account-like values of the ten pool keys."""
    j = parsed(raw, TOKEN_INFO, "raw", "mint")
    flat = F.flatten(F.transform("pools", lambda p: F.array(*[p[k] for k in POOL_KEYS])))
    return j.select("mint", F.explode(F.array_distinct(F.filter(flat, lambda a: F.length(a) >= 30))).alias("account"))


def total_supply(raw: DataFrame) -> DataFrame:
    j = parsed(raw, TOKEN_INFO, "raw", "mint")
    first = F.try_element_at(F.filter(F.transform("pools", lambda p: p["tokenSupply"]), lambda s: s > 0), F.lit(1))
    return j.select("mint", F.coalesce(first, F.lit(DEFAULT_SUPPLY)).alias("total_supply"))


def market_state(raw: DataFrame) -> DataFrame:
    """Holder count plus price, cap and counts of the deepest pool."""
    j = parsed(raw, TOKEN_INFO, "raw", "mint").select("mint", F.col("holders").alias("holder_count"), F.posexplode_outer("pools").alias("pos", "p"))
    best = F.max_by("p", F.when(F.col("p.liquidity.usd").isNotNull(), F.struct(F.col("p.liquidity.usd"), -F.col("pos"))))
    g = j.groupBy("mint").agg(F.max("holder_count").alias("holder_count"), best.alias("b"))
    return g.select("mint", "holder_count", F.col("b.liquidity.usd").alias("liquidity_usd"), F.col("b.marketCap.usd").alias("market_cap_usd"),
                    F.col("b.price.usd").alias("price_usd"), F.col("b.txns.total").alias("txns_total"))


def mentions(raw: DataFrame) -> DataFrame:
    j = parsed(raw, POST, "raw", "narrative_id")
    return j.select("narrative_id", "id", F.unix_timestamp(F.to_timestamp("created_at")).alias("posted_at"), F.substring("text", 1, 200).alias("excerpt"), "author", "followers")


def wallet_holders(accounts: DataFrame, owners: DataFrame, programs: DataFrame, off_curve: DataFrame) -> DataFrame:
    """Token accounts to owner wallets: unresolved, program-owned and off-curve owners drop, duplicates add up."""
    j = accounts.join(owners, "account").filter("owner IS NOT NULL")
    j = j.join(programs.select(F.col("address").alias("owner")), "owner", "left_anti").join(off_curve.select("owner"), "owner", "left_anti")
    return j.groupBy("mint", "owner").agg(F.sum(F.col("amount").cast("decimal(28,9)")).cast("double").alias("amount"))


def sol_inflows(transfers: DataFrame, launches: DataFrame, lookback: int) -> DataFrame:
    """Largest inflow to each buyer inside [launch - lookback, launch]; self transfers do not count."""
    j = transfers.filter("sender <> wallet AND sol > 0").join(launches, "wallet").filter(
        F.col("ts").between(F.col("launch_ts") - lookback, F.col("launch_ts")))
    best = F.max_by(F.struct("sender", "ts", "sol"), F.struct(F.col("sol"), -F.col("ts"), F.col("sender")))
    return j.groupBy("token_mint", "wallet").agg(best.alias("b")).select("token_mint", "wallet", "b.*")


def first_funder(transfers: DataFrame, cex: DataFrame, oldest: int = 5) -> DataFrame:
    """First sender among the oldest transactions of a wallet; exchange senders read 'cex'."""
    w = Window.partitionBy("wallet").orderBy("ts", "tx")
    early = transfers.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= oldest)
    g = early.filter("sender <> wallet").groupBy("wallet").agg(F.min_by("sender", F.struct("ts", "tx")).alias("sender"), F.min("ts").alias("first_seen"))
    return g.join(cex.select(F.col("wallet").alias("sender"), F.lit(1).alias("c")), "sender", "left").select(
        "wallet", F.when(F.col("c") == 1, "cex").otherwise(F.col("sender")).alias("funder"), "first_seen")


def two_hop(funding: DataFrame, gate: int = 10) -> DataFrame:
    """Second hop for funders with a narrow history."""
    f2 = funding.select(F.col("wallet").alias("funder"), F.col("funder").alias("funder2"), F.col("sig_count").alias("s2")).filter(F.col("s2") < gate)
    return funding.select("wallet", "funder").join(f2, "funder", "left").select("wallet", "funder", "funder2")


def created_at(tokens: DataFrame, first_trades: DataFrame) -> DataFrame:
    """Creation time by source precedence; the first trade wins when it is over a minute earlier."""
    feed, info, now = F.col("feed_ts"), F.col("info_ts"), F.col("now_ts")
    use_feed = feed.isNotNull() & (now - feed > 300) & (info.isNull() | (feed <= info + 60))
    base = F.when(use_feed, feed).when(info.isNotNull(), info).otherwise(now)
    src = F.when(use_feed, "launch_feed").when(info.isNotNull(), "info").otherwise("fallback_now")
    j = tokens.withColumn("b", base).withColumn("s", src).join(first_trades, "token_mint", "left")
    early = F.coalesce(F.col("first_trade_ts") < F.col("b") - 60, F.lit(False))
    return j.select("token_mint", F.when(early, F.col("first_trade_ts")).otherwise(F.col("b")).alias("created_at"), F.when(early, "first_trade").otherwise(F.col("s")).alias("source"))


def platform_of(keys: Column, mayhem: str, classic: str) -> Column:
    return F.when(F.array_contains(keys, mayhem), "mayhem").when(F.array_contains(keys, classic), "pump.fun")


def allowed_venue(venue: Column, allowed: list[str]) -> Column:
    """Unknown venues and address-like labels pass; named ones must be on the list."""
    return venue.isNull() | (F.length(venue) > 20) | F.lower(venue).isin(allowed)


def reresolve(tokens: DataFrame, resolved: DataFrame, now: int, stale_s: int) -> DataFrame:
    """Unverified platforms take the resolved value, or 'unresolvable' once they are old."""
    j = tokens.join(resolved, "token_mint", "left")
    open_ = F.col("platform") == "unverified"
    new = F.when(open_ & F.col("resolved").isNotNull(), F.col("resolved")).when(open_ & (F.lit(now) - F.col("graduated_at") > stale_s), "unresolvable")
    return j.select("token_mint", F.coalesce(new, F.col("platform")).alias("platform"))


def missed_events(feed: DataFrame, seen: DataFrame, skipped: DataFrame, first_prints: DataFrame, now: int, max_age: int = 3600, max_lag: int = 120) -> DataFrame:
    """Feed minus seen minus skipped, recent, with a first print inside the anchor lag."""
    m = feed.join(seen.select("token_mint"), "token_mint", "left_anti").join(skipped.select("token_mint"), "token_mint", "left_anti")
    m = m.filter(F.lit(now) - F.col("pool_created_at") <= max_age).join(first_prints, "token_mint")
    return m.filter((F.col("first_ts") - F.col("pool_created_at")).between(0, max_lag)).select(
        "token_mint", F.col("pool_created_at").alias("graduated_at"), F.lit(1).alias("recovered"), F.lit("poll").alias("detection_source"))


def dedup_key(sig: Column, wallet: Column, mint: Column, ts: Column, side: Column, sol: Column) -> Column:
    """signature:wallet, or a composite with the rounded amount when the signature is missing."""
    composite = F.concat_ws(":", mint, wallet, ts.cast("string"), side, F.format_string("%.6f", sol))
    return F.when(sig.isNotNull(), F.concat_ws(":", sig, wallet)).otherwise(composite)


# ── page text ────────────────────────────────────────────────────────────────
def domain_of(url: Column) -> Column:
    """Host in lower case without www; a host may come without a scheme."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.trim(url), r"^(?:[A-Za-z]+://)?([^/:?#\s]+\.[^/:?#\s]+)", 1)), r"^www\.", "")


#: Hosts of channel links, and what a channel name is made of.
CHANNEL_HOSTS = ["t.me", "telegram.me"]
CHANNEL_NAME = "[A-Za-z0-9_]{3,}"


def channel_name(url: Column) -> Column:
    """User name: the last path part of a channel link, or what follows the at signs of a bare handle."""
    parts = F.split(F.regexp_replace(F.trim(url), r"[?#].*$", ""), "/")
    host = F.exists(parts, lambda p: p.isin(CHANNEL_HOSTS))
    name = F.when(host, F.element_at(F.filter(parts, lambda p: p != ""), -1)).when(F.size(parts) == 1, F.ltrim(parts[0], F.lit("@")))
    return F.when(name.rlike(f"^{CHANNEL_NAME}$") & ~name.isin(CHANNEL_HOSTS), name)


def member_count(text: Column) -> Column:
    """Digits in front of 'subscribers' or 'members'; blanks and commas group them."""
    d = F.regexp_replace(F.regexp_extract(text, r"(?i)([\d\u00a0, ]+)\s+(?:subscriber|member)", 1), r"[^\d]", "")
    return F.when(d != "", d.cast("long"))


#: The labels in front of a registration date, and the layouts of the date.
REGISTRY_LABELS = ["creation date", "created", "registered on", "registration time"]
REGISTRY_LAYOUTS = ["yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "dd.MM.yyyy"]


def registered_on(text: Column) -> Column:
    """Date behind the first registry label; the text after it is read in each layout."""
    after = F.regexp_extract(text, "(?i)(?:" + "|".join(REGISTRY_LABELS) + r")[:\s]*([0-9][0-9./-]{8}[0-9])", 1)
    return F.coalesce(*[F.try_to_timestamp(after, F.lit(layout)) for layout in REGISTRY_LAYOUTS]).cast("date")


def domain_age_days(text: Column, as_of: Column) -> Column:
    return F.greatest(F.datediff(as_of, registered_on(text)), F.lit(0))
