"""Registered parsing, sink, narrative and page-text queries with SQL twins.

Raw JSON is built from the landed tables in the shapes the feeds use, then parsed back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tapelens.functions import columns as C
from tapelens.functions.address import is_on_curve
from tapelens.operators import flow
from tapelens.plans.registry import cte, dsum, query
from tapelens.sources import bronze, sinks
from tapelens.sources.tables import Tables, exact_sum

PROGRAM = "6EF8rrecthR5Dkzon8Nwu78hRvfCKubJ14M5uBEwF6P"   # fixed value: launch program id
js = lambda **kw: F.to_json(F.struct(*[v.alias(k) for k, v in kw.items()]))
null = lambda t: F.lit(None).cast(t)


def raw_transactions(t: Tables):
    buy = F.col("side") == "buy"
    payer, pool, lamports = F.col("signer"), F.lit("pool"), F.round(F.col("sol_amount") * 1e9).cast("long")
    other = F.struct(pool.alias("fromUserAccount"), F.lit("else").alias("toUserAccount"), F.lit(5.0).alias("tokenAmount"), F.lit(0).alias("decimals"), F.col("token_mint").alias("mint"))
    mine = F.struct(F.when(buy, pool).otherwise(payer).alias("fromUserAccount"), F.when(buy, payer).otherwise(pool).alias("toUserAccount"),
                    (F.col("token_amount") * 1000).alias("tokenAmount"), F.lit(3).alias("decimals"), F.col("token_mint").alias("mint"))
    native = F.struct(F.when(buy, payer).otherwise(pool).alias("fromUserAccount"), F.when(buy, pool).otherwise(payer).alias("toUserAccount"), lamports.alias("amount"))
    kind = F.when(F.col("ts") % 3 == 0, "SWAP").otherwise("UNKNOWN")
    source = F.when(F.col("ts") % 3 == 1, "PUMP_AMM").otherwise("SYSTEM")
    program = F.when(F.col("ts") % 4 == 3, F.lit("other")).otherwise(F.lit(PROGRAM))
    ins = F.array(F.struct(F.lit("outer").alias("programId"), F.array(F.struct(program.alias("programId"))).alias("innerInstructions")))
    return t.swaps.select(js(type=kind, source=source, feePayer=payer, signature=F.col("tx_signature"), slot=F.col("slot"), timestamp=F.col("ts"),
                             tokenTransfers=F.array(other, mine), nativeTransfers=F.array(native), instructions=ins).alias("raw"))


_accepted = "(ts % 3 = 0 OR ts % 3 = 1 OR ts % 4 <> 3)"


@query("parse_enriched_swaps", sql=f"SELECT side, token_mint, round(sol_amount, 5) AS sol_amount, token_amount, signer, ts, slot, tx_signature FROM t_swaps WHERE {_accepted}")
def _(t):
    return bronze.swaps_from_transactions(raw_transactions(t), [PROGRAM]).withColumn("sol_amount", F.round("sol_amount", 5))


@query("parse_enriched_buys", sql=f"SELECT token_mint, count(*) AS n FROM t_swaps WHERE {_accepted} AND side = 'buy' GROUP BY 1")
def _(t):
    return bronze.buys_from_transactions(raw_transactions(t), [PROGRAM]).groupBy("token_mint").agg(F.count("*").alias("n"))


def raw_indexed(t):
    ms = (F.lit(1_700_000_000) + F.col("ts")) * F.when(F.col("ts") % 2 == 0, 1000).otherwise(1)
    side = F.when(F.col("ts") % 11 == 0, "other").otherwise(F.col("side"))
    return t.swaps.select("token_mint", js(wallet=F.when(F.col("ts") % 13 != 0, F.col("signer")), type=side, amount=F.col("token_amount"), volumeSol=F.col("sol_amount"),
                                           priceUsd=F.col("price_usd"), time=ms, tx=F.col("tx_signature")).alias("raw"))


@query("parse_indexed_trades", sql="""SELECT side, token_mint, sol_amount, token_amount, signer, ts + 1700000000 AS ts, ts + 1700000000 AS slot, tx_signature, price_usd FROM t_swaps WHERE ts % 11 <> 0 AND ts % 13 <> 0""")
def _(t):
    return bronze.swaps_from_indexed(raw_indexed(t))


@query("history_scan", sql="SELECT token_mint, count(*) AS n FROM t_swaps WHERE ts BETWEEN 500 AND 900 GROUP BY 1")
def _(t):
    return bronze.history(t.swaps, 500, 900).groupBy("token_mint").agg(F.count("*").alias("n"))


@query("parse_listings", sql="""SELECT token_mint AS mint, name, symbol, concat('about ', name) AS description, creator, created_at, CASE WHEN p_size % 2 = 0 THEN p_retailprice ELSE p_size * 150.0::DOUBLE END AS market_cap_usd FROM t_tokens""")
def _(t):
    k = t.tokens
    odd = F.col("p_size") % 2 == 1
    raw = k.select(js(mint=F.col("token_mint"), name=F.when(odd, F.col("name")).otherwise(""), symbol=F.when(odd, F.col("symbol")), creator=F.when(odd, F.col("creator")),
                      traderPublicKey=F.when(~odd, F.col("creator")), created_timestamp=F.when(odd, F.col("created_at")), timestamp=F.when(~odd, F.col("created_at")),
                      usd_market_cap=F.when(~odd, F.col("p_retailprice")), marketCapSol=F.col("p_size").cast("double"),
                      metadata=F.struct(F.col("name").alias("name"), F.col("symbol").alias("symbol"), F.concat(F.lit("about "), F.col("name")).alias("description"))).alias("raw"))
    return bronze.listings(raw).select("mint", "name", "symbol", "description", "creator", "created_at", "market_cap_usd")


@query("parse_launch_trades", sql="SELECT token_mint AS mint, signer, side, round(sol_amount, 6) AS sol_amount, token_amount, ts FROM t_swaps")
def _(t):
    odd = F.col("ts") % 2 == 1
    buy = F.col("side") == "buy"
    raw = t.swaps.select(js(mint=F.col("token_mint"), user=F.when(odd, F.col("signer")), traderPublicKey=F.when(~odd, F.col("signer")), sol_amount=F.when(odd, F.col("sol_amount") * 1e9),
                            solAmount=F.when(~odd, F.col("sol_amount")), token_amount=F.when(odd, F.col("token_amount")), tokenAmount=F.when(~odd, F.col("token_amount")),
                            is_buy=F.when(odd, buy), txType=F.when(~odd, F.col("side")), timestamp=F.col("ts")).alias("raw"))
    return bronze.launch_trades(raw).withColumn("sol_amount", F.round("sol_amount", 6))


@query("parse_graduations", sql="SELECT token_mint AS mint, CASE WHEN CAST(token_mint AS BIGINT) % 5 = 0 THEN 42 ELSE graduated_at END AS graduated_at FROM t_coins")
def _(t):
    m = F.col("token_mint").cast("long")
    raw = t.coins.select(F.lit(42).cast("long").alias("received_at"), js(mint=F.when(m % 2 == 0, F.col("token_mint")), token=F.when(m % 2 == 1, F.col("token_mint")),
                         timestamp=F.when((m % 5 != 0) & (m % 3 == 0), F.col("graduated_at") * 1), blockTime=F.when((m % 5 != 0) & (m % 3 != 0), F.col("graduated_at"))).alias("raw"))
    return bronze.graduations(raw, F.col("received_at")).select("mint", "graduated_at")


@query("parse_wallet_profiles", sql="SELECT wallet, sol_funded / 10000 AS win_rate_90d, sig_count + 3 AS total_trades, CASE WHEN sig_count % 2 = 0 THEN 'smart_degen' END AS label FROM t_funding")
def _(t):
    raw = t.funding.select("wallet", js(code=F.lit(0), data=F.struct(F.col("sig_count").alias("buy"), F.lit(3).alias("sell"), (F.col("sol_funded") / 10000).alias("winrate"),
                                        F.when(F.col("sig_count") % 2 == 0, F.array(F.lit("smart_degen"), F.lit("kol"))).otherwise(F.array().cast("array<string>")).alias("tags"))).alias("raw"))
    return bronze.wallet_profiles(raw)


@query("parse_token_profiles", sql="""SELECT CAST(p_partkey AS VARCHAR) AS mint, CASE p_size % 3 WHEN 0 THEN 'pump.fun' WHEN 1 THEN 'bags' ELSE 'unknown' END AS launchpad, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS lp_burned,
  CASE WHEN p_size <= 10 THEN p_size / 10.0::DOUBLE * 100 ELSE p_size END AS top10_pct FROM part""")
def _(t):
    s = F.col("p_size")
    raw = t.raw("part").select(F.col("p_partkey").cast("string").alias("mint"), js(data=F.struct(
        F.when(s % 3 == 0, "Pump.fun").when(s % 3 == 1, "BagsApp").otherwise("x").alias("launchpad"), F.when(s % 2 == 0, "Burned").otherwise("no").alias("burn_status"),
        F.when(s <= 10, s / 10.0).otherwise(s.cast("double")).alias("top10_holder_rate"))).alias("raw"))
    return bronze.token_profiles(raw).select("mint", "launchpad", "lp_burned", "top10_pct")


def raw_info(t):
    s, key = F.col("p_size"), F.col("p_partkey").cast("string")
    acct = lambda p: F.rpad(F.concat(F.lit(p), key), 32, "x")
    pool = lambda i, liq: F.struct(acct(f"pool{i}").alias("poolId"), acct("curve").alias("bondingCurve"), F.lit("short").alias("lpMint"),
                                   F.when(s % 4 == 0, F.lit(0.0)).otherwise(s * 10.0).alias("tokenSupply"), F.struct(liq.alias("usd")).alias("liquidity"),
                                   F.struct(F.col("p_retailprice").alias("usd")).alias("marketCap"), F.struct((F.col("p_retailprice") / (i + 1)).alias("usd")).alias("price"),
                                   F.struct((s + i).cast("long").alias("total")).alias("txns"))
    token = F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("symbol"), F.when(s % 2 == 0, F.concat(F.lit("https://"), key, F.lit(".example"))).alias("website"),
                     F.struct(F.when(s % 3 == 0, F.lit("https://x.com/abc")).alias("twitter")).alias("socials"), F.struct(F.lit("ext text").alias("description")).alias("extensions"),
                     F.struct(F.when(s % 5 != 0, acct("creator")).otherwise(F.lit(bronze.PLACEHOLDER_CREATOR)).alias("creator"), (F.lit(1_700_000_000_000) + s).alias("created_time")).alias("creation"))
    return t.raw("part").select(key.alias("mint"), js(token=token, holders=s.cast("long"), pools=F.array(pool(0, s * 1.0), pool(1, F.lit(25.0)))).alias("raw"))


_acct = lambda p: f"rpad(concat('{p}', p_partkey), 32, 'x')"


@query("parse_pool_accounts", sql=f"SELECT CAST(p_partkey AS VARCHAR) AS mint, unnest([{_acct('pool0')}, {_acct('pool1')}, {_acct('curve')}]) AS account FROM part")
def _(t):
    return bronze.pool_accounts(raw_info(t))


@query("parse_supply_and_creation", sql=f"""SELECT CAST(p_partkey AS VARCHAR) AS mint, CASE WHEN p_size % 4 = 0 THEN 1e9 ELSE p_size * 10.0::DOUBLE END AS total_supply, CASE WHEN p_size % 5 <> 0 THEN {_acct('creator')} END AS creator, 1700000000 AS created_at FROM part""")
def _(t):
    return bronze.total_supply(raw_info(t)).join(bronze.creation(raw_info(t)), "mint")


@query("parse_market_state", sql="""SELECT CAST(p_partkey AS VARCHAR) AS mint, CAST(p_size AS BIGINT) AS holder_count, greatest(p_size, 25.0)::DOUBLE AS liquidity_usd, p_retailprice AS market_cap_usd,
  CASE WHEN p_size >= 25 THEN p_retailprice ELSE p_retailprice / 2 END AS price_usd, CAST(CASE WHEN p_size >= 25 THEN p_size ELSE p_size + 1 END AS BIGINT) AS txns_total FROM part""")
def _(t):
    return bronze.market_state(raw_info(t))


@query("token_metadata_gap_fill", sql="""SELECT CAST(p_partkey AS VARCHAR) AS mint, p_name AS name, 'ext text' AS description, CASE WHEN p_size % 2 = 0 THEN concat('https://', p_partkey, '.example') WHEN p_size % 3 <> 0 THEN 'https://second.example' END AS website,
  CASE WHEN p_size % 3 = 0 THEN 'https://x.com/abc' END AS twitter FROM part""")
def _(t):
    second = t.raw("part").select(F.col("p_partkey").cast("string").alias("mint"), F.lit("https://second.example").alias("website"), null("string").alias("twitter"), null("string").alias("telegram"))
    return bronze.token_meta(raw_info(t), second).select("mint", "name", "description", "website", "twitter")


@query("parse_mentions", sql="""SELECT event_type AS narrative_id, CAST(event_id AS VARCHAR) AS id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS posted_at, CAST(user_id AS VARCHAR) AS author FROM events""")
def _(t):
    raw = t.raw("events").select(F.col("event_type").alias("narrative_id"), js(id=F.col("event_id").cast("string"), text=F.col("props"), author=F.col("user_id").cast("string"),
                                 created_at=F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).alias("raw"))
    return bronze.mentions(raw).select("narrative_id", "id", "posted_at", "author")


cte("t_transfers", "SELECT signer AS wallet, concat('F', CAST(signer AS BIGINT) % 40) AS sender, ts, tx_signature AS tx, sol_amount AS sol FROM t_swaps")


def transfers(t):
    return t.swaps.select(F.col("signer").alias("wallet"), F.concat(F.lit("F"), (F.col("signer").cast("long") % 40).cast("string")).alias("sender"), "ts",
                          F.col("tx_signature").alias("tx"), F.col("sol_amount").alias("sol"))


@query("wallet_sol_inflows", "e", """SELECT token_mint, wallet, b.sender, b.ts, b.sol FROM (SELECT token_mint, t.wallet, arg_max({'sender': sender, 'ts': t.ts, 'sol': sol}, (sol, -t.ts, sender)) AS b
FROM t_transfers t JOIN (SELECT token_mint, wallet, bought_at AS launch_ts FROM t_buyers) l ON l.wallet = t.wallet AND t.ts BETWEEN launch_ts - 144 AND launch_ts WHERE sol > 0 GROUP BY 1, 2)""")
def _(t):
    return bronze.sol_inflows(transfers(t), t.buyers.select("token_mint", "wallet", F.col("bought_at").alias("launch_ts")), 144)


@query("first_funder_oldest5", sql="""SELECT wallet, CASE WHEN s IN ('F0', 'F7') THEN 'cex' ELSE s END AS funder, first_seen FROM (SELECT wallet, arg_min(sender, (ts, tx)) AS s, min(ts) AS first_seen FROM (
SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY ts, tx) AS rn FROM t_transfers) WHERE rn <= 5 GROUP BY 1)""")
def _(t):
    cex = t.spark.createDataFrame([("F0",), ("F7",)], "wallet string")
    return bronze.first_funder(transfers(t), cex)


@query("funding_two_hop", sql="""SELECT f.wallet, f.f AS funder, g.f AS funder2 FROM (SELECT wallet, CAST(CAST(wallet AS BIGINT) // 2 AS VARCHAR) AS f FROM t_funding) f LEFT JOIN (SELECT wallet, CAST(CAST(wallet AS BIGINT) // 2 AS VARCHAR) AS f, sig_count FROM t_funding) g ON g.wallet = f.f AND g.sig_count < 10""")
def _(t):
    f = t.funding.select("wallet", F.expr("cast(cast(wallet as bigint) div 2 as string)").alias("funder"), "sig_count")
    return bronze.two_hop(f)


@query("holder_owners", sql=f"""SELECT mint, owner, {dsum('amount')} AS amount FROM (SELECT token_mint AS mint, CAST(CAST(wallet AS BIGINT) % 700 AS VARCHAR) AS owner, amount FROM t_balances WHERE CAST(wallet AS BIGINT) % 17 <> 0) WHERE CAST(owner AS BIGINT) % 100 <> 0 GROUP BY 1, 2""")
def _(t):
    acc = t.balances.select(F.col("token_mint").alias("mint"), F.concat_ws(":", "token_mint", "wallet").alias("account"), "amount", F.col("wallet").cast("long").alias("w"))
    owners = acc.select("account", F.when(F.col("w") % 17 != 0, (F.col("w") % 700).cast("string")).alias("owner"))
    programs = t.cex_wallets.select(F.col("wallet").alias("address"))
    distinct = owners.select("owner").filter("owner IS NOT NULL").distinct()
    off = distinct.filter(~is_on_curve(F.col("owner")))
    return bronze.wallet_holders(acc.select("mint", "account", "amount"), owners, programs, off)


@query("created_at_precedence", sql="""SELECT token_mint, CASE WHEN c < b - 60 THEN c ELSE b END AS created_at, CASE WHEN c < b - 60 THEN 'first_trade' ELSE s END AS source FROM (SELECT token_mint, created_at AS c,
  CASE WHEN k % 3 = 0 THEN created_at + 10 WHEN k % 3 = 1 THEN created_at + 100 ELSE 5000 END AS b, CASE WHEN k % 3 = 0 THEN 'launch_feed' WHEN k % 3 = 1 THEN 'info' ELSE 'fallback_now' END AS s FROM (SELECT *, CAST(token_mint AS BIGINT) AS k FROM t_coins))""")
def _(t):
    k = F.col("token_mint").cast("long")
    tk = t.coins.select("token_mint", F.when(k % 3 == 0, F.col("created_at") + 10).alias("feed_ts"), F.when(k % 3 == 1, F.col("created_at") + 100).alias("info_ts"), F.lit(5000).cast("long").alias("now_ts"))
    return bronze.created_at(tk, t.coins.select("token_mint", F.col("created_at").alias("first_trade_ts")))


@query("platform_gates", sql="""SELECT platform, venue_ok, count(*) AS n FROM (SELECT CASE p_size % 3 WHEN 0 THEN 'mayhem' WHEN 1 THEN 'pump.fun' END AS platform, CASE WHEN p_type IN ('ECONOMY', 'PROMO') OR p_size % 7 = 0 THEN 1 ELSE 0 END AS venue_ok FROM part) GROUP BY 1, 2""")
def _(t):
    s = F.col("p_size")
    keys = F.when(s % 3 == 0, F.array(F.lit("mayhem_prog"), F.lit(PROGRAM))).when(s % 3 == 1, F.array(F.lit(PROGRAM))).otherwise(F.array(F.lit("zzz")))
    venue = F.when(s % 7 == 0, null("string")).otherwise(F.col("p_type"))
    p = t.raw("part").select(bronze.platform_of(keys, "mayhem_prog", PROGRAM).alias("platform"), bronze.allowed_venue(venue, ["economy", "promo"]).cast("int").alias("venue_ok"))
    return p.groupBy("platform", "venue_ok").agg(F.count("*").alias("n"))


@query("platform_reresolution", sql="""SELECT platform, count(*) AS n FROM (SELECT CASE WHEN k % 4 = 0 THEN CASE WHEN k % 8 = 0 THEN 'mayhem' WHEN 2600 - graduated_at > 2200 THEN 'unresolvable' ELSE 'unverified' END ELSE 'pump.fun' END AS platform FROM (SELECT *, CAST(token_mint AS BIGINT) AS k FROM t_coins)) GROUP BY 1""")
def _(t):
    k = F.col("token_mint").cast("long")
    tk = t.coins.select("token_mint", "graduated_at", F.when(k % 4 == 0, "unverified").otherwise("pump.fun").alias("platform"))
    res = t.coins.filter(k % 8 == 0).select("token_mint", F.lit("mayhem").alias("resolved"))
    return bronze.reresolve(tk, res, 2600, 2200).groupBy("platform").agg(F.count("*").alias("n"))


@query("missed_event_recovery", sql="""SELECT f.token_mint, graduated_at, 1 AS recovered, 'poll' AS detection_source FROM t_coins f JOIN t_first_prices p USING (token_mint, graduated_at) WHERE CAST(token_mint AS BIGINT) % 3 = 0 AND CAST(token_mint AS BIGINT) % 9 <> 0
AND 4000 - graduated_at <= 3600 AND first_ts - graduated_at BETWEEN 0 AND 120""")
def _(t):
    k = F.col("token_mint").cast("long")
    feed = t.coins.select("token_mint", F.col("graduated_at").alias("pool_created_at"))
    return bronze.missed_events(feed, t.coins.filter(k % 3 != 0), t.coins.filter(k % 9 == 0), t.first_prices.select("token_mint", "first_ts"), 4000)


cte("t_keys", """SELECT side, concat_ws('#', CASE WHEN ts % 5 <> 0 THEN concat_ws(':', tx_signature, signer) ELSE concat_ws(':', token_mint, signer, CAST(ts AS VARCHAR), side, printf('%.6f', sol_amount)) END, tx_signature) AS k FROM t_swaps""")


@query("idempotent_insert", sql="""SELECT 'sell' AS side, count(*) AS n FROM t_keys WHERE side = 'sell' UNION ALL SELECT 'buy', count(DISTINCT k) FROM t_keys WHERE side = 'buy' AND k NOT IN (SELECT k FROM t_keys WHERE side = 'sell')""")
def _(t):
    """The tape inserted over its own half: every key lands exactly once."""
    key = bronze.dedup_key(F.when(F.col("ts") % 5 != 0, F.col("tx_signature")), F.col("signer"), F.col("token_mint"), F.col("ts"), F.col("side"), F.col("sol_amount"))
    rows = t.swaps.withColumn("k", F.concat_ws("#", key, "tx_signature")).select("k", "side", "token_mint")
    stored = rows.filter("side = 'sell'")
    return stored.unionByName(sinks.insert_new(stored, rows.unionByName(rows), "k")).groupBy("side").agg(F.count("*").alias("n"))


@query("keyed_upsert_policies", sql="""SELECT wallet, funder, first_seen, CASE WHEN k % 2 = 0 THEN greatest(sig_count, 7) ELSE sig_count END AS sig_count FROM (SELECT *, CAST(wallet AS BIGINT) AS k FROM t_funding)""")
def _(t):
    k = F.col("wallet").cast("long")
    cols = ["wallet", "funder", "first_seen", "sig_count"]
    incoming = t.funding.filter(k % 2 == 0).select("wallet", F.lit("later").alias("funder"), null("bigint").alias("first_seen"), F.lit(7).cast("long").alias("sig_count"))
    return sinks.merge_rows(t.funding.select(*cols), incoming, ["wallet"], {"funder": "keep", "first_seen": "coalesce", "sig_count": "max"})


@query("gap_backfill_rows", sql="SELECT count(*) AS n, min(ts) AS lo FROM t_swaps WHERE ts > 1500")
def _(t):
    return sinks.gap_rows(t.swaps, t.swaps.filter("ts <= 1500"), "ts").agg(F.count("*").alias("n"), F.min("ts").alias("lo"))


@query("name_repair", sql="SELECT CAST(p_partkey AS VARCHAR) AS token_mint, p_name AS name, p_brand AS symbol FROM part")
def _(t):
    p = t.raw("part").select(F.col("p_partkey").cast("string").alias("token_mint"), F.col("p_name").alias("name"), F.col("p_brand").alias("symbol"), "p_size")
    broken = p.select("token_mint", F.when(F.col("p_size") % 3 == 0, "UNKNOWN").when(F.col("p_size") % 3 == 1, " ").otherwise(F.col("name")).alias("name"), F.when(F.col("p_size") % 2 == 0, F.col("symbol")).alias("symbol"))
    return sinks.repair_names(broken, p)


@query("request_accounting", sql="""SELECT CAST(ts AS DATE) AS day, event_type AS provider, '/tokens/{mint}/trades' AS endpoint, count(*) AS n FROM events GROUP BY 1, 2""")
def _(t):
    path = F.concat(F.lit("/tokens/"), F.rpad(F.concat(F.lit("Wa"), F.translate(F.col("user_id").cast("string"), "0", "A")), 40, "x"), F.lit("/trades"))
    return t.raw("events").groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("provider"), C.endpoint_template(path).alias("endpoint")).agg(F.count("*").alias("n"))


@query("exchange_registry", sql="SELECT count(*) AS cex_buys FROM t_buyers WHERE wallet IN (SELECT wallet FROM t_cex) OR wallet IN ('1', '2', '3')")
def _(t):
    ext = t.spark.createDataFrame([("1",), ("2",), ("3",), ("100",)], "wallet string")
    return t.buyers.join(t.cex_wallets.union(ext).distinct(), "wallet", "left_semi").agg(F.count("*").alias("cex_buys"))


# ── narratives ───────────────────────────────────────────────────────────────
NARRATIVES = [("click", ["ring", "bolt"]), ("view", ["widget", "gizmos"]), ("purchase", ["anvil"]), ("signup", ["gears", "plate"]), ("error", ["rods"])]
KEYWORDS = [(k, n) for n, ks in NARRATIVES for k in ks]
TAGS = [("ring", "shape"), ("bolt", "shape"), ("widget", "thing"), ("gizmo", "thing"), ("hot", "temp"), ("cold", "temp"), ("old", "age"), ("new", "age")]


@query("narrative_tags", sql="SELECT CAST(p_partkey AS VARCHAR) AS mint, array_to_string(list_distinct_ordered(1), ',') AS tags FROM part".replace("array_to_string(list_distinct_ordered(1), ',')", "concat_ws(',', " + ", ".join(
    f"CASE WHEN {' OR '.join(f'''contains(lower(p_name), '{k}')''' for k, g in TAGS if g == tag)} THEN '{tag}' END" for tag in ("shape", "thing", "temp", "age")) + ")"))
def _(t):
    return t.raw("part").select(F.col("p_partkey").cast("string").alias("mint"), F.array_join(C.narrative_tags(F.col("p_name"), TAGS), ",").alias("tags"))


def matches(t):
    """(mint, label): keyword inside a field, field inside a keyword, or edit distance of at most two."""
    fields = F.concat(F.array(F.lower("name"), F.lower("symbol")), F.split(F.lower("name"), " "))
    near = lambda k: F.exists(fields, lambda f: f.contains(k) | F.lit(k).contains(f) | ((F.length(f) >= 4) & F.lit(len(k) >= 4) & (F.levenshtein(f, F.lit(k)) <= 2)))
    hits = F.array_distinct(F.array_compact(F.array(*[F.when(near(k), n) for k, n in KEYWORDS])))
    return t.tokens.select("token_mint", "created_at", F.explode(hits).alias("label"))


_kw = ", ".join(f"('{k}', '{n}')" for k, n in KEYWORDS)
cte("t_match_n", f"""SELECT DISTINCT token_mint, created_at, label FROM (SELECT token_mint, created_at, unnest(list_concat([lower(name), lower(symbol)], string_split(lower(name), ' '))) AS f FROM t_tokens)
CROSS JOIN (VALUES {_kw}) k(kw, label) WHERE contains(f, kw) OR contains(kw, f) OR (length(f) >= 4 AND length(kw) >= 4 AND levenshtein(f, kw) <= 2)""")


@query("narrative_match", sql="SELECT token_mint, label FROM t_match_n")
def _(t):
    return matches(t).select("token_mint", "label")


cte("t_ment", "SELECT event_type AS label, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 600000000 AS ts FROM events")


@query("narrative_velocity_at_entry", "e", """SELECT m.token_mint, m.label, count(n.ts) AS mentions FROM t_match_n m LEFT JOIN t_ment n ON n.label = m.label AND n.ts >= m.created_at - 6 AND n.ts < m.created_at GROUP BY 1, 2""")
def _(t):
    sec = F.expr("(unix_micros(cast(ts as timestamp)) - unix_micros(cast(timestamp_ntz'2024-01-01 00:00:00' as timestamp))) div 600000000")
    per = t.raw("events").groupBy(F.col("event_type").alias("label"), sec.alias("ts")).agg(F.count("*").alias("n"))
    m = matches(t).withColumn("ts", F.explode(F.sequence(F.col("created_at") - 6, F.col("created_at") - 1)))
    return m.join(per, ["label", "ts"], "left").groupBy("token_mint", "label").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("mentions"))


@query("narrative_rolling_status", sql="""SELECT label, ts, velocity, CASE WHEN velocity >= 50 THEN 'hot' WHEN velocity >= 5 THEN 'emerging' WHEN peak > 0 THEN 'fading' ELSE 'dead' END AS status FROM (
SELECT label, ts, velocity, max(velocity) OVER (PARTITION BY label ORDER BY ts) AS peak FROM (SELECT label, ts, CAST(sum(n) OVER (PARTITION BY label ORDER BY ts RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS BIGINT) AS velocity FROM (SELECT label, ts, count(*) AS n FROM t_ment GROUP BY 1, 2)))""")
def _(t):
    from pyspark.sql import Window

    sec = F.expr("(unix_micros(cast(ts as timestamp)) - unix_micros(cast(timestamp_ntz'2024-01-01 00:00:00' as timestamp))) div 600000000")
    per = t.raw("events").groupBy(F.col("event_type").alias("label"), sec.alias("ts")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("label").orderBy("ts")
    v = per.withColumn("velocity", F.sum("n").over(w.rangeBetween(-5, 0)))
    return v.withColumn("peak", F.max("velocity").over(w)).select("label", "ts", "velocity", C.narrative_status("velocity", "peak").alias("status"))


@query("project_class", sql="""SELECT k, count(*) AS n FROM (SELECT CASE WHEN meme = 0 AND ((site AND (product >= 1 OR strong)) OR (strong AND product >= 2)) THEN 'project' WHEN NOT site AND NOT strong AND product = 0 THEN 'meme' ELSE 'ambiguous' END AS k FROM (
SELECT """ + " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in C.PRODUCT_WORDS) + " AS product, " + " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in C.MEME_WORDS) + """ AS meme, length(trim(text)) >= 80 AS strong, doc_id % 2 = 0 AS site FROM documents)) GROUP BY 1""")
def _(t):
    url = F.when(F.col("doc_id") % 2 == 0, "https://site.example").otherwise("https://t.me/x")
    return t.raw("documents").select(C.project_class(F.col("text"), F.col("text"), url).alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query("page_domains", sql="""SELECT regexp_replace(lower(regexp_extract(trim(url), '^(?:[A-Za-z]+://)?([^/:?#\\s]+\\.[^/:?#\\s]+)', 1)), '^www\\.', '') AS domain, count(*) AS n FROM pages GROUP BY 1""")
def _(t):
    return t.raw("pages").groupBy(bronze.domain_of(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


@query("page_social_capture", sql="""SELECT page_id, regexp_replace(lower(regexp_extract(trim(url), '^(?:[A-Za-z]+://)?([^/:?#\\s]+\\.[^/:?#\\s]+)', 1)), '^www\\.', '') AS domain,
  regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, 'href="')) AS n_links,
  CAST(nullif(regexp_replace(regexp_extract(html, '(?i)([0-9, ]+)[ ]+(?:subscriber|member)', 1), '[^0-9]', '', 'g'), '') AS BIGINT) AS members,
  regexp_matches(html, '(?i)https?://(?:x|twitter)[.]com/') AS has_account, regexp_matches(html, '(?i)(?:t|telegram)[.]me/') AS has_channel FROM pages""")
def _(t):
    """What a landed page tells about a project: host, title, links, member count and presence flags."""
    h = F.col("html")
    return t.raw("pages").select(
        "page_id", bronze.domain_of(F.col("url")).alias("domain"), F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_count(h, F.lit('href="')).cast("long").alias("n_links"), bronze.member_count(h).alias("members"),
        h.rlike("(?i)https?://(?:x|twitter)[.]com/").alias("has_account"), h.rlike("(?i)(?:t|telegram)[.]me/").alias("has_channel"))


@query("summary_metadata", sql="""SELECT token_mint, confidence, round(greatest(0.5, least(5.0, 3.0 + green * 0.5 - red)), 1)::DOUBLE AS position_pct FROM (
SELECT *, CASE WHEN red = 0 AND green >= 2 THEN 'high' WHEN green = 0 AND red <> 1 THEN 'low' ELSE 'med' END AS confidence FROM (
SELECT c.token_mint, (CASE WHEN member_count >= 3 THEN 1 ELSE 0 END) + (CASE WHEN bundle_pct > 15 THEN 1 ELSE 0 END) + (CASE WHEN creator_n > 0 THEN 1 ELSE 0 END) AS red,
  (CASE WHEN smart_money_count >= 2 THEN 1 ELSE 0 END) + (CASE WHEN m.token_mint IS NOT NULL THEN 1 ELSE 0 END) AS green
FROM t_ctx c LEFT JOIN t_team_clusters t USING (token_mint) LEFT JOIN t_bundle_pct b USING (token_mint) LEFT JOIN (SELECT DISTINCT token_mint FROM t_match_n) m USING (token_mint)))""")
def _(t):
    """The landed tables hold no social accounts, so the verified-account sign is never set here."""
    from tapelens.operators import patterns, team
    from tapelens.plans.memory import context
    from tapelens.plans.teams import fc

    bp = team.bundle_pct(team.cluster_summary(fc(t)), t.buyers)
    m = matches(t).select("token_mint", F.lit(1).alias("nm")).distinct()
    j = context(t).select("token_mint", "team_size", "smart_money_count", "creator_n").join(bp, "token_mint", "left").join(m, "token_mint", "left")
    return patterns.summary_metadata(
        j, red=[F.col("team_size") >= 3, F.col("bundle_pct") > 15, F.col("creator_n") > 0],
        green=[F.col("smart_money_count") >= 2, F.col("nm") == 1, patterns.verified_account(F.lit(False), F.lit(0))])


@query("fact_sheet_text", sql="SELECT token_mint, concat('buyers=', n_buyers, ' sellers=', n_sellers, ' trades=', n_trades) AS facts FROM t_flow")
def _(t):
    return flow.bc_flow(t.bc).select("token_mint", F.format_string("buyers=%d sellers=%d trades=%d", "n_buyers", "n_sellers", "n_trades").alias("facts"))


@query("training_export", sql="""SELECT c.token_mint, team_size, funder_rug_rate, n_buyers, gini_buy_size, bundled.v AS max_cluster_pct, o.label_1h, o.label_4h, o.label_24h, time_to_team_exit_s AS label_exit_s FROM t_ctx c LEFT JOIN t_flow f USING (token_mint)
LEFT JOIN (SELECT token_mint, bundle_pct AS v FROM t_bundle_pct) bundled USING (token_mint) LEFT JOIN t_traj USING (token_mint) LEFT JOIN (SELECT token_mint, max(CASE WHEN check_offset_h = 1 THEN classified END) AS label_1h, max(CASE WHEN check_offset_h = 4 THEN classified END) AS label_4h,
 max(CASE WHEN check_offset_h = 24 THEN classified END) AS label_24h FROM t_outcomes GROUP BY 1) o USING (token_mint)""")
def _(t):
    from tapelens.operators import team
    from tapelens.plans.memory import context
    from tapelens.plans.teams import fc

    lab = t.outcomes.groupBy("token_mint").pivot("check_offset_h", [1, 4, 24]).agg(F.first("classified"))
    lab = lab.select("token_mint", *[F.col(str(h)).alias(f"label_{h}h") for h in (1, 4, 24)])
    bp = team.bundle_pct(team.cluster_summary(fc(t)), t.buyers).withColumnRenamed("bundle_pct", "max_cluster_pct")
    j = context(t).select("token_mint", "team_size", "funder_rug_rate")
    for s in (flow.bc_flow(t.bc).select("token_mint", "n_buyers", "gini_buy_size"), bp, lab, t.trajectory.select("token_mint", F.col("time_to_team_exit_s").alias("label_exit_s"))):
        j = j.join(s, "token_mint", "left")
    return j


_label_sql = ", ".join(f"max(classified) FILTER (check_offset_h = {h}) AS label_outcome_{h}h, max(price_change_pct) FILTER (check_offset_h = {h}) AS label_change_pct_{h}h" for h in (1, 4, 24))
_signal_sql = ", ".join(f"max(signal) FILTER (check_offset_h = {h}) AS label_dist_signal_{h}h, max(team_sold_pct) FILTER (check_offset_h = {h}) AS label_team_sold_pct_{h}h" for h in (1, 4, 24))


@query("training_export_written", sql=f"""SELECT x.*, f.* EXCLUDE (token_mint), ch.n_sellers AS label_team_sellers, o.* EXCLUDE (token_mint), b.* EXCLUDE (token_mint) FROM t_ctx x LEFT JOIN t_flow f USING (token_mint)
LEFT JOIN t_choreo_sum ch USING (token_mint) LEFT JOIN (SELECT token_mint, {_label_sql} FROM t_outcomes GROUP BY 1) o USING (token_mint) LEFT JOIN (SELECT token_mint, {_signal_sql} FROM t_behavior GROUP BY 1) b USING (token_mint)""")
def _(t):
    """Snapshot, curve flow and pivoted labels of every coin, written as CSV parts and read back."""
    from tapelens.plans.memory import behavior, context
    from tapelens.session import shared_path

    at = lambda h, c: F.max(F.when(F.col("check_offset_h") == h, F.col(c)))
    o = t.outcomes.groupBy("token_mint").agg(*[at(h, c).alias(f"label_{n}_{h}h") for h in (1, 4, 24) for c, n in (("classified", "outcome"), ("price_change_pct", "change_pct"))])
    b = behavior(t).groupBy("token_mint").agg(*[at(h, c).alias(f"label_{n}_{h}h") for h in (1, 4, 24) for c, n in (("signal", "dist_signal"), ("team_sold_pct", "team_sold_pct"))])
    ch = flow.choreography_summary(flow.exit_choreography(t.post, t.team)).select("token_mint", F.col("n_sellers").alias("label_team_sellers"))
    rows, own = context(t), set(context(t).columns)
    f = flow.bc_flow(t.bc)
    for side in (f.select("token_mint", *[c for c in f.columns if c not in own]), ch, o, b):
        rows = rows.join(side, "token_mint", "left")
    path = shared_path(t.spark, "training-export")
    sinks.export_csv(rows, path)
    return t.spark.read.schema(rows.schema).option("header", True).csv(path)


@query("rebuild_changed_keys", sql="SELECT token_mint, wallet, amount FROM t_balances")
def _(t):
    """Balances stored from a tape with a gap, then rebuilt for the coins whose trades the gap had held back."""
    from tapelens.session import shared_path
    from tapelens.sources.tables import exact_sum

    signed = F.when(F.col("side") == "buy", F.col("token_amount")).otherwise(-F.col("token_amount"))
    build = lambda tape: tape.groupBy("token_mint", F.col("signer").alias("wallet")).agg(exact_sum(signed).alias("amount")).filter("amount > 0")
    held_back = (F.col("ts") - F.col("created_at") > 100) & (F.col("token_mint").cast("long") % 4 == 0)
    path = shared_path(t.spark, "keyed-balances")
    sinks.write_keyed(build(t.bc.filter(~held_back)), path, "token_mint")
    sinks.recompute_changed(path, "token_mint", t.bc.filter(held_back), lambda keys: build(t.bc.join(keys, "token_mint", "left_semi")))
    return t.spark.read.parquet(path).drop("bucket")
