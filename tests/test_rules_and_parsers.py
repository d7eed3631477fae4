"""Verdict contract, gates, metrics, parsers and sinks on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from tapelens.functions import columns as C
from tapelens.functions.address import on_curve
from tapelens.operators import evaluation as ev
from tapelens.operators import memory, verdict
from tapelens.sources import bronze, sinks


def judge(spark, **ctx):
    cols = [F.lit(v).alias(k) for k, v in ctx.items()] or [F.lit(1).alias("x")]
    r = verdict.structural_verdict(spark.range(1).select(*cols)).first()
    return r.verdict, r.confidence


@pytest.mark.parametrize("ctx, want", [
    ({"funder_n": 8, "funder_rug_rate": 0.65}, ("SKIP", 0.90)),
    ({"signal": "DUMPED"}, ("SKIP", 0.95)),
    ({"team_supply_pct": 50.0, "team_is_bc_sniper": 1}, ("SKIP", 0.80)),
    ({"top_holder_pct": 51.0}, ("SKIP", 0.92)),
    ({"top_holder_pct": 51.0, "bc_duration_seconds": 900}, ("SKIP", 0.70)),
    ({"top3_holder_pct": 76.0}, ("SKIP", 0.90)),
    ({"graph_rug_hits": 1}, ("SKIP", 0.85)),
    ({"smart_money_count": 2, "bc_duration_seconds": 900}, ("STRUCTURALLY_SOUND", 0.70)),
    ({"smart_money_count": 2, "team_supply_pct": 5.0, "proven_wallet_count": 2, "signal": "DISTRIBUTING"}, ("WATCH", 0.50)),
    ({"launches_24h": 3}, ("SKIP", 0.60)),
    ({}, ("WATCH", 0.50)),
])
def test_verdict_contract(spark, ctx, want):
    v, c = judge(spark, **ctx)
    assert v == want[0] and c == pytest.approx(want[1])


@pytest.mark.parametrize("row, want", [
    ((1.0, 0, None, None), True), ((0.5, 0, None, None), False), ((0.5, 1, None, None), True), ((0.5, 0, None, 3), True),
    ((0.0, 1, "creator_linked", None), False), ((0.3, 0, "creator_linked", None), True), ((0.3, 1, "shared_funder", 0), False)])
def test_member_gate(spark, row, want):
    df = spark.createDataFrame([row], "o double, e int, f string, s int")
    assert df.select(C.member_gate("o", "e", "f", "s").alias("g")).first().g is want


@pytest.mark.parametrize("h, s, want", [(4, 50.0, "DUMPED"), (9, 30.0, "DISTRIBUTING"), (9, -10.0, "ACCUMULATING"), (9, 29.9, "HOLDING"), (9, None, "HOLDING")])
def test_signal(spark, h, s, want):
    df = spark.createDataFrame([(h, s)], "h int, s double")
    assert df.select(C.distribution_signal("h", "s").alias("x")).first().x == want


def test_manufactured_needs_two_flags(spark):
    df = spark.createDataFrame([(100, 30, .1, 1., 1), (100, 10, .1, 1., 1), (None, 10, .1, 1., 1)], "d int, b int, t double, s double, g int")
    assert [r.n for r in df.select(F.size(C.manufactured_flags("d", "b", "t", "s", "g")).alias("n")).collect()] == [1, 2, 1]


def test_metrics_with_ties(spark):
    df = spark.createDataFrame([(.5, 1), (.5, 0), (.9, 1), (.1, 0)], "s double, y int")
    assert ev.roc_auc(df, [], "s", "y").first().auc == 0.875
    assert ev.average_precision(df, [], "s", "y").first().ap == pytest.approx(1 * .5 + 2 / 3 * .5)
    last = ev.calibration_bins(spark.createDataFrame([(1.0, 1)], "s double, y int"), [], "s", "y").first()
    assert last.bin == 9


def test_prior_median(spark):
    rows = [("f", 1, 10.0), ("f", 2, 1.0), ("f", 3, 30.0), ("f", 4, 2.0), ("f", 5, 0.0)]
    df = spark.createDataFrame(rows, "k string, t long, v double").withColumn("b", F.lit(6.0))
    got = {r.t: (r.n_prior, r.at_least) for r in ev.prior_median_at_least(df, "k", "t", "v", "b").collect()}
    assert got[2] == (1, True) and got[3] == (2, False) and got[4] == (3, True) and got[5] == (4, True)


def team_tables(spark, coins):
    """coins: mint -> (anchor, wallets, class)."""
    team = spark.createDataFrame([(m, w) for m, (_, ws, _) in coins.items() for w in ws], "token_mint string, wallet string")
    out = spark.createDataFrame([(m, c) for m, (_, _, c) in coins.items() if c], "token_mint string, classified string")
    return memory.team_memberships(team, out, spark.createDataFrame([(m, at) for m, (at, *_) in coins.items()], "token_mint string, graduated_at long"))


def test_graph_hits_count_resolved_teams_only(spark):
    coins = {"a": (0, "xy", "rug"), "b": (10, "xz", "rug"), "c": (100, "xy", "ok"), "d": (104, "xy", None), "e": (300, "xyz", "rug"), "f": (5, "x", "rug")}
    got = {(r.token_mint, r.connected): (r.rug_hits, r.soft_hits) for r in memory.graph_hit_counts(team_tables(spark, coins), 50).collect()}
    # f has one wallet and is no team; c and d see a and b; e sees a, b and c
    assert got == {("c", "x"): (1, 0), ("d", "x"): (1, 0), ("e", "x"): (1, 0), ("e", "y"): (0, 1)}


def test_later_coins_change_no_earlier_row(spark):
    """Every point-in-time table is the same for old coins whether or not later ones exist."""
    coins = {f"c{i}": (i * 40, "xyz"[: 1 + i % 3] + "w", ["rug", "moon", "ok"][i % 3]) for i in range(12)}
    early = {m: v for m, v in coins.items() if v[0] <= 240}
    resolve = 50

    def frames(chosen):
        at = spark.createDataFrame([(m, v[0]) for m, v in chosen.items()], "token_mint string, graduated_at long")
        own = at.withColumn("funder", F.when(F.col("graduated_at") % 80 == 0, "F1").otherwise("F2"))
        graded = own.join(spark.createDataFrame([(m, v[2]) for m, v in chosen.items()], "token_mint string, classified string"), "token_mint")
        teams = team_tables(spark, chosen)
        wallets = teams.select("token_mint", "wallet", "graduated_at")
        calls = teams.select("wallet", "graduated_at", "classified")
        buys = wallets.select("wallet", (F.col("graduated_at") - 5).alias("ts"))
        clusters = graded.select("token_mint", F.lit(3).alias("member_count"), (F.col("graduated_at") % 7).cast("double").alias("supply_pct"),
                                 F.lit(1).alias("is_bc_sniper"), F.lit(2.0).alias("first_buy_offset_s"))
        summary = own.select("token_mint", "funder", "graduated_at", F.lit(3).alias("n_sellers"), F.concat(F.lit("L"), F.col("graduated_at") % 3).alias("leader_wallet"))
        prints = memory.fingerprints_by_epoch(clusters, own.select("token_mint", "funder"), graded, at, resolve, 60)
        return [memory.reputation_as_of(own, graded, "funder", resolve), memory.graph_hit_counts(teams, resolve),
                memory.smart_scores_as_of(wallets, calls, buys, buys.withColumn("n", F.lit(2)), resolve, 30),
                memory.choreography_as_of(own, summary, resolve), prints.filter("epoch <= 4").withColumnRenamed("funder", "token_mint")]

    for before, after in zip(frames(early), frames(coins)):
        keep = [r for r in map(tuple, after.collect()) if r[0] in early or r[0] in ("F1", "F2")]
        assert sorted(map(str, keep)) == sorted(map(str, map(tuple, before.collect()))) and keep


@pytest.mark.parametrize("red,green,want", [(0, 2, "high"), (0, 1, "med"), (0, 0, "low"), (1, 0, "med"), (2, 0, "low"), (2, 1, "med"), (3, 0, "low")])
def test_summary_confidence(spark, red, green, want):
    from tapelens.operators.patterns import summary_metadata

    signs = lambda n: [F.lit(i < n) for i in range(3)]
    assert summary_metadata(spark.createDataFrame([("m",)], "token_mint string"), signs(red), signs(green)).first().confidence == want


def test_parsers_treat_blanks_as_missing(spark):
    df = spark.createDataFrame([(json.dumps(x),) for x in (
        {"mint": "m", "name": "", "creator": "", "traderPublicKey": "c", "usd_market_cap": 0, "marketCapSol": 2, "created_timestamp": 0, "timestamp": 7, "metadata": {"name": "n", "telegram": "tg"}},)], "raw string")
    r = bronze.listings(df).first()
    assert (r.name, r.creator, r.created_at, r.telegram, r.market_cap_usd > 0) == ("n", "c", 7, "tg", True)
    trades = spark.createDataFrame([(json.dumps(x),) for x in (
        {"mint": "m", "user": "u", "is_buy": True, "sol_amount": 1e9, "tokenAmount": 5, "token_amount": 9, "timestamp": 1}, {"mint": "m", "is_buy": True, "timestamp": 1})], "raw string")
    assert [(r.signer, r.token_amount) for r in bronze.launch_trades(trades).collect()] == [("u", 5.0)]
    hosts = spark.createDataFrame([("https://www.A.com/x",), ("b.org/y",), ("plain",)], "u string").select(bronze.domain_of(F.col("u")).alias("d"))
    assert [r.d for r in hosts.collect()] == ["a.com", "b.org", ""]
    names = spark.createDataFrame([("https://t.me/s/abc_d?x=1",), ("@@abcd",), ("https://x.com/abcd",), ("t.me/",)], "u string").select(bronze.channel_name(F.col("u")).alias("d"))
    assert [r.d for r in names.collect()] == ["abc_d", "abcd", None, None]
    dates = spark.createDataFrame([("Creation Date: 2020-01-31T00",), ("registered on 31.01.2020",), ("none",)], "u string").select(bronze.registered_on(F.col("u")).alias("d"))
    assert [str(r.d) for r in dates.collect()] == ["2020-01-31", "2020-01-31", "None"]


def test_upsert_never_mixes_tied_rows(spark):
    old = spark.createDataFrame([("z", 0, "o")], "k string, n int, s string")
    new = spark.createDataFrame([("a", 1, "y"), ("a", 2, "x")], "k string, n int, s string")
    assert [tuple(r) for r in sinks.merge_rows(old, new, ["k"], {}).filter("k = 'a'").collect()] == [("a", 2, "x")]


def test_transaction_parser(spark):
    tx = {"type": "UNKNOWN", "source": "X", "feePayer": "me", "signature": "s", "slot": 9, "timestamp": 5,
          "tokenTransfers": [{"fromUserAccount": "a", "toUserAccount": "b", "tokenAmount": 1, "mint": "m"}, {"fromUserAccount": "me", "toUserAccount": "p", "tokenAmount": 5000, "decimals": 3, "mint": "m"}],
          "nativeTransfers": [{"fromUserAccount": "p", "toUserAccount": "me", "amount": 2_000_000_000}, {"fromUserAccount": "me", "toUserAccount": "z", "amount": 7}],
          "instructions": [{"programId": "o", "innerInstructions": [{"programId": "PROG"}]}]}
    df = spark.createDataFrame([(json.dumps(tx),), (json.dumps({**tx, "instructions": []}),), ("not json",)], "raw string")
    rows = bronze.swaps_from_transactions(df, ["PROG"]).collect()
    assert [(r.side, r.sol_amount, r.token_amount, r.slot) for r in rows] == [("sell", 2.0, 5.0, 9)]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", None, "y")], "k string, n int, s string")
    new = spark.createDataFrame([("a", None, "z"), ("c", 3, "w")], "k string, n int, s string")
    once = sinks.merge_rows(old, new, ["k"], {"n": "coalesce", "s": "keep"})
    assert sorted(map(tuple, once.collect())) == [("a", 1, "x"), ("b", None, "y"), ("c", 3, "w")]
    assert sorted(map(tuple, sinks.merge_rows(once, new, ["k"], {"n": "coalesce", "s": "keep"}).collect())) == sorted(map(tuple, once.collect()))


def test_curve_predicate():
    assert on_curve("not-an-address!") and on_curve("abc")
    assert on_curve("11111111111111111111111111111111") in (True, False)
    assert on_curve("So11111111111111111111111111111111111111112") in (True, False)
