"""Canonical tables derived from the landed star-schema and event tables.

`Tables(spark, folder, tape)` exposes each canonical table as a lazily built
DataFrame. Two tapes exist: ``t`` (line items; one day is one tape second) and ``e``
(the event log; ten minutes are one tape second). Every table is a plain projection,
aggregation or join, so Catalyst prunes columns and pushes filters to the scans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapelens.session import ensure_checkpoint_dir

ANCHOR_DELAY = {"t": 200, "e": 500}
HOUR_S = 100          # tape seconds that stand for one hour of outcome checks
TOP_HOLDERS = 20
MONEY = "decimal(28,9)"


def exact_sum(col, digits: int | None = None) -> F.Column:
    """Order-independent sum of a double column (decimal inside, rounded there, double outside)."""
    c = F.col(col) if isinstance(col, str) else col
    total = F.sum(c.cast(MONEY))
    return (total if digits is None else F.round(total, digits)).cast("double")


_WRITTEN: set[str] = set()


class Stored:
    """A canonical table written once per application to the shared folder, then read back.

    Every query of a run shares the written table instead of deriving it again, readers
    see real file sizes (so only small sides are broadcast), and a lost executor costs
    one re-read rather than the whole lineage.
    """

    def __init__(self, fn: Callable, partition_by: str | None = None):
        self.fn, self.partition_by, self.__doc__ = fn, partition_by, fn.__doc__

    def __set_name__(self, owner, name):
        self.name = name

    def __get__(self, obj, owner=None):
        if obj is None:
            return self
        df = obj.store(self.name, lambda: self.fn(obj), self.partition_by)
        obj.__dict__[self.name] = df
        return df


def stored(fn=None, *, partition_by: str | None = None):
    return Stored(fn, partition_by) if fn else (lambda f: Stored(f, partition_by))


class Tables:
    def store(self, name: str, make: Callable[[], DataFrame], partition_by: str | None = None) -> DataFrame:
        base = ensure_checkpoint_dir(self.spark)
        app = self.spark.sparkContext.applicationId
        source = hashlib.md5(self.folder.encode()).hexdigest()[:12]
        path = f"{base}/tables/{app}/{source}/{self.tape}/{name}"
        if path not in _WRITTEN:
            writer = make().write.mode("overwrite")
            (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
            _WRITTEN.add(path)
        return self.spark.read.parquet(path)

    def __init__(self, spark: SparkSession, folder: str, tape: str = "t"):
        self.spark, self.folder, self.tape = spark, folder, tape

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # ── facts ────────────────────────────────────────────────────────────────
    @cached_property
    def swaps(self) -> DataFrame:
        return self._swaps_e() if self.tape == "e" else self._swaps_t()

    def _swaps_t(self) -> DataFrame:
        li = self.raw("lineitem").select(
            "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_returnflag", "l_shipdate")
        orders = self.raw("orders").select("o_orderkey", "o_custkey")
        day = F.datediff(F.col("l_shipdate"), F.lit("1995-01-01").cast("date")).cast("long")
        return (
            li.join(orders, li.l_orderkey == orders.o_orderkey)
            .select(
                F.col("l_partkey").cast("string").alias("token_mint"),
                F.col("o_custkey").cast("string").alias("signer"),
                F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
                (F.col("l_extendedprice") / 1000).alias("sol_amount"),
                F.col("l_quantity").alias("token_amount"),
                day.alias("ts"),
                day.alias("slot"),
                F.concat_ws("-", "l_orderkey", "l_linenumber").alias("tx_signature"),
            )
            .withColumn("price_usd", F.col("sol_amount") / F.col("token_amount"))
        )

    def _swaps_e(self) -> DataFrame:
        micros = F.expr(
            "unix_micros(cast(ts as timestamp))"
            " - unix_micros(cast(timestamp_ntz'2024-01-01 00:00:00' as timestamp))")
        second = F.expr("__us div 600000000")
        return (
            self.raw("events")
            .filter(F.col("event_type").isin("error", "purchase", "signup"))
            .withColumn("__us", micros)
            .select(
                F.get_json_object("props", "$.k").alias("token_mint"),
                F.col("user_id").cast("string").alias("signer"),
                F.when(F.col("event_type") == "error", "sell").otherwise("buy").alias("side"),
                F.col("value").alias("sol_amount"),
                (F.col("event_id") % 97 + 1).cast("double").alias("token_amount"),
                second.cast("long").alias("ts"),
                second.cast("long").alias("slot"),
                F.col("event_id").cast("string").alias("tx_signature"),
            )
            .withColumn("price_usd", F.col("sol_amount") / F.col("token_amount"))
        )

    # ── anchor and phases ────────────────────────────────────────────────────
    @stored
    def coins(self) -> DataFrame:
        return self.swaps.groupBy("token_mint").agg(
            F.min("ts").alias("created_at"),
            (F.min("ts") + ANCHOR_DELAY[self.tape]).alias("graduated_at"))

    @stored(partition_by="phase")
    def phase_rows(self) -> DataFrame:
        """Every swap with its coin's anchor; one equi join, skew split by AQE. Prices are left to the reader."""
        phase = F.when(F.col("ts") < F.col("graduated_at"), "bc").otherwise("post")
        return self.swaps.drop("price_usd", "slot").join(self.coins, "token_mint").withColumn("phase", phase)

    @cached_property
    def phased(self) -> DataFrame:
        """`phase_rows` with the columns that follow from others: the slot of both tapes is the second."""
        return self.phase_rows.select(
            "token_mint", "signer", "side", "sol_amount", "token_amount", "ts", F.col("ts").alias("slot"), "tx_signature",
            (F.col("sol_amount") / F.col("token_amount")).alias("price_usd"), "created_at", "graduated_at", "phase")

    @cached_property
    def bc(self) -> DataFrame:
        return self.phased.filter("phase = 'bc'").drop("phase")

    @cached_property
    def post(self) -> DataFrame:
        return self.phased.filter("phase = 'post'").drop("phase")

    @cached_property
    def all_trades(self) -> DataFrame:
        """(wallet, ts) of every swap: the stored ones, and those without a coin, which have no phase."""
        pick = lambda df: df.select(F.col("signer").alias("wallet"), "ts")
        return pick(self.phased).unionByName(pick(self.swaps.filter("token_mint IS NULL")))

    # ── holders and team ─────────────────────────────────────────────────────
    @stored
    def balances(self) -> DataFrame:
        signed = F.when(F.col("side") == "buy", F.col("token_amount")).otherwise(-F.col("token_amount"))
        return (
            self.bc.groupBy("token_mint", F.col("signer").alias("wallet"))
            .agg(exact_sum(signed).alias("amount"))
            .filter("amount > 0")
        )

    @cached_property
    def supply(self) -> DataFrame:
        return self.balances.groupBy("token_mint").agg(exact_sum("amount").alias("total_supply"))

    @stored
    def holders(self) -> DataFrame:
        """Top holders per coin with their share; the rank filter limits before the shuffle."""
        w = Window.partitionBy("token_mint").orderBy(F.desc("amount"), F.asc("wallet"))
        return (
            self.balances.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= TOP_HOLDERS)
            .join(self.supply, "token_mint")
            .withColumn("pct", F.round(F.col("amount") / F.col("total_supply") * 100, 2))
        )

    @stored
    def held(self) -> DataFrame:
        """All holders with their share; the rank is known for the listed ones only."""
        ranks = self.holders.select("token_mint", "wallet", "rank")
        pct = F.round(F.col("amount") / F.col("total_supply") * 100, 2)
        return self.balances.join(self.supply, "token_mint").join(ranks, ["token_mint", "wallet"], "left").select(
            "token_mint", "wallet", "amount", pct.alias("pct"), "rank")

    @stored
    def buyers(self) -> DataFrame:
        return (
            self.bc.filter("side = 'buy'")
            .groupBy("token_mint", F.col("signer").alias("wallet"))
            .agg(F.min("ts").alias("bought_at"), exact_sum("sol_amount").alias("sol_amount"),
                 exact_sum("token_amount").alias("tokens_received"))
        )

    @stored
    def team(self) -> DataFrame:
        """Gate without optional evidence: every holder that also bought before the anchor."""
        return self.held.select("token_mint", "wallet", "pct", "amount").join(
            self.buyers.select("token_mint", "wallet", "bought_at"), ["token_mint", "wallet"], "left_semi")

    @stored
    def team_clusters(self) -> DataFrame:
        firsts = self.buyers.groupBy("token_mint").agg(F.min("bought_at").alias("launch_ts"))
        members = self.team.join(self.buyers.select("token_mint", "wallet", "bought_at"), ["token_mint", "wallet"])
        return (
            members.groupBy("token_mint")
            .agg(F.count("*").alias("member_count"), exact_sum("pct").alias("supply_pct"),
                 F.min("bought_at").alias("first_team_buy"))
            .join(firsts, "token_mint")
            .select(
                "token_mint", "member_count", F.round("supply_pct", 2).alias("supply_pct"),
                (F.col("first_team_buy") - F.col("launch_ts")).cast("double").alias("first_buy_offset_s"),
                ((F.col("first_team_buy") - F.col("launch_ts")) <= 30).cast("int").alias("is_bc_sniper"))
        )

    # ── wallets, tokens, funding ─────────────────────────────────────────────
    @stored
    def funding(self) -> DataFrame:
        orders = self.raw("orders").groupBy("o_custkey").agg(
            F.min(F.datediff("o_orderdate", F.lit("1995-01-01").cast("date"))).cast("long").alias("first_seen"),
            F.count("*").alias("sig_count"))
        nation = self.raw("nation").select("n_nationkey", "n_regionkey")
        c = self.raw("customer").select("c_custkey", "c_nationkey", "c_acctbal")
        return (
            c.join(F.broadcast(nation), c.c_nationkey == nation.n_nationkey)
            .join(orders, c.c_custkey == orders.o_custkey, "left")
            .select(
                F.col("c_custkey").cast("string").alias("wallet"),
                F.when(F.col("n_regionkey") == 0, "cex")
                .otherwise(F.concat(F.lit("F"), F.col("c_nationkey"))).alias("funder"),
                F.col("c_acctbal").alias("sol_funded"), "first_seen",
                F.coalesce("sig_count", F.lit(0)).alias("sig_count"))
        )

    @cached_property
    def cex_wallets(self) -> DataFrame:
        return self.raw("customer").filter("c_custkey % 100 = 0").select(
            F.col("c_custkey").cast("string").alias("wallet"))

    @stored
    def creators(self) -> DataFrame:
        uses = self.raw("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
        top = uses.groupBy("l_partkey").agg(
            F.max_by("l_suppkey", F.struct("n", -F.col("l_suppkey"))).alias("l_suppkey"))
        nation = F.broadcast(self.raw("nation").select("n_nationkey", "n_regionkey"))
        s = self.raw("supplier").select("s_suppkey", "s_nationkey")
        s = s.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        return top.join(s, top.l_suppkey == s.s_suppkey).select(
            F.col("l_partkey").cast("string").alias("token_mint"),
            F.concat(F.lit("S"), F.col("l_suppkey")).alias("creator"),
            F.when(F.col("n_regionkey") == 0, "cex")
            .otherwise(F.concat(F.lit("F"), F.col("s_nationkey"))).alias("creator_funder"))

    @cached_property
    def tokens(self) -> DataFrame:
        p = self.raw("part").select(
            F.col("p_partkey").cast("string").alias("token_mint"), F.col("p_name").alias("name"),
            F.col("p_brand").alias("symbol"), "p_type", "p_size", "p_retailprice")
        return p.join(self.creators, "token_mint").join(self.coins, "token_mint")

    # ── labels ───────────────────────────────────────────────────────────────
    @stored
    def first_prices(self) -> DataFrame:
        return self.post.groupBy("token_mint").agg(
            F.min(F.struct("ts", "price_usd"))["price_usd"].alias("first_price"),
            F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
            F.count("*").alias("n_price_points"), F.first("graduated_at").alias("graduated_at"))

    @stored
    def outcomes(self) -> DataFrame:
        """Cap ratio label at +1/+4/+24 checks: last print at or before each check."""
        from tapelens.functions.columns import outcome_label, quotient

        checks = F.explode(F.array(*[F.lit(h) for h in (1, 4, 24)]))
        p = self.post.select("token_mint", "ts", "price_usd", "graduated_at", checks.alias("check_offset_h"))
        last = (
            p.filter(F.col("ts") <= F.col("graduated_at") + F.col("check_offset_h") * HOUR_S)
            .groupBy("token_mint", "check_offset_h")
            .agg(F.max(F.struct("ts", "price_usd"))["price_usd"].alias("price"),
                 F.min(F.struct("ts", "price_usd"))["price_usd"].alias("launch_price"))
        )
        ratio = quotient(F.col("price"), F.col("launch_price"))
        return last.select(
            "token_mint", "check_offset_h", "price", "launch_price",
            ((ratio - 1) * 100).alias("price_change_pct"), outcome_label(ratio).alias("classified"))

    @stored
    def trajectory(self) -> DataFrame:
        from tapelens.operators.labels import trajectory

        return trajectory(self.post, self.team)

    @stored
    def coin_funder(self) -> DataFrame:
        """Most common non-exchange funder among the team of a coin (tie: smallest name)."""
        votes = (
            self.team.join(self.funding.select("wallet", "funder"), "wallet")
            .filter("funder <> 'cex'").groupBy("token_mint", "funder").agg(F.count("*").alias("n")))
        return votes.groupBy("token_mint").agg(
            F.min_by("funder", F.struct(-F.col("n"), F.col("funder"))).alias("funder"))
