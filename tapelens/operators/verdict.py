"""Launch rules and the structural verdict as ordered Column expressions.

One expression builder serves production, replay from frozen snapshots and ablation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INPUTS = [
    "team_supply_pct", "team_is_bc_sniper", "funder_n", "funder_rug_rate", "funder_moon_rate", "creator_n",
    "creator_rug_rate", "smart_money_count", "proven_wallet_count", "signal", "top_holder_pct", "top3_holder_pct",
    "bc_duration_seconds", "unique_bc_buyers", "graph_rug_hits", "graph_soft_hits", "launches_24h", "launches_7d",
    "fingerprint_distance", "launch_slot_snipe_count", "leader_consistency", "choreography_n",
]


def _ctx(c):
    n = lambda k: F.coalesce(c(k), F.lit(0))
    raw = c("bc_duration_seconds")
    return n, F.when(raw.isNull() | (raw == 0), -1).otherwise(raw)


def hard_skips(c=F.col) -> list[tuple[str, Column, float]]:
    """Ordered hard conditions: (name, condition, confidence)."""
    n, dur = _ctx(c)
    true = lambda e: F.coalesce(e, F.lit(False))
    return [
        ("known_rugger", (n("funder_n") >= 8) & true(c("funder_rug_rate") >= 0.65), 0.90),
        ("dumped", true(c("signal") == "DUMPED"), 0.95),
        ("team_snipers", true(c("team_supply_pct") >= 50) & (n("team_is_bc_sniper") == 1), 0.80),
        ("graduation_push", (n("top_holder_pct") > 50) & ((dur < 300) | (dur == -1)), 0.92),
        ("bundled", n("top3_holder_pct") > 75, 0.90),
        ("graph_rug", n("graph_rug_hits") > 0, 0.85),
    ]


def score_terms(c=F.col) -> list[tuple[str, Column]]:
    """Additive terms: (factor name, points); the sum is the structural score."""
    n, dur = _ctx(c)
    true = lambda e: F.coalesce(e, F.lit(False))
    pick = lambda *arms: _first(arms)
    sm, rugger = n("smart_money_count"), (n("funder_n") >= 8) & true(c("funder_rug_rate") >= 0.65)
    serial = (n("creator_n") >= 8) & true(c("creator_rug_rate") >= 0.65)
    return [
        ("smart_money", pick((sm >= 2, 2), (sm == 1, 1))),
        ("signal_positive", pick((true(c("signal") == "HOLDING"), 1), (true(c("signal") == "ACCUMULATING"), 2))),
        ("low_team_supply", pick((true(c("team_supply_pct") < 20), 1))),
        ("funder_moons", pick((~rugger & (n("funder_n") >= 8) & true(c("funder_moon_rate") >= 0.4), 1))),
        ("proven_buyers", pick((n("proven_wallet_count") >= 2, 1))),
        ("distributing", pick((true(c("signal") == "DISTRIBUTING"), -2))),
        ("funder_partial_rugger", pick(((n("funder_n") >= 4) & true(c("funder_rug_rate") >= 0.5), -1))),
        ("slot_snipes", pick((n("launch_slot_snipe_count") >= 3, -1))),
        ("exit_leader", pick((true(c("leader_consistency") >= 0.7) & (n("choreography_n") >= 8), -1))),
        ("creator", pick((serial, -2), ((n("creator_n") >= 4) & true(c("creator_rug_rate") >= 0.5), -1))),
        ("top_holder", pick((n("top_holder_pct") > 35, -2), (n("top_holder_pct") > 20, -1))),
        ("top3", pick((n("top3_holder_pct") > 60, -1))),
        ("fast_curve", pick(((dur > 0) & (dur < 180), -2), ((dur > 0) & (dur < 600), -1))),
        ("few_buyers", pick(((n("unique_bc_buyers") > 0) & (n("unique_bc_buyers") < 15), -1))),
        ("graph_soft", pick((n("graph_soft_hits") > 0, -1))),
        ("velocity", pick((n("launches_24h") >= 3, -1), (n("launches_7d") >= 7, -1))),
        ("fingerprint", pick((c("fingerprint_distance").isNotNull(), -1))),
    ]


def _first(arms) -> Column:
    e = F.when(arms[0][0], arms[0][1])
    for cond, pts in arms[1:]:
        e = e.when(cond, pts)
    return e.otherwise(0)


def structural_verdict(df: DataFrame, overrides: dict[str, Column] | None = None) -> DataFrame:
    """Adds verdict, confidence, score, hard-skip name and the factor list.

    `overrides` replaces inputs by expressions, which is how ablations and replay reuse the rules.
    """
    ov = overrides or {}
    cols = set(df.columns)
    types = {"signal": "string"}
    def c(name):
        if name in ov:
            return ov[name]
        return F.col(name) if name in cols else F.lit(None).cast(types.get(name, "double"))
    hard, terms = hard_skips(c), score_terms(c)
    rule = F.coalesce(*[F.when(cond, F.lit(name)) for name, cond, _ in hard])
    conf = F.coalesce(*[F.when(cond, F.lit(k)) for _, cond, k in hard])
    total = sum((p for _, p in terms[1:]), terms[0][1])
    factors = F.array_join(F.array_compact(F.array(*[F.when(p != 0, F.lit(n)) for n, p in terms])), ",")
    out = df.withColumn("hard_skip", rule).withColumn("__hc", conf).withColumn("score", total).withColumn("factors", factors)
    s = F.col("score")
    tape_ok = ~F.coalesce(c("signal").isin("DISTRIBUTING", "DUMPED"), F.lit(False))
    verdict = (F.when(F.col("hard_skip").isNotNull(), "SKIP").when((s >= 2) & tape_ok, "STRUCTURALLY_SOUND")
               .when(s <= -1, "SKIP").otherwise("WATCH"))
    soft = F.least(F.lit(0.85), F.round(0.5 + F.abs(s) * 0.1, 2))
    out = out.withColumn("verdict", verdict)
    confidence = F.when(F.col("hard_skip").isNotNull(), F.col("__hc")).when(F.col("verdict") == "WATCH", 0.5).otherwise(soft)
    return out.withColumn("confidence", confidence).drop("__hc")


LAUNCH_RULES = {
    "smart_money_early": lambda c: (F.coalesce(c("smart_money_count"), F.lit(0)) >= 2) & F.coalesce(c("minutes_since_launch") <= 5, F.lit(False)),
    "low_bundle": lambda c: F.coalesce(c("bundle_pct") < 10, F.lit(False)),
    "lp_burned": lambda c: F.coalesce(c("lp_burned"), F.lit(False)),
    "narrative_hot": lambda c: F.coalesce(c("narrative_velocity") > 50, F.lit(False)),
    "exit_dev_dump": lambda c: F.coalesce(c("dev_sell_pct") > 20, F.lit(False)),
}


def evaluate_rules(ctx: DataFrame, key: str = "token_mint") -> DataFrame:
    """Long form (key, rule_id, triggered) of every launch rule; missing inputs never trigger."""
    cells = F.array(*[F.struct(F.lit(n).alias("rule_id"), r(F.col).cast("int").alias("triggered")) for n, r in LAUNCH_RULES.items()])
    return ctx.select(key, F.inline(cells))
