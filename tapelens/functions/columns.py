"""Row-level classifiers and predicates as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quotient(a: Column, b: Column) -> Column:
    """a / b as floating point has it: over zero it is infinite or NaN, as in the SQL twins, and never an error."""
    nan = F.lit(float("nan"))
    over_zero = F.when(F.isnan(a.cast("double")) | (a == 0), nan).when(a > 0, float("inf")).when(a < 0, float("-inf"))
    return F.when(b == 0, over_zero).otherwise(F.try_divide(a, b))


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(c, F.lit(float(hi))))


def unit_price(sol="sol_amount", tokens="token_amount") -> Column:
    return F.when(col(tokens) > 0, col(sol) / col(tokens))


def outcome_label(ratio: Column) -> Column:
    """>=3x moon, <=0.30x rug, otherwise ok; null when the ratio is unknown."""
    return (F.when(ratio.isNull(), F.lit(None).cast("string"))
            .when(ratio >= 3, "moon").when(ratio <= 0.30, "rug").otherwise("ok"))


def distribution_signal(holders, sold_pct) -> Column:
    h, s = col(holders), col(sold_pct)
    return (F.when(h < 5, "DUMPED").when(s.isNull(), "HOLDING").when(s >= 30, "DISTRIBUTING")
            .when(s <= -10, "ACCUMULATING").otherwise("HOLDING"))


def accumulation_style(n_buys, offset) -> Column:
    n, o = col(n_buys), col(offset)
    return (F.when(n == 0, F.lit(None).cast("string")).when(n >= 2, "gradual")
            .when(o <= 30, "sniped").otherwise("single"))


def entity_state(bought, sold) -> Column:
    b, s = col(bought), col(sold)
    frac = s / b
    return (F.when(b <= 0, "HOLDING").when(frac >= 0.9, "DUMPED").when(frac >= 0.3, "DISTRIBUTING")
            .when(s == 0, "ACCUMULATING").otherwise("HOLDING"))


def fresh_flag(age_s, offset) -> Column:
    """Under a day critical, under three days warning, first buy within 120 s sniper."""
    a, o = col(age_s), col(offset)
    return (F.when(a < 86400, "critical").when(a < 3 * 86400, "warning")
            .when(o <= 120, "sniper").otherwise("none"))


def manufactured_flags(duration, buyers, top5_share, team_supply, max_slot_group) -> Column:
    """Array of the independent red flags of one launch."""
    d, b, t, s, g = map(col, (duration, buyers, top5_share, team_supply, max_slot_group))
    return F.array_compact(F.array(
        F.when((d > 0) & (d < 300), "lightning_curve"),
        F.when((b > 0) & (b < 25), "few_buyers"),
        F.when(t >= 0.60, "bundled_buying"),
        F.when(F.least(s, F.lit(100.0)) >= 50, "team_majority"),
        F.when(g >= 8, "slot_bundle"),
    ))


def narrative_status(current, peak) -> Column:
    c, p = col(current), col(peak)
    return F.when(c >= 50, "hot").when(c >= 5, "emerging").when(p > 0, "fading").otherwise("dead")


def wallet_tag(is_team, is_rugger, is_smart, holders_known, is_holder) -> Column:
    t, r, s, k, h = map(col, (is_team, is_rugger, is_smart, holders_known, is_holder))
    return (F.when(t, "team").when(r, "known_rugger").when(s, "smart_money")
            .when(k & ~h, "new").otherwise("unknown"))


def sell_severity(n_sellers, still_selling, share) -> Column:
    n, st, sh = map(col, (n_sellers, still_selling, share))
    return (F.when((n >= 3) & st, "CRITICAL").when((n >= 3) | (st & (sh > 0.3)), "ELEVATED").otherwise("LOW"))


def member_gate(overlap, n_edges, funding, slot_offset) -> Column:
    """Skin-in-the-game requirement: edges corroborate a position, they never carry it."""
    o, e, f, s = map(col, (overlap, n_edges, funding, slot_offset))
    corroborated = (F.coalesce(e, F.lit(0)) > 0) | f.isNotNull() | (F.coalesce(s, F.lit(99)) <= 3)
    return (o >= 1.0) | ((o >= 0.5) & corroborated) | (F.coalesce(f == "creator_linked", F.lit(False)) & (o > 0))


def distribute_score(verdict, confidence) -> Column:
    v, c = col(verdict), col(confidence)
    return (F.when(v == "SKIP", 0.5 + 0.5 * c).when(v == "STRUCTURALLY_SOUND", 0.5 - 0.5 * c).otherwise(F.lit(0.5)))


def attribution_state(exit_s, supply_pct, n_ungated) -> Column:
    x, s, n = map(col, (exit_s, supply_pct, n_ungated))
    return (F.when(x.isNotNull(), "observed").when(F.coalesce(s, F.lit(0.0)) >= 10.0, "held")
            .when(n > 0, "uncertain").otherwise("held"))


# Keyword -> narrative tag, in match order.
NARRATIVE_KEYWORDS = [
    ("pepe", "pepe"), ("frog", "pepe"), ("doge", "doge"), ("shib", "doge"), ("dog", "doge"),
    ("cat", "cat"), ("kitty", "cat"), ("nyan", "cat"), ("wojak", "wojak"), ("chad", "wojak"),
    ("bobo", "wojak"), ("trump", "trump"), ("maga", "trump"), ("potus", "trump"), ("elon", "elon"),
    ("musk", "elon"), ("tesla", "elon"), ("biden", "biden"), ("ai", "ai"), ("agent", "ai"),
    ("gpt", "ai"), ("neural", "ai"), ("base", "base"), ("based", "base"), ("solana", "solana"),
    ("sol", "solana"), ("bitcoin", "bitcoin"), ("btc", "bitcoin"), ("eth", "eth"), ("ethereum", "eth"),
]
# Words that mark a meme and words that mark a product.
MEME_WORDS = [
    "pepe", "frog", "doge", "shib", "inu", "cat", "kitty", "nyan", "wojak", "chad", "bobo", "moon", "elon",
    "trump", "maga", "wif", "bonk", "baby", "rocket", "pump", "meme", "coin", "lol", "wtf", "cum", "gay",
    "retard", "based", "giga", "florki",
]
PRODUCT_WORDS = [
    "app", "platform", "protocol", "utility", "dapp", "dApp", "governance", "staking", "ecosystem",
    "infrastructure", "ai", "agent", "tool", "marketplace", "exchange", "wallet", "sdk", "api", "network",
    "launchpad", "analytics", "dashboard", "bot", "trading", "defi", "yield", "vault", "oracle", "bridge",
    "rollup", "node", "game", "engine", "framework", "terminal", "scanner", "tracker", "aggregator",
]
# Hosts that are no project site of their own.
JUNK_SITES = ["pump.fun", "t.me", "twitter.com", "x.com", "discord", "dexscreener", "birdeye"]


def narrative_tags(text, keywords=NARRATIVE_KEYWORDS) -> Column:
    """Distinct tags in first-match order."""
    low = F.lower(col(text))
    return F.array_distinct(F.array_compact(F.array(*[F.when(low.contains(k), tag) for k, tag in keywords])))


def word_hits(text, words) -> Column:
    low = F.lower(col(text))
    total = F.lit(0)
    for w in words:
        total = total + low.contains(w).cast("int")
    return total


def real_website(url) -> Column:
    u = F.lower(col(url))
    junk = F.lit(False)
    for j in JUNK_SITES:
        junk = junk | u.contains(j)
    return F.coalesce(u.startswith("http") & ~junk, F.lit(False))


def project_class(text, description, website) -> Column:
    """project / meme / ambiguous from product words, meme words, site and description length."""
    site = real_website(website)
    strong = F.length(F.trim(F.coalesce(col(description), F.lit("")))) >= 80
    product, meme = word_hits(text, PRODUCT_WORDS), word_hits(text, MEME_WORDS)
    is_project = (meme == 0) & ((site & ((product >= 1) | strong)) | (strong & (product >= 2)))
    is_meme = ~site & ~strong & (product == 0)
    return F.when(is_project, "project").when(is_meme, "meme").otherwise("ambiguous")


def handle_of(url) -> Column:
    """Account name behind the four profile URL prefixes; empty becomes null."""
    h = F.regexp_extract(col(url), r"^https?://(?:x|twitter)\.com/([^/?]*)", 1)
    return F.when(h != "", h)


def endpoint_template(path) -> Column:
    """Address-like path segments collapse to one placeholder so counts group by endpoint."""
    return F.array_join(
        F.transform(F.split(col(path), "/"),
                    lambda s: F.when(s.rlike(r"^[1-9A-HJ-NP-Za-km-z]{30,}$"), F.lit("{mint}")).otherwise(s)), "/")
