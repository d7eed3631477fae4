"""Grouped evaluation statistics as DataFrame recipes: ranking, calibration, drift, bootstrap, grading.

Rank statistics run on tie-collapsed score histograms (see `functions.ordered`), take key
columns so many groups share one job, and never sort raw rows in a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapelens.functions.columns import quotient
from tapelens.functions.ordered import magnitude_cell, split_fill, split_row_number, split_running_sum, time_cell
from tapelens.operators import resample
from tapelens.session import cut

DEC = "decimal(38,12)"


def _dsum(c: Column) -> Column:
    return F.sum(c.cast(DEC)).cast("double")


def _score_histogram(df: DataFrame, keys: list[str], score: str, label: str, weight: Column | None = None) -> DataFrame:
    """Per (keys, score): positives, negatives and the running counts in ascending score."""
    w = F.lit(1) if weight is None else weight
    h = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, F.col(score).alias("s")).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 0, w).otherwise(0)).alias("neg"))
    h = split_running_sum(h, keys, [F.col("s")], magnitude_cell("s"), F.col("neg"), "cneg")
    return split_running_sum(h, keys, [F.col("s")], magnitude_cell("s"), F.col("pos"), "cpos")


def _totals(h: DataFrame, keys: list[str]) -> DataFrame:
    return h.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))


def _attach(h: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    return h.join(totals, keys) if keys else h.join(F.broadcast(totals))


def roc_auc(df: DataFrame, keys: list[str], score: str, label: str, weight: Column | None = None) -> DataFrame:
    """Tie-corrected area under the ROC curve per group; null when a class is missing."""
    h = _score_histogram(df, keys, score, label, weight)
    g = h.groupBy(*keys).agg(
        F.sum(F.col("pos").cast("decimal(19,0)") * (2 * (F.col("cneg") - F.col("neg")) + F.col("neg")).cast("decimal(19,0)")).cast("double").alias("u2"),
        F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return g.select(*keys, F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("u2") / (2.0 * F.col("P") * F.col("N"))).alias("auc"),
                    (F.col("P") + F.col("N")).alias("n"))


def average_precision(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Average precision with tied scores entering together."""
    h = _score_histogram(df, keys, score, label)
    j = _attach(h, _totals(h, keys), keys)
    tp, fp = F.col("P") - F.col("cpos") + F.col("pos"), F.col("N") - F.col("cneg") + F.col("neg")
    term = F.when(F.col("P") > 0, tp / (tp + fp) * F.col("pos") / F.col("P"))
    return j.groupBy(*keys).agg(_dsum(term).alias("ap"))


def brier(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    e = F.col(score) - F.col(label)
    return df.groupBy(*keys).agg((_dsum(e * e) / F.count("*")).alias("brier"), F.count("*").alias("n"))


def prf(df: DataFrame, keys: list[str], pred: str, label: str) -> DataFrame:
    """Precision, recall and F1; null where undefined."""
    p, y = F.col(pred) == 1, F.col(label) == 1
    g = df.groupBy(*keys).agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.select(*keys, ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
                    F.when((tp > 0), 2 * tp / (2 * tp + fp + fn)).alias("f1"))


def calibration_bins(df: DataFrame, keys: list[str], score: str, label: str, bins: int = 10) -> DataFrame:
    """Mean score and hit rate per equal-width bin; a score of one belongs to the last bin."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(*keys, b.alias("bin")).agg(
        F.round(_dsum(F.col(score)) / F.count("*"), 9).alias("mean_score"),
        (F.sum(F.col(label).cast("long")) / F.count("*")).alias("hit_rate"), F.count("*").alias("n"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float]) -> DataFrame:
    """(keys, q): linearly interpolated quantiles from the value histogram."""
    h = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("k"))
    h = split_running_sum(h, keys, [F.col("v")], magnitude_cell("v"), F.col("k"), "cum")
    t = h.groupBy(*keys).agg(F.sum("k").alias("T"))
    j = _attach(h, t, keys)
    picks = []
    for i, q in enumerate(qs):
        at = (F.col("T") - 1) * F.lit(float(q))
        for tag, pos in (("l", F.floor(at)), ("h", F.ceil(at))):
            held = (F.col("cum") - F.col("k") <= pos) & (pos < F.col("cum"))
            picks.append(F.max(F.when(held, F.col("v"))).alias(f"{tag}{i}"))
    g = j.groupBy(*keys).agg(F.first("T").alias("T"), *picks)
    lerp = lambda i, q: F.col(f"l{i}") + (F.col(f"h{i}") - F.col(f"l{i}")) * (
        (F.col("T") - 1) * F.lit(float(q)) - F.floor((F.col("T") - 1) * F.lit(float(q))))
    return g.select(*keys, F.col("T").alias("n"), F.array(*[lerp(i, q) for i, q in enumerate(qs)]).alias("q"))


def psi(ref: DataFrame, cur: DataFrame, feature: str, value: str, bins: int = 10, min_n: int = 20) -> DataFrame:
    """Population stability per feature with reference deciles; values outside them are dropped."""
    keys = [feature]
    q = exact_quantiles(ref, keys, value, [i / bins for i in range(bins + 1)]).filter(F.col("n") >= min_n)
    edges = q.select(feature, F.array_distinct("q").alias("e"))
    def counts(df, name):
        j = df.filter(F.col(value).isNotNull()).join(F.broadcast(edges), feature)
        n_le = F.size(F.filter("e", lambda x: x <= F.col(value)))
        b = F.when(F.col(value) == F.element_at("e", -1), F.size("e") - 1).otherwise(n_le)
        inside = (F.col(value) >= F.element_at("e", 1)) & (F.col(value) <= F.element_at("e", -1))
        return j.filter(inside).groupBy(feature, b.alias("b")).agg(F.count("*").alias(name))
    enough = cur.filter(F.col(value).isNotNull()).groupBy(feature).agg(F.count("*").alias("n")).filter(F.col("n") >= min_n)
    grid = edges.join(enough.select(feature), feature, "left_semi").filter(F.size("e") >= 3).select(
        feature, F.explode(F.sequence(F.lit(1), F.size("e") - 1)).alias("b"))
    j = grid.join(counts(ref, "r"), [feature, "b"], "left").join(counts(cur, "c"), [feature, "b"], "left").fillna(0, ["r", "c"])
    tot = j.groupBy(feature).agg(F.sum("r").alias("r_all"), F.sum("c").alias("c_all"))
    j = j.join(tot, feature)
    share = lambda a, b: F.greatest(F.col(a) / F.greatest(F.col(b), F.lit(1)), F.lit(1e-4))
    r, c = share("r", "r_all"), share("c", "c_all")
    return j.groupBy(feature).agg(F.round(_dsum((c - r) * F.ln(c / r)), 6).alias("psi"))


def walk_forward_folds(df: DataFrame, ts: str, tie: str, cell_s: int, first_share: float = 0.4, folds: int = 5) -> DataFrame:
    """Adds rank in time (from 1) and fold: -1 for the opening train block, then 0..folds-1 in time order (equal counts)."""
    n = df.agg(F.count("*").alias("__total"))
    ranked = _global_rank(df, ts, tie, cell_s)
    j = ranked.join(F.broadcast(n))
    start = F.floor(F.col("__total") * first_share)
    size = (F.col("__total") - start) / folds
    fold = F.when(F.col("__rank") <= start, -1).otherwise(F.least(F.floor((F.col("__rank") - 1 - start) / size), F.lit(folds - 1)))
    return j.withColumn("fold", fold.cast("int")).withColumnRenamed("__rank", "rank").drop("__total")


def time_ranked(df: DataFrame, ts: str, tie: str, cell_s: int) -> DataFrame:
    """Adds rank: the place in time from 1, over all rows."""
    return _global_rank(df, ts, tie, cell_s).withColumnRenamed("__rank", "rank")


def _global_rank(df: DataFrame, ts: str, tie: str, cell_s: int) -> DataFrame:
    """Global time rank by cells: only one summary row per cell meets in a single task."""
    return split_row_number(df.withColumn("__all", F.lit(1)), ["__all"], [F.col(ts), F.col(tie)], time_cell(ts, cell_s), "__rank").drop("__all")


def day_windows(df: DataFrame, ts: str, days: int, day_s: int = 86400) -> DataFrame:
    """Consecutive windows of fixed width counted from the first sample."""
    first = df.agg(F.min(ts).alias("__t0"))
    return df.join(F.broadcast(first)).withColumn("window", F.floor((F.col(ts) - F.col("__t0")) / (days * day_s)).cast("int")).drop("__t0")


def hash_uniform(*parts: Column) -> Column:
    """Reproducible uniform in [0, 1) from the first 32 bits of an MD5."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def poisson_weight(u: Column) -> Column:
    """Poisson(1) count by inverse distribution, the bootstrap multiplicity of a cluster."""
    cuts = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    w = F.lit(0)
    for c in cuts:
        w = w + (u >= c).cast("int")
    return w


def cluster_bootstrap_auc(df: DataFrame, cluster: str, score: str, label: str, draws: int) -> DataFrame:
    """Percentile interval of the AUC over cluster resamples."""
    per = resample.draw_auc(df, [], cluster, score, label, draws).filter("auc IS NOT NULL")
    return exact_quantiles(per, [], "auc", [0.025, 0.5, 0.975]).select(
        F.col("n").alias("draws"), *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("lo", "mid", "hi"))])


def cluster_bootstrap_mean(df: DataFrame, keys: list[str], cluster: str, value: str, draws: int, null_at: float = 1.0) -> DataFrame:
    """Mean per group with a cluster-bootstrap interval and the share of draws at or below `null_at`."""
    per = df.groupBy(*keys, cluster).agg(F.sum(F.col(value).cast(DEC)).alias("s"), F.count("*").alias("k"))
    means = resample.draw_means(per, keys, cluster, "s", "k", draws).filter("m IS NOT NULL")
    q = exact_quantiles(means, keys, "m", [0.025, 0.975])
    low = means.groupBy(*keys).agg((F.count_if(F.col("m") <= null_at) / F.count("*")).alias("p_low"))
    base = per.groupBy(*keys).agg((F.sum("s").cast("double") / F.sum("k")).alias("mean"), F.sum("k").alias("n"), F.count("*").alias("clusters"))
    j = base.join(q.drop("n"), keys).join(low, keys) if keys else base.join(F.broadcast(q.drop("n"))).join(F.broadcast(low))
    r = lambda c, n: F.round(c, 6).alias(n)
    return j.select(*keys, "n", "clusters", r(F.col("mean"), "mean"), r(F.col("q")[0], "lo"), r(F.col("q")[1], "hi"), r(F.col("p_low"), "p_low"))


def top_lift(df: DataFrame, keys: list[str], score: str, label: str, quantile: float = 0.8, min_n: int = 20, min_top: int = 5) -> DataFrame:
    """Hit rate above the score quantile minus the base rate; null when too few rows."""
    q = exact_quantiles(df, keys, score, [quantile]).select(*keys, F.col("q")[0].alias("thr"))
    j = _attach(df, q, keys)
    g = j.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("k"), F.count_if(F.col(score) >= F.col("thr")).alias("n_top"),
        F.sum(F.when(F.col(score) >= F.col("thr"), F.col(label)).otherwise(0).cast("long")).alias("k_top"))
    base = F.col("k") / F.col("n")
    ok = (F.col("n") >= min_n) & (F.col("n_top") >= min_top) & (F.col("k") > 0) & (F.col("k") < F.col("n"))
    return g.select(*keys, "n", "n_top", base.alias("base_rate"), F.when(ok, F.col("k_top") / F.col("n_top") - base).alias("lift"))


def bootstrap_lift(df: DataFrame, keys: list[str], row_id: str, score: str, label: str, draws: int) -> DataFrame:
    """Lift with a percentile interval over Poisson resamples of the rows."""
    per = resample.draw_lift(df, keys, row_id, score, label, draws).filter("lift IS NOT NULL")
    q = exact_quantiles(per, keys, "lift", [0.025, 0.975])
    point = top_lift(df, keys, score, label)
    j = point.join(q.select(*keys, "q"), keys, "left") if keys else point.join(F.broadcast(q.select("q")), how="left")
    return j.select(*keys, "n", "base_rate", F.round("lift", 6).alias("lift"), F.round(F.col("q")[0], 6).alias("lo"), F.round(F.col("q")[1], 6).alias("hi"))


def equivalence_verdict(lo: Column, hi: Column, lift_a: Column, lift_b: Column, n_a: Column, n_b: Column,
                        need: int = 1600, margin: float = 0.10, min_lift: float = 0.10) -> Column:
    """POOL only when the interval of the difference stays inside the margin and both arms lift."""
    enough = (n_a >= need) & (n_b >= need) & lift_a.isNotNull() & lift_b.isNotNull()
    same = (F.abs(lo) <= margin) & (F.abs(hi) <= margin) & (lift_a >= min_lift) & (lift_b >= min_lift)
    return F.when(~enough, "INSUFFICIENT_DATA").when(same, "POOL").otherwise("KEEP_SEPARATE")


def prior_median_at_least(df: DataFrame, key: str, ts: str, value: str, bound: str) -> DataFrame:
    """(key, ts, n_prior, at_least): is the median of strictly earlier values at least `bound`?

    Counts decide unless exactly half the values reach the bound; then the two middle values are
    the largest below it and the smallest at or above it. All four are running aggregates over
    one row per (key, second), so no pair of events is ever formed.
    """
    high = F.col(value) >= F.col(bound)
    line = df.groupBy(key, ts).agg(
        F.count("*").alias("__n"), F.count_if(high).alias("__k"), F.max(F.when(~high, F.col(value))).alias("__lo"),
        F.min(F.when(high, F.col(value))).alias("__hi"), F.first(bound).alias("__b"))
    w = Window.partitionBy(key).orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)
    r = line.select(key, ts, "__b", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("n_prior"), F.sum("__k").over(w).alias("__k"),
                    F.max("__lo").over(w).alias("__lo"), F.min("__hi").over(w).alias("__hi"))
    twice = 2 * F.col("__k")
    even = (F.col("__lo") + F.col("__hi")) / 2 >= F.col("__b")
    return r.select(key, ts, "n_prior", F.when(twice == F.col("n_prior"), even).otherwise(twice > F.col("n_prior")).alias("at_least"))


def partial_spearman(df: DataFrame, features: list[str], target: str, control: str) -> DataFrame:
    """Raw rank correlation of each feature with the target, and with the control regressed out."""
    long = df.select(F.col(target).alias("__y"), F.col(control).alias("__c"),
                     F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("__x")) for f in features])))
    def ranked(d, col, out):
        h = d.groupBy("feature", F.col(col).alias("v")).agg(F.count("*").alias("k"))
        h = split_running_sum(h, ["feature"], [F.col("v")], magnitude_cell("v"), F.col("k"), "cum")
        r = h.select("feature", F.col("v").alias(col), (F.col("cum") - F.col("k") + (F.col("k") + 1) / 2).alias(out))
        return d.join(r, ["feature", col])
    long = cut(long)     # each ranking reads its input twice
    for col, out in (("__x", "rx"), ("__y", "ry"), ("__c", "rc")):
        long = cut(ranked(long, col, out))
    fit = long.groupBy("feature").agg(
        F.regr_slope("rx", "rc").alias("sx"), F.regr_intercept("rx", "rc").alias("ix"), F.regr_slope("ry", "rc").alias("sy"),
        F.regr_intercept("ry", "rc").alias("iy"), F.corr("rx", "ry").alias("rho"), F.stddev_pop("rx").alias("sd"), F.count("*").alias("n"))
    j = long.join(F.broadcast(fit), "feature").filter("sd > 0")
    # Rounding merges residuals that differ only by floating error before they are ranked.
    j = j.withColumn("ex", F.round(F.col("rx") - F.col("sx") * F.col("rc") - F.col("ix"), 6) + 0.0).withColumn(
        "ey", F.round(F.col("ry") - F.col("sy") * F.col("rc") - F.col("iy"), 6) + 0.0)
    res = cut(j.select("feature", "rho", "n", "ex", "ey"))
    res = ranked(cut(ranked(res, "ex", "qx")), "ey", "qy")
    return res.groupBy("feature").agg(
        F.max("n").alias("n"), F.round(F.max("rho"), 6).alias("rho"), F.round(F.corr("qx", "qy"), 6).alias("partial_rho"))


def grade_exit_alarms(alarms: DataFrame, prints: DataFrame, hour_s: int) -> DataFrame:
    """Price as of the alarm and one hour later; correct when it fell, pending while the tape is short."""
    at = alarms.select("token_mint", "alert_ts", F.explode(F.array(F.lit(0), F.lit(hour_s))).alias("lag")).withColumn(
        "ts", F.col("alert_ts") + F.col("lag"))
    line = prints.select("token_mint", "ts", F.struct("ts", "tx_signature").alias("k"), "price_usd")
    opening = line.groupBy("token_mint", "ts").agg(F.max_by("price_usd", "k").alias("px")).withColumn("ask", F.lit(0))
    asks = at.select("token_mint", "ts", F.lit(None).cast("double").alias("px"), F.lit(1).alias("ask")).distinct()
    known = split_fill(opening.unionByName(asks), ["token_mint"], [F.col("ts"), F.col("ask")], time_cell("ts", 600), F.col("px"), "seen").filter("ask = 1")
    seen = at.join(known.select("token_mint", "ts", "seen"), ["token_mint", "ts"], "left").groupBy("token_mint", "alert_ts").agg(
        F.max(F.when(F.col("lag") == 0, F.col("seen"))).alias("p0"), F.max(F.when(F.col("lag") > 0, F.col("seen"))).alias("p1"))
    last = prints.groupBy("token_mint").agg(F.max("ts").alias("last_ts"))
    j = alarms.join(seen, ["token_mint", "alert_ts"], "left").join(last, "token_mint", "left")
    long_enough = F.coalesce(F.col("last_ts") >= F.col("alert_ts") + hour_s, F.lit(False))
    ratio = quotient(F.col("p1"), F.col("p0"))  # an alarm at price zero has an infinite or undefined ratio and no grade
    gradable = F.coalesce(F.col("p0") > 0, F.lit(False)) & long_enough
    return j.select(
        "token_mint", "alert_ts",
        F.when(gradable, F.when(ratio < 1, "correct").otherwise("wrong")).when(long_enough, "ungradable").otherwise("pending").alias("outcome"),
        F.when(long_enough, F.round(ratio, 6)).alias("price_ratio"), F.when(long_enough, F.round((1 - ratio) * 100, 4)).alias("saved_pct"))


def grade_prewarn(exit_s: Column, span_s: Column, claim_s: int = 600) -> Column:
    """Correct within the claim, wrong later or on a long tape without exit, otherwise ungradable."""
    return (F.when(exit_s.isNotNull(), F.when(exit_s <= claim_s, "correct").otherwise("wrong"))
            .when(span_s >= 3 * claim_s, "wrong").otherwise("ungradable"))


def grade_summary(graded: DataFrame, keys: list[str]) -> DataFrame:
    o = F.col("outcome")
    done = F.count_if(o.isin("correct", "wrong"))
    return graded.groupBy(*keys).agg(
        F.count("*").alias("fired"), done.alias("graded"), F.count_if(o == "correct").alias("correct"),
        F.when(done > 0, F.round(F.count_if(o == "correct") / done, 3)).alias("precision"),
        F.count_if(o == "pending").alias("pending"), F.count_if(o == "ungradable").alias("ungradable"))


def alert_threshold(df: DataFrame, score: str, label: str, precision: float = 0.93, min_fires: int = 20) -> DataFrame:
    """Lowest score whose alerts reach the precision with enough fires."""
    h = _score_histogram(df.withColumn("__g", F.lit(1)), ["__g"], score, label)
    j = _attach(h, _totals(h, ["__g"]), ["__g"])
    tp, fp = F.col("P") - F.col("cpos") + F.col("pos"), F.col("N") - F.col("cneg") + F.col("neg")
    ok = j.filter(((tp + fp) >= min_fires) & (tp / (tp + fp) >= precision))
    return ok.agg(F.min("s").alias("threshold"))
