"""Hot-key-safe ordered helpers against plain Python."""

import random
from statistics import median

from pyspark.sql import functions as F

from tapelens.functions import ordered as o


def greedy(times, w):
    groups, anchor = {}, None
    for t in sorted(set(times)):
        if anchor is None or t - anchor > w:
            anchor = t
        groups[t] = anchor
    return groups


def test_anchored_groups_boundary(spark):
    df = spark.createDataFrame([("k", t) for t in (0, 100, 300, 301, 600)], "k string, t long")
    got = {r.t: r.g for r in o.anchored_groups(df, ["k"], "t", 300, "g").collect()}
    assert got == {0: 0, 100: 0, 300: 0, 301: 301, 600: 301}


def test_anchored_groups_random(spark):
    rng = random.Random(1)
    tapes = {f"k{i}": [rng.randrange(400) for _ in range(rng.randrange(1, 60))] for i in range(40)}
    df = spark.createDataFrame([(k, t) for k, ts in tapes.items() for t in ts], "k string, t long")
    for w in (0, 1, 7, 50):
        got = {(r.k, r.t): r.g for r in o.anchored_groups(df, ["k"], "t", w, "g").collect()}
        assert got == {(k, t): g for k, ts in tapes.items() for t, g in greedy(ts, w).items()}


def test_split_rank_sum_fill_match_one_sorted_pass(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(3)}", rng.randrange(300), i, float(rng.randrange(9)), rng.choice([None, float(i)])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t long, i long, v double, x double")
    order, cell = [F.col("t"), F.col("i")], o.time_cell("t", 20)
    rank = {r.i: r.r for r in o.split_row_number(df, ["k"], order, cell, "r").collect()}
    total = {r.i: r.s for r in o.split_running_sum(df, ["k"], order, cell, F.col("v"), "s").collect()}
    back = {r.i: r.f for r in o.split_fill(df, ["k"], order, cell, F.col("x"), "f").collect()}
    ahead = {r.i: r.f for r in o.split_fill(df, ["k"], order, cell, F.col("x"), "f", forward=True, inclusive=False).collect()}
    for key in {r[0] for r in rows}:
        part = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        run, last = 0.0, None
        for n, r in enumerate(part, 1):
            run += r[3]
            last = r[4] if r[4] is not None else last
            nxt = next((q[4] for q in part[n:] if q[4] is not None), None)
            assert (rank[r[2]], total[r[2]], back[r[2]], ahead[r[2]]) == (n, run, last, nxt)


def test_grouped_median(spark):
    rng = random.Random(3)
    rows = [(f"k{rng.randrange(4)}", rng.choice([-2.5, 0.0, 1.0, 7.25, rng.random()])) for _ in range(200)]
    got = {r.k: r.m for r in o.grouped_median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", "m").collect()}
    for k in got:
        assert abs(got[k] - median(v for q, v in rows if q == k)) < 1e-12
