"""Bootstrap vectors against loops over draws that copy every row by its weight."""

import hashlib
import random

import numpy as np
import pytest

from tapelens.operators import evaluation as ev
from tapelens.operators import resample
from tapelens.operators.resample import draw_auc, draw_lift, draw_means, poisson_weights
from pyspark.sql import functions as F

DRAWS = 7
ROWS = "g string, c long, s double, y int"


@pytest.fixture
def rows(monkeypatch):
    """Ties, a null group, a null cluster, missing scores and labels, and one score on a third of the rows."""
    monkeypatch.setattr(resample, "BLOCK", 3)
    monkeypatch.setattr(resample, "HELD", 4)
    r = random.Random(5)
    data = []
    for i in range(400):
        s = 0.5 if i % 3 == 0 else r.choice([None, *[round(r.random(), 1) for _ in range(6)], r.random(), -1.0])
        data.append((r.choice(["a", "a", "b", None]), r.choice([None, *range(40)]), s, r.choice([0, 0, 1, None])))
    return data


def weights(cluster):
    return poisson_weights(None if cluster is None else str(cluster), [b"%d" % d for d in range(DRAWS)])


def copies(rows, group, draw):
    return [(s, y) for g, c, s, y in rows if g == group and s is not None and y is not None for _ in range(weights(c)[draw])]


def close(a, b):
    return (a is None and b is None) or (a is not None and b is not None and abs(a - b) < 1e-9)


def test_weights_equal_the_column_form(spark):
    df = spark.range(30).withColumn("w", F.transform(F.sequence(F.lit(0), F.lit(DRAWS - 1)), lambda d: ev.poisson_weight(ev.hash_uniform(d, F.col("id")))))
    for r in df.collect():
        assert list(weights(r["id"])) == r["w"]


def test_weights_of_any_length_and_draw():
    draws, clusters = [b"%d" % d for d in (0, 9, 10, 99, 100, 1234)], [None, "", "7", "x" * 40, "x" * 50, "x" * 51, "x" * 53, "x" * 54, "x" * 70, "\u00fc" * 9]
    got = resample.weight_rows(clusters, draws)
    for i, c in enumerate(clusters):
        for j, d in enumerate(draws):
            text = d if c is None else d + b"|" + c.encode()
            u = int(hashlib.md5(text).hexdigest()[:8], 16) / 2**32
            assert got[i, j] == sum(u >= cut for cut in resample.CUTS)


def test_auc_of_each_draw(spark, rows):
    got = {(r["g"], r["draw"]): r["auc"] for r in draw_auc(spark.createDataFrame(rows, ROWS).repartition(5), ["g"], "c", "s", "y", DRAWS).collect()}
    assert len(got) == 3 * DRAWS
    for (g, d), auc in got.items():
        drawn = copies(rows, g, d)
        pos, neg = [s for s, y in drawn if y == 1], [s for s, y in drawn if y == 0]
        want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
        assert close(auc, want), (g, d)


def test_lift_of_each_draw(spark, rows):
    got = {(r["g"], r["draw"]): r["lift"] for r in draw_lift(spark.createDataFrame(rows, ROWS).repartition(5), ["g"], "c", "s", "y", DRAWS).collect()}
    assert len(got) == 3 * DRAWS
    for (g, d), lift in got.items():
        drawn = copies(rows, g, d)
        threshold = np.quantile([s for s, _ in drawn], 0.8)
        top = [y for s, y in drawn if s >= threshold]
        n, k = len(drawn), sum(y for _, y in drawn)
        want = sum(top) / len(top) - k / n if n >= 20 and len(top) >= 5 and 0 < k < n else None
        assert close(lift, want), (g, d)


def test_lift_carries_few_vectors(spark, monkeypatch):
    """Vectors leave the tasks for score bins and the scores near the quantile, not for every score."""
    made, plain = [], resample.draw_sums

    def counted(df, keys, draws):
        out = plain(df, keys, draws)
        made.append(out.count())
        return out

    monkeypatch.setattr(resample, "draw_sums", counted)
    rows = [("a", i, i / 7, i % 3 == 0) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, c long, s double, y boolean").withColumn("y", F.col("y").cast("int")).repartition(4)
    got = {r["draw"]: r["lift"] for r in draw_lift(df, ["g"], "c", "s", "y", DRAWS).collect()}
    assert sum(made) < 1000
    for d in range(DRAWS):
        drawn = [(s, int(y)) for _, c, s, y in rows for _ in range(weights(c)[d])]
        threshold = np.quantile([s for s, _ in drawn], 0.8)
        top = [y for s, y in drawn if s >= threshold]
        assert close(got[d], sum(top) / len(top) - sum(y for _, y in drawn) / len(drawn))


def test_mean_of_each_draw(spark, rows):
    df = spark.createDataFrame(rows, ROWS).withColumn("one", F.lit(1))
    got = {(r["g"], r["draw"]): r["m"] for r in draw_means(df.repartition(5), ["g"], "c", "s", "one", DRAWS).collect()}
    assert len(got) == 3 * DRAWS
    for (g, d), m in got.items():
        drawn = [s for h, c, s, _ in rows if h == g and s is not None for _ in range(weights(c)[d])]
        assert close(m, sum(drawn) / len(drawn)), (g, d)


def test_empty_and_single_class(spark):
    empty = spark.createDataFrame([], ROWS)
    assert draw_auc(empty, ["g"], "c", "s", "y", DRAWS).count() == 0
    assert draw_lift(empty, [], "c", "s", "y", DRAWS).count() == 0
    one = spark.createDataFrame([("a", i, 0.1 * i, 1) for i in range(30)], ROWS)
    assert {r["auc"] for r in draw_auc(one, [], "c", "s", "y", DRAWS).collect()} == {None}
    assert {r["lift"] for r in draw_lift(one, [], "c", "s", "y", DRAWS).collect()} == {None}
