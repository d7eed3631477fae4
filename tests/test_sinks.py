"""Recompute of changed keys in a keyed table."""

import glob
import os
import random

from pyspark.sql import functions as F

from tapelens.sources import sinks

ROWS = "k string, v long"


def totals(rows):
    return rows.groupBy("k").agg(F.sum("v").alias("total")).filter("total > 0")


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/bucket=*/*.parquet")}


def read(spark, path):
    return sorted((r.k, r.total) for r in spark.read.parquet(path).collect())


def test_recompute_equals_full_build_and_leaves_other_buckets(spark, tmp_path):
    rng = random.Random(8)
    old = [(f"k{rng.randrange(200)}", rng.randrange(1, 9)) for _ in range(900)]
    more = [(f"k{i}", 5) for i in (3, 7, 300, 301)] + [("k9", -10_000)]  # new keys, and one that loses its row
    before, after = spark.createDataFrame(old, ROWS), spark.createDataFrame(old + more, ROWS)
    path, full = str(tmp_path / "table"), str(tmp_path / "full")
    sinks.write_keyed(totals(before), path, "k")
    kept = files(path)
    changed = spark.createDataFrame(more, ROWS)
    touched = {r.b for r in changed.select(sinks.key_bucket("k").alias("b")).collect()}
    for _ in range(2):  # the second run finds the same table
        sinks.recompute_changed(path, "k", changed, lambda keys: totals(after.join(keys, "k", "left_semi")))
        sinks.write_keyed(totals(after), full, "k")
        assert read(spark, path) == read(spark, full)
    untouched = {f: t for f, t in kept.items() if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert untouched and untouched.items() <= files(path).items()


def test_recompute_of_no_keys_and_of_a_bucket_that_empties(spark, tmp_path):
    path = str(tmp_path / "table")
    one = spark.createDataFrame([("a", 1), ("b", 2)], ROWS)
    sinks.write_keyed(totals(one), path, "k")
    kept = files(path)
    sinks.recompute_changed(path, "k", one.limit(0), totals)
    assert files(path) == kept
    sinks.recompute_changed(path, "k", one.filter("k = 'a'"), lambda keys: totals(one.join(keys, "k", "left_semi").withColumn("v", -F.col("v"))))
    assert read(spark, path) == [("b", 2)]
