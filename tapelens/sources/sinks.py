"""Keyed upserts, partition replacement, recompute of changed keys and exports on plain Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelens.session import stored


def merge_rows(target: DataFrame, incoming: DataFrame, keys: list[str], policy: dict[str, str], default: str = "replace",
               order: str | None = None) -> DataFrame:
    """One row per key from stored and incoming rows, column by column.

    Policies: replace (incoming wins), keep (stored wins), coalesce (incoming unless null),
    max, min. With `order`, the latest incoming row of a key wins. Pure partial aggregation:
    one shuffle on the keys, no window, so a hot key is pre-merged on the map side.
    """
    cols = [c for c in target.columns if c not in keys]
    seq = F.col(order).cast("double") if order else F.lit(0.0)
    both = target.withColumn("__new", F.lit(0)).withColumn("__o", seq).unionByName(
        incoming.select(*target.columns).withColumn("__new", F.lit(1)).withColumn("__o", seq))
    # a total order over whole rows: tied rows are never mixed column by column
    latest, first = F.struct("__new", "__o", *cols), F.struct(-F.col("__new"), -F.col("__o"), *cols)
    aggs = []
    for c in cols:
        how = policy.get(c, default)
        ranked = {"replace": F.max_by(c, latest), "keep": F.max_by(c, first),
                  "coalesce": F.max_by(c, F.when(F.col(c).isNotNull(), latest)), "max": F.max(c), "min": F.min(c)}
        aggs.append(ranked[how].alias(c))
    return both.groupBy(*keys).agg(*aggs).select(*target.columns)


def insert_new(target: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of `incoming` with a key that is neither stored nor repeated earlier in the batch."""
    rest = [c for c in incoming.columns if c != key]
    once = incoming.groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, "r.*")
    return once.join(target.select(key), key, "left_anti").select(*incoming.columns)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replaces only the partitions present in `df` (all of the table when unpartitioned)."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


#: Buckets of a keyed table: one holds the rows of a fixed share of its keys.
KEY_BUCKETS = 32


def key_bucket(key: str, buckets: int = KEY_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_keyed(df: DataFrame, path: str, key: str, buckets: int = KEY_BUCKETS) -> None:
    """Replace the buckets of keys that `df` has rows in; the files of other buckets stay."""
    placed = df.withColumn("bucket", key_bucket(key, buckets))
    write_table(placed.repartition(F.col("bucket"), key_bucket(key, buckets * 8)), path, ["bucket"])


def recompute_changed(path: str, key: str, changed: DataFrame, build: Callable[[DataFrame], DataFrame], buckets: int = KEY_BUCKETS) -> None:
    """Rebuild a keyed table for a set of keys alone.

    `build` gets the distinct changed keys and returns their new rows, as the full build would. Only
    the buckets of those keys are read and written again: their other rows are carried over by an anti
    join, keys without new rows vanish. The replacement is written aside first, so a job that dies
    leaves the table as it was, and running it twice gives the same table.
    """
    spark = changed.sparkSession
    keys = stored(changed.select(key).distinct(), "changed-keys")
    touched = [r.b for r in keys.select(key_bucket(key, buckets).alias("b")).distinct().collect()]  # at most `buckets`
    if not touched:
        return
    old = spark.read.parquet(path)
    fresh = build(keys)
    kept = old.filter(F.col("bucket").isin(touched)).drop("bucket").join(keys, key, "left_anti")
    both = stored(kept.unionByName(fresh.select(*kept.columns)).withColumn("bucket", key_bucket(key, buckets)), "replaced-buckets")
    write_table(both.repartition(F.col("bucket"), key_bucket(key, buckets * 8)), path, ["bucket"])
    full = {r.bucket for r in both.select("bucket").distinct().collect()}
    for b in set(touched) - full:  # a bucket that lost its last row
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={b}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def gap_rows(source: DataFrame, sink: DataFrame, ts: str) -> DataFrame:
    """Source rows newer than anything in the sink."""
    top = sink.agg(F.coalesce(F.max(ts), F.lit(-(2**62))).alias("__top"))
    return source.join(F.broadcast(top)).filter(F.col(ts) > F.col("__top")).drop("__top")


def repair_names(tokens: DataFrame, second: DataFrame) -> DataFrame:
    """Missing, blank or UNKNOWN names and symbols are taken from a second source."""
    bad = lambda c: F.col(c).isNull() | (F.trim(c) == "") | (F.upper(c) == "UNKNOWN")
    j = tokens.join(second.select("token_mint", F.col("name").alias("n2"), F.col("symbol").alias("s2")), "token_mint", "left")
    return j.withColumn("name", F.when(bad("name"), F.coalesce("n2", "name")).otherwise(F.col("name"))).withColumn(
        "symbol", F.when(bad("symbol"), F.coalesce("s2", "symbol")).otherwise(F.col("symbol"))).drop("n2", "s2")


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
