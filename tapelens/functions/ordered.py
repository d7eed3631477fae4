"""Ordered operations that do not put one key into one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to a single task. A
coin may hold a third of all trades, so the helpers here cut each key into *cells*
by a coarse, order-preserving value (a time bucket, a magnitude bucket), work inside
the cells, summarise every cell to one row, run the key-wide window over those
summaries only, and join the carried value back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapelens.session import cut

CELL = "__cell"


def time_cell(ts: str | Column, width: int = 60) -> Column:
    return F.floor((F.col(ts) if isinstance(ts, str) else ts) / F.lit(width))


def magnitude_cell(x: str | Column, steps: int = 64) -> Column:
    """Monotone log bucket of a number; negative numbers mirror the positive ones below zero."""
    c = (F.col(x) if isinstance(x, str) else x).cast("double")
    far = F.lit(2**40)
    return (F.when(F.isnan(c), far + 1).when(c == float("inf"), far).when(c == float("-inf"), -far).when(c > 0, F.floor(F.log2(c) * steps))
            .when(c < 0, -F.floor(F.log2(-c) * steps) - 2**21).otherwise(F.lit(-(2**20))))


def split_row_number(
    df: DataFrame, keys: list[str], order: list[Column], cell: Column, out: str,
    descending_cells: bool = False,
) -> DataFrame:
    """row_number() per key under `order`; `cell` must be monotone in the order."""
    d = df.withColumn(CELL, cell)
    sizes = d.groupBy(*keys, CELL).agg(F.count("*").alias("__n"))
    cell_order = F.col(CELL).desc() if descending_cells else F.col(CELL).asc()
    before = Window.partitionBy(*keys).orderBy(cell_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, CELL, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    local = Window.partitionBy(*keys, CELL).orderBy(*order)
    return (
        d.withColumn("__rn", F.row_number().over(local))
        .join(offsets, [*keys, CELL])
        .withColumn(out, (F.col("__rn") + F.col("__off")).cast("long"))
        .drop(CELL, "__rn", "__off")
    )


def split_running_sum(
    df: DataFrame, keys: list[str], order: list[Column], cell: Column, value: Column, out: str,
) -> DataFrame:
    """Running sum (row inclusive) per key, carried across cells."""
    d = df.withColumn(CELL, cell).withColumn("__v", value)
    sums = d.groupBy(*keys, CELL).agg(F.sum("__v").alias("__s"))
    before = Window.partitionBy(*keys).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, CELL, F.sum("__s").over(before).alias("__off"))
    local = Window.partitionBy(*keys, CELL).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        d.withColumn("__r", F.sum("__v").over(local))
        .join(offsets, [*keys, CELL])
        .withColumn(out, F.col("__r") + F.coalesce(F.col("__off"), F.lit(0)))
        .drop(CELL, "__v", "__r", "__off")
    )


def split_fill(
    df: DataFrame, keys: list[str], order: list[Column], cell: Column, value: Column, out: str,
    forward: bool = False, inclusive: bool = True,
) -> DataFrame:
    """Last non-null `value` at or before each row (``forward``: first at or after it).

    `order` holds plain ascending columns.
    """
    d = df.withColumn(CELL, cell).withColumn("__v", value)
    marked = d.filter(F.col("__v").isNotNull())
    position = F.struct(*[F.col(f"__o{i}") for i in range(len(order))])
    for i, o in enumerate(order):
        marked = marked.withColumn(f"__o{i}", o)
    pick = F.min_by if forward else F.max_by
    edge = marked.groupBy(*keys, CELL).agg(pick("__v", position).alias("__edge"))
    cells = d.select(*keys, CELL).distinct().join(edge, [*keys, CELL], "left")
    if forward:
        w = Window.partitionBy(*keys).orderBy(CELL).rowsBetween(1, Window.unboundedFollowing)
        carried = F.first("__edge", ignorenulls=True).over(w)
        lw = Window.partitionBy(*keys, CELL).orderBy(*order).rowsBetween(
            0 if inclusive else 1, Window.unboundedFollowing)
        local = F.first("__v", ignorenulls=True).over(lw)
    else:
        w = Window.partitionBy(*keys).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
        carried = F.last("__edge", ignorenulls=True).over(w)
        lw = Window.partitionBy(*keys, CELL).orderBy(*order).rowsBetween(
            Window.unboundedPreceding, 0 if inclusive else -1)
        local = F.last("__v", ignorenulls=True).over(lw)
    carry = cells.select(*keys, CELL, carried.alias("__carry"))
    return (
        d.withColumn("__l", local)
        .join(carry, [*keys, CELL])
        .withColumn(out, F.coalesce(F.col("__l"), F.col("__carry")))
        .drop(CELL, "__v", "__l", "__carry")
    )


def anchored_groups(df: DataFrame, keys: list[str], ts: str, width: int, out: str) -> DataFrame:
    """Greedy anchored windows over the distinct `ts` of each key: (keys, ts, out=anchor).

    A group takes every time within `width` of its first one; the next group starts at the first
    time beyond. Anchors are found by doubling jumps: every time knows the first time beyond its
    own window, a time after a gap is an anchor for certain, and each round joins the jump of
    twice the length, so a chain of n anchors takes log2(n) rounds of equi joins. No key is
    gathered into one row or one task.
    """
    cell = lambda c: time_cell(c, 64 * (width + 1))
    times = cut(df.select(*keys, F.col(ts).alias("__t")).distinct())
    before = split_fill(times, keys, [F.col("__t")], cell("__t"), F.col("__t"), "__prev", inclusive=False)
    starts = before.filter(F.col("__prev").isNull() | (F.col("__t") - F.col("__prev") > width)).select(*keys, "__t")
    none = F.lit(None).cast("long")
    line = times.select(*keys, F.col("__t").alias("__at"), F.lit(0).alias("__kind"), F.col("__t").alias("__v"), none.alias("__from")).unionByName(
        times.select(*keys, (F.col("__t") + width).alias("__at"), F.lit(1).alias("__kind"), none.alias("__v"), F.col("__t").alias("__from")))
    jumps = split_fill(line, keys, [F.col("__at"), F.col("__kind")], cell("__at"), F.col("__v"), "__to", forward=True, inclusive=False)
    jumps = cut(jumps.filter("__from IS NOT NULL AND __to IS NOT NULL").select(*keys, F.col("__from").alias("__t"), "__to"))
    anchors, known = cut(starts), None
    while known != (known := anchors.count()):
        reached = anchors.join(jumps, [*keys, "__t"]).select(*keys, F.col("__to").alias("__t"))
        anchors = cut(anchors.union(reached).distinct())
        twice = jumps.select(*keys, F.col("__t").alias("__first"), F.col("__to").alias("__t")).join(jumps, [*keys, "__t"])
        jumps = cut(twice.select(*keys, F.col("__first").alias("__t"), "__to"))
    marked = cut(times.join(anchors.withColumn("__a", F.col("__t")), [*keys, "__t"], "left"))
    filled = split_fill(marked, keys, [F.col("__t")], cell("__t"), F.col("__a"), out)
    return filled.select(*keys, F.col("__t").alias(ts), out)


def exact_quantile_ranks(df: DataFrame, keys: list[str], value: str, cell: Column | None = None) -> DataFrame:
    """(keys, value, n, cum_before): tie-collapsed value histogram with running counts.

    Feeds rank statistics (Gini, AUC, medians) without sorting raw rows in one task.
    """
    hist = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    cell = magnitude_cell(value) if cell is None else cell
    ran = split_running_sum(hist, keys, [F.col(value)], cell, F.col("n"), "cum")
    return ran.withColumn("cum_before", F.col("cum") - F.col("n"))


def grouped_median(df: DataFrame, keys: list[str], value: str, out: str, cell: Column | None = None) -> DataFrame:
    """Exact median per key from the value histogram; hot keys stay spread over cells."""
    h = exact_quantile_ranks(df.filter(F.col(value).isNotNull()), keys, value, cell)
    total = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("__t"))
    if keys:
        j = h.join(total, keys)
    else:
        j = h.crossJoin(total)
    lo = F.floor((F.col("__t") - 1) / 2)
    hi = F.floor(F.col("__t") / 2)
    holds = lambda p: (F.col("cum_before") <= p) & (p < F.col("cum"))
    return j.groupBy(*keys).agg(
        ((F.max(F.when(holds(lo), F.col(value))) + F.max(F.when(holds(hi), F.col(value)))) / 2).alias(out)
    )
