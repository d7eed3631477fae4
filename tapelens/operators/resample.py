"""Bootstrap draws as vectors: means, AUC and top-quantile lift of every draw in one pass over the rows.

A row is never copied by draw or by weight. Each task draws the Poisson weights of a row for all
draws at once and adds them, times the row's two numbers, into vectors held per (keys, score); what
leaves the task is one row per (block of draws, keys, score) with two vectors. The ordered statistics
range-partition these rows by block, keys and score, so equal scores meet in one task whatever their
number and one hot group spreads over many tasks; each range learns the weight below it from the
vectors of the ranges before it. A lift needs one place in that order only: bins of scores find where
the place of each draw lies, and vectors by single scores are made for the rows of those bins alone.

Weights depend on the draw's number and the cluster's id only, so results repeat on any
partitioning. A null cluster id is one cluster of its own; rows whose score or label is null are
left out; an empty table gives no draws.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from tapelens.session import cut

BLOCK = 250            # draws in one vector
TOGETHER = 16          # rows whose weights are drawn in one step
HELD = 512             # (keys, score) sums a task holds before it passes them on
RANGE_BYTES = 1 << 26  # vectors in one range
SALTS = 256            # first step of adding up the vectors of all tasks
BINS = 64              # least number of score bins a lift starts from
TASK_WEIGHTS = 10**8   # weights that one task of a lift draws
SCORE_PARTS = 16       # tasks over which the rows of one score are spread
CUTS = np.array([0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183])
LIMITS = np.ceil(CUTS * 4294967296.0).astype("u4")  # least 32 bits at or above each cut


#: Shifts and sines of the 64 MD5 steps and its start, for many short messages at once.
TURNS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).ravel().tolist()
SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _md5_first(words: list) -> np.ndarray:
    """First 32 bits of the MD5 of one-block messages, as in its hex form; `words` are the 16 words, each one number or one per message."""
    a, b, c, d = START
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), (7 * i) % 16
        x = f + (a + (words[g] + SINES[i]))
        a, d, c, b = d, c, b, b + ((x << TURNS[i]) | (x >> (32 - TURNS[i])))
    return (a + START[0]).byteswap()


def _uniform_bits(draws: list[bytes], tails: list[bytes]) -> np.ndarray:
    """(tail, draw): first 32 bits of the MD5 of the draw's number with the tail behind it."""
    out = np.empty((len(tails), len(draws)), "u4")
    digits, sizes = np.array([len(d) for d in draws], "i8"), np.array([len(t) for t in tails], "i8")
    for n in np.unique(digits).tolist():
        of = np.flatnonzero(digits == n)
        for m in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == m)
            if n + m > 55:
                out[np.ix_(at, of)] = [[int.from_bytes(hashlib.md5(draws[j] + tails[i]).digest()[:4], "big") for j in of] for i in at]
                continue
            text = np.zeros((len(at), len(of), 64), "u1")
            text[:, :, :n] = np.frombuffer(b"".join(draws[j] for j in of), "u1").reshape(1, -1, n)
            text[:, :, n:n + m] = np.frombuffer(b"".join(tails[i] for i in at), "u1").reshape(len(at), 1, m)
            text[:, :, n + m] = 128
            words = text.view("<u4").reshape(-1, 16)
            own = (n + m) // 4 + 1
            fixed = [np.uint32(0)] * (16 - own)
            if own < 15:
                fixed[-2] = np.uint32(8 * (n + m))
            with np.errstate(over="ignore"):
                out[np.ix_(at, of)] = _md5_first([words[:, w].copy() for w in range(own)] + fixed).reshape(len(at), -1)
    return out


def poisson_weights(cluster: str | None, draws: list[bytes]) -> np.ndarray:
    """Poisson(1) multiplicities of a cluster in all draws, equal to `evaluation.poisson_weight` of `hash_uniform`."""
    return weight_rows([cluster], draws)[0]


def weight_rows(clusters: list[str | None], draws: list[bytes]) -> np.ndarray:
    """(cluster, draw): `poisson_weights` of some clusters at once."""
    tails = [b"" if c is None else b"|" + c.encode() for c in clusters]
    return np.searchsorted(LIMITS, _uniform_bits(draws, tails), side="right")


def _schema(df: DataFrame, keys: list[str], *names: str, extra: tuple[StructField, ...] = ()) -> StructType:
    """block, the keys as in `df`, `extra`, and one vector per name."""
    vectors = [StructField(n, ArrayType(DoubleType())) for n in names]
    return StructType([StructField("block", IntegerType()), *[df.schema[k] for k in keys], *extra, *vectors])


def draw_sums(df: DataFrame, keys: list[str], draws: int) -> DataFrame:
    """(block, keys, s, a, b): weighted sums of columns a and b by score s and draw, partial per task.

    `df` has the keys, `cluster` (string), `s`, `a` and `b` (doubles).
    """
    out = _schema(df, keys, "a", "b", extra=(StructField("s", DoubleType()),))
    arrow = to_arrow_schema(out)
    named = [*keys, "s"]
    block, most = BLOCK, HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = [b"%d" % d for d in range(draws)]
        held: dict[tuple, np.ndarray] = {}

        def passed_on():
            for key, sums in held.items():
                rows = [dict(zip(named, key), block=i, a=sums[0, lo:lo + block], b=sums[1, lo:lo + block])
                        for i, lo in enumerate(range(0, draws, block))]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
            held.clear()

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in (*named, "cluster", "a", "b")]
            for lo in range(0, batch.num_rows, TOGETHER):
                *named_values, clusters, ones, others = (c[lo:lo + TOGETHER] for c in columns)
                for *key, w, a, b in zip(*named_values, weight_rows(clusters, numbers), ones, others):
                    key = tuple(key)
                    if key not in held:
                        if len(held) >= most:
                            yield from passed_on()
                        held[key] = np.zeros((2, draws))
                    if a:
                        held[key][0] += a * w
                    if b:
                        held[key][1] += b * w
        yield from passed_on()

    return df.select(*keys, "cluster", "s", "a", "b").mapInArrow(run, out)


def _row(pdf: pd.DataFrame, names: list[str], **vectors: np.ndarray) -> pd.DataFrame:
    """One row with the leading values of `names` and the given vectors."""
    return pd.DataFrame({**{n: pdf[n].iloc[:1].array for n in names}, **{n: [v] for n, v in vectors.items()}})


def _added(sums: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Vectors added up per (block, keys, by)."""
    extra = tuple(sums.schema[n] for n in by)

    def add(pdf):
        return _row(pdf, ["block", *keys, *by], a=np.sum(np.stack(pdf["a"]), axis=0), b=np.sum(np.stack(pdf["b"]), axis=0))

    return sums.groupBy("block", *keys, *by).applyInPandas(add, _schema(sums, keys, "a", "b", extra=extra))


def _by_draw(df: DataFrame, keys: list[str], name: str, finish: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
    """(keys, draw, name): `finish` turns the few rows of one (block, keys) into one number per draw; NaN becomes null."""
    block = BLOCK
    schema = StructType([*[df.schema[k] for k in keys], StructField("draw", IntegerType()), StructField(name, DoubleType())])

    def emit(pdf):
        with np.errstate(invalid="ignore", divide="ignore"):
            values = finish(pdf)
        rows = pd.DataFrame({k: pdf[k].iloc[:1].repeat(len(values)).array for k in keys})
        rows["draw"] = np.arange(len(values), dtype="int32") + np.int32(pdf["block"].iloc[0] * block)
        return rows.assign(**{name: values})

    out = df.groupBy("block", *keys).applyInPandas(emit, schema)
    return out.withColumn(name, F.when(~F.isnan(name), F.col(name)))


def draw_means(df: DataFrame, keys: list[str], cluster: str, total: str, count: str, draws: int) -> DataFrame:
    """(keys, draw, m): weighted sum of `total` over weighted sum of `count`; null where a draw is empty."""
    rows = df.select(*keys, F.col(cluster).cast("string").alias("cluster"), F.lit(0.0).alias("s"),
                     F.col(total).cast("double").alias("a"), F.col(count).cast("double").alias("b")).dropna(subset=["a", "b"])
    partial = draw_sums(rows, keys, draws).withColumn("salt", F.spark_partition_id() % SALTS)
    salted = _added(partial, keys, ["salt"])
    return _by_draw(salted, keys, "m", lambda p: np.sum(np.stack(p["a"]), axis=0) / np.sum(np.stack(p["b"]), axis=0))


def _scored(df: DataFrame, keys: list[str], cluster: str, score: str, label: str) -> DataFrame:
    """(keys, cluster, s, a, b): rows with a score and a label; a marks the hits and b the others."""
    return df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).select(
        *keys, F.col(cluster).cast("string").alias("cluster"), F.col(score).cast("double").alias("s"),
        (F.col(label) == 1).cast("double").alias("a"), (F.col(label) == 0).cast("double").alias("b"))


def _binned(rows: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """`rows` with bin, the place of the score among about `bins` quantiles of its keys.

    Equal scores share a bin. Odd bins hold one score, a quantile itself, as every frequent score is.
    """
    edges = rows.groupBy(*keys).agg(F.percentile_approx("s", [i / bins for i in range(1, bins)]).alias("edges"))
    named = edges.select(*[F.col(k).alias(f"__{k}") for k in keys], "edges")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    j = rows.join(named, reduce(Column.__and__, same)) if keys else rows.join(F.broadcast(named))  # one row
    below = F.size(F.filter("edges", lambda e: e < F.col("s")))
    return j.withColumn("bin", below * 2 + F.array_contains("edges", F.col("s")).cast("int")).drop("edges", *named.columns)


def _scan(df: DataFrame, keys: list[str], cluster: str, score: str, label: str, draws: int, names: tuple[str, ...],
          visit: Callable[..., dict[str, np.ndarray]]) -> DataFrame:
    """(block, keys, P, N, names): `visit` sees each range of scores in order, with the weight below it.

    It gets the scores of the range, positives and negatives by (score, draw), both sums below the
    range, and the totals, and returns one vector per name.
    """
    rows = _scored(df, keys, cluster, score, label)
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() * draws * 16 // RANGE_BYTES)
    sums = draw_sums(rows, keys, draws).repartitionByRange(ranges, "block", *keys, "s")
    sums = cut(sums.withColumn("part", F.spark_partition_id()))
    totals = _added(sums, keys, ["part"])

    def below(pdf):
        pdf = pdf.sort_values("part")
        a, b = np.stack(pdf["a"]), np.stack(pdf["b"])
        lists = {"a0": np.cumsum(a, axis=0) - a, "b0": np.cumsum(b, axis=0) - b,
                 "P": np.broadcast_to(a.sum(axis=0), a.shape), "N": np.broadcast_to(b.sum(axis=0), b.shape)}
        return pdf[["block", *keys, "part"]].assign(**{n: list(v) for n, v in lists.items()})

    extra = (sums.schema["part"],)
    carry = totals.groupBy("block", *keys).applyInPandas(below, _schema(sums, keys, "a0", "b0", "P", "N", extra=extra))

    def ordered(here, before):
        here = here.sort_values("s", kind="stable")
        scores, first = np.unique(here["s"].to_numpy(), return_index=True)
        pos, neg = (np.add.reduceat(np.stack(here[n]), first, axis=0) for n in ("a", "b"))
        a0, b0, p, n = (np.asarray(before[c].iloc[0]) for c in ("a0", "b0", "P", "N"))
        return _row(here, ["block", *keys], P=p, N=n, **visit(scores, pos, neg, a0, b0, p, n))

    place = ["block", *keys, "part"]
    return sums.groupBy(*place).cogroup(carry.groupBy(*place)).applyInPandas(ordered, _schema(sums, keys, "P", "N", *names))


def draw_auc(df: DataFrame, keys: list[str], cluster: str, score: str, label: str, draws: int) -> DataFrame:
    """(keys, draw, auc): tie-corrected AUC of each cluster resample; null where a class is missing."""
    def visit(scores, pos, neg, a0, b0, p, n):
        return {"u2": np.sum(pos * (2 * (b0 + np.cumsum(neg, axis=0) - neg) + neg), axis=0)}

    def finish(parts):
        p, n = np.asarray(parts["P"].iloc[0]), np.asarray(parts["N"].iloc[0])
        return np.sum(np.stack(parts["u2"]), axis=0) / (2.0 * p * n)

    return _by_draw(_scan(df, keys, cluster, score, label, draws, ("u2",), visit), keys, "auc", finish)


def draw_lift(df: DataFrame, keys: list[str], row_id: str, score: str, label: str, draws: int,
              quantile: float = 0.8, min_n: int = 20, min_top: int = 5) -> DataFrame:
    """(keys, draw, lift): hit rate at or above each resample's interpolated score quantile, minus its base rate.

    The quantile lies between the scores at two neighbouring ranks. The first pass adds up weights by
    score bin, which tells the bins that hold a rank in some draw; the second draws the rows of these
    bins again, by score, and reports the score at a rank and the rows and hits below it. Null under
    the conditions of `top_lift`.
    """
    names = ("v_lo", "n_lo", "k_lo", "v_hi", "n_hi", "k_hi")
    rows = _scored(df, keys, row_id, score, label)
    n_rows = rows.count()
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, n_rows * draws // TASK_WEIGHTS)
    rows = cut(_binned(rows, keys, max(BINS, n_rows * BLOCK * 16 // RANGE_BYTES)).repartition(tasks))
    place = ["block", *keys, "bin"]
    coarse = cut(_added(draw_sums(rows.withColumn("s", F.col("bin").cast("double")), keys, draws), keys, ["s"]))

    def at(p, n):
        return (p + n - 1) * quantile

    def below(pdf):
        pdf = pdf.sort_values("s")
        a, b = np.stack(pdf["a"]), np.stack(pdf["b"])
        a0, b0, p, n = np.cumsum(a, axis=0) - a, np.cumsum(b, axis=0) - b, a.sum(axis=0), b.sum(axis=0)
        start = a0 + b0
        inside = [(start <= rank) & (rank < start + a + b) for rank in (np.floor(at(p, n)), np.ceil(at(p, n)))]
        lists = {"a0": a0, "b0": b0, "P": np.broadcast_to(p, a.shape), "N": np.broadcast_to(n, a.shape)}
        out = pdf[["block", *keys]].assign(bin=pdf["s"].astype("int32"), **{c: list(v) for c, v in lists.items()})
        wanted = np.logical_or(*inside).any(axis=1)
        wanted[0] |= not wanted.any()
        return out[wanted]

    extra = (rows.schema["bin"],)
    carry = cut(coarse.groupBy("block", *keys).applyInPandas(below, _schema(rows, keys, "a0", "b0", "P", "N", extra=extra)))
    near = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*keys, "bin")]
    wanted = carry.select(*[F.col(c).alias(f"__{c}") for c in (*keys, "bin")]).distinct()
    near_rows = rows.join(wanted, reduce(Column.__and__, near), "left_semi")
    few = near_rows.filter("bin % 2 = 0").repartition(tasks, *keys, "s", F.pmod(F.hash("cluster"), F.lit(SCORE_PARTS)))
    single = near_rows.filter("bin % 2 = 1").select(*[F.col(c).alias(f"__{c}") for c in (*keys, "bin")], "s").distinct()
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*keys, "bin")]
    known = coarse.withColumn("bin", F.col("s").cast("int")).drop("s").join(single, reduce(Column.__and__, same))
    sums = draw_sums(few, [*keys, "bin"], draws)
    sums = sums.unionByName(known.select(sums.columns))

    def visit(scores, pos, neg, a0, b0, p, n):
        hits = a0 + np.cumsum(pos, axis=0)
        rows = hits + b0 + np.cumsum(neg, axis=0)
        place = np.arange(len(p))
        found = {}
        for tag, rank in (("lo", np.floor(at(p, n))), ("hi", np.ceil(at(p, n)))):
            i = np.minimum(np.sum(rows <= rank, axis=0), len(scores) - 1)
            before = rows[i, place] - pos[i, place] - neg[i, place]
            here = (before <= rank) & (rank < rows[i, place])
            for name, value in (("v", scores[i]), ("n", before), ("k", hits[i, place] - pos[i, place])):
                found[f"{name}_{tag}"] = np.where(here, value, np.nan)
        return found

    def ordered(here, before):
        if here.empty or before.empty:
            return pd.DataFrame(columns=out.names, dtype=object)
        scores, group = np.unique(here["s"].to_numpy(), return_inverse=True)
        pos, neg = np.zeros((2, len(scores), len(before["P"].iloc[0])))
        for total, n in ((pos, "a"), (neg, "b")):
            np.add.at(total, group, np.stack(here[n]))
        a0, b0, p, n = (np.asarray(before[c].iloc[0]) for c in ("a0", "b0", "P", "N"))
        return _row(before, ["block", *keys], P=p, N=n, **visit(scores, pos, neg, a0, b0, p, n))

    def finish(parts):
        p, n = np.asarray(parts["P"].iloc[0]), np.asarray(parts["N"].iloc[0])
        f = {c: np.fmax.reduce(np.stack(parts[c]), axis=0) for c in names}
        threshold = f["v_lo"] + (f["v_hi"] - f["v_lo"]) * (at(p, n) - np.floor(at(p, n)))
        above = threshold > f["v_lo"]
        n_top = p + n - np.where(above, f["n_hi"], f["n_lo"])
        k_top = p - np.where(above, f["k_hi"], f["k_lo"])
        ok = (p + n >= min_n) & (n_top >= min_top) & (p > 0) & (n > 0)
        return np.where(ok, k_top / n_top - p / (p + n), np.nan)

    out = _schema(rows, keys, "P", "N", *names)
    found = sums.groupBy(*place).cogroup(carry.groupBy(*place)).applyInPandas(ordered, out)
    return _by_draw(found, keys, "lift", finish)
