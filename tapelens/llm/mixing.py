"""Temperature mixing of sources (DataFrame operations only).

A source's share of all tokens is raised to an exponent between 0 (all sources equal) and 1 (as
they are) and normalised. Bisection finds the exponent: the largest one whose weights reach the
target entropy, raised where needed until no source is read more often than the repetition limit.
Every source is then read in epochs, each a permutation of its documents by hash, until its token
budget is used up, and the stream of copies is cut into blocks, each of which holds all sources in
the target proportion.

A document counts one token for each word and one for its end, so that empty and null texts take
part. A null source is a source of its own. Rows with the same doc_id and text come to the same
place. An empty table gives no rows. A limit that the budget alone exceeds leaves the shares as
they are (exponent 1).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelens.functions.ordered import split_running_sum
from tapelens.llm.common import pick
from tapelens.session import stored

#: The exponent is a multiple of 1 / STEPS.
STEPS = 1024
ENTROPY, REPETITION, BLOCKS = 0.95, 4.0, 64


def token_count(text: str = "text") -> Column:
    return (F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")) + 1).cast("long")


def order_key(doc_id: str, row: str, epoch: Column) -> Column:
    """Place of a document in the permutation of an epoch."""
    return F.md5(F.concat_ws("-", F.col(doc_id).cast("string"), F.col(row), epoch.cast("string")).cast("binary"))


@dataclass
class Mix:
    exponent: float
    budget: int
    sources: DataFrame  # source, tokens, quota


def measured(sources: DataFrame, k: int, total: int) -> tuple[float, float, float]:
    """Entropy of the weights at exponent k / STEPS, and the largest and least weight over share."""
    p = F.col("tokens") / F.lit(float(total))
    raised = F.pow(p, F.lit(k / STEPS))
    r = sources.agg(F.sum(raised).alias("z"), F.sum(raised * F.log(raised)).alias("e"), F.max(raised / p).alias("most"), F.min(raised / p).alias("least")).first()
    return math.log(r.z) - r.e / r.z, r.most / r.z, r.least / r.z


def fit_mix(sources: DataFrame, entropy: float = ENTROPY, repetition: float = REPETITION, budget: int | None = None, whole: bool = False) -> Mix:
    """Bisect the exponent and give each source its quota of tokens.

    `entropy` is a share of the greatest one, ln(number of sources). The budget is `budget` tokens,
    else all tokens of the table; `whole` makes it the least one that reads every document once.
    """
    total, n = sources.agg(F.sum("tokens"), F.count("*")).first()
    if not n:
        return Mix(1.0, 0, sources.withColumn("quota", F.lit(0).cast("long")))
    size = lambda most, least: (1 / least if whole else (budget or total) / total)  # noqa: E731  budget over total
    target = entropy * math.log(n) - 1e-12

    def bisect(good, low: int, high: int) -> int:
        """The largest k in low..high with good(k), where good holds up to some k; else low."""
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if good(mid) else (low, mid - 1)
        return low

    even = bisect(lambda k: measured(sources, k, total)[0] >= target, 0, STEPS)

    def too_often(k: int) -> bool:
        _, most, least = measured(sources, k, total)
        return most * size(most, least) > repetition + 1e-12

    k = even if not too_often(even) else min(STEPS, bisect(too_often, even, STEPS) + 1)
    z = sources.agg(F.sum(F.pow(F.col("tokens") / F.lit(float(total)), F.lit(k / STEPS)))).first()[0]
    weight = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(k / STEPS)) / F.lit(z)
    if whole:
        # to the next token, so that no source falls short of one epoch
        quota = F.greatest(F.ceil(weight * F.lit(total / measured(sources, k, total)[2] / 1.0)), F.col("tokens"))
    else:
        quota = F.floor(weight * F.lit(float(budget or total)) + F.lit(1e-6))
    sources = sources.withColumn("quota", quota.cast("long"))
    return Mix(k / STEPS, int(sources.agg(F.sum("quota")).first()[0]), sources)


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, row, source, n_tokens), written once."""
    rows = pick(docs, doc_id=id_col, text=text_col, source=source_col)
    row = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return stored(rows.select("doc_id", row.alias("row"), "source", token_count().alias("n_tokens")), "mix-tokens")


def mixed(rows: DataFrame, blocks: int = BLOCKS, **options) -> tuple[DataFrame, Mix]:
    """Copies (doc_id, source, n_tokens, epoch, block, place) of counted documents."""
    mix = fit_mix(stored(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "mix-sources"), **options)
    quotas = stored(mix.sources, "mix-quotas").withColumnRenamed("source", "of")
    joined = rows.join(quotas, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    copies = joined.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("quota") / F.col("tokens")))).alias("epoch"))
    copies = stored(copies.withColumn("key", order_key("doc_id", "row", F.col("epoch"))), "mix-copies")  # the running sum reads it twice
    # running tokens inside one epoch of one source, in cells of the key: a hot source is spread
    summed = split_running_sum(copies.withColumn("__source", F.struct(F.col("source").isNull(), F.coalesce("source", F.lit("")))), ["__source", "epoch"],
                               [F.col("key"), F.col("doc_id"), F.col("row")], F.substring("key", 1, 3), F.col("n_tokens"), "upto")
    end = F.col("epoch") * F.col("tokens") + F.col("upto")
    block = F.floor((end - F.col("n_tokens")) * F.lit(blocks) / F.col("quota")).cast("long")
    return summed.filter(end <= F.col("quota")).select("doc_id", "row", "source", "n_tokens", "epoch", block.alias("block"), F.col("key").alias("place")), mix


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The given rows, each as often as the mix has it.

    Whole epochs repeat a source's rows; of the last one it takes those up to a key, so rows need
    only their source's line of a small table and no text is shuffled.
    """
    copies, mix = mixed(counted(docs, id_col, text_col, source_col), **options)
    last = F.floor(F.col("quota") / F.col("tokens"))
    part = copies.groupBy("source", "epoch").agg(F.max("place").alias("upto"))
    plan = mix.sources.select(F.col("source").alias("of"), last.alias("times"))
    plan = plan.join(part, F.col("of").eqNullSafe(F.col("source")) & (F.col("times") == F.col("epoch")), "left").select("of", "times", "upto")
    plan = stored(plan, "mix-plan")
    at = {c: i for i, c in reversed(list(enumerate(docs.columns)))}
    plain = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    plain = plain.withColumn("__row", F.md5(F.coalesce(F.col(f"_c{at[text_col]}"), F.lit("")).cast("binary")))
    rows = plain.join(plan, F.col(f"_c{at[source_col]}").eqNullSafe(F.col("of")))
    extra = F.coalesce(order_key(f"_c{at[id_col]}", "__row", F.col("times")) <= F.col("upto"), F.lit(False)).cast("long")
    rows = rows.withColumn("__n", F.col("times") + extra).filter("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    return rows.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])


SQL = f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, coalesce(text, '') AS body, md5(coalesce(text, '')) AS row_key,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) + 1 AS n_tokens FROM documents),
sources AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM rows_ GROUP BY source),
total AS (SELECT CAST(sum(tokens) AS BIGINT) AS t, count(*) AS n FROM sources),
tried AS (
  SELECT k, ln(sum(r)) - sum(r * ln(r)) / sum(r) AS entropy, max(r / p) / sum(r) AS most, sum(r) AS z
  FROM (SELECT k, tokens / t::DOUBLE AS p, pow(tokens / t::DOUBLE, k / {STEPS}.0) AS r FROM sources, total, range(0, {STEPS} + 1) s(k)) GROUP BY k),
even AS (SELECT coalesce(max(k), 0) AS k FROM tried, total WHERE entropy >= {ENTROPY} * ln(n) - 1e-12),
chosen AS (SELECT greatest((SELECT k FROM even), coalesce((SELECT min(k) FROM tried WHERE most <= {REPETITION} + 1e-12), {STEPS})) AS k),
quotas AS (
  SELECT source, tokens, CAST(floor(pow(tokens / t::DOUBLE, c.k / {STEPS}.0) / z * t + 1e-6) AS BIGINT) AS quota
  FROM sources, total, chosen c JOIN tried USING (k)),
copies AS (
  SELECT r.doc_id, r.row_key, r.source, r.n_tokens, q.tokens, q.quota, e.epoch,
         md5(concat_ws('-', CAST(r.doc_id AS VARCHAR), r.row_key, CAST(e.epoch AS VARCHAR))) AS place
  FROM rows_ r JOIN quotas q ON r.source IS NOT DISTINCT FROM q.source, LATERAL (SELECT unnest(range(0, q.quota // q.tokens + 1)) AS epoch) e),
placed AS (SELECT *, epoch * tokens + CAST(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY place, doc_id, row_key ROWS UNBOUNDED PRECEDING) AS BIGINT) AS done FROM copies)
SELECT doc_id, source, n_tokens, epoch, (done - n_tokens) * {BLOCKS} // quota AS block, place FROM placed WHERE done <= quota"""
