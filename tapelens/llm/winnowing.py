"""Benchmark decontamination by winnowing (DataFrame functions only).

Words are runs of digits, a-z and characters outside ASCII, after A-Z are lower-cased. A window is
GUARANTEE consecutive words of an item; an item with fewer words is one window of its own length.
A window length t is served by a scheme: k-grams of k = ceil(t / 2) words, and in every window of
t words (w = t - k + 1 k-grams) the one with the least hash, the leftmost of equals, is kept. Two
texts that share t words share the choice made in them, so no shared window goes unseen.

Document and item fingerprints meet in one equi join. Each carries the few words around it: a hit
is extended to both sides as far as the words agree, at most t - k, which also rejects collisions
of hashes, and counts when it spans t words. Longer passages are the union of the spans of their
fingerprints. Documents are never joined with each other, and their words never leave their row.

The item side is broadcast only when it has at most BROADCAST_ROWS fingerprints (about 300 bytes
each); larger ones go through a shuffled join that splits hot fingerprints at run time.

Each row is a document; repeated rows give repeated results. Null and empty texts have no words.
Items without item_id mark words but are not counted among the items; several rows of one item_id
are one item, windows never cross its rows. An empty benchmark or corpus gives no hits or no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelens.llm.common import pick
from tapelens.session import stored

GUARANTEE = 10
SEPARATOR = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
BROADCAST_ROWS = 200_000


def words_of(text: str = "text") -> Column:
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, SEPARATOR, -1), "")


def gram_of(t: int) -> int:
    """Words of a k-gram in the scheme of windows of t words."""
    return (t + 1) // 2


def windows(rows: DataFrame, t: int) -> DataFrame:
    """`rows` (with w, the words) once for each window of t words, with key and pos of the k-gram that winnowing keeps.

    The row at = -1 stands for the text itself; it and windows whose choice is that of the window
    before have no key. Hash and place share one long, so that the least is also the leftmost.
    Exploding the places keeps the word array in its row: every window reads its few elements.
    """
    k, reach = gram_of(t), t - gram_of(t)
    hashed = rows.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    places = F.when(F.size("w") >= t, F.sequence(F.lit(-1), F.size("w") - t)).otherwise(F.array(F.lit(-1)))
    at = hashed.withColumn("at", F.explode(places))
    gram = lambda i: F.xxhash64(F.lit(t), *[F.get("h", i + j) for j in range(k)])
    placed = lambda i: F.shiftleft(F.shiftright(gram(i), 31), 31).bitwiseOR(i.cast("long"))
    grams = at.select("*", *[placed(F.col("at") + j).alias(f"v{j + 1}") for j in range(-1, reach + 1)])
    least = lambda cols: F.least(*cols) if len(cols) > 1 else cols[0]
    mins = grams.select(*rows.columns, "h", "at", least([F.col(f"v{j}") for j in range(1, reach + 2)]).alias("now"),
                        least([F.col(f"v{j}") for j in range(reach + 1)]).alias("before"))
    pos = F.when(F.col("at") >= 0, F.col("now").bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
    fresh = (F.col("at") == 0) | ((F.col("at") > 0) & (F.col("now") != F.col("before")))
    return mins.select(*rows.columns, "at", "h", fresh.alias("fresh"), pos.alias("pos")).select(
        *rows.columns, "at", F.lit(t).alias("t"), "pos", F.when(F.col("fresh"), gram(F.col("pos"))).alias("key"))


def around(t: int) -> Column:
    """The k-gram at `pos` between its t - k neighbours on each side, null beyond the text."""
    return F.array(*[F.get("w", F.col("pos") + j) for j in range(gram_of(t) - t, t)])


def item_fingerprints(items: DataFrame, guarantee: int = GUARANTEE) -> tuple[DataFrame, dict[int, int]]:
    """(item_id, t, key, i_around) of every item, and their number for each window length t.

    Items shorter than a window have a scheme of their own length.
    """
    rows = items.select("item_id", words_of().alias("w")).withColumn("own", F.least(F.size("w"), F.lit(guarantee))).filter("own > 0")
    lengths = sorted(r.own for r in rows.select("own").distinct().collect())  # at most `guarantee` rows
    parts = [windows(rows.filter(F.col("own") == t), t).filter("key IS NOT NULL").select("item_id", "t", "key", around(t).alias("i_around")) for t in lengths]
    out = items.sparkSession.createDataFrame([], "item_id bigint, t int, key bigint, i_around array<string>")
    for p in parts:
        out = p if p is parts[0] else out.unionByName(p)
    out = stored(out.distinct(), "item-fingerprints")
    return out, {r.t: r["count"] for r in out.groupBy("t").count().collect()} if parts else {}


def hits(rows: DataFrame, prints: DataFrame, t: int, small: bool) -> DataFrame:
    """(doc_id, t1, t2, n, item_id, span) of what is shared with items in the scheme of t; n only in the row of the text itself."""
    k, reach = gram_of(t), t - gram_of(t)
    side = prints.filter(F.col("t") == t).select("item_id", F.col("key").alias("i_key"), "i_around")
    flat = windows(rows, t).withColumn("text_row", F.col("at") < 0).drop("at", "t")
    meets = F.col("key") == F.col("i_key")
    if small:  # in the same task, so a text's words need not be cut out before the join
        met = flat.join(F.broadcast(side), meets, "left").filter(F.col("text_row") | F.col("i_key").isNotNull()).withColumn("d_around", F.when(~F.col("text_row"), around(t)))
    else:
        cut = flat.filter(F.col("text_row") | F.col("key").isNotNull()).withColumn("d_around", F.when(~F.col("text_row"), around(t))).drop("w")
        spread = cut.withColumn("key", F.when(F.col("text_row"), F.col("t1")).otherwise(F.col("key")))
        met = spread.join(side, meets & ~F.col("text_row"), "left")
    # written before the words are compared: that filter would otherwise move below the join and copy the words for each window
    met = stored(met.select("doc_id", "t1", "t2", F.when(F.col("text_row"), F.col("n")).alias("n"), "item_id", "pos", "d_around", "i_around"), f"fingerprint-hits-{t}")
    met = met.withColumn("agree", F.zip_with("d_around", "i_around", lambda a, b: F.coalesce(a == b, F.lit(False))))

    def run(steps) -> Column:
        """How many of the places agree one after the other."""
        out = F.lit(reach)
        for j, place in reversed(list(enumerate(steps))):
            out = F.when(F.get("agree", F.lit(place)), out).otherwise(j)
        return out

    grown = met.select("*", run(range(reach - 1, -1, -1)).alias("left"), run(range(reach + k, t + reach)).alias("right"))
    equal = F.forall(F.slice("agree", reach + 1, k), lambda x: x)
    shared = equal & (F.col("left") + k + F.col("right") >= t)
    start, end = F.col("pos") - F.col("left"), F.col("pos") + k + F.col("right")
    span = F.when(F.col("n").isNull(), F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))
    return grown.filter(F.col("n").isNotNull() | shared).select("doc_id", "t1", "t2", "n", "item_id", span.alias("span"))


def contaminated(docs: DataFrame, items: DataFrame, guarantee: int = GUARANTEE, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, spans, items) of every row.

    `spans` are the (start, end) word ranges found, merged where they touch, end exclusive; `items` the
    distinct item ids with a window in the text.
    """
    docs, items = pick(docs, doc_id=id_col, text=text_col), pick(items, item_id=item_col, text=item_text_col)
    prints, sizes = item_fingerprints(items, guarantee)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2"), words_of().alias("w")).withColumn("n", F.size("w"))
    found = None
    for t in sorted(sizes) or [guarantee]:
        part = hits(rows, prints, t, sizes.get(t, 0) <= BROADCAST_ROWS)
        # the row of the text itself comes with the first scheme only
        found = part if found is None else found.unionByName(part.filter("span IS NOT NULL"))
    by_text = found.groupBy("doc_id", "t1", "t2").agg(F.max("n").cast("long").alias("n_words"), F.count("n").cast("int").alias("rows"),
                                                      F.collect_set("span").alias("spans"), F.collect_set("item_id").alias("items"))
    return by_text.select("doc_id", "n_words", merged(F.col("spans")).alias("spans"), "items", F.explode(F.array_repeat(F.lit(0), F.col("rows")))).drop("col")


def merged(spans: Column) -> Column:
    """Sorted union of ranges: those that overlap or touch become one."""
    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (s["start"] <= last["end"])
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end")).cast("struct<start:int,end:int>")
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(s)))
    return F.aggregate(F.sort_array(spans), F.array().cast("array<struct<start:int,end:int>>"), add)


def report(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS t FROM (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, t, array_to_string(w[i : i + t - 1], ' ') AS g FROM (SELECT item_id, t, w, unnest(range(1, len(w) - t + 2)) AS i FROM b)),
dw AS (SELECT doc_id, t, i, array_to_string(w[i : i + t - 1], ' ') AS g
       FROM (SELECT doc_id, w, t, unnest(range(1, len(w) - t + 2)) AS i FROM d, (SELECT DISTINCT t FROM b))),
hit AS (SELECT doc_id, i, t, item_id FROM dw JOIN bw USING (t, g)),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + t)) AS j FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN found ON d.doc_id = found.doc_id"""
