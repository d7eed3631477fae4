"""Line deduplication over levelled sorted runs of line hashes (DataFrame operations only).

Documents come in batches of falling doc_id. A batch is reduced to one row per line key; the keys
that no run holds (merge anti join) are fresh and enter a new run with their keeper, the largest
doc_id of the batch; known keys enter it with their number of documents alone. FANOUT runs of a
level are compacted into one of the next level, so a key is rewritten a logarithmic number of
times. After the last batch the runs tell, for each key, in how many documents it occurs and which
one keeps its lines.

A key is the line without white space at both ends, with A-Z in lower case; short keys stay. Null
and empty texts are one empty line. Rows of one doc_id are one document, rows without doc_id are
one document below all others. Lines of a key that occurs several times in its keeper all stay.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelens.llm.common import WHITESPACE, pick
from tapelens.session import shared_path, stored

MIN_CHARS, MIN_DOCS = 20, 3
BATCHES, FANOUT = 4, 2
ENTRY_DDL = "h1 bigint, h2 bigint, doc_id bigint, row bigint, pos int, batch int"
RUN_DDL = "h1 bigint, h2 bigint, n bigint, keeper bigint"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITESPACE)), string.ascii_uppercase, string.ascii_lowercase)


def lines_of(text: str = "text") -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def row_key(text: str = "text") -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


class LineRuns:
    """Levelled sorted runs (h1, h2, n, keeper) below one folder."""

    def __init__(self, spark):
        self.spark, self.levels = spark, {}

    def read(self) -> DataFrame:
        paths = [p for level in self.levels.values() for p in level]
        return self.spark.read.schema(RUN_DDL).parquet(*paths) if paths else self.spark.createDataFrame([], RUN_DDL)

    def add(self, batch: DataFrame) -> None:
        """Merge-anti-join a batch (h1, h2, n, keeper) of distinct keys with the runs and add its own run."""
        if self.levels:
            known = self.read().select("h1", "h2").hint("merge")
            fresh = batch.join(known, ["h1", "h2"], "left_anti")
            again = batch.join(known, ["h1", "h2"], "left_semi").withColumn("keeper", F.lit(None).cast("bigint"))
            batch = fresh.unionByName(again)
        self.write(batch, 0)
        level = 0
        while len(self.levels.get(level, [])) >= FANOUT:
            old = self.levels.pop(level)
            self.write(summed(self.spark.read.schema(RUN_DDL).parquet(*old)), level + 1)
            for path in old:
                remove(self.spark, path)
            level += 1

    def write(self, rows: DataFrame, level: int) -> None:
        path = shared_path(self.spark, f"line-run-{level}")
        rows.select("h1", "h2", "n", "keeper").sortWithinPartitions("h1", "h2").write.parquet(path)
        self.levels.setdefault(level, []).append(path)


def summed(runs: DataFrame) -> DataFrame:
    return runs.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))


def remove(spark, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def line_entries(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(batch, h1, h2, doc_id, row, pos) of all lines with a long key; batch 0 has the largest ids."""
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000).alias("q")).first().q or []
    batch = sum((F.when(F.col("doc_id") >= c, 0).otherwise(1) for c in cuts), F.lit(0))
    lines = docs.select("doc_id", F.coalesce(batch, F.lit(batches - 1)).alias("batch"), row_key().alias("row"), F.posexplode(lines_of()).alias("pos", "line"))
    keyed = lines.withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= MIN_CHARS)
    return keyed.select("batch", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc_id", "row", "pos")


def repeated_keys(entries: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(h1, h2, keeper) of keys found in MIN_DOCS documents or more."""
    runs = LineRuns(entries.sparkSession)
    for i in range(batches):
        part = entries.filter(F.col("batch") == i)
        # one row per key and document first: a hot key is spread over its documents
        runs.add(part.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")))
    return summed(runs.read()).filter(F.col("n") >= MIN_DOCS).select("h1", "h2", "keeper")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, drop): the sorted places of the lines that each row loses; rows that lose none are absent."""
    docs = pick(docs, doc_id=id_col, text=text_col)
    path = shared_path(docs.sparkSession, "line-entries")
    line_entries(docs).write.partitionBy("batch").parquet(path)
    entries = docs.sparkSession.read.schema(ENTRY_DDL).parquet(path)
    repeated = stored(repeated_keys(entries), "repeated-lines")
    lost = entries.join(repeated, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.select("doc_id", "row", "pos").distinct().groupBy("doc_id", "row").agg(F.collect_list("pos").alias("drop"))


def with_kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The given rows with n_lines, n_dropped and kept_text."""
    drops = dedup_lines(docs, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), F.col("drop").alias("__drop"))
    at = {c: i for i, c in reversed(list(enumerate(docs.columns)))}
    plain = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    rows = plain.withColumn("__text", F.coalesce(F.col(f"_c{at[text_col]}"), F.lit(""))).withColumn("__key", row_key("__text"))
    rows = rows.join(drops, F.col(f"_c{at[id_col]}").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__row")), "left")
    lines = rows.withColumn("__lines", lines_of("__text"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop"))
    kept = F.when(F.col("__drop").isNull(), F.col("__text")).otherwise(F.array_join(F.transform(stay, lambda i: F.element_at(F.col("__lines"), i + 1)), "\n"))
    return lines.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)], F.size("__lines").cast("long").alias("n_lines"),
                        F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))


SQL = """
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
repeated AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT l.doc_id, l.pos, l.line, r.key IS NOT NULL AND l.doc_id <> r.keeper AS gone FROM lines l LEFT JOIN repeated r ON l.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""
