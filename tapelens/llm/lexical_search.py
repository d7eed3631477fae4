"""Ranked lexical search by an Aho-Corasick scan of the documents; there is no document index.

The terms of all items make one automaton, each guarded by a blank on both sides. A document is
scanned once, with A-Z lower-cased and every byte that is no term character blanked, so a match is a
whole term; its outputs are term numbers, and postings map those to the items that hold the term.
A first scan counts documents, terms and document frequencies, a second one scores each document and
keeps, per task, the best rows of each item; Spark then ranks those few.

Item terms are counted in Spark and broadcast in blocks of at most about BLOCK_BYTES of terms, one
pair of scans for each block, so neither the automaton nor the postings grow without bound. Scores
are 64-bit integers; weights are rounded down from doubles.

Every row is a document: rows of one doc_id are ranked apart, rows without doc_id count everywhere
and rank last among equal scores. Rows of one item_id (null too) are one item. Null and empty texts
have no terms; an item without terms, or whose terms no document holds, has no result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tapelens.llm.common import arrow_map, pick, slices
from tapelens.session import stored

BLOCK_BYTES = 16 << 20
TOP = 20
#: Cells of the score matrix that a task holds at once.
CELLS = 1 << 20
NO_ID = np.iinfo(np.int64).max
#: Each byte as it is scanned: A-Z lower-cased, other ASCII than digits and letters blanked, UTF-8 kept.
SCANNED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

ITEM_TERMS = pa.schema([("item_id", pa.int64()), ("term", pa.binary())])
COUNTS = pa.schema([("term", pa.int64()), ("n", pa.int64())])
BEST = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def scanned(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(SCANNED)


class Terms:
    """The automaton of a block of items and the postings of its terms."""

    def __init__(self, terms: list[bytes]):
        self.automaton = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            self.automaton.add_word(f" {term.decode('latin-1')} ", i)
        self.automaton.make_automaton()

    def counts(self, text: str | None) -> tuple[int, Counter]:
        """(number of terms, occurrences of each known term) of a whole text."""
        body = scanned(text)
        return len(body.split()), Counter(map(itemgetter(1), self.automaton.iter(f" {body.decode('latin-1')} ")))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, qtf): how often an item holds a term."""
    def step(cols):
        found = [(i, w) for i, t in zip(cols["item_id"], cols["text"]) for w in scanned(t).split()]
        return {"item_id": [i for i, _ in found], "term": [w for _, w in found]}

    return arrow_map(items, ITEM_TERMS, step).groupBy("item_id", "term").agg(F.count("*").alias("qtf"))


def saturation(tf: np.ndarray, m: int) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def statistics(docs: DataFrame, block) -> dict[int, int]:
    """Document frequency of each term number; -1 documents with a term, -2 terms with repeats."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, total = Terms(block.value["terms"]), Counter()
        for batch in batches:
            for part in slices(batch):
                for text in part.column(0).to_pylist():
                    n, found = terms.counts(text)
                    total.update(found.keys())
                    total.update({-1: int(n > 0), -2: n})
        yield pa.RecordBatch.from_pydict({"term": list(total.keys()), "n": list(total.values())}, schema=COUNTS)

    counted = docs.select("text").mapInArrow(count, from_arrow_schema(COUNTS)).groupBy("term").agg(F.sum("n").alias("n"))
    return {r.term: r.n for r in counted.collect()}  # one row for each term of the block


class Best:
    """The TOP best (score, least id) of each item among the documents seen."""

    def __init__(self, items: int, top: int):
        self.top, self.floor = top, np.ones(items, np.int64)
        self.rows = tuple(np.empty(0, np.int64) for _ in range(3))

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        doc, item = np.nonzero(scores >= self.floor)
        if len(doc) == 0:
            return
        item, score, ids = (np.concatenate(p) for p in zip(self.rows, (item, scores[doc, item], ids[doc])))
        order = np.lexsort((ids, -score, item))
        item, score, ids = item[order], score[order], ids[order]
        first = np.searchsorted(item, item)
        rank = np.arange(len(item)) - first
        last = rank == self.top - 1
        self.floor[item[last]] = score[last]  # an equal score may still win by its id
        keep = rank < self.top
        self.rows = item[keep], score[keep], ids[keep]


def best_of_task(docs: DataFrame, block, top: int) -> DataFrame:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        terms, best = Terms(b["terms"]), Best(b["items"], top)
        start, holders, qtf, weights = b["start"], b["holders"], b["qtf"], b["weights"]
        rows = max(1, CELLS // b["items"])

        def flush(group: list[tuple[int, int, Counter]]) -> None:
            scores = np.zeros((len(group), b["items"]), np.int64)
            for at, (_, m, found) in enumerate(group):
                t = np.fromiter(found.keys(), np.int64, len(found))
                part = weights[t] * saturation(np.fromiter(found.values(), np.int64, len(found)), m)
                size = start[t + 1] - start[t]
                # places of all postings of the terms, one run after the other
                places = np.repeat(start[t] - np.cumsum(size) + size, size) + np.arange(size.sum())
                np.add.at(scores[at], holders[places], np.repeat(part, size) * qtf[places])
            best.add(scores, np.array([NO_ID if i is None else i for i, _, _ in group], np.int64))

        for batch in batches:
            for part in slices(batch):
                group = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    n, found = terms.counts(text)
                    if found:
                        group.append((doc_id, 100 - 25 + 25 * n * b["n_docs"] // b["n_terms"], found))
                    if len(group) == rows:
                        flush(group)
                        group = []
                if group:
                    flush(group)
        item, value, ids = best.rows
        yield pa.RecordBatch.from_pydict({"item": item, "doc_id": ids, "score": value}, schema=BEST)

    return docs.select("doc_id", "text").mapInArrow(score, from_arrow_schema(BEST))


def searched(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score) of the `top` best documents of every item."""
    spark = docs.sparkSession
    docs, items = pick(docs, doc_id=id_col, text=text_col), pick(items, item_id=item_col, text=item_text_col)
    terms = stored(item_terms(items), "item-terms")
    size = terms.agg(F.sum(F.length("term") + 24).alias("bytes")).first().bytes or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    found = spark.createDataFrame([], "item_id bigint, doc_id bigint, score bigint")
    for i in range(blocks):
        # about BLOCK_BYTES of distinct (item, term) rows
        rows = terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).orderBy("item_id", "term").collect()
        if rows:
            found = found.unionByName(block_best(docs, rows, top))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("item_id", "rank", F.when(F.col("doc_id") < int(NO_ID), F.col("doc_id")).alias("doc_id"), "score")


def block_best(docs: DataFrame, rows: list, top: int) -> DataFrame:
    """(item_id, doc_id, score): the best rows of every task for one block of items."""
    spark = docs.sparkSession
    ids = list(dict.fromkeys(r.item_id for r in rows))
    item_at = {x: i for i, x in enumerate(ids)}
    names = sorted({bytes(r.term) for r in rows})
    term_at = {x: i for i, x in enumerate(names)}
    term = np.array([term_at[bytes(r.term)] for r in rows])
    by_term = np.argsort(term, kind="stable")
    block = {"terms": names, "items": len(ids), "start": np.searchsorted(term[by_term], np.arange(len(names) + 1)),
             "holders": np.array([item_at[r.item_id] for r in rows])[by_term], "qtf": np.array([r.qtf for r in rows], np.int64)[by_term]}
    count = statistics(docs, spark.sparkContext.broadcast(block))
    n_docs = count.get(-1, 0)
    block |= {"n_docs": n_docs, "n_terms": max(count.get(-2, 0), 1),
              "weights": np.array([weight(n_docs, count.get(i, 0)) for i in range(len(names))], np.int64)}
    best = best_of_task(docs, spark.sparkContext.broadcast(block), top)
    of_item = F.broadcast(spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "item int, item_id bigint"))  # ids of one block
    return best.join(of_item, "item").select("item_id", "doc_id", "score")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT count(*) FILTER (WHERE len(w) > 0)::BIGINT AS N, sum(len(w))::BIGINT AS L FROM d),
tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
wt AS (SELECT term, floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM tf, s GROUP BY term, N),
part AS (SELECT row, term, weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * len(w) * N) // L)))) AS part FROM tf JOIN wt USING (term) JOIN d USING (row), s),
score AS (SELECT item_id, row, sum(part * qtf)::BIGINT AS score FROM part JOIN q USING (term) GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM score JOIN d USING (row) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20"""
