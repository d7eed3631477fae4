"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor when the least hash among its inner s-mers is that of its
first or its last one. Whether a k-mer is an anchor depends on nothing outside it, so an edit
changes only the anchors that touch it. A fingerprint keeps the number of anchors and, with their
places, all whose hash is below a fixed share of the range, and the KEEP least ones at any rate, so its
resolution does not fall with the length of a text. Two fingerprints are compared over the hashes that
both cover, by the anchors that occur at one common shift of places.

A k-mer that occurs several times is an anchor at each place, numbered in order. Short texts use
smaller k and s and are alike only to short ones. Null texts count as empty. A text of fewer than
k code points has itself as its one anchor; an empty text has none, and two empty texts are alike (1). Equal texts have equal fingerprints.
The successor of a document is the next greater doc_id; null ids stand first, equal ids in order
of their texts, and the first document follows the last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tapelens.llm.common import BATCH_ROWS, mix, pick, slices

#: k and s, and those of texts with fewer code points than SHORT.
SIZES, SHORT_SIZES, SHORT = (12, 4), (5, 2), 64
#: Least number of anchors kept in a fingerprint, share of hashes that are always kept; shifts of places that count as the same.
KEEP, SHARE, SLACK = 128, 16, 64
LIMIT = np.uint64((1 << 64) // SHARE - 1)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def anchors(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of all closed syncmers; the i-th occurrence of a k-mer has a hash of its own."""
    k, s = SIZES if len(chars) >= SHORT else SHORT_SIZES
    if len(chars) < k:
        h = np.full(min(len(chars), 1), np.uint64(len(chars)), np.uint64)
        for c in chars:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + c)
        return h, np.zeros(len(h), np.int64)
    small = np.full(len(chars) - s + 1, np.uint64(s), np.uint64)
    for i in range(s):
        small = small * np.uint64(0x100000001B3) + chars[i : len(chars) - s + 1 + i]
    small = mix(small)
    inner = k - s + 1  # s-mers inside a k-mer
    least, width = small, 1
    while width < inner:  # sliding minimum by doubling
        step = min(width, inner - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    places = np.flatnonzero((small[: len(least)] == least) | (small[inner - 1 :] == least))
    # the hash of a k-mer from those of s-mers that tile it
    h = np.full(len(places), np.uint64(k), np.uint64)
    for i in range(0, k, s):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + small[places + min(i, k - s)])
    order = np.argsort(h, kind="stable")
    new = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
    number = np.empty(len(h), np.uint64)
    number[order] = np.arange(len(h)) - np.repeat(new, np.diff(np.append(new, len(h))))
    return mix(h + number), places


Print = tuple[int, np.ndarray, np.ndarray]


def fingerprint(text: str) -> Print:
    """Number of anchors, and hashes (ascending) with first places of those kept."""
    h, places = anchors(code_points(text))
    h, first = np.unique(h, return_index=True)
    kept = max(KEEP, int(np.searchsorted(h, LIMIT, "right")))
    return len(h), h[:kept], places[first[:kept]]


def covered(p: Print) -> np.uint64:
    """Up to which hash a fingerprint holds every anchor of its text."""
    return np.uint64((1 << 64) - 1) if len(p[1]) == p[0] else max(p[1][-1], LIMIT)


def written(p: Print) -> str:
    """count/hash@place,...: the fingerprint as text, hashes and places in hexadecimal."""
    return f"{p[0]}/" + ",".join(f"{h:016x}@{x:x}" for h, x in zip(p[1].tolist(), p[2].tolist()))


def likeness(a: Print, b: Print) -> float:
    """Estimated share of anchors in common (Dice), counting only those at one common shift."""
    if not a[0] or not b[0]:
        return float(a[0] == b[0])
    upto = min(covered(a), covered(b))
    union = np.union1d(a[1], b[1])
    union = union[union <= upto]
    both, i, j = np.intersect1d(a[1], b[1], assume_unique=True, return_indices=True)
    inside = both <= upto
    shift = np.sort((a[2][i] - b[2][j])[inside])
    if not len(shift):
        return 0.0
    # the window of shifts that holds most anchors
    together = int((np.searchsorted(shift, shift + SLACK, "right") - np.arange(len(shift))).max())
    jaccard = together / len(union)
    return 2 * jaccard / (1 + jaccard)


OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                 ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many first ones of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def in_ranges(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, text, part, tail): documents in ranges of ids, each range closed by its successor.

    Range borders are ids of the table itself, so the first document of a range is known from its
    id alone; a copy of it, marked as tail, also goes to the range before (from the first to the last).
    """
    docs = pick(docs, doc_id="doc_id", text="text")
    n = docs.count()
    ranges = max(1, min(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 8))
    found = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(ranges)], 20 * ranges).alias("q"),
                     F.min("doc_id").alias("low"), F.count_if(F.isnull("doc_id")).alias("nulls")).first()
    borders = np.array(sorted({*(found.q or []), *([found.low] if found.low is not None else [])}), np.int64)
    parts, nulls = max(1, len(borders)), found.nulls > 0

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series) -> pd.Series:
        none = ids.isna().to_numpy()
        values = ids.fillna(0).to_numpy().astype(np.int64)
        part = np.maximum(np.searchsorted(borders, values, "right") - 1, 0)
        part[none] = 0
        first = ~none & (borders[part] == values) if len(borders) else np.zeros(len(values), bool)
        first &= ~((part == 0) & nulls)
        return pd.Series([[p, (p - 1) % parts] if f else [p] for p, f in zip(part.tolist(), (first | none).tolist())])

    return docs.select("doc_id", "text", F.posexplode(places("doc_id")).alias("tail", "part")), parts


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, and likeness to the edited and to the next text."""
    dealt, parts = in_ranges(docs)
    conf = docs.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # (part, id, text, fingerprint) that waits for its successor
        for batch in batches:
            for piece in slices(batch):
                rows = []
                for doc, text, tail, part in zip(*(piece.column(i).to_pylist() for i in range(4))):
                    text = text or ""
                    own = fingerprint(text) if before is None or before[0] != part or before[2] != text else before[3]
                    if before is not None and before[0] == part:
                        _, last_id, last, last_own = before
                        edited = edited_text(last, text)
                        changed = fingerprint(edited)
                        rows.append((last_id, len(last), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), written(last_own),
                                     written(changed), likeness(last_own, changed), likeness(last_own, own)))
                    before = None if tail else (part, doc, text, own)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), OUT)], schema=OUT)

    ordered = (dealt.repartition(parts, "part").sortWithinPartitions("part", "tail", F.asc_nulls_first("doc_id"), F.coalesce("text", F.lit("")))
               .select("doc_id", "text", "tail", "part"))
    return ordered.mapInArrow(run, from_arrow_schema(OUT))
