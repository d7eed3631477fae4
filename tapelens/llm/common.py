"""Shared pieces of the text operators: column picking, Arrow maps, word hashes, bounded samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tapelens.session import stored

#: Rows of one Arrow batch and bytes a Python step takes at once.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20
#: Tasks whose tables one task adds up.
FAN_IN = 8

WHITESPACE = " \t\n\r\x0b\x0c"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under new names: ``pick(df, doc_id="id")``.

    Columns are found by exact name (else ignoring case) and position, so further columns
    may have any names, also ones that clash with these or with each other.
    """
    lower = [c.lower() for c in df.columns]
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    at = {new: df.columns.index(old) if old in df.columns else lower.index(old.lower()) for new, old in columns.items()}
    return plain.select(*[F.col(f"_c{i}").alias(new) for new, i in at.items()])


def arrow_map(df: DataFrame, schema: pa.Schema, step: Callable[[dict[str, list]], dict[str, list]]) -> DataFrame:
    """mapInArrow with bounded batches: `step` takes and returns columns as lists."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = step(part.to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return df.mapInArrow(run, from_arrow_schema(schema))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most `rows` rows for what is executed inside: for frames of wide rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before or BATCH_ROWS)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about BATCH_BYTES each; one very long row is a part of its own."""
    rows = max(1, int(batch.num_rows * BATCH_BYTES / max(batch.nbytes, 1)))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def words_of(text: str) -> list[bytes]:
    """Runs of ``[^\\x20\\x09-\\x0D]`` as UTF-8 (bytes.split knows exactly these separators)."""
    return text.encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """Sorted distinct hashes of all n-word windows; fewer words are one shingle, none give none."""
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    k = min(n, len(words))
    out = np.full(len(h) - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def bounded_sample(df: DataFrame, key: str, bound: int) -> DataFrame:
    """About `bound` rows of `df` by hash of `key`: the same ones for the same table, any partitioning."""
    share = min(1.0, bound / max(df.count(), 1))
    spread = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30))
    return df.filter(spread < int(share * (1 << 30)) + (share >= 1))


def quality_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, label): one row per labelled document, the majority of repeated rows; nulls are left out."""
    rows = pick(labels, doc_id="doc_id", quality="quality").dropna()
    return rows.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))


def packed(total: np.ndarray, sparse: bool = False) -> pa.RecordBatch:
    """One row with a compressed array; a sparse one as the bits of its entries that are not zero, then these entries."""
    raw = np.packbits(total != 0).tobytes() + total[total != 0].tobytes() if sparse else total.tobytes()
    return pa.RecordBatch.from_pydict({"part": pa.array([zstandard.compress(raw, 1)], pa.binary())})


def unpacked(part: bytes, zero: np.ndarray, sparse: bool = False) -> np.ndarray:
    raw = zstandard.decompress(part)
    if not sparse:
        return np.frombuffer(raw, zero.dtype)
    out, bits = np.zeros_like(zero), -(-len(zero) // 8)
    out[np.unpackbits(np.frombuffer(raw, np.uint8, bits), count=len(zero)).view(bool)] = np.frombuffer(raw, zero.dtype, offset=bits)
    return out


def summed_parts(parts: DataFrame, add, zero: np.ndarray, sparse: bool = False) -> np.ndarray:
    """Combine arrays of one fixed size: no task adds up more than FAN_IN of them, then one array goes to the driver."""
    kind, size = zero.dtype, len(zero)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, kind)
        for batch in batches:
            for row in batch.column(0):
                total = add(total, unpacked(row.as_py(), total, sparse))
        yield packed(total, sparse)

    n = parts.rdd.getNumPartitions()
    parts = stored(parts, "parts")  # the scan runs with its own batches; one-row batches are for the arrays only
    with arrow_rows(parts.sparkSession, 1):
        while n > 1:
            n = -(-n // FAN_IN)
            parts = parts.repartition(n).mapInArrow(combine, "part binary")
        for r in parts.collect():
            zero = add(zero, unpacked(r.part, zero, sparse))
    return zero
