"""WARC archives, Zstandard-compressed: writer and reader.

An archive is a leading skippable frame with the dictionary, then one frame per record, so that
any record can be decoded alone. Pages with equal payloads are one response (that of the largest
page_id) and revisits of it. The writer fills archives of bounded size from each partition and
writes them as rows (name, content) of a table in the shared folder, since executors share no
other store; `export` puts them as files into a folder that all executors mount, and both forms
are read back alike. The reader loads the dictionary, decodes frame by frame, and validates
version line, required fields, lengths and digests.

Null html is an empty payload. Repeated rows of one page_id with the response's payload are all
responses; rows without page_id are responses only if no page with an id has their payload.
A broken archive raises ValueError with the name of the archive and the offset.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tapelens.llm.common import pick
from tapelens.session import stored

#: Payload bytes of one archive, bytes of a dictionary, payload bytes it is trained on, longest part of one sample.
ARCHIVE_BYTES, DICTIONARY_BYTES, TRAIN_BYTES, SAMPLE_BYTES = 4 << 20, 32 << 10, 1 << 20, 16 << 10
LEVEL = 3
SKIPPABLE = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Time stamp of records that come without one, so that archives repeat bit by bit.
DATE = "1970-01-01T00:00:00Z"

ARCHIVES = pa.schema([("name", pa.string()), ("records", pa.int64()), ("content", pa.binary())])
RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                     ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit with the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [("WARC-Type", "revisit" if refers_to is not None else "response"), ("WARC-Record-ID", urn(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)))
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", urn(refers_to))]
    fields += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"),
               ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(value: str) -> int | None:
    if not (value.startswith("<urn:page:") and value.endswith(">")):
        raise ValueError(f"not a page: {value}")
    return None if value[10:-1] == "none" else int(value[10:-1])


def archive(records: list[bytes]) -> bytes:
    """Dictionary frame, then one frame per record. Too little text for a dictionary leaves it out."""
    dictionary, out = None, []
    samples, size = [], 0
    for r in records:
        if size >= TRAIN_BYTES:
            break
        samples.append(r[:SAMPLE_BYTES])
        size += len(samples[-1])
    if len(samples) >= 16 and size >= 8 * DICTIONARY_BYTES // 4:
        try:
            dictionary = zstandard.train_dictionary(min(DICTIONARY_BYTES, size // 8), samples, k=256, d=8)
        except zstandard.ZstdError:
            dictionary = None  # samples without anything in common
    if dictionary is not None:
        data = dictionary.as_bytes()
        out.append(struct.pack("<II", SKIPPABLE, len(data)) + data)
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
    return b"".join(out + [pack.compress(r) for r in records])


def frames(content: bytes, name: str = "archive") -> Iterator[tuple[int, bytes]]:
    """(offset, record bytes) of every frame; the dictionary comes from the leading skippable frame."""
    at, dictionary = 0, None
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", content, 4)[0]
        if 8 + size > len(content):
            raise ValueError(f"{name}: dictionary frame of {size} bytes is cut off")
        data = content[8 : 8 + size]
        if data[:4] == zstandard.FRAME_HEADER:  # the dictionary may itself be compressed
            data = zstandard.ZstdDecompressor().decompress(data, max_output_size=64 << 20)
        dictionary, at = zstandard.ZstdCompressionDict(data), 8 + size
    view = memoryview(content)
    unpack = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(content):
        try:
            one = unpack.decompressobj()
            data, fed = one.decompress(view[at : at + (1 << 16)]), min(at + (1 << 16), len(content))
            while not one.eof and fed < len(content):
                data += one.decompress(view[fed : fed + (1 << 20)])
                fed = min(fed + (1 << 20), len(content))
        except zstandard.ZstdError as error:
            raise ValueError(f"{name}: no whole frame at {at}: {error}") from error
        if not one.eof:
            raise ValueError(f"{name}: frame at {at} is cut off")
        yield at, data
        at = fed - len(one.unused_data)


def parse(data: bytes) -> dict:
    """One record as a row of RECORDS, after all checks."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC version line")
    fields = {}
    for line in lines[1:]:
        key, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"header line without colon: {line[:40]}")
        fields[key.strip().lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest", "warc-block-digest"} - fields.keys()
    if missing:
        raise ValueError(f"fields missing: {sorted(missing)}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(rest) - 4} bytes, Content-Length {length}")
    block = rest[:length]
    if fields["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError("block digest differs")
    http, gap, payload = block.partition(b"\r\n\r\n")
    sizes = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    kind = fields["warc-type"]
    if not gap or len(sizes) != 1 or kind not in ("response", "revisit"):
        raise ValueError("no HTTP head, or a type that is neither response nor revisit")
    if kind == "response" and (len(payload) != sizes[0] or fields["warc-payload-digest"] != f"sha1:{digest(payload)}"):
        raise ValueError("payload length or digest differs")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise ValueError("revisit with a payload or without a record it refers to")
    return {"page_id": page_of(fields["warc-record-id"]), "payload_bytes": sizes[0], "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"),
            "record_type": kind, "refers_to": page_of(fields["warc-refers-to"]) if kind == "revisit" else None,
            "url": fields.get("warc-target-uri"), "payload": payload if kind == "response" else None}


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, refers_to): pages and the response that a repeated payload refers to."""
    key = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    rows = pick(pages, page_id="page_id", url="url", html="html").withColumn("key", key)
    # digests alone are grouped; only groups of two or more rows need the join, which splits hot ones
    groups = rows.groupBy("key").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1").drop("n")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("response")), None).otherwise(F.col("response"))
    return rows.join(groups, "key", "left").select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(pages: DataFrame) -> DataFrame:
    """Archives (name, records, content) of all pages, written to the shared folder and read back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                page, url, html, refers = (batch.column(c)[i].as_py() for c in range(4))
                waiting.append(record(page, url, (html or "").encode("utf-8", "surrogatepass"), refers))
                size += len(waiting[-1])
                if size >= ARCHIVE_BYTES:
                    yield packed(waiting)
                    waiting, size = [], 0
        if waiting:
            yield packed(waiting)

    def packed(records: list[bytes]) -> pa.RecordBatch:
        content = archive(records)
        name = f"pages-{hashlib.sha256(content).hexdigest()[:16]}.warc.zst"
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(records)]), pa.array([content], pa.binary())], schema=ARCHIVES)

    rows = with_revisits(pages)
    conf = rows.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 500)
    return stored(rows.mapInArrow(run, from_arrow_schema(ARCHIVES)), "warc")


def read_archives(archives: DataFrame, name: str = "name", content: str = "content", payloads: bool = True) -> DataFrame:
    """RECORDS of archives given as rows (name, content), or of files through Spark's binaryFile source (path, content)."""
    schema = RECORDS if payloads else pa.schema([f for f in RECORDS if f.name not in ("url", "payload")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                label, rows = batch.column(0)[i].as_py(), []
                for at, data in frames(batch.column(1)[i].as_py() or b"", label):
                    try:
                        rows.append(parse(data))
                    except ValueError as error:
                        raise ValueError(f"{label}, frame at {at}: {error}") from error
                yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)

    return pick(archives, name=name, content=content).mapInArrow(run, from_arrow_schema(schema))


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Write archives as files below a folder that all executors mount; returns (name, bytes). Writing again is safe."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = os.path.join(folder, f".{name}.{os.getpid()}")
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, os.path.join(folder, name))
                sizes.append(len(content))
            yield pa.RecordBatch.from_pydict({"name": batch.column(0), "bytes": pa.array(sizes, pa.int64())})

    return pick(archives, name="name", content="content").mapInArrow(run, "name string, bytes long")


#: The query over the pages themselves: 5 hexadecimal digits of a SHA-1 are 4 base-32 characters.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
top AS (SELECT h, max(page_id) AS response FROM p GROUP BY h)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(p.h, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)
                   for i in range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> response THEN response END AS refers_to
FROM p JOIN top ON p.h = top.h"""
