"""Fill-in-middle transformation over seekable compressed frames.

A text is stored as independent Zstandard frames of FRAME_BYTES, cut at code points, with the
cumulative numbers of units and code points before each frame. A unit is a run of A-Z and a-z or one
other code point and counts where it starts, so a unit longer than a frame is no special case. To cut
after so many units, the frame that holds the unit is found in the table of counts and it alone is
decompressed. The output is written frame by frame into frames of its own; digests stream over frames
in order, and the text is rebuilt from the frames of the output and the form alone, by its markers.

No step holds more than the compressed frames of a document and one frame of text. `framed` is a table
in the shared folder; every later step reads frames from it.

Null texts are empty. Each row is transformed on its own: repeated rows give repeated results, and a
row without doc_id is drawn by the empty number ("1:"). Texts that hold a marker are plain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tapelens.llm.common import arrow_map, pick
from tapelens.session import stored

FRAME_BYTES = 64 << 10
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
SEED = "1"

LETTER = np.zeros(256, bool)
LETTER[ord("A") : ord("Z") + 1] = LETTER[ord("a") : ord("z") + 1] = True

FRAMED = pa.schema([("doc_id", pa.int64()), ("frames", pa.list_(pa.binary())), ("units", pa.list_(pa.int64())),
                    ("chars", pa.list_(pa.int64())), ("marked", pa.bool_())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
                    ("output_sha256", pa.string()), ("restored_sha256", pa.string())])


def starts(body: bytes, inside: bool) -> np.ndarray:
    """Where units start; `inside` tells that the byte before is a letter."""
    x = np.frombuffer(body, np.uint8)
    letter = LETTER[x]
    after = np.empty(len(x), bool)
    after[:1], after[1:] = inside, letter[:-1]
    return ((x & 0xC0) != 0x80) & ~(letter & after)


@dataclass
class Frames:
    """Independent frames with the units and code points before each one, and in all (one more entry)."""

    bodies: list[bytes]
    units: list[int]
    chars: list[int]

    @classmethod
    def of(cls, pieces: Iterable[bytes], size: int = FRAME_BYTES) -> "Frames":
        """Frames of about `size` bytes from a stream of bytes."""
        out, pack = cls([], [0], [0]), zstandard.ZstdCompressor(level=1)
        rest, inside = bytearray(), False

        def add(body: bytes, inside: bool) -> bool:
            out.bodies.append(pack.compress(body))
            out.units.append(out.units[-1] + int(starts(body, inside).sum()))
            out.chars.append(out.chars[-1] + int(((np.frombuffer(body, np.uint8) & 0xC0) != 0x80).sum()))
            return bool(LETTER[body[-1]])

        for piece in pieces:
            for at in range(0, len(piece), size):
                rest += piece[at : at + size]
                while len(rest) >= size + 4:  # a code point has at most four bytes
                    end = size
                    while rest[end] & 0xC0 == 0x80:
                        end += 1
                    inside = add(bytes(rest[:end]), inside)
                    del rest[:end]
        if rest:
            add(bytes(rest), inside)
        return out

    def read(self, i: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.bodies[i])

    def cut(self, units: int) -> tuple[int, int, int]:
        """(frame, byte in it, code points before) of the place after so many units."""
        if units >= self.units[-1]:
            return len(self.bodies), 0, self.chars[-1]
        i = int(np.searchsorted(self.units, units, side="right")) - 1
        body = self.read(i)
        inside = i > 0 and bool(LETTER[self.read(i - 1)[-1]])
        at = int(np.flatnonzero(starts(body, inside))[units - self.units[i]])
        return i, at, self.chars[i] + int(((np.frombuffer(body[:at], np.uint8) & 0xC0) != 0x80).sum())

    def stream(self, start: tuple[int, int], end: tuple[int, int]) -> Iterator[bytes]:
        """The bytes between two places, frame by frame."""
        for i in range(start[0], min(end[0] + (end[1] > 0), len(self.bodies))):
            body = self.read(i)
            yield body[start[1] if i == start[0] else 0 : end[1] if i == end[0] else len(body)]

    def whole(self) -> Iterator[bytes]:
        return self.stream((0, 0), (len(self.bodies), 0))

    def find(self, marker: bytes, start: tuple[int, int] = (0, 0)) -> tuple[int, int] | None:
        """Place of the first occurrence of a marker; it may lie across two frames."""
        tail, where = b"", start
        for i in range(start[0], len(self.bodies)):
            begin = start[1] if i == start[0] else 0
            body = self.read(i)[begin:]
            at = (tail + body).find(marker)
            if at >= 0:
                return (i, begin + at - len(tail)) if at >= len(tail) else (where[0], where[1] - (len(tail) - at))
            tail = (tail + body)[-(len(marker) - 1) :]
            where = (i, begin + len(body))  # the tail ends here
        return None

    def after(self, place: tuple[int, int], n: int) -> tuple[int, int]:
        """The place n bytes further on."""
        i, at = place[0], place[1] + n
        while i < len(self.bodies) and at >= (size := len(self.read(i))):
            i, at = i + 1, at - size
        return i, at


def digest(pieces: Iterable[bytes]) -> str:
    out = hashlib.sha256()
    for piece in pieces:
        out.update(piece)
    return out.hexdigest()


def draws(doc_id: int | None, seed: str = SEED) -> list[int]:
    """h1 to h4 of a document."""
    hexes = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(hexes[i : i + 8], 16) for i in range(0, 32, 8)]


def transformed(text: Frames, marked: bool, doc_id: int | None) -> tuple[str, int | None, int | None, Frames]:
    """(form, prefix_chars, middle_chars, output) of a document."""
    n = text.units[-1]
    h1, h2, h3, h4 = draws(doc_id)
    if not text.bodies or marked or h3 % 100 >= PLAIN_FROM:
        return "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, end = text.cut(low), text.cut(high), (len(text.bodies), 0)
    prefix, middle, suffix = ((0, 0), a[:2]), (a[:2], b[:2]), (b[:2], end)
    form = "spm" if h4 % 100 < SPM_BELOW else "psm"
    order = [(PREFIX, prefix), (SUFFIX, suffix)]

    def parts() -> Iterator[bytes]:
        for marker, span in (order if form == "psm" else order[::-1]) + [(MIDDLE, middle)]:
            yield marker
            yield from text.stream(*span)

    return form, a[2], b[2] - a[2], Frames.of(parts())


def restored(output: Frames, form: str) -> Iterator[bytes]:
    """The text in order, from the output and its form."""
    if form == "plain":
        return output.whole()
    names = [PREFIX, SUFFIX, MIDDLE] if form == "psm" else [SUFFIX, PREFIX, MIDDLE]
    places, at = [], (0, 0)
    for name in names:
        places.append(output.find(name, at))
        at = output.after(places[-1], len(name))
    ends = places[1:] + [(len(output.bodies), 0)]
    span = {name: (output.after(p, len(name)), e) for name, p, e in zip(names, places, ends)}
    return (piece for name in (PREFIX, MIDDLE, SUFFIX) for piece in output.stream(*span[name]))


def framed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """FRAMED of every row, written once."""
    def step(cols):
        out = {"doc_id": cols["doc_id"], "frames": [], "units": [], "chars": [], "marked": []}
        for text in cols["text"]:
            body = (text or "").encode("utf-8", "surrogatepass")
            frames = Frames.of([body])
            for k, v in zip(("frames", "units", "chars"), (frames.bodies, frames.units, frames.chars)):
                out[k].append(v)
            out["marked"].append(any(m in body for m in (PREFIX, SUFFIX, MIDDLE)))
        return out

    return stored(arrow_map(pick(docs, doc_id=id_col, text=text_col), FRAMED, step), "text-frames")


def fill_in_middle(store: DataFrame, texts: bool = False) -> DataFrame:
    """RESULT of every row of a `framed` table; with `texts` also the output itself (output)."""
    schema = RESULT.append(pa.field("output", pa.string())) if texts else RESULT

    def step(cols):
        out = {f.name: [] for f in schema}
        for doc_id, bodies, units, chars, marked in zip(*(cols[f.name] for f in FRAMED)):
            text = Frames(bodies, units, chars)
            form, prefix, middle, output = transformed(text, marked, doc_id)
            row = [doc_id, units[-1], form, prefix, middle, digest(output.whole()), digest(restored(output, form))]
            if texts:
                row.append(b"".join(output.whole()).decode("utf-8", "surrogatepass"))
            for f, v in zip(schema, row):
                out[f.name].append(v)
        return out

    return arrow_map(store, schema, step)


SQL = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
p AS (SELECT doc_id, text, u, len(u) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM h),
c AS (SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, u,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM p),
s AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(CASE WHEN form = 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256 FROM s"""
