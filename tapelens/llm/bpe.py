"""Byte-level BPE encoding and decoding with rank files, in padded numpy matrices.

Texts are cut by the tokenizer's pattern; distinct pieces become rows of padded id matrices,
bucketed by length. In each round every row merges its leftmost pair of minimum rank: ranks are
found in an open-addressing hash table of pairs, merged rows are compacted to the left, and rows
without a pair leave the matrix. Pieces seen before in the task come from a bounded cache.

Null and empty texts have no tokens. Lone surrogates cannot reach UTF-8 columns. The rank file
is a parameter; executors read it from the installed package that holds it, once per worker.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tapelens.llm.common import arrow_map, pick

NONE = np.int32(2**31 - 1)
#: Pieces remembered per worker; cells of one matrix.
CACHE_PIECES, MATRIX_CELLS = 150_000, 1 << 18
#: A piece of more bytes than this is merged through a heap: rounds over a row that long cost its square.
LONG_PIECE = 1024
ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


class PairTable:
    """Open-addressing table from (left id, right id) to the merged id, filled and probed by numpy."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(left), 1) * 2.5))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        key = self.pack(left, right)
        slot, todo = self.start(key), np.arange(len(key))
        while len(todo):
            free = todo[self.keys[slot[todo]] < 0]
            self.keys[slot[free]] = key[free]
            done = self.keys[slot[todo]] == key[todo]
            self.values[slot[todo[done]]] = merged[todo[done]]
            todo = todo[~done]
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)

    @staticmethod
    def pack(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) | right

    def start(self, key: np.ndarray) -> np.ndarray:
        spread = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        spread >>= np.uint64(64 - self.bits)
        return spread.view(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where the two do not merge."""
        key = self.pack(left, right)
        slot = self.start(key)
        found = self.keys[slot]
        hit = found == key
        out = np.where(hit, self.values[slot], NONE)
        todo = np.flatnonzero(~hit & (found >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out


class Bpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t))
                 if t[:i] in self.ranks and t[i:] in self.ranks]
        left, right, merged = np.array(pairs, np.int64).reshape(-1, 3).T
        self.pairs = PairTable(left, right, merged.astype(np.int32))
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pattern = regex.compile(pattern)
        top = max(self.ranks.values()) + 1
        lengths = np.zeros(top, np.int64)
        for t, r in self.ranks.items():
            lengths[r] = len(t)
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.bytes = np.frombuffer(b"".join(sorted(self.ranks, key=self.ranks.get)), np.uint8)
        self.texts = [str(i) for i in range(top)]
        self.forget()

    def forget(self) -> None:
        """Empty the cache: piece -> number, and the ids of all numbers one after another."""
        self.number: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.first, self.count = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of every text."""
        pieces = [self.split(t) for t in texts]
        if len(self.number) > CACHE_PIECES:
            self.forget()
        self.learn(list({p for ps in pieces for p in ps if p not in self.number}))
        out = []
        for ps in pieces:
            at = np.fromiter(map(self.number.__getitem__, ps), np.int64, len(ps))
            out.append(self.flat[ranges(self.first[at], self.count[at])])
        return out

    def learn(self, pieces: list[str]) -> None:
        """Encode distinct new pieces: whole vocabulary entries at once, the others by merging."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            b = p.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(b)
            if whole is not None:
                self.remember([p], np.array([[whole]], np.int32), np.array([1]))
            elif len(b) > LONG_PIECE:
                ids = self.merge_long(b)
                self.remember([p], ids[None, :], np.array([len(ids)]))
            else:
                by_width.setdefault(1 << (len(b) - 1).bit_length(), []).append((p, b))
        for width, rows in by_width.items():
            step = max(1, MATRIX_CELLS // width)
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                self.remember([p for p, _ in part], *self.merge_rows([b for _, b in part], width))

    def remember(self, pieces: list[str], ids: np.ndarray, n: np.ndarray) -> None:
        have, total = len(self.number), int(n.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while have + len(pieces) > len(self.first):
            self.first, self.count = (np.concatenate([x, np.empty_like(x)]) for x in (self.first, self.count))
        self.flat[self.used : self.used + total] = ids[np.arange(ids.shape[1]) < n[:, None]]
        self.first[have : have + len(pieces)] = self.used + np.cumsum(n) - n
        self.count[have : have + len(pieces)] = n
        self.number.update(zip(pieces, range(have, have + len(pieces))))
        self.used += total

    def merge_rows(self, rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Padded ids and lengths after all merges of byte strings of at most `width` bytes."""
        n = np.fromiter(map(len, rows), np.int64, len(rows))
        ids = self.byte_ids[np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(-1, width)]
        final, live = ids.copy(), np.arange(len(rows))
        rank = self.pair_ranks(ids, n)
        while len(live):
            at = rank.argmin(axis=1)  # the first of equal minima: the leftmost pair
            new = rank[np.arange(len(live)), at]
            stop = new == NONE
            if stop.any():
                final[live[stop], : ids.shape[1]] = ids[stop]
                go = ~stop
                used = max(int(n[live[go]].max(initial=0)), 1)  # narrower as rows get shorter
                live, ids, rank, at, new = live[go], ids[go, :used], rank[go, :used], at[go], new[go]
                if not len(live):
                    break
            row = np.arange(len(live))
            move = np.arange(ids.shape[1] - 1) > at[:, None]  # compaction: the right side moves left
            ids[:, :-1] = np.where(move, ids[:, 1:], ids[:, :-1])
            rank[:, :-1] = np.where(move, rank[:, 1:], rank[:, :-1])
            ids[row, at], rank[:, -1] = new, NONE
            n[live] -= 1
            self.rank_pairs(ids, rank, n[live], np.concatenate([row, row]), np.concatenate([at, at - 1]))
        return final, n

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece: a heap of (rank, place) over a linked list of ids."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        first = self.pairs.find(ids[:-1], ids[1:])
        heap = [(int(r), i) for i, r in enumerate(first.tolist()) if r != NONE]
        heapq.heapify(heap)
        ids = ids.tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))

        def find(i: int) -> int | None:
            if i < 0 or after[i] >= len(ids):
                return None
            return self.pair_of((ids[i], ids[after[i]]))

        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] is None or find(i) != r:
                continue
            gone = after[i]
            ids[i], ids[gone], after[i] = r, None, after[gone]
            if after[i] < len(ids):
                before[after[i]] = i
            for j in (i, before[i]):
                if (x := find(j)) is not None:
                    heapq.heappush(heap, (x, j))
        return np.array([x for x in ids if x is not None], np.int32)

    def pair_of(self, pair: tuple[int, int]) -> int | None:
        return self.ranks.get(self.token(pair[0]) + self.token(pair[1]))

    def token(self, i: int) -> bytes:
        return self.bytes[self.starts[i] : self.starts[i] + self.lengths[i]].tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids."""
        return self.bytes[ranges(self.starts[ids], self.lengths[ids])].tobytes()

    def pair_ranks(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        rank = np.full(ids.shape, NONE, np.int32)
        if ids.shape[1] > 1:
            inside = np.arange(ids.shape[1] - 1) < n[:, None] - 1
            found = self.pairs.find(ids[:, :-1][inside], ids[:, 1:][inside])
            rank[:, :-1][inside] = found
        return rank

    def rank_pairs(self, ids, rank, n, row, at) -> None:
        """Ranks of the pairs that start at `at`, where the row has such a pair."""
        ok = at >= 0
        row, at = row[ok], at[ok]
        rank[row, at] = NONE
        pair = at + 1 < n[row]
        row, at = row[pair], at[pair]
        rank[row, at] = self.pairs.find(ids[row, at], ids[row, at + 1])


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (count[0] numbers), start[1], ... one after another."""
    ends = np.cumsum(count)
    return np.repeat(start - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> Bpe:
    """One tokenizer and cache per worker process."""
    return Bpe(path, pattern)


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes of every whole text."""
    def step(cols):
        bpe = tokenizer(path, pattern)
        ids = bpe.encode_batch([t or "" for t in cols["text"]])
        return {"doc_id": cols["doc_id"], "n_tokens": [len(x) for x in ids],
                "ids_sha256": [hashlib.sha256(",".join(map(bpe.texts.__getitem__, x.tolist())).encode()).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]}

    return arrow_map(pick(docs, doc_id=id_col, text=text_col), ENCODED, step)


def token_ids(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids themselves."""
    return arrow_map(pick(docs, doc_id=id_col, text=text_col), pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]),
                     lambda c: {"doc_id": c["doc_id"], "ids": tokenizer(path, pattern).encode_batch([t or "" for t in c["text"]])})


def decoded(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); bytes that are not UTF-8 become replacement characters."""
    return arrow_map(pick(tokens, doc_id="doc_id", ids="ids"), pa.schema([("doc_id", pa.int64()), ("text", pa.string())]),
                     lambda c: {"doc_id": c["doc_id"], "text": [tokenizer(path, pattern).decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in c["ids"]]})
