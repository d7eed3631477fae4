"""Personal data with a skip-chain conditional random field.

Patterns find the base spans. Words with a digit or an at sign become nodes with the labels
of ``KINDS`` or none; every other word is fixed to none. A node's potential comes from the shape
of its word, neighbouring nodes share a chain potential, and words of one document that repeat
each other share a skip potential. Words repeat each other if their letters and digits are equal,
whatever the separators, or if their last seven digits are, where neighbouring groups of digits
are read as one number. Each repeated key of a document is a hub: all pairs with a recognised
occurrence come down to a count for each label (the recognised end is fixed), and the others
share a hub variable, so links are linear in the occurrences and no occurrence is far from another.
Loopy belief propagation runs until the messages of a document settle, for each document on its
own, so that its result does not hang on the batch. It pulls the repetitions of a recognised word
to the same label; words that end up with a label become further spans.

Shape weights and chain potentials are fitted on counts of (shape, previous label, label) over
all documents. Null and empty texts have no spans. Without any candidate in the table the field
adds nothing. Repeated documents get equal spans. Spans are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelens.llm.common import arrow_map, pick

KINDS = ["email", "ip", "card", "phone"]
#: Strength of the skip potential, belief needed for a further span, share of the old message kept in a round.
SKIP, BELIEF, DAMPING = 4.0, 0.8, 0.5
#: Messages have settled when none changes by so much; a document that oscillates ends after so many rounds.
SETTLED, LIMIT = 1e-3, 1000
#: Repetitions link only words with so many letters and digits, or numbers that share so many last digits.
MIN_KEY, SUFFIX = 6, 7

Span = tuple[int, int, str]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*+")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ANY = re.compile(r"[0-9@]")
WORD = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
NOT_KEY = re.compile(r"[^0-9A-Za-z@]+")
EDGE = "\"'`.,;:!?()[]{}<>*&%$#|"


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping addresses, found from each at sign to both sides (linear time)."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            out.append((start, m.end(), "email"))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def addresses(text: str) -> list[Span]:
    """Four dotted numbers; a longer dotted chain is taken four numbers at a time."""
    out = []
    for m in DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            start = at + sum(map(len, parts[:i])) + i
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
                out.append((start, start + sum(map(len, four)) + 3, "ip"))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the four patterns, by start, then kind."""
    if not ANY.search(text):
        return []
    out = emails(text) + addresses(text)
    for m in DIGITS.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def shape(word: str) -> int:
    """Bit set of what a word looks like."""
    core = word.strip(EDGE)
    digits = sum(map(core.count, "0123456789"))
    tests = ["@" in core, bool(DOMAIN.search(core)), core.count(".") == 3, word.startswith("+"), word.startswith("("),
             digits == len(core), 1 <= digits <= 2, 3 <= digits <= 4, 5 <= digits <= 8, 9 <= digits <= 11, digits >= 12, "-" in core]
    return sum(1 << i for i, t in enumerate(tests) if t)


BITS = 12


@dataclass
class Nodes:
    """Candidate words of a batch of texts."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    shape: np.ndarray
    label: np.ndarray  # of the base spans: 0 none, else 1 + index of the kind
    chain: np.ndarray  # pairs of nodes whose words follow each other
    skip: np.ndarray  # pairs of a node without base label and the hub of its repeated key
    pull: np.ndarray  # (hubs, labels): occurrences of the key that have a base label


def nodes_of(texts: list[str], spans: list[list[Span]]) -> Nodes:
    rows, chain, skip, pull = [], [], [], []
    for d, (text, found) in enumerate(zip(texts, spans)):
        if not ANY.search(text):
            continue
        last, seen, k, tail = -2, {}, 0, []
        for m in WORD.finditer(text):
            me, at = len(rows), m.start()
            while k < len(found) and found[k][1] <= at:
                k += 1
            over = next((s for s in found[k : k + 4] if s[0] < m.end() and s[1] > at), None)
            core = m.group().strip(EDGE)
            begin = at + m.group().find(core)
            rows.append((d, begin, begin + len(core), shape(m.group()), 1 + KINDS.index(over[2]) if over else 0))
            beside = me and rows[me - 1][0] == d and at - last <= 1
            if beside:
                chain.append((me - 1, me))
            last = m.end()
            key = NOT_KEY.sub("", core).lower()
            # the neighbouring groups of digits that the last SUFFIX digits up to here reach into
            tail = [*(tail if beside else []), (me, key)] if key.isdigit() else []
            while sum(len(g) for _, g in tail[1:]) >= SUFFIX:
                del tail[0]
            digits = "".join(g for _, g in tail)
            if len(digits) >= SUFFIX:
                seen.setdefault((True, digits[-SUFFIX:]), []).append([i for i, _ in tail])
            if len(key) >= MIN_KEY and not (key.isdigit() and len(key) >= SUFFIX):
                seen.setdefault((False, key), []).append([me])
        for held in seen.values():
            free = sorted({i for each in held for i in each if not rows[i][4]})
            if len(held) > 1 and free:
                labels = Counter(rows[each[-1]][4] for each in held)
                skip += [(i, len(pull)) for i in free]
                pull.append([0, *(labels[1 + j] for j in range(len(KINDS)))])
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return Nodes(*cols, np.array(chain, np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2), np.array(pull, float).reshape(-1, 1 + len(KINDS)))


def counts_of(docs: DataFrame) -> DataFrame:
    """(shape, before, label, n) over the candidate words of all documents; before is -1 at a chain's start."""
    schema = pa.schema([("shape", pa.int64()), ("before", pa.int64()), ("label", pa.int64()), ("n", pa.int64())])

    def step(cols):
        texts = [t or "" for t in cols["text"]]
        g = nodes_of(texts, [base_spans(t) for t in texts])
        before = np.full(len(g.doc), -1)
        before[g.chain[:, 1]] = g.label[g.chain[:, 0]]
        seen = Counter(zip(g.shape.tolist(), before.tolist(), g.label.tolist()))
        return dict(zip(["shape", "before", "label", "n"], zip(*[(*k, n) for k, n in seen.items()]))) or dict.fromkeys(["shape", "before", "label", "n"], [])

    rows = arrow_map(pick(docs, text="text"), schema, step)
    return rows.groupBy("shape", "before", "label").agg(F.sum("n").alias("n"))  # at most 2^BITS * 6 * 5 rows


@dataclass
class Field:
    unary: np.ndarray  # (2^BITS, labels)
    chain: np.ndarray  # (labels, labels)


def fit_field(docs: DataFrame) -> Field:
    """Softmax weights of the shape bits, and smoothed log ratios of neighbouring labels."""
    rows = np.array([tuple(r) for r in counts_of(docs).collect()], np.int64).reshape(-1, 4)
    rows = rows[np.lexsort(rows.T)]
    size = len(KINDS) + 1
    bits = (np.arange(1 << BITS)[:, None] >> np.arange(BITS) & 1).astype(float)
    x = np.hstack([bits, np.ones((1 << BITS, 1))])
    seen = np.zeros((1 << BITS, size))
    np.add.at(seen, (rows[:, 0], rows[:, 2]), rows[:, 3])
    used = seen.sum(axis=1) > 0
    w = np.zeros((BITS + 1, size))
    share = seen[used] / max(seen.sum(), 1)
    for _ in range(600):
        z = x[used] @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w -= 4.0 * (x[used].T @ (p * share.sum(axis=1, keepdims=True) - share) + 1e-5 * w)
    pairs = np.ones((size, size))
    linked = rows[rows[:, 1] >= 0]
    np.add.at(pairs, (linked[:, 1], linked[:, 2]), linked[:, 3])
    pairs /= pairs.sum()
    z = x @ w
    z -= z.max(axis=1, keepdims=True)
    return Field(z - np.log(np.exp(z).sum(axis=1, keepdims=True)), np.log(pairs / np.outer(pairs.sum(axis=1), pairs.sum(axis=0))))


def beliefs(g: Nodes, field: Field) -> np.ndarray:
    """Label probabilities of all nodes after loopy message passing; base labels are observed."""
    size, n = len(KINDS) + 1, len(g.doc)
    unary = field.unary[g.shape].copy()
    np.add.at(unary, g.skip[:, 0], SKIP * g.pull[g.skip[:, 1]])
    known = g.label > 0
    unary[known] = -20.0
    unary[known, g.label[known]] = 0.0
    unary = np.vstack([unary, np.zeros((len(g.pull), size))])  # hubs follow the nodes
    ends = np.vstack([g.chain, g.skip + [0, n]]).T
    doc, kind = g.doc[ends[0]], (np.arange(ends.shape[1]) >= len(g.chain)).astype(int)
    same = SKIP * np.eye(size)
    pot = np.array([[field.chain, same], [field.chain.T, same]])
    msg = np.zeros((2, ends.shape[1], size))  # along each edge and back
    live = np.arange(ends.shape[1])  # edges of documents whose messages have not settled
    for _ in range(LIMIT):
        if not len(live):
            break
        src, old = ends[:, live], msg[:, live]
        total = unary.copy()
        np.add.at(total, src[::-1], old)
        z = (total[src] - old[::-1])[..., None] + pot[:, kind[live]]
        top = z.max(axis=2)
        new = top + np.log(np.exp(z - top[:, :, None, :]).sum(axis=2))
        new -= new.max(axis=2, keepdims=True)
        msg[:, live] = DAMPING * old + (1 - DAMPING) * new
        moved = np.zeros(g.doc[-1] + 1)
        np.maximum.at(moved, doc[live], np.abs(new - old).max(axis=(0, 2)))
        live = live[moved[doc[live]] > SETTLED]
    np.add.at(unary, ends[::-1], msg)
    p = np.exp(unary[:n] - unary[:n].max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def find_spans(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of every text."""
    base = [base_spans(t) for t in texts]
    g = nodes_of(texts, base)
    out = [list(s) for s in base]
    if len(g.doc):
        p = beliefs(g, field)
        best = p.argmax(axis=1)
        for i in np.flatnonzero((best > 0) & (g.label == 0) & (p.max(axis=1) >= BELIEF) & (g.end > g.start)):
            out[g.doc[i]].append((int(g.start[i]), int(g.end[i]), KINDS[best[i] - 1]))
    return [(b, sorted(a, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))) for b, a in zip(base, out)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


SCHEMA = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string())])


def tagged(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Counts of base spans by kind, their digest, and all spans of every whole text."""
    field = field or fit_field(docs)

    def step(cols):
        found = find_spans([t or "" for t in cols["text"]], field)
        return {"doc_id": cols["doc_id"], **{f"n_{k}": [sum(s[2] == k for s in b) for b, _ in found] for k in KINDS},
                "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], "spans": [joined(a) for _, a in found]}

    return arrow_map(pick(docs, doc_id="doc_id", text="text"), SCHEMA, step)
