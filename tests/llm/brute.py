"""Plain single-process versions of the text operators, straight from their definitions."""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = " \t\n\r\x0b\x0c"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def base_quality(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in lines
            lines.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def shingle_set(text, n):
    words = WORDS.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) or frozenset([tuple(words)])


def components(docs, n, percent):
    """doc_id -> (set size, component) for distinct ids."""
    sets = {d: shingle_set(t, n) for d, t in docs}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        common = Counter(o for x in s for o in holders[x] if o < d)
        for o, k in common.items():
            if 100 * k >= percent * (len(s) + len(sets[o]) - k):
                a, b = sorted((root(d), root(o)))
                parent[b] = a
    return {d: (len(s), root(d)) for d, s in sets.items()}


def line_dedup(docs):
    key = lambda line: line.strip(SPACE).translate(LOWER)
    holders = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(d)
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < 3 or max(holders[key(x)]) == d]
        out[d] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        x = int(c) * (2 if i % 2 else 1)
        total += x if x < 10 else x - 9
    return total % 10 == 0


def pii(text):
    text, out = text or "", []
    for k, pattern in enumerate([r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                                 r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = [True, all(int(x) <= 255 for x in m.group().split(".")) if k == 1 else True, 12 <= len(digits) <= 19 and luhn(digits or "1"), 9 <= len(digits) <= 15][k]
            if good:
                out.append((m.start(), k, m.end()))
    names = ["email", "ip", "card", "phone"]
    out.sort()
    return [sum(x[1] == k for x in out) for k in range(4)], ",".join(f"{names[k]}:{a}:{b}" for a, k, b in out)


def secrets(text):
    text, out = text or "", []
    any_case = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    names = "|".join(any_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + any_case("api") + "_?" + any_case("key")
    for k, (pattern, good) in enumerate([(rf"({names})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m.group(2)) >= 8),
                                         (r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 16), (r"[0-9a-f]+", lambda m: len(m.group()) >= 32)]):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if good(m)]
    kinds = ["assign", "access", "hex"]
    out.sort()
    return [sum(x[1] == k for x in out) for k in range(3)], ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in out)


def warc(pages):
    best = {}
    for p, html in pages:
        best[html or ""] = max(best.get(html or "", p), p)
    out = {}
    for p, html in pages:
        data = (html or "").encode()
        top = best[html or ""]
        out[p] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if top == p else "revisit", None if top == p else top)
    return out


def edited(docs):
    rows = sorted(docs)
    out = {}
    for i, (d, t) in enumerate(rows):
        t, following = t or "", rows[(i + 1) % len(rows)][1] or ""
        n = len(t) // 4
        out[d] = (len(t), sha(t[: len(t) - n] + following[:n]))
    return out


def contaminated(docs, items, guarantee=10):
    """Rows of (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: pattern.findall((t or "").translate(LOWER))
    holders = defaultdict(set)
    for item, text in items:
        w = words(text)
        m = min(len(w), guarantee)
        for i in range(len(w) - m + 1 if m else 0):
            holders[tuple(w[i : i + m])].add(item)
    lengths = {len(g) for g in holders}
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for m in lengths:
            for i in range(len(w) - m + 1):
                if (g := tuple(w[i : i + m])) in holders:
                    hit |= set(range(i, i + m))
                    found |= holders[g]
        found -= {None}
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return out


def ranked(docs, items, top=20):
    """item_id -> [(doc_id, score)] by falling score, then doc_id (None last)."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    terms = lambda t: pattern.findall((t or "").translate(LOWER))
    held = [(d, Counter(terms(t))) for d, t in docs]
    df = Counter(w for _, c in held for w in c)
    n_docs, total = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    query = defaultdict(Counter)
    for item, text in items:
        query[item].update(terms(text))
    out = {}
    for item, q in query.items():
        scores = []
        for d, c in held:
            m = 75 + 25 * c.total() * n_docs // max(total, 1)
            s = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 12 * m)) for w, n in q.items() if w in c)
            if s > 0:
                scores.append((d, s))
        scores.sort(key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        if scores:
            out[item] = scores[:top]
    return out


def fill_in_middle(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output, restored)."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    hexes = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexes[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text
