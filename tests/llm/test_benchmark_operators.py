"""Decontamination, lexical search and fill-in-middle against their plain versions, and on odd and empty tables."""

import random
from collections import Counter

import brute
import pytest

from tapelens.llm import fim, lexical_search, winnowing
from tapelens.llm.common import pick

ITEMS = "item_id long, text string"
HITS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


@pytest.fixture(scope="module")
def items(spark, rows):
    texts = [t for _, t, *_ in rows if t]
    long = texts[-1].split()
    return [(1, texts[8]), (2, " ".join(texts[8].split()[50:75]) + " tail"), (3, "W3 w7"), (4, "one"), (5, None), (6, "... --"), (7, " ".join(long[9000:9010])),
            (8, " ".join(long[100:109]) + " other " + " ".join(long[200:211])), (9, "shared by many"), (2, "w1 w2 w3 w4 w5 w6 w7"), (10, texts[8]), (None, texts[9][:200])]


@pytest.fixture(scope="module")
def bench(spark, items):
    return spark.createDataFrame(items, ITEMS)


def decontaminated(docs, items):
    return [tuple(r[c] for c in HITS) for r in winnowing.report(winnowing.contaminated(docs, items)).collect()]


def test_hits_equal_all_windows(docs, rows, bench, items):
    expected = brute.contaminated([(d, t) for d, t, *_ in rows], items)
    assert sum(r[-1] for r in expected) > 10 and Counter(decontaminated(docs, bench)) == Counter(expected)


def test_large_benchmarks_join_by_shuffle(docs, rows, bench, items, monkeypatch):
    monkeypatch.setattr(winnowing, "BROADCAST_ROWS", -1)
    assert Counter(decontaminated(docs, bench)) == Counter(brute.contaminated([(d, t) for d, t, *_ in rows], items))


def test_winnowing_on_few_words(spark):
    """Small alphabets: ties of hashes, repeated k-grams, windows at both ends."""
    rng = random.Random(3)
    word = lambda: rng.choice("ab")
    docs = [(i, " ".join(word() for _ in range(rng.randrange(0, 60)))) for i in range(120)]
    items = [(i, "-".join(word() for _ in range(rng.choice((1, 2, 5, 8, 9, 10, 11, 14))))) for i in range(12)]
    for pick_items in (items[:3], items[4:], [x for x in items if len(x[1]) > 21]):
        got = decontaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(pick_items, ITEMS))
        assert Counter(got) == Counter(brute.contaminated(docs, pick_items))


def test_spans_are_merged(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    docs = spark.createDataFrame([(1, f"x {passage} y z {passage.upper()}"), (2, " ".join(f"p{i}" for i in range(9)))], "doc_id long, text string")
    found = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in winnowing.contaminated(docs, spark.createDataFrame([(1, passage)], ITEMS)).collect()}
    assert found == {1: [(1, 26), (28, 53)], 2: []}


def search(docs, items, **more):
    out = {}
    for r in lexical_search.searched(docs, items, **more).orderBy("item_id", "rank").collect():
        out.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r["rank"] == len(out[r.item_id])
    return out


def test_search_equals_plain_scores(docs, rows, bench, items):
    assert search(docs, bench) == brute.ranked([(d, t) for d, t, *_ in rows], items)


def test_search_in_blocks_and_small_groups(docs, rows, bench, items, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", 600)
    monkeypatch.setattr(lexical_search, "CELLS", 5)
    assert search(docs, bench, top=3) == brute.ranked([(d, t) for d, t, *_ in rows], items, 3)


def test_search_ties_and_whole_terms(spark):
    docs = [(i, "alpha beta") for i in range(50, 0, -1)] + [(60, "alphabet"), (61, "Alpha-beta_alpha"), (None, "alpha beta"), (62, "ÀLPHA")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    items = [(1, "ALPHA"), (2, "alpha alpha beta"), (3, "Àlpha ÀLPHA"), (4, "missing")]
    assert search(frame, spark.createDataFrame(items, ITEMS)) == brute.ranked(docs, items)


FORMS = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def plain_forms(doc_id, text):
    n, form, p, m, output, restored = brute.fill_in_middle(doc_id, text)
    return n, form, p, m, brute.sha(output), brute.sha(restored)


@pytest.mark.parametrize("size", [3, 16, fim.FRAME_BYTES])
def test_forms_equal_plain_version(docs, rows, size, monkeypatch):
    if size < 100:
        monkeypatch.setattr(fim.Frames.of.__func__, "__defaults__", (size,))
        for d, t, *_ in rows[:-1]:
            body = (t or "").encode()
            text = fim.Frames.of([body])
            assert b"".join(text.whole()) == body
            form, p, m, out = fim.transformed(text, any(x in body for x in (b"<P>", b"<S>", b"<M>")), d)
            assert (text.units[-1], form, p, m, fim.digest(out.whole()), fim.digest(fim.restored(out, form))) == plain_forms(d, t)
        return
    got = {r.doc_id: tuple(r[c] for c in FORMS) for r in fim.fill_in_middle(fim.framed(docs)).collect()}
    assert got == {d: plain_forms(d, t) for d, t, *_ in rows} and len({v[1] for v in got.values()}) == 3


def test_markers_and_long_units(spark):
    texts = ["a<P", "<S", "<<M>>", "<M", "P><S", "x" * 300_000, "é" * 100_000, "\n" * 70_000 + "z", "a€b😀" * 30_000, "<P>", "S>", "<", ">"]
    rows = [(i, t) for i, t in enumerate(texts * 4)]
    out = fim.fill_in_middle(fim.framed(spark.createDataFrame(rows, "doc_id long, text string")), texts=True).collect()
    for r in out:
        assert tuple(r[c] for c in FORMS) == plain_forms(r.doc_id, rows[r.doc_id][1])
        assert r.output == brute.fill_in_middle(r.doc_id, rows[r.doc_id][1])[4]


def test_odd_rows(spark, odd, bench, items):
    plain = [(r.doc_id, r.text) for r in pick(odd, doc_id="doc_id", text="text").collect()]
    assert Counter(decontaminated(odd, bench)) == Counter(brute.contaminated(plain, items))
    clash = bench.selectExpr("item_id", "1 AS doc_id", "text", "2 AS term", "3 AS TEXT", "4 AS score")
    assert Counter(decontaminated(odd, clash)) == Counter(brute.contaminated(plain, items))
    assert search(odd, clash) == brute.ranked(plain, items)
    got = fim.fill_in_middle(fim.framed(odd)).collect()
    assert Counter((r.doc_id, *(r[c] for c in FORMS)) for r in got) == Counter((d, *plain_forms(d, t)) for d, t in plain)


def test_empty_tables(spark, docs, rows, bench):
    none, no_items = docs.limit(0), bench.limit(0)
    assert decontaminated(none, bench) == [] and not any(r[-1] or r[3] for r in decontaminated(docs, no_items))
    assert len(decontaminated(docs, no_items)) == len(rows)
    assert search(none, bench) == {} and search(docs, no_items) == {}
    assert fim.fill_in_middle(fim.framed(none)).count() == 0
