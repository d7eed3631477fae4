"""Every operator against its plain version, and on odd and empty tables."""

import base64
import hashlib
import json
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tapelens.llm import bpe, line_dedup, mixing, ngram_join, pii, quality_model, quality_rules, queries, secret_scan, syncmers, warc
from tapelens.llm.common import bounded_sample, pick

RANKS, PATTERN = public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def by_id(frame, *cols):
    return {r.doc_id: tuple(r[c] for c in cols) for r in frame.collect()}


def test_one_id_with_three_texts_joins_all_their_classes(spark):
    words = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    rows = [(1, words[0]), (2, words[1]), (3, words[2])] + [(9, w) for w in words]
    got = {(r.doc_id, r.component_id) for r in ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(d, 1) for d in (1, 2, 3, 9)}


def test_saturating_sum_and_table_sizes():
    a = np.array([1, 65_000, 65_535, 0], np.uint16)
    assert ngram_join.added(a, np.array([2, 1000, 1, 65_535], np.uint16)).tolist() == [3, 65_535, 65_535, 65_535]
    assert [ngram_join.sized(n, (4, 10)) for n in (0, 16, 17, 1000, 1e9)] == [16, 16, 32, 1024, 1024]


# quality rules ---------------------------------------------------------------

def test_quality_counts(docs, rows, labels):
    got = by_id(quality_rules.judged(docs, []), *quality_rules.COUNTS, "base_failed")
    assert got == {d: brute.base_quality(t) for d, t, *_ in rows}


def test_rules_are_learned_and_explained_in_order(docs, rows, labels):
    rules = quality_rules.fit_rules(docs, labels)
    assert rules and all(1 <= len(r) <= quality_rules.MAX_CONDITIONS for r in rules)
    got = by_id(quality_rules.judged(docs, rules), "rule", "kept", "base_failed")
    for d, t, *_ in rows:
        x = np.array([[dict(zip(quality_rules.COUNTS + quality_rules.SHARES, quality_rules.text_counts(t)))[f] for f in quality_rules.FEATURES]], float)
        first = next((i for i, r in enumerate(rules, 1) if quality_rules.rule_mask(r, x)[0]), 0)
        assert got[d] == (first, first == 0 and not got[d][2], got[d][2])
    assert all(not got[d][1] for d, t, *_ in rows if "&&&" in (t or ""))
    assert sum(got[d][0] > 0 for d, t, *_ in rows if "&&&" not in (t or "")) == 0
    kept = Counter(r.doc_id for r in quality_rules.filtered(docs, rules).collect())
    assert kept == Counter(d for d, v in got.items() if v[1])


def test_pruning_drops_useless_conditions():
    rng = np.random.default_rng(1)
    x = rng.random((600, len(quality_rules.FEATURES)))
    y = x[:, 2] > 0.7
    (rule,) = quality_rules.learn_list(x, y)
    assert [c.feature for c in rule] == ["symbol_share"] and rule[0].above and abs(rule[0].threshold - 0.7) < 0.02


# n-gram join -----------------------------------------------------------------

@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80), (2, 60)])
def test_join_equals_all_pairs(docs, rows, n, percent):
    got = by_id(ngram_join.linked(docs, n, percent), "n_shingles", "component_id")
    assert got == brute.components([r[:2] for r in rows], n, percent)
    assert sum(c != d for d, (_, c) in got.items()) > 8


def test_tree_finds_every_pair():
    """Dual traversal over random nested sets, against all pairs; components are skipped."""
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        base = rng.integers(1, 2**62, rng.integers(5, 300)).astype(np.uint64)
        for _ in range(3):
            sets.append(np.unique(np.where(rng.random(len(base)) < 0.04, rng.integers(1, 2**62, len(base)).astype(np.uint64), base)))
    ids, comps = np.arange(len(sets)), np.arange(len(sets))
    comps[1::3] = comps[::3]
    tree = ngram_join.Tree(ids, np.array([len(s) for s in sets]), comps, np.array([ngram_join.bitmap_of(s) for s in sets]))
    got = {(int(a), int(b)) for x, y in tree.pairs(tree, 85) for a, b in zip(x, y)}
    want = {(i, j) for i in ids for j in ids[i + 1 :] if comps[i] != comps[j] and
            100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    assert want and want <= got and len(got) < 3 * len(want)


def test_spanning_candidates_join_the_same_components():
    """A crowd of near copies: as few candidates as members, with the components of all of them."""
    rng = np.random.default_rng(5)
    base = rng.integers(1, 2**62, 150).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(150) < 0.03, rng.integers(1, 2**62, 150).astype(np.uint64), base)) for _ in range(120)]
    ids = np.arange(len(sets))
    tree = ngram_join.Tree(ids, np.array([len(s) for s in sets]), ids.copy(), np.array([ngram_join.bitmap_of(s) for s in sets]))
    pairs = lambda found: {(int(a), int(b)) for x, y in found for a, b in zip(x, y)}
    every, few = pairs(tree.pairs(tree, 85)), pairs(ngram_join.spanning(tree.pairs(tree, 85), tree, tree))
    assert few <= every and len(few) < len(ids) < len(every)
    parent = list(ids)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def components(links):
        parent[:] = ids
        for a, b in links:
            parent[root(b)] = root(a)
        return [{i for i in ids if root(i) == r} for r in {root(i) for i in ids}]

    key = lambda groups: sorted(map(min, groups))
    assert key(components(every)) == key(components(few))


def test_large_cells_use_upper_nodes(spark, monkeypatch):
    """One cell of many nodes: near copies whose star centre links with none of them."""
    monkeypatch.setattr(ngram_join, "NODE", 8)
    words = [f"c{i}" for i in range(100)]
    texts = [" ".join(words[:60] + [f"z{i}" for i in range(40)])] + [" ".join(words[: 99 - k] + [f"q{k}"] * (k % 3) + words[99 - k :]) for k in range(60)]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(ngram_join.linked(frame, 3, 90), "n_shingles", "component_id") == brute.components(rows, 3, 90)


# quality classifier ------------------------------------------------------------

def test_classifier_separates_held_out_rows(docs, rows, labels):
    vectors, net = quality_model.fit_model(docs, labels)
    got = by_id(quality_model.scored(docs, (vectors, net)), "score")
    assert len(got) == len(rows) and all(0 <= s <= 1 for (s,) in got.values())
    assert max(got[d][0] for d, t, *_ in rows if "&&&" in (t or "")) < min(got[d][0] for d, t, *_ in rows if t and len(t) > 400 and "w1" in t and "&&&" not in t)


def test_word_vectors_equal_plain_counts(docs, rows):
    where, sign = quality_model.index_vectors()
    want = np.zeros((quality_model.BUCKETS, quality_model.DIM))
    for _, t, *_ in rows:
        b, n = quality_model.bucket_lists([t])
        for i in range(len(b)):
            for j in range(max(0, i - quality_model.WINDOW), min(len(b), i + quality_model.WINDOW + 1)):
                if i != j:
                    np.add.at(want[b[i]], where[b[j]], sign[b[j]])
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert np.allclose(quality_model.word_vectors(docs), want, atol=1e-5)


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    z = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(float)
    assert 2.6 < quality_model.fit_temperature(z * 3, y) < 3.4
    assert quality_model.train(np.zeros((3, 2)), np.ones(3)).probability(np.zeros((2, 2))).tolist() == [1.0, 1.0]


# BPE ---------------------------------------------------------------------------

def test_bpe_equals_library(docs, rows, library):
    want = {}
    for d, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        want[d] = (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(t or ""))
    assert by_id(bpe.encoded(docs, RANKS, PATTERN), "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_bpe_odd_texts_and_round_trip(spark, library):
    rng = np.random.default_rng(2)
    texts = ["", "\x1c a  b\n\n c", "a" * 5000, "é" * 1500 + "'ll 's​\t\t x", "abcde" * 3000, "0123456789" * 900, "<|endoftext|>", "🤦🏼‍♂️ x　y",
             "".join(chr(c) for c in rng.integers(32, 0xD7FF, 4000))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokens = bpe.token_ids(frame, RANKS, PATTERN)
    assert by_id(tokens, "ids") == {i: (library.encode_ordinary(t),) for i, t in enumerate(texts)}
    assert by_id(bpe.decoded(tokens, RANKS, PATTERN), "text") == {i: (t,) for i, t in enumerate(texts)}


def test_bpe_cache_is_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 50)
    coder = bpe.Bpe(RANKS, PATTERN)
    for i in range(20):
        text = " ".join(f"word{i}x{j}" for j in range(40))
        assert coder.encode_batch([text])[0].tolist() == library.encode_ordinary(text)
        assert len(coder.number) <= 50 + 200


# line dedup --------------------------------------------------------------------

def test_lines_equal_plain_version(docs, rows):
    kept = line_dedup.with_kept(docs)
    got = {r.doc_id: (r.n_lines, r.n_dropped, brute.sha(r.kept_text)) for r in kept.collect()}
    assert got == brute.line_dedup([r[:2] for r in rows])
    assert sum(v[1] for v in got.values()) >= 8


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_runs_give_totals_whatever_the_batches(spark, batches):
    rng = np.random.default_rng(batches)
    data = sorted({(int(k), 0, int(d)) for k, d in rng.integers(0, 40, (400, 2))})
    cut = np.quantile([d for *_, d in data], [i / batches for i in range(1, batches)])
    frame = spark.createDataFrame([(int(sum(d < c for c in cut)), a, b, d) for a, b, d in data], "batch int, h1 long, h2 long, doc_id long")
    got = {(r.h1, r.keeper) for r in line_dedup.repeated_keys(frame, batches).collect()}
    held = {}
    for k, _, d in data:
        held.setdefault(k, set()).add(d)
    assert got == {(k, max(v)) for k, v in held.items() if len(v) >= 3}


# PII -----------------------------------------------------------------------------

def test_pii_base_equals_patterns(docs, rows):
    got = by_id(pii.tagged(docs), *[f"n_{k}" for k in pii.KINDS], "base_sha256", "spans")
    for d, t, *_ in rows:
        counts, spans = brute.pii(t)
        assert list(got[d][:4]) == counts and got[d][4] == brute.sha(spans)
        assert set(filter(None, spans.split(","))) <= set(got[d][5].split(","))


def test_pii_random_strings():
    rng = np.random.default_rng(4)
    for _ in range(400):
        text = "".join(rng.choice(list("a.@-+ 0123456789()_%\n"), rng.integers(0, 60)))
        counts, spans = brute.pii(text)
        assert pii.joined(pii.base_spans(text)) == spans


def test_field_labels_distant_repetition(spark):
    """A number in card form makes its bare repetition, far away, a card too; unrelated numbers stay."""
    texts = [f"pay 4539 1488 0343 6467 now {'word ' * 50} 4539-1488-0343-6467x {'word ' * 20} 12345678 end" for _ in range(3)]
    texts += [f"call +1 (437) 555-0689 or {'word ' * 30} 555-0689 {i}7654321" for i in range(3)] + ["nothing here 1234567"] * 3
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    field = pii.fit_field(frame)
    (base, every), = pii.find_spans([texts[3]], field)
    extra = [s for s in every if s not in base]
    assert [texts[3][a:b] for a, b, _ in extra] == ["555-0689"] and extra[0][2] == "phone"
    assert pii.find_spans([texts[6]], field)[0][1] == []


def plain_field(ratio):
    """Every shape speaks for none by this log ratio; neighbours do not matter."""
    size = len(pii.KINDS) + 1
    unary = np.full((1 << pii.BITS, size), float(ratio))
    unary[:, 0] = 0.0
    return pii.Field(unary, np.zeros((size, size)))


@pytest.mark.parametrize("ratio", [-1, -3])
def test_field_labels_all_repetitions(ratio):
    """One full phone number, then bare 40 times: every repetition gets the label, an unrelated number none."""
    text = "call +1 (437) 555-0689 or " + " ".join(f"word word 555-0689 and {7_000_000 + 13 * i} then" for i in range(40))
    other = "no 1234567 or 1234567"
    (base, every), (_, none) = pii.find_spans([text, other], plain_field(ratio))
    extra = [s for s in every if s not in base]
    assert [(text[a:b], k) for a, b, k in extra] == [("555-0689", "phone")] * 40 and none == []
    assert pii.find_spans([text], plain_field(ratio)) == [(base, every)]  # whatever the batch
    assert pii.find_spans([text.replace("+1 (437) 555-0689", "me")], plain_field(ratio)) == [([], [])]


def test_field_links_similar_numbers():
    text = "call +1 (437) 555-0689 or else 555 0689 or else 4375550689 or else 555 0688 or else 0689 end"
    (base, every), = pii.find_spans([text], plain_field(-1))
    assert [text[a:b] for a, b, _ in every if (a, b) not in [s[:2] for s in base]] == ["555", "0689", "4375550689"]


def test_pii_is_linear_on_long_runs():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "@" * 100_000):
        pii.base_spans(text)


# mixing ----------------------------------------------------------------------------

def test_mixing_meets_limits_and_budget(docs, rows):
    counted = mixing.counted(docs)
    tokens = {d: len(brute.WORDS.findall(t or "")) + 1 for d, t, *_ in rows}
    assert by_id(counted, "n_tokens") == {d: (n,) for d, n in tokens.items()}
    copies, mix = mixing.mixed(counted, entropy=0.99, repetition=3.0)
    got = copies.collect()
    quota = {r.source: (r.quota, r.tokens) for r in mix.sources.collect()}
    used = Counter()
    for r in got:
        used[r.source] += r.n_tokens
    longest = {s: max(tokens[d] for d, _, _, src, _ in rows if src == s) for s in quota}
    for s, (q, t) in quota.items():
        assert q - longest[s] < used[s] <= q and q <= 3.0 * t + 1
    times = Counter(r.doc_id for r in got)
    for s, (q, t) in quota.items():  # whole epochs read every row of a source
        assert all(times[d] in (q // t, q // t + 1) for d, _, _, src, _ in rows if src == s)
    assert all(0 <= r.block < mixing.BLOCKS for r in got)


def test_mixing_exponent_is_the_largest_that_reaches_the_entropy(spark):
    sizes = {"a": 1000, "b": 100, "c": 10}
    frame = spark.createDataFrame(list(sizes.items()), "source string, tokens long")
    mix = mixing.fit_mix(frame, entropy=0.8, repetition=1e9)

    def entropy(x):
        w = np.array(list(sizes.values())) ** x
        w = w / w.sum()
        return -(w * np.log(w)).sum()

    assert entropy(mix.exponent) >= 0.8 * np.log(3) > entropy(mix.exponent + 1 / mixing.STEPS)
    limited = mixing.fit_mix(frame, entropy=1.0, repetition=5.0)
    w = np.array(list(sizes.values())) ** limited.exponent
    assert (w / w.sum() * 1110 / np.array(list(sizes.values()))).max() <= 5.0 + 1e-9


def test_whole_mix_keeps_every_row(docs, rows):
    times = Counter(r.doc_id for r in mixing.mixed_documents(docs, entropy=0.95, repetition=2.0, whole=True).collect())
    assert set(times) == {r[0] for r in rows} and max(times.values()) == 2
    copies, _ = mixing.mixed(mixing.counted(docs), entropy=0.95, repetition=2.0, whole=True)
    assert times == Counter(r.doc_id for r in copies.collect())


# WARC --------------------------------------------------------------------------------

PAGES = [(i, f"http://h/{i}?ü\n", h) for i, h in enumerate([None, "", "<p>a</p>", "<p>é</p>" * 2000, "<p>a</p>", "x" * 200_000, None] + [f"<html>{i} common words of a page {i}</html>" * 20 for i in range(300)])]


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 60_000)
    archives = warc.write_archives(spark.createDataFrame(PAGES, "page_id long, url string, html string"))
    got = warc.read_archives(archives).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == brute.warc([(p, h) for p, _, h in PAGES])
    html = {p: (h or "").encode() for p, _, h in PAGES}
    assert all(bytes(r.payload) == html[r.page_id] for r in got if r.record_type == "response")


def test_warc_files_and_dictionary(spark, tmp_path):
    archives = warc.write_archives(spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1))
    assert sum(r.bytes for r in warc.export(archives, str(tmp_path)).collect()) == sum(f.stat().st_size for f in tmp_path.iterdir())
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert warc.read_archives(files, name="path").count() == len(PAGES)
    content = archives.first().content
    assert int.from_bytes(content[:4], "little") == warc.SKIPPABLE


def test_warc_rejects_damage():
    good = warc.archive([warc.record(i, "u", b"page " * 50, None) for i in range(3)])
    assert [warc.parse(d)["page_id"] for _, d in warc.frames(good)] == [0, 1, 2]
    with pytest.raises(ValueError):
        list(warc.frames(good[:-3]))
    raw = warc.record(1, "u", b"payload", None)
    for broken in (raw.replace(b"payload", b"payloaD"), raw.replace(b"WARC/1.1", b"WARX/1.1"), raw[:-1], raw.replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(ValueError):
            warc.parse(broken)


# fingerprints ------------------------------------------------------------------------------

def test_fingerprints(docs, rows):
    got = by_id(syncmers.compared(docs), "n_chars", "edited_sha256", "fingerprint", "near_edited", "near_next")
    assert {d: v[:2] for d, v in got.items()} == brute.edited([r[:2] for r in rows])
    text = {r[0]: r[1] or "" for r in rows}
    prints = {}
    for d, v in got.items():
        assert prints.setdefault(text[d], v[2]) == v[2] and 0 <= v[3] <= 1 and 0 <= v[4] <= 1
        if len(text[d]) > 300:
            assert v[3] > 0.5


def test_resolution_does_not_fall_with_length():
    """A passage of under one percent is seen between long texts that share nothing else."""
    rng = np.random.default_rng(9)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz "))
    text = lambda n: "".join(rng.choice(letters, n))
    shared = text(2000)
    for _ in range(3):
        a, b = (text(150_000) + shared + text(150_000) for _ in range(2))
        p, q = syncmers.fingerprint(a), syncmers.fingerprint(b)
        assert 0.001 < syncmers.likeness(p, q) < 0.03 and syncmers.likeness(p, syncmers.fingerprint(text(300_000))) == 0
        assert p[0] / 20 < len(p[1]) < p[0] / 12
    for n in (20, 500, 5000, 60_000):
        a = text(n)
        for part in (0.3, 0.7):
            b = a[: int(n * part)] + text(n - int(n * part))
            sets = [set(syncmers.anchors(syncmers.code_points(x))[0].tolist()) for x in (a, b)]
            want = 2 * len(sets[0] & sets[1]) / max(sum(map(len, sets)), 1)
            assert abs(syncmers.likeness(syncmers.fingerprint(a), syncmers.fingerprint(b)) - want) < 0.15


def test_anchors_are_context_free():
    rng = np.random.default_rng(6)
    text = "".join(rng.choice(list("abcdefgh "), 500))
    h, p = syncmers.anchors(syncmers.code_points(text))
    h2, p2 = syncmers.anchors(syncmers.code_points("zzz" + text))
    shifted = dict(zip(p2.tolist(), h2.tolist()))
    assert all(shifted[x + 3] == y for x, y in zip(p.tolist(), h.tolist()))
    k, s = syncmers.SIZES
    hashes = {i: syncmers.anchors(syncmers.code_points(text[i : i + k])) for i in range(5)}
    assert hashes  # windows alone do not fail
    assert syncmers.likeness(syncmers.fingerprint(text), syncmers.fingerprint(text)) == 1.0


# secrets ----------------------------------------------------------------------------------------

def test_secrets_equal_patterns(spark, docs, rows):
    ledger = secret_scan.BlobLedger(spark)
    ledger.scan(docs)
    got = by_id(secret_scan.report(ledger.by_path(docs)), "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    for d, t, *_ in rows:
        counts, spans = brute.secrets(t)
        assert list(got[d][:3]) == counts and got[d][3] == brute.sha(spans)
        assert set(filter(None, spans.split(","))) <= set(got[d][4].split(","))
    assert "private_key" in got[rows[-2][0]][4] and "url_login" in got[rows[-2][0]][4]


def test_secret_random_strings():
    rng = np.random.default_rng(8)
    parts = ["token", "API_key", "=", ":", " ", '"', "AKIA", "ABC123", "0123456789abcdef", "x", "-", "\n", "paSSword", "fff"]
    for _ in range(500):
        text = "".join(rng.choice(parts, rng.integers(0, 25)))
        low = text.lower()
        found = sorted((a, i, b) for i, k in enumerate(secret_scan.BASE_KINDS) for a, b in secret_scan.RULES[k][1](text, low))
        assert ",".join(f"{secret_scan.BASE_KINDS[k]}:{a}:{b}" for a, k, b in found) == brute.secrets(text)[1]


def test_ledger_scans_only_unseen_pairs(spark):
    def frame(*texts):
        return spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")

    ledger = secret_scan.BlobLedger(spark)
    assert ledger.scan(frame("a token=12345678", "b", "b")).count() == 2
    assert ledger.scan(frame("b", "c")).count() == 1
    rules = dict(secret_scan.RULES)
    rules["hex"] = (2, lambda text, low: [(0, 1)] if text == "c" else [])
    ledger.rules = rules
    again = ledger.scan(frame("b", "c", "d")).collect()
    assert sorted(len(r.rules) for r in again) == [1, 1, len(rules)]
    found = {r.doc_id: [(f.kind, f.start, f.end) for f in r.findings] for r in ledger.by_path(frame("a token=12345678", "c", "c", "d")).collect()}
    assert found == {"p0": [("assign", 2, 16)], "p1": [("hex", 0, 1)], "p2": [("hex", 0, 1)], "p3": []}


def test_ledger_outlives_its_object(spark, docs, rows, tmp_path):
    """Objects on one folder, as after a restart: nothing is scanned twice, no finding is lost."""
    folder = str(tmp_path / "ledger")
    first = secret_scan.BlobLedger(spark, folder)
    half = docs.filter(f"doc_id < {rows[len(rows) // 2][0]}")
    n = first.scan(half).count()
    second = secret_scan.BlobLedger(spark, folder)
    assert second.scan(half).count() == 0
    assert n + second.scan(docs).count() == len({t or "" for _, t, *_ in rows})
    third = secret_scan.BlobLedger(spark, folder, dict(reversed(secret_scan.RULES.items())))
    assert third.scan(docs).count() == 0
    whole = secret_scan.BlobLedger(spark)
    whole.scan(docs)
    want = by_id(secret_scan.report(whole.by_path(docs)), "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    for ledger in (second, secret_scan.BlobLedger(spark, folder)):
        assert by_id(secret_scan.report(ledger.by_path(docs)), "n_assign", "n_access", "n_hex", "base_sha256", "spans") == want
    kinds = lambda ledger: {r.doc_id: sorted((f.kind, f.start, f.end) for f in r.findings) for r in ledger.by_path(docs).collect()}
    assert kinds(third) == kinds(whole) and any(kinds(whole).values())


def test_secret_query_scans_in_steps(spark, docs, tmp_path, monkeypatch):
    """op10 scans in two steps or more, and the later ones leave out what the earlier ones read."""
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen, scan = [], secret_scan.BlobLedger.scan
    monkeypatch.setattr(secret_scan.BlobLedger, "scan", lambda self, *a: seen.append(scan(self, *a)) or seen[-1])
    got = queries.op10_secret_scan(spark, str(tmp_path))
    blobs = [r.blob for frame in seen for r in frame.collect()]
    assert len(seen) >= 2 and all(frame.count() for frame in seen) and len(blobs) == len(set(blobs))
    whole = secret_scan.BlobLedger(spark)
    whole.scan(docs)
    assert by_id(got, "spans") == by_id(secret_scan.report(whole.by_path(docs)), "spans")


# odd and empty tables --------------------------------------------------------------------------

def test_odd_rows(spark, odd, labels):
    n = odd.count()
    rules = quality_rules.fit_rules(odd, labels)
    assert quality_rules.judged(odd, rules).count() == n
    assert quality_rules.filtered(odd, rules).columns == odd.columns
    links = ngram_join.linked(odd).collect()
    assert len(links) == n and all((r.component_id is None) == (r.doc_id is None) for r in links)
    same = {r.component_id for r in links if r.doc_id == 27}
    assert len(same) == 1  # a doc_id with two texts is one document
    assert quality_model.scored(odd, quality_model.fit_model(odd, labels)).count() == n
    assert bpe.encoded(odd, RANKS, PATTERN).count() == n
    kept = line_dedup.with_kept(odd)
    assert kept.count() == n and kept.columns[: len(odd.columns)] == odd.columns
    assert pii.tagged(odd).count() == n
    assert mixing.mixed_documents(odd, whole=True).count() >= n
    assert syncmers.compared(odd).count() == n
    ledger = secret_scan.BlobLedger(spark)
    ledger.scan(odd)
    assert ledger.by_path(odd).count() == n


def test_empty_tables(spark, docs, labels):
    none, no_labels = docs.filter("false"), labels.filter("false")
    assert quality_rules.fit_rules(none, no_labels) == [] and quality_rules.judged(none, []).count() == 0
    assert ngram_join.linked(none).count() == 0
    assert quality_model.scored(none, quality_model.fit_model(none, no_labels)).count() == 0
    assert {r.score for r in quality_model.scored(docs, quality_model.fit_model(docs, no_labels)).collect()} == {0.5}
    assert bpe.encoded(none, RANKS, PATTERN).count() == 0
    assert line_dedup.with_kept(none).count() == 0
    assert pii.tagged(none).count() == 0
    assert mixing.mixed_documents(none).count() == 0 and mixing.mixed(mixing.counted(none))[0].count() == 0
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
    assert syncmers.compared(none).count() == 0
    ledger = secret_scan.BlobLedger(spark)
    ledger.scan(none)
    assert ledger.by_path(none).count() == 0


def test_sample_is_stable(spark):
    frame = spark.range(5000).withColumnRenamed("id", "doc_id")
    a = {r.doc_id for r in bounded_sample(frame, "doc_id", 500).collect()}
    assert a == {r.doc_id for r in bounded_sample(frame.repartition(7), "doc_id", 500).collect()} and 400 < len(a) < 600
    assert bounded_sample(frame, "doc_id", 5000).count() == 5000
    assert pick(frame, x="DOC_ID").columns == ["x"]
    assert json.dumps(hashlib.sha256(b"").hexdigest())
