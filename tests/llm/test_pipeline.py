"""The pipeline, stage by stage against plain versions, and as a whole."""

from collections import Counter

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tapelens.llm import quality_rules


@pytest.fixture(scope="module")
def folder(tmp_path_factory, docs, labels):
    at = tmp_path_factory.mktemp("corpus")
    docs.write.parquet(f"{at}/documents.parquet")
    labels.write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages(spark, docs, labels, folder):
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        columns = docs.columns
        docs = stage(spark, docs, folder).checkpoint()
        rows = docs.collect()
        if name == "quality_rules":
            rules = quality_rules.fit_rules(spark.read.parquet(f"{folder}/documents.parquet"), labels)
            judged = quality_rules.judged(spark.read.parquet(f"{folder}/documents.parquet"), rules)
            assert {r.doc_id for r in rows} == {r.doc_id for r in judged.filter("kept").collect()} and len(rows) > 25
        elif name == "line_dedup":
            want = brute.line_dedup(list(before.items()))
            assert {r.doc_id: brute.sha(r.text) for r in rows} == {d: w[2] for d, w in want.items()}
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "ngram_jaccard_join":
            want = brute.components(list(before.items()), 5, 80)
            assert sorted(r.doc_id for r in rows) == sorted(d for d, (_, c) in want.items() if c == d) and len(rows) < len(before)
        elif name == "source_mixing":
            times = Counter(r.doc_id for r in rows)
            assert set(times) == set(before) and max(times.values()) <= 2
            assert all(before[r.doc_id] == r.text for r in rows)
        if name != "byte_bpe":
            assert docs.columns == columns
        else:
            assert all(r.decoded_sha256 == brute.sha(before[r.doc_id]) for r in rows)


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 20
    assert out.agg(F.sum("n_tokens")).first()[0] > 10_000
