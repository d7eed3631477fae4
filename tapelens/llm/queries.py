"""The thin registered queries of the text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelens.llm import bpe, fim, lexical_search, line_dedup, mixing, ngram_join, pii, quality_model, quality_rules, secret_scan, syncmers, warc, winnowing
from tapelens.llm.common import table
from tapelens.session import shared_path

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Scans that op10 deals the documents to, by hash of doc_id.
SCANS = 2


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    rules = quality_rules.fit_rules(docs, table(spark, folder, "labels"))
    return quality_rules.judged(docs, rules).select("doc_id", *quality_rules.COUNTS, "base_failed", "rule", "kept")


def op2_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.linked(table(spark, folder, "documents"), n=3, percent=90)


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scores = quality_model.scored(docs, quality_model.fit_model(docs, table(spark, folder, "labels")))
    return scores.select("doc_id", quality_model.held_out().alias("held_out"), "score", (F.col("score") >= quality_model.THRESHOLD).cast("int").alias("predicted"))


def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encoded(table(spark, folder, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.with_kept(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.tagged(table(spark, folder, "documents"))


def op7_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    copies, _ = mixing.mixed(mixing.counted(table(spark, folder, "documents")))
    return copies.select("doc_id", "source", "n_tokens", "epoch", "block", "place")


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, folder, "pages")), payloads=False)


def op9_syncmers(spark: SparkSession, folder: str) -> DataFrame:
    return syncmers.compared(table(spark, folder, "documents"))


def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    shelf = shared_path(spark, "secret-ledger")
    for i in range(SCANS):  # as on following days: each scan has a new object and finds the others' entries in the folder
        secret_scan.BlobLedger(spark, shelf).scan(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SCANS)) == i))
    return secret_scan.report(secret_scan.BlobLedger(spark, shelf).by_path(docs))


def op11_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return winnowing.report(winnowing.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.searched(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fim.fill_in_middle(fim.framed(table(spark, folder, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_quality_rules, op2_ngram_jaccard, op3_quality_classifier, op4_byte_bpe, op5_line_dedup,
    op6_pii, op7_source_mixing, op8_warc, op9_syncmers, op10_secret_scan,
    op11_decontamination, op12_lexical_search, op13_fill_in_middle)}

SQL: dict[str, str] = {"op5_line_dedup": line_dedup.SQL, "op7_source_mixing": mixing.SQL, "op8_warc": warc.SQL,
                       "op11_decontamination": winnowing.SQL, "op12_lexical_search": lexical_search.SQL, "op13_fill_in_middle": fim.SQL}
