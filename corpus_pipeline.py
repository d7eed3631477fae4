"""The corpus pipeline: quality rules, line dedup, near-duplicate join, source mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. Stages but the
last return the columns they were given, with n_chars brought up to date. Near duplicates are
documents with a Jaccard index of 0.8 or more on five-word shingles; the smallest doc_id of a
component stays. Mixing reads every remaining document at least once and repeats those of small
sources (to at most REPETITION times as often as the largest); texts are never cut.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelens.llm import bpe, line_dedup, mixing, ngram_join, quality_rules
from tapelens.llm.common import table
from tapelens.session import stored

SHINGLE_WORDS, PERCENT = 5, 80
ENTROPY, REPETITION = 0.95, 2.0
RANKS = "byte_bpe_multi_50k.tiktoken"

#: Learned rules, component search and BPE merges cannot be stated in SQL; tests compare with brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose document the learned rules keep."""
    rules = quality_rules.fit_rules(docs, table(spark, sf_dir, "labels"))
    return quality_rules.filtered(docs, rules)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that other documents keep."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    kept = line_dedup.with_kept(docs).toDF(*names, "n_lines", "n_dropped", "kept_text")
    text = F.when(F.col(names[docs.columns.index("text")]).isNotNull(), F.col("kept_text"))
    changed = {"text": text, "n_chars": F.length(text).cast("long")}
    return kept.select(*[changed.get(c, F.col(n)).alias(c) for n, c in zip(names, docs.columns)])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    gone = ngram_join.linked(docs, SHINGLE_WORDS, PERCENT).filter("component_id < doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    plain = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    gone_id = F.col(f"_c{docs.columns.index('doc_id')}") == F.col("__gone")
    return plain.join(stored(gone, "near-duplicates"), gone_id, "left_anti").toDF(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix reads them."""
    return mixing.mixed_documents(docs, entropy=ENTROPY, repetition=REPETITION, whole=True)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the final corpus."""
    return bpe.encoded(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [("quality_rules", quality_stage), ("line_dedup", line_stage), ("ngram_jaccard_join", near_duplicate_stage),
          ("source_mixing", mixing_stage), ("byte_bpe", encoding_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
