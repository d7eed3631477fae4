"""Quality rules: a decision list learned by sequential covering.

Text statistics of labelled documents grow conjunctions of thresholds (``symbol_share >= 0.2
AND ...``) that single out rejected texts; each is pruned on rows it was not grown on, and the
accepted ones become one ordered Spark conditional expression over the statistics.

Null and empty texts have zero in all statistics; repeated rows are judged one by one; a table
without labels gives an empty list, which keeps every text. Statistics with a zero denominator
are 0. Ties between conditions go to the first statistic and the lowest threshold.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tapelens.llm.common import WHITESPACE, arrow_map, bounded_sample, pick, quality_labels, words_of

SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = ["word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share", "distinct_share"]
#: Statistics that the rules may test.
FEATURES = ["n_words", *SHARES]
STATS_SCHEMA = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS], *[(c, pa.float64()) for c in SHARES]])

#: Labelled rows that the list is fitted on, at most about this many.
FIT_ROWS = 20_000
#: Thresholds tried per statistic, conditions per rule, rules per list.
CUTS, MAX_CONDITIONS, MAX_RULES = 32, 3, 12
#: A rule must be right on this share of the held-back rows it covers, and cover so many rows.
MIN_PRECISION, MIN_COVER = 0.9, 8

MIN_WORDS = 50


def text_counts(text: str | None) -> list[float]:
    """The COUNTS and SHARES of one text."""
    text = text or ""
    words = words_of(text)
    n = len(words)
    word_chars = len(text) - sum(map(text.count, WHITESPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = text.split("\n")
    full = [x for x in lines if x.strip(WHITESPACE)]
    dup_lines = len(full) - len(set(full))
    repeated = repeat_words(words)
    return [n, word_chars, symbols, dup_lines, repeated,
            word_chars / max(n, 1), symbols / max(word_chars, 1), dup_lines / len(lines), repeated / max(n, 1),
            sum(map(bytes.isupper, words)) / max(n, 1), text.count("!") / max(n, 1), len(set(words)) / max(n, 1)]


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    hit = np.fromiter((seen[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for i in range(3):
        covered[i : i + len(hit)] |= hit
    return int(covered.sum())


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, COUNTS, SHARES) of every whole text."""
    def step(cols):
        rows = [text_counts(t) for t in cols["text"]]
        return {"doc_id": cols["doc_id"], **dict(zip(COUNTS + SHARES, zip(*rows)))}

    return arrow_map(pick(docs, doc_id=id_col, text=text_col), STATS_SCHEMA, step)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= self.threshold if self.above else c < self.threshold

    def mask(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v >= self.threshold if self.above else v < self.threshold


Rule = tuple[Condition, ...]


def rule_mask(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([c.mask(x) for c in rule], initial=True)


def learn_list(x: np.ndarray, reject: np.ndarray) -> list[Rule]:
    """Sequential covering: grow on two thirds, prune on the rest, remove what is covered, repeat."""
    rules: list[Rule] = []
    held = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)
    while len(rules) < MAX_RULES and reject[left & ~held].any():
        grow, prune = left & ~held, left & held
        rule = prune_rule(grow_rule(x[grow], reject[grow]), x[prune], reject[prune])
        covers = rule_mask(rule, x)
        check = covers & prune if (covers & prune).any() else covers & grow
        if not rule or (covers & left).sum() < MIN_COVER or reject[check].mean() < MIN_PRECISION:
            break
        rules.append(rule)
        left &= ~covers
    return rules


def grow_rule(x: np.ndarray, y: np.ndarray) -> Rule:
    """Add the condition of the highest information gain until only rejected rows are covered."""
    rule: Rule = ()
    inside = np.ones(len(x), bool)
    while len(rule) < MAX_CONDITIONS and not y[inside].all():
        p, n = y[inside].sum(), (~y[inside]).sum()
        best, gain = None, 1e-9
        for f, name in enumerate(FEATURES):
            for cut in np.unique(np.quantile(x[inside, f], np.linspace(0, 1, CUTS + 1), method="higher")):
                for above in (True, False):
                    c = Condition(name, above, float(cut))
                    m = inside & c.mask(x)
                    p1, n1 = y[m].sum(), (~y[m]).sum()
                    if p1:
                        g = p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p / (p + n)))
                        if g > gain:
                            best, gain = c, g
        if best is None:
            break
        rule += (best,)
        inside &= best.mask(x)
    return rule


def prune_rule(rule: Rule, x: np.ndarray, y: np.ndarray) -> Rule:
    """The shortest prefix of the rule that is worth most on held-back rows."""
    def worth(r: Rule) -> float:
        m = rule_mask(r, x)
        return (y[m].sum() - (~y[m]).sum()) / max(m.sum(), 1)

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=worth, default=())


def fit_rules(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> list[Rule]:
    """Learn the list from about `rows` labelled documents (a bounded hash sample of the labels)."""
    sample = bounded_sample(quality_labels(labels), "doc_id", rows)
    chosen = pick(docs, doc_id="doc_id", text="text").join(F.broadcast(sample), "doc_id")  # at most about `rows` ids
    stats = text_statistics(chosen).join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])
    got = stats.select("doc_id", "label", *FEATURES).toPandas().sort_values("doc_id")
    order = np.argsort(np.random.default_rng(7).random(len(got)), kind="stable")
    return learn_list(got[FEATURES].to_numpy(float)[order], (got["label"] == 0).to_numpy()[order])


def rule_column(rules: list[Rule]) -> Column:
    """Number of the first rule that fires (from 1), else 0: one ordered conditional expression."""
    out = None
    for i, rule in enumerate(rules, 1):
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, i) if out is None else out.when(test, i)
    return F.lit(0) if out is None else out.otherwise(0)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Statistics, base test, first rule that fired, and the verdict of every document."""
    return (text_statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", rule_column(rules))
            .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)))


def filtered(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows whose text is kept, with their own columns; the text is judged where it lies, without a join."""
    @F.pandas_udf(from_arrow_schema(pa.schema([f for f in STATS_SCHEMA if f.name != "doc_id"])))
    def statistics(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_counts(t) for t in texts], columns=COUNTS + SHARES).astype(dict.fromkeys(COUNTS, "int64") | dict.fromkeys(SHARES, "float64"))

    at = {c: i for i, c in reversed(list(enumerate(docs.columns)))}
    plain = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    judged_rows = plain.select("*", statistics(f"_c{at[text_col]}").alias("_s")).select("*", "_s.*")
    kept = judged_rows.filter(~base_failed() & (rule_column(rules) == 0))
    return kept.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
