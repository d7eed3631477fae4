"""Model heads on Spark ML: matrix, logistic and boosted trees, calibration in time, walk-forward.

A head is what scoring needs and nothing else: feature names, the fill and scale of each column, the
fitted classifier, the calibrator and the alert threshold. Columns are prepared by expressions, so a
batch is scored in one pass. Every fit reads a stored vector table of its own training block.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelens.operators import evaluation as ev
from tapelens.session import stored

#: Boosted trees of a full model, as the reference fits it; deviations at which scaled inputs are cut.
TREES, CLIP = 300, 5.0
#: Rows below which a fold, a calibrator or a head is left out.
MIN_TRAIN, MIN_TEST, MIN_INNER, MIN_TAIL, MIN_HEAD = 50, 10, 40, 20, 500
#: Rows of a training partition: boosting runs a few small jobs per tree, so few tasks win.
PART_ROWS = 50_000


@dataclass
class Head:
    """Everything that turns a snapshot into a calibrated probability."""

    features: list[str]
    median: list[float]
    mean: list[float]
    sd: list[float]
    kind: str
    model: object = None
    platt: tuple[float, float] | None = None
    threshold: float | None = None
    meta: dict = field(default_factory=dict)
    #: Features with a missing sign; all of them unless a model names its own.
    indicators: list[str] | None = None

    def signs(self) -> list[str]:
        return self.features if self.indicators is None else self.indicators

    def columns(self) -> list[str]:
        return self.features + [f"{f}_missing" for f in self.signs()]

    def vector(self) -> Column:
        """Filled features, then one missing sign per feature; scaled and cut for the logistic model only."""
        raw = [F.coalesce(F.col(f).cast("double"), F.lit(m)) for f, m in zip(self.features, self.median)]
        raw += [F.col(f).isNull().cast("double") for f in self.signs()]
        if self.kind == "logistic":
            raw = [F.greatest(F.least((c - m) / s, F.lit(CLIP)), F.lit(-CLIP)) for c, m, s in zip(raw, self.mean, self.sd)]
        return array_to_vector(F.array(*raw))

    def score(self, df: DataFrame, raw: str = "p", calibrated: str = "p_cal") -> DataFrame:
        """`df` with the classifier's probability and the calibrated one."""
        scored = self.model.transform(df.withColumn("x", self.vector())).withColumn(raw, vector_to_array("probability")[1])
        scored = scored.drop("x", "rawPrediction", "probability", "prediction")
        return scored.withColumn(calibrated, platt_apply(self.platt, raw) if self.platt else F.col(raw))


def fitted_columns(df: DataFrame, features: list[str], kind: str, indicators: list[str] | None = None) -> Head:
    """Medians, means and deviations of one training block; a feature without any value is left out."""
    x = {f: F.col(f).cast("double") for f in features}
    row = df.agg(*[F.percentile_approx(x[f], 0.5, 10_000).alias(f"m_{f}") for f in features]).first()
    used = [f for f in features if row[f"m_{f}"] is not None]
    median = [float(row[f"m_{f}"]) for f in used]
    signs = used if indicators is None else [f for f in indicators if f in used]
    filled = [F.coalesce(x[f], F.lit(m)) for f, m in zip(used, median)] + [F.col(f).isNull().cast("double") for f in signs]
    row = df.agg(*[F.avg(c).alias(f"a_{i}") for i, c in enumerate(filled)], *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(filled)]).first()
    sd = [row[f"s_{i}"] or 0.0 for i in range(len(filled))]
    return Head(used, median, [row[f"a_{i}"] or 0.0 for i in range(len(filled))], [s if s >= 1e-9 else 1.0 for s in sd], kind, indicators=signs)


def classifier(kind: str, label: str, trees: int = TREES):
    """Logistic with L2, or shallow boosted trees with row subsampling."""
    if kind == "gbm":
        return GBTClassifier(featuresCol="x", labelCol=label, maxIter=trees, maxDepth=3, stepSize=0.05, subsamplingRate=0.8, minInstancesPerNode=30, seed=0,
                             cacheNodeIds=False, checkpointInterval=50)
    return LogisticRegression(featuresCol="x", labelCol=label, regParam=0.01, maxIter=100, standardization=False)


def fit(df: DataFrame, features: list[str], label: str, kind: str = "logistic", trees: int = TREES, indicators: list[str] | None = None) -> Head:
    """A head without calibrator. The vectors are written once in as few partitions as their number needs."""
    head = fitted_columns(df, features, kind, indicators)
    rows = df.count()
    x = df.select(head.vector().alias("x"), F.col(label).cast("double").alias(label)).coalesce(max(1, -(-rows // PART_ROWS)))
    head.model = classifier(kind, label, trees).fit(stored(x, "training-vectors"))
    return head


def _logit(p: str) -> Column:
    c = F.greatest(F.least(F.col(p), F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(c / (1 - c))


def platt_fit(held: DataFrame, p: str, label: str) -> tuple[float, float] | None:
    """Slope and shift of a one-feature logistic on the logit of a score; None when a class is missing."""
    x = held.select(array_to_vector(F.array(_logit(p))).alias("x"), F.col(label).cast("double").alias(label))
    if x.agg(F.countDistinct(label)).first()[0] < 2:
        return None
    m = LogisticRegression(featuresCol="x", labelCol=label, standardization=False).fit(x)
    return float(m.coefficients[0]), float(m.intercept)


def platt_apply(platt: tuple[float, float], p: str) -> Column:
    return 1.0 / (1.0 + F.exp(-(F.lit(platt[0]) * _logit(p) + F.lit(platt[1]))))


def isotonic(held: DataFrame, df: DataFrame, p: str, label: str, out: str = "p_cal") -> DataFrame:
    m = IsotonicRegression(featuresCol=p, labelCol=label).fit(held.select(p, F.col(label).cast("double").alias(label)))
    return m.transform(df).withColumnRenamed("prediction", out)


def fold_scores(df: DataFrame, features: list[str], label: str, kind: str, k: int, sizes: tuple[int, int], calibration: str | None, trees: int) -> DataFrame | None:
    """Predictions of fold k by a model of everything before it.

    The calibrator comes from a model of the first four fifths of the training block in time, scored
    on the last fifth; the scoring model is then fitted on the whole block.
    """
    n_train, n_test = sizes
    if n_test < MIN_TEST or n_train < MIN_TRAIN:
        return None
    train, test = df.filter(F.col("rank") <= n_train), df.filter(F.col("fold") == k)
    cut = int(n_train * 0.8)
    held = None
    with ThreadPoolExecutor(2) as pool:
        whole = pool.submit(fit, train, features, label, kind, trees)
        if calibration and cut > MIN_INNER and n_train - cut > MIN_TAIL:
            inner = fit(train.filter(F.col("rank") <= cut), features, label, kind, trees)
            held = inner.score(train.filter(F.col("rank") > cut)).select("p", label)
        scored = whole.result().score(test)
    if held is not None and calibration == "isotonic":
        scored = isotonic(held, scored.drop("p_cal"), "p", label)
    elif held is not None and (platt := platt_fit(held, "p", label)):
        scored = scored.withColumn("p_cal", platt_apply(platt, "p"))
    return stored(scored.select("sample_id", "fold", label, "p", "p_cal"), f"fold-{k}")


def walk_forward(df: DataFrame, features: list[str], label: str, kind: str, folds: int, calibration: str | None = "platt", trees: int = TREES) -> DataFrame:
    """Pooled out-of-time predictions (sample_id, fold, label, p, p_cal).

    Expects fold (-1 for the opening block) and rank, the place in time from 1. Folds are independent
    jobs and run side by side, since a boosted fit alone cannot fill a cluster.
    """
    n = {r.fold: r["count"] for r in df.groupBy("fold").count().collect()}  # one row a fold
    before = [sum(v for f, v in n.items() if f < k) for k in range(folds)]
    with ThreadPoolExecutor(folds) as pool:
        jobs = [pool.submit(fold_scores, df, features, label, kind, k, (before[k], n.get(k, 0)), calibration, trees) for k in range(folds)]
        parts = [p for j in jobs if (p := j.result()) is not None]
    if not parts:
        return df.select("sample_id", "fold", label, F.lit(0.0).alias("p"), F.lit(0.0).alias("p_cal")).limit(0)
    return reduce(DataFrame.unionByName, parts)


def train_head(df: DataFrame, features: list[str], label: str, kind: str = "gbm", trees: int = TREES, min_rows: int = MIN_HEAD, precision: float = 0.93) -> Head | None:
    """A calibrated head with its alert threshold, or None when the data gate is not met.

    The calibrator and the threshold come from the last fifth in time, by a model that has not seen
    it; the threshold is the least calibrated score that is still this precise on 20 alerts or more.
    """
    rows = df.filter(F.col(label).isNotNull())
    ranked = ev.time_ranked(rows, "grad", "sample_id", 30)
    ranked = stored(ranked, "head-rows")
    n = ranked.count()
    if n < min_rows or ranked.agg(F.countDistinct(label)).first()[0] < 2:
        return None
    cut = int(n * 0.8)
    inner = fit(ranked.filter(F.col("rank") <= cut), features, label, kind, trees)
    tail = stored(inner.score(ranked.filter(F.col("rank") > cut)).select("p", label), "head-tail")
    head = fit(ranked, features, label, kind, trees)
    head.platt = platt_fit(tail, "p", label)
    at = tail.withColumn("s", F.round(platt_apply(head.platt, "p") if head.platt else F.col("p"), 3))
    head.threshold = ev.alert_threshold(at, "s", label, precision=precision).first()[0]
    roc = ev.roc_auc(tail, [], "p", label).first()
    head.meta = {"n": n, "base_rate": float(ranked.agg(F.avg(label)).first()[0]), "tail_roc": roc.auc if roc else None, "label": label}
    return head


def coefficients(head: Head, spark) -> DataFrame:
    """(feature, coef, size) of a logistic head on scaled inputs."""
    return spark.createDataFrame([(n, float(c), abs(float(c))) for n, c in zip(head.columns(), head.model.coefficients)], "feature string, coef double, size double")


def head_report(pred: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """AUC, average precision and Brier of calibrated predictions."""
    b = ev.brier(pred, keys, "p_cal", label)
    return ev.roc_auc(pred, keys, "p_cal", label).drop("n").join(ev.average_precision(pred, keys, "p_cal", label), keys).join(b, keys)
