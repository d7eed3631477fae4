"""Versioned model artifacts in a shared folder, and a pointer that moves only after a clean audit.

    <folder>/v=<version>/<head>/model    the fitted classifier as Spark ML writes it
    <folder>/v=<version>/meta            one JSON line: features, fills, calibrators, thresholds, population
    <folder>/pointer/seq=<n>             one row each: the version in force from this move on

A version is written whole before anything points to it, and moves of the pointer are only added, so
a job that dies half-way leaves the version in force untouched.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelens.operators.models import Head

KINDS = {"gbm": GBTClassificationModel, "logistic": LogisticRegressionModel}


class ModelStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def save(self, version: int, heads: dict[str, Head], **meta) -> None:
        """Write a candidate; it is not in force before `promote`. A head that met no data gate is absent."""
        for name, h in heads.items():
            h.model.write().overwrite().save(f"{self.folder}/v={version}/{name}/model")
        body = meta | {"version": version, "heads": {name: {"features": h.features, "median": h.median, "mean": h.mean, "sd": h.sd, "kind": h.kind,
                                                            "platt": h.platt, "threshold": h.threshold, "meta": h.meta, "indicators": h.indicators} for name, h in heads.items()}}
        self.spark.createDataFrame([(json.dumps(body),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/v={version}/meta")

    def pointer(self) -> DataFrame:
        """(seq, version) of every move."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/pointer")
        schema = "version long, seq long"
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/pointer")

    def current(self) -> int | None:
        row = self.pointer().agg(F.max_by("version", "seq").alias("v"), F.max("seq").alias("seq")).first()
        return row.v

    def promote(self, version: int, audit: DataFrame) -> bool:
        """Put a saved version in force unless a row of the audit failed (ok = 0); otherwise keep the old one."""
        if not audit.filter("ok = 0").isEmpty():
            return False
        last = self.pointer().agg(F.max("seq")).first()[0]
        self.spark.createDataFrame([(version,)], "version long").coalesce(1).write.parquet(f"{self.folder}/pointer/seq={0 if last is None else last + 1}")
        return True

    def meta(self, version: int | None = None) -> dict | None:
        """Metadata of a version, of the one in force by default; None when there is none."""
        version = self.current() if version is None else version
        return None if version is None else json.loads(self.spark.read.text(f"{self.folder}/v={version}/meta").first().value)

    def heads(self, version: int | None = None) -> dict[str, Head]:
        meta = self.meta(version)
        out = {}
        for name, h in (meta or {"heads": {}})["heads"].items():
            model = KINDS[h["kind"]].load(f"{self.folder}/v={meta['version']}/{name}/model")
            out[name] = Head(h["features"], h["median"], h["mean"], h["sd"], h["kind"], model, tuple(h["platt"]) if h["platt"] else None, h["threshold"], h["meta"], h["indicators"])
        return out

    def scored(self, snapshots: DataFrame) -> DataFrame:
        """`snapshots` with model_version, p_<head> and alert_<head> of the version in force, in one pass.

        Without any version in force every coin keeps a null version: no second opinion, never a failure.
        """
        meta = self.meta()
        out = snapshots.withColumn("model_version", F.lit(None if meta is None else meta["version"]).cast("long"))
        for name, h in self.heads().items():
            out = h.score(out, raw="__p", calibrated=f"p_{name}").drop("__p").withColumn(f"p_{name}", F.round(f"p_{name}", 4))
            fires = F.col(f"p_{name}") >= h.threshold if h.threshold is not None else F.lit(False)
            out = out.withColumn(f"alert_{name}", fires.cast("int"))
        return out


#: What a stored model may not hold.
EARLY_HEADS, LATE_PREFIX = {"survive60"}, "e5_"


def artifact_checks(meta: dict | None, early: dict | None, spark: SparkSession) -> DataFrame:
    """Audit rows (check, ok, detail) on stored metadata: forbidden heads of the early model, forbidden features of the other."""
    late = sorted({f for h in (meta or {"heads": {}})["heads"].values() for f in h["features"] if f.startswith(LATE_PREFIX)})
    extra = sorted(set((early or {"heads": {}})["heads"]) - EARLY_HEADS)
    rows = [("model_present", int(meta is not None), "" if meta else "missing"), ("no_late_features", int(not late), ",".join(late)), ("early_heads_allowed", int(not extra), ",".join(extra))]
    return spark.createDataFrame(rows, "check string, ok int, detail string")
