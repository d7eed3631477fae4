"""Secret scans over a blob ledger.

Every version of every document is addressed by the digest of its content. The ledger is a table
in the shared folder with one row per scanned blob: the rule versions that it was scanned with and
what they found. A scan reads only pairs of blob and rule version that the ledger does not hold,
appends them, and joins the findings back to all paths (documents, versions) of a blob. A changed
rule gets a new version and is run alone over the known blobs.

Null texts count as empty. Equal texts are one blob however many rows hold them, also a hot one:
copies are combined before the shuffle. The ledger outlives its object: all state is one Parquet
table with a partition for each scan, so a new object on the same folder knows all former scans.
A row holds all that its rule versions found in its blob, so whatever an interrupted scan leaves is
valid, and repeating the scan reads only the rest. Spans are code points, end exclusive.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelens.llm.common import arrow_map, pick
from tapelens.session import shared_path

BASE_KINDS = ["assign", "access", "hex"]

ASSIGN = re.compile(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
                    r"[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+")
PRIVATE_KEY = re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----")
WEB_TOKEN = re.compile(r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+")
BEARER = re.compile(r"[bB]earer\x20++([A-Za-z0-9+/_.=-]{20,}+)")
URL_LOGIN = re.compile(r"://[A-Za-z0-9._-]++:([^\x20\x09-\x0D/:@]{6,64})@")


def _assign(text: str, low: str):
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        return [m.span() for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    return []


#: name -> (version, finder over the text and its lower-case form). The first three are the base.
RULES: dict[str, tuple[int, Callable]] = {
    "assign": (1, _assign),
    "access": (1, lambda text, low: [m.span() for m in ACCESS.finditer(text)] if "AKIA" in text else []),
    "hex": (1, lambda text, low: [m.span() for m in HEX.finditer(text)]),
    "private_key": (1, lambda text, low: [m.span() for m in PRIVATE_KEY.finditer(text)] if "PRIVATE KEY" in text else []),
    "web_token": (1, lambda text, low: [m.span() for m in WEB_TOKEN.finditer(text)] if "eyJ" in text else []),
    "bearer": (1, lambda text, low: [m.span() for m in BEARER.finditer(text)] if "bearer" in low else []),
    "url_login": (1, lambda text, low: [m.span() for m in URL_LOGIN.finditer(text)] if "://" in text else []),
}

SPAN = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int64())])
LEDGER = pa.schema([("blob", pa.string()), ("rules", pa.list_(pa.string())), ("findings", pa.list_(SPAN))])
LEDGER_DDL = "blob string, rules array<string>, findings array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def rule_names(rules: dict) -> list[str]:
    return [f"{name}@{version}" for name, (version, _) in rules.items()]


def blob_of(text: str = "text") -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


class BlobLedger:
    """Scanned (blob, rule version) pairs and their findings: one table in a folder, a partition for each scan.

    A given folder may hold the scans of earlier objects; without one the ledger starts empty.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, rules: dict | None = None):
        self.spark, self.rules = spark, rules or RULES
        self.folder = folder or shared_path(spark, "secret-ledger")
        # an empty first partition, so that the table can be read before the first scan
        spark.createDataFrame([], LEDGER_DDL).write.mode("ignore").parquet(f"{self.folder}/batch=start")

    def entries(self) -> DataFrame:
        return self.spark.read.schema(LEDGER_DDL).parquet(self.folder).select("blob", "rules", "findings")

    def scan(self, versions: DataFrame, text: str = "text") -> DataFrame:
        """Scan what is unseen, append it to the ledger, and return the entries appended."""
        blobs = pick(versions, text=text).select(blob_of().alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
        # one row per content: equal texts are combined within each task before they are shuffled
        contents = blobs.groupBy("blob").agg(F.first("text").alias("text"))
        wanted = F.array(*[F.lit(n) for n in rule_names(self.rules)])
        known = self.entries().select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("known"))
        todo = F.array_except(wanted, F.coalesce("known", F.array().cast("array<string>")))
        unseen = contents.join(known, "blob", "left").select("blob", "text", todo.alias("rules")).filter(F.size("rules") > 0)
        rules = self.rules
        rank = {name: i for i, name in enumerate(rules)}

        def step(cols):
            found = []
            for text, names in zip(cols["text"], cols["rules"]):
                low = text.lower()
                found.append([{"start": a, "rank": rank[k], "kind": k, "end": b}
                              for k in (n.split("@")[0] for n in names) for a, b in rules[k][1](text, low)])
            return {"blob": cols["blob"], "rules": cols["rules"], "findings": found}

        path = f"{self.folder}/batch=scan-{uuid.uuid4().hex}"
        arrow_map(unseen, LEDGER, step).write.parquet(path)
        return self.spark.read.schema(LEDGER_DDL).parquet(path)

    def findings(self) -> DataFrame:
        """(blob, findings) of all blobs with any, under the current rule versions, in order."""
        current = F.array(*[F.lit(n) for n in rule_names(self.rules)])
        live = F.transform(F.array_intersect("rules", current), lambda r: F.substring_index(r, "@", 1))
        # rank by the rules of now: an earlier object may have had them in another order
        names = F.array(*[F.lit(n) for n in self.rules])
        ranked = F.transform(F.filter("findings", lambda f: F.array_contains(live, f["kind"])),
                             lambda f: F.struct(f["start"].alias("start"), (F.array_position(names, f["kind"]) - 1).cast("int").alias("rank"), f["kind"].alias("kind"), f["end"].alias("end")))
        kept = self.entries().filter(F.size("findings") > 0).select("blob", ranked.alias("found"))
        # distinct: two scans at the same time may both have read a blob
        found = F.array_sort(F.array_distinct(F.flatten(F.collect_list("found"))))
        return kept.groupBy("blob").agg(found.alias("findings")).filter(F.size("findings") > 0)

    def by_path(self, versions: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
        """(path, findings) of every row, findings empty where there are none."""
        paths = pick(versions, doc_id=path, text=text).select("doc_id", blob_of().alias("blob"))
        none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
        return paths.join(self.findings(), "blob", "left").select("doc_id", F.coalesce("findings", none).alias("findings"))


def joined(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def of_kinds(*kinds: str) -> Column:
    return F.filter("findings", lambda f: f["kind"].isin(*kinds))


def report(found: DataFrame) -> DataFrame:
    """Counts of base findings by kind, their digest, and all spans."""
    counts = [F.size(of_kinds(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(of_kinds(*BASE_KINDS)).cast("binary"), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))
