r"""Secret scans with an incremental blob ledger.

Every version of every text is addressed by the SHA-256 of its content. The ledger, a table in a shared folder, has one row per pair of blob
and rule version that was ever scanned, with the spans found. A run scans only the pairs that the ledger lacks, once per blob however many
documents hold it, appends them, and joins the findings back to all documents. A changed rule has another version, so it alone is run again.

Defined results: a null text is empty; spans are code points, end exclusive, leftmost and not overlapping within a rule; repeated rows and
several texts of one doc_id get their findings each; a null doc_id stays null; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorefold.llm import query
from scorefold.llm.common import ship, small, stored, table
from scorefold.session import shared_folder

ship(__name__)


class Rule(NamedTuple):
    kind: str
    pattern: str
    least: int  # characters of `group` that a match must have; shorter matches are dropped after they are made
    group: int
    hints: tuple[str, ...]  # a match holds one of these, lower-cased (empty: no hint)

    @property
    def version(self) -> str:
        return f"{self.kind}@{hashlib.sha256(repr(self[1:4]).encode()).hexdigest()[:16]}"


#: In the order of kinds at equal starts. The first three are the base rules (fixed patterns), the others are added by this operator.
RULES = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 8, 2, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", r"AKIA[A-Z0-9]+", 16, 0, ("akia",)),
    Rule("hex", r"[0-9a-f]+", 32, 0, ()),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40, 0, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, ("private key-----",)),
]
BASE = ("assign", "access", "hex")
LEDGER = "blob binary, rule string, spans array<struct<start:int,end:int>>"


def find(text: str, rule: Rule, lowered: str | None = None) -> list[tuple[int, int]]:
    """The spans of one rule in one text."""
    if rule.hints and not any(h in (text.lower() if lowered is None else lowered) for h in rule.hints):
        return []
    if rule.pattern == r"[0-9a-f]+":  # runs of one class: only long ones need a look
        return [m.span() for m in re.finditer(rf"[0-9a-f]{{{rule.least},}}", text)]
    return [m.span() for m in re.finditer(rule.pattern, text, re.ASCII) if len(m[rule.group]) >= rule.least]


def scan(blobs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Ledger rows of (blob, text, todo): todo names the rule versions to run."""
    by_version = {r.version: r for r in rules}

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for blob, text, todo in zip(b["blob"], b["text"], b["todo"]):
                lowered = text.lower()
                rows += [(blob, v, [{"start": s, "end": e} for s, e in find(text, by_version[v], lowered)]) for v in todo]
            yield pd.DataFrame(rows, columns=["blob", "rule", "spans"])

    return blobs.select("blob", "text", "todo").mapInPandas(task, LEDGER)


def addressed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"))


def update(docs: DataFrame, ledger: str, rules: list[Rule] = RULES) -> int:
    """Scan what the ledger at this path lacks, append it, and return the number of blobs that were scanned."""
    spark = docs.sparkSession
    versions = F.array(*(F.lit(r.version) for r in rules))
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger)
    known = spark.read.schema(LEDGER).parquet(ledger).groupBy("blob").agg(F.collect_set("rule").alias("known"))
    rows = addressed(docs)
    one = rows.groupBy("blob").agg(F.min(F.struct("doc_id")).alias("first"))
    todo = F.array_except(versions, F.coalesce("known", F.array().cast("array<string>")))
    unseen = stored(one.join(known, "blob", "left").select(F.col("blob").alias("_b_blob"), F.col("first.doc_id").alias("_b_id"), todo.alias("todo")).where(F.size("todo") > 0), "unseen-blobs")
    picked = rows.join(small(unseen), F.col("doc_id").eqNullSafe(F.col("_b_id")) & (F.col("blob") == F.col("_b_blob")))
    scan(picked, rules).dropDuplicates(["blob", "rule"]).write.mode("append").parquet(ledger)  # a repeated row is one blob
    return unseen.count()


def findings(docs: DataFrame, ledger: str, rules: list[Rule] = RULES) -> DataFrame:
    """doc_id and spans, array<struct<start,kind_no,end>> in order, for every row of docs."""
    of = docs.sparkSession.read.schema(LEDGER).parquet(ledger).where(F.size("spans") > 0)
    number = F.coalesce(*(F.when(F.col("rule") == r.version, F.lit(i)) for i, r in enumerate(rules)))
    hits = of.withColumn("no", number).where("no IS NOT NULL").dropDuplicates(["blob", "rule"])
    spans = hits.select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("no").alias("kind_no"), s["end"].alias("end"))).alias("s"))
    blobs = stored(spans.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("s"))).alias("spans")), "blob-findings")
    return addressed(docs).drop("text").join(blobs, "blob", "left").select("doc_id", F.coalesce("spans", F.array().cast(blobs.schema["spans"].dataType)).alias("spans"))


SQL = r"""
WITH k(kind, no, least, pat) AS (
  VALUES ('assign', 0, 8, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
    ('access', 1, 16, 'AKIA[A-Z0-9]+'), ('hex', 2, 32, '[0-9a-f]+'), ('github', 3, 40, 'gh[pousr]_[A-Za-z0-9]+'),
    ('pem', 4, 0, '-----BEGIN [A-Z ]*PRIVATE KEY-----')
), d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), m AS (
  SELECT doc_id, kind, no, least, regexp_extract_all(t, pat) AS found, regexp_split_to_array(t, pat) AS gaps,
    CASE WHEN kind = 'assign' THEN regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) ELSE regexp_extract_all(t, pat) END AS part
  FROM d, k
), e AS (
  SELECT doc_id, kind, no, least, unnest(found) AS x, unnest(part) AS p, unnest(list_transform(gaps[1:len(found)], lambda g: length(g))) AS gap, unnest(range(1, len(found) + 1)) AS i
  FROM m WHERE len(found) > 0
), s AS (
  SELECT doc_id, kind, no, least, length(p) AS n, sum(gap + length(x)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop, length(x) AS w FROM e
), f AS (
  SELECT doc_id, kind, no, CAST(stop - w AS BIGINT) AS a, kind || ':' || CAST(stop - w AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span FROM s WHERE n >= least
), g AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    coalesce(string_agg(span, ',' ORDER BY a, no) FILTER (no < 3), '') AS base, string_agg(span, ',' ORDER BY a, no) AS spans
  FROM f GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


@query("op8_secret_scan", SQL)
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = shared_folder(spark, "secret-ledger")
    update(docs, ledger)
    kinds = F.array(*(F.lit(r.kind) for r in RULES))
    show = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind_no"]), s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind_no"] == [r.kind for r in RULES].index(kind))).cast("bigint")
    base = F.filter("spans", lambda s: s["kind_no"] < len(BASE))
    return findings(docs, ledger).select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(show(base), 256).alias("base_sha256"), show(F.col("spans")).alias("spans"))
