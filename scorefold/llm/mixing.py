r"""Mixing sources to target weights by Poisson replication.

A source with n documents and weight w has the mean repetition rate r = total * w / n. Each document's number of copies is the inverse of the
Poisson distribution of mean r at a uniform number hashed from the document's id, so a rerun draws the same copies and no group is gathered.
Means over `PART` are split into equal parts with a hashed number each; their sum has the same distribution, and no table grows with the mean.
Copies are dealt to partitions by a hash of (id, copy) and sorted by it: one shuffle, and the order is independent of the input's.

Defined results: a null source is a source of its own; a source without weight (when weights are given) goes; by default all sources weigh alike
and the total is the number of documents; rows with the same doc_id and text draw alike; an empty table gives no rows; columns named copy and
shuffle_key are replaced, others pass through, texts of any length and nulls too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorefold.llm import query
from scorefold.llm.common import BROADCAST_ROWS, ship, stored, table

SEED = 9
PART = 500.0
#: Hex digits of an MD5 that make a uniform number: 52 bits, exact in a double.
DIGITS = 13
SALTS = 64

ship(__name__)


def uniform(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)


def poisson_cdf(mean: float) -> list[float]:
    """P(X <= k) for k = 0, 1, ... until it stops growing."""
    out, term, total, k = [], float(np.exp(-mean)), 0.0, 0
    while True:
        total, before = total + term, total
        if total == before and k > mean:
            return out
        out.append(total)
        k += 1
        term *= mean / k


def _tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(_m_cdf=[poisson_cdf(r / n) for r, n in zip(b["_m_rate"], b["_m_parts"])])


def rates(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None) -> DataFrame:
    """_m_source, _m_rate, _m_parts, _m_cdf per source; weights has source and weight (any positive numbers)."""
    counts = stored(docs.groupBy("source").agg(F.count("*").alias("_m_n")), "source-counts")
    weighed = counts.withColumn("weight", F.lit(1.0)) if weights is None else counts.join(weights.select(F.col("source").alias("_m_s"), F.col("weight").cast("double").alias("weight")), F.col("source").eqNullSafe(F.col("_m_s"))).drop("_m_s")
    weighed = weighed.where("weight > 0")
    all_ = weighed.agg(F.sum("weight"), F.sum("_m_n")).first()
    if not all_[0]:
        all_ = (1.0, 0)
    rate = F.lit(float(all_[1] if total is None else total)) * F.col("weight") / F.lit(float(all_[0])) / F.col("_m_n")
    rows = weighed.select(F.col("source").alias("_m_source"), rate.alias("_m_rate")).withColumn("_m_parts", F.greatest(F.lit(1.0), F.ceil(F.col("_m_rate") / PART)).cast("int"))
    return stored(rows.mapInPandas(_tables, f"_m_source {docs.schema['source'].dataType.simpleString()}, _m_rate double, _m_parts int, _m_cdf array<double>"), "source-rates")


def mix(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None, seed: int = SEED) -> DataFrame:
    """docs replicated to the target weights, with `copy` (from 1) and `shuffle_key`, in a global order by that key within each partition."""
    by_source = rates(docs, weights, total)
    bound = by_source.count() <= BROADCAST_ROWS // 16
    if bound:
        rows = docs.join(F.broadcast(by_source), F.col("source").eqNullSafe(F.col("_m_source")))
    else:  # so many sources that their tables are shuffled; salts split those that hold much of the corpus
        salted = by_source.withColumn("_m_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = docs.withColumn("_m_at", F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int"))
        rows = dealt.join(salted, F.col("source").eqNullSafe(F.col("_m_source")) & (F.col("_m_at") == F.col("_m_salt"))).drop("_m_salt", "_m_at")
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    drawn = F.transform(F.sequence(F.lit(0), F.col("_m_parts") - 1), lambda i: uniform(F.lit(str(seed)), name, i.cast("string")))
    below = F.transform(drawn, lambda u: F.size(F.filter("_m_cdf", lambda c: c <= u)).cast("bigint"))
    more = F.aggregate(below, F.lit(0).cast("bigint"), lambda a, x: a + x)
    counted = rows.withColumn("_m_copies", more).where("_m_copies > 0")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_m_copies"))))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(str(seed)), name, F.col("copy").cast("string"))))
    kept = keyed.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("copy", "shuffle_key")), "copy", "shuffle_key")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept.repartition(n, "shuffle_key").sortWithinPartitions("shuffle_key")


SQL = r"""
WITH RECURSIVE c AS (
  SELECT source, count(*) AS n FROM documents GROUP BY source
), r AS (
  SELECT source, CAST((SELECT sum(n) FROM c) AS DOUBLE) * 1.0 / (SELECT CAST(count(*) AS DOUBLE) FROM c) / n AS rate FROM c
), p(source, rate, k, term, total) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM r
  UNION ALL SELECT source, rate, k + 1, term * (rate / (k + 1)), total + term * (rate / (k + 1)) FROM p WHERE k < 200
), f AS (
  SELECT source, list(total ORDER BY k) AS cdf FROM p GROUP BY source
), d AS (
  SELECT doc_id, source, text, CAST('0x' || md5('9|' || doc_id || '|0')[1:13] AS BIGINT) / 4503599627370496.0 AS u FROM documents
), k AS (
  SELECT doc_id, d.source, text, len(list_filter(cdf, lambda x: x <= u)) AS copies FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source
)
SELECT doc_id, source, text, copy, md5('9|' || doc_id || '|' || copy) AS shuffle_key FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM k)
"""


@query("op9_source_mixing", SQL)
def op9(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
