r"""Toxicity by a character n-gram linear classifier over naive Bayes features.

Features are hashed character n-grams, present or not in a text. Their log-count ratio r = log(p / q), where p and q are the smoothed shares of
toxic and other training texts that hold the n-gram, scales them: a logistic regression sees r where the n-gram is present and 0 elsewhere.
Every n-gram that `MIN_TEXTS` training texts hold is a feature. A ratio is shrunk by z^4 / (z^4 + `Z_HALF`^4), z being the ratio in standard errors, so
what chance explains weighs little without being cut off; the ridge does the rest. The intercept starts at the log-odds of the toxic share, which is
also the score of a text without evidence where there are too few texts for any feature.

Counts of the n-grams are taken by tasks and summed by Spark; what reaches the driver is bounded by the number of buckets and by `TRAIN_ROWS`
rows, a hash-drawn sample of the labelled training rows. The regression's steps are jobs over that sample's features, about a byte each; the driver
holds vectors of one number per feature. Scoring is one pass over the documents.

Defined results: null and empty texts have no features and get the score of the intercept; a document labelled several times counts as toxic if
one label says so, and a doc_id that is repeated is one training row, that of its smallest text; null labels are ignored; where `MIN_TEXTS` training
texts share no n-gram, or training rows are of one class, every score is the smoothed share of toxic rows (0.0 without rows); repeated documents are
scored each; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorefold.llm import query
from scorefold.llm.common import held_out, ship, stored, table
from scorefold.llm.grams import buckets

SIZES = range(3, 7)
BITS = 20
TRAIN_ROWS = 12_000
MIN_TEXTS = 5
#: Standard errors at which a ratio is halved.
Z_HALF = 3.0
STEPS, POWER_STEPS, DECAY = 30, 4, 1e-2
#: Rows whose features are unpacked at once, and partitions of the sample.
UNPACKED, PARTS = 100, 8

ship(__name__)


class Model(NamedTuple):
    weights: np.ndarray  # by bucket, ratio included; zero for what is no feature
    intercept: float


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per partition: how many toxic and other texts hold each bucket."""
    n = np.zeros((2, 1 << BITS), np.int32)
    for b in batches:
        for text, toxic in zip(b["text"], b["toxic"]):
            for part in _present(text):
                n[int(toxic), part] += 1
    seen = np.flatnonzero(n.sum(0))
    for at in range(0, len(seen), 1 << 16):
        s = seen[at : at + (1 << 16)]
        yield pd.DataFrame({"bucket": s.astype(np.int32), "other": n[0, s].astype(np.int64), "toxic": n[1, s].astype(np.int64)})


def _present(text: str | None, of: np.ndarray | None = None) -> list[np.ndarray]:
    """The distinct buckets of a text (in one array), only those that `of` marks if given."""
    parts = [p if of is None else p[of[p]] for p in buckets(text, SIZES, BITS)]
    return [np.unique(np.concatenate(parts))] if parts else []


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most `rows` labelled documents outside the held-out fold."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    sample = stored(found.select("text", "toxic"), "toxicity-sample")
    classes = {int(r["toxic"] > 0): r["n"] for r in sample.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n0, n1 = classes.get(0, 0), classes.get(1, 0)
    share = (n1 + 1) / (n0 + n1 + 2) if n0 + n1 else 0.0
    base = float(np.log(share / (1 - share))) if share else -np.inf
    if not n0 or not n1:
        return Model(np.zeros(1 << BITS, np.float32), base)
    sample = sample.select("text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    counts = sample.mapInPandas(_counts, "bucket int, other bigint, toxic bigint").groupBy("bucket").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    c = counts.where(F.col("other") + F.col("toxic") >= MIN_TEXTS).toArrow().to_pandas().sort_values("bucket")  # at most 2^BITS rows
    ratio = np.log((c["toxic"] + 1) / (n1 + 2)) - np.log((c["other"] + 1) / (n0 + 2))
    error = np.sqrt(1 / (c["toxic"] + 1) + 1 / (c["other"] + 1))
    z4 = (ratio / error) ** 4
    ratios = np.zeros(1 << BITS, np.float64)
    ratios[c["bucket"]] = ratio * z4 / (z4 + Z_HALF**4)
    feature = ratios != 0
    if not feature.any():
        return Model(np.zeros(1 << BITS, np.float32), base)

    number = np.cumsum(feature, dtype=np.int32) - 1

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(number[p[0]] if (p := _present(t, feature)) else np.zeros(0, np.int32)) for t in b["text"]]
            yield pd.DataFrame({"toxic": b["toxic"], "n": [len(h) for h in found], "steps": [pack(h) for h in found]})

    # rows in one order, so that sums do not depend on the order in which tasks are done
    rows = stored(sample.repartition(PARTS, "text").sortWithinPartitions("toxic", "text").mapInPandas(hits, "toxic int, n int, steps binary"), "toxicity-hits")
    weights, intercept = _regress(rows, n0 + n1, ratios[feature], base)
    out = np.zeros(1 << BITS, np.float32)
    out[feature] = weights
    return Model(out, intercept)


def pack(numbers: np.ndarray) -> bytes:
    """Ascending bucket numbers as bytes: each step from the last one as its remainder by 255 behind as many bytes 255 as it holds."""
    step = np.diff(numbers.astype(np.int64), prepend=0)
    ends = np.cumsum(step // 255 + 1) - 1
    out = np.full(ends[-1] + 1 if len(ends) else 0, 255, np.uint8)
    out[ends] = step % 255
    return out.tobytes()


def unpack(rows: list[bytes], counts: np.ndarray) -> np.ndarray:
    """The bucket numbers of several packed rows, one after the other."""
    v = np.frombuffer(b"".join(rows), np.uint8)
    total = np.cumsum(v, dtype=np.int64)
    stop = np.cumsum([len(r) for r in rows])
    before = np.concatenate([[0], total[stop[:-1] - 1] if len(v) else []]).astype(np.int64)
    before[np.concatenate([[0], stop[:-1]]) == 0] = 0
    return total[v < 255] - np.repeat(before, counts)


def _gradient(rows: DataFrame, scaled: np.ndarray, slope) -> tuple[np.ndarray, float]:
    """Per feature the sum of the slopes of the rows that hold it, and the sum of all slopes; slope: of (sum of the features' scaled weights, toxic).

    One job; each task hands on one vector, which the driver adds up in the order of the partitions."""
    shared = rows.sparkSession.sparkContext.broadcast(scaled.astype(np.float32))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        g, total = np.zeros(len(w)), 0.0
        for b in batches:
            for k in range(0, len(b), UNPACKED):
                part = b.iloc[k : k + UNPACKED]
                counts = part["n"].to_numpy()
                column, row = unpack(part["steps"].tolist(), counts), np.repeat(np.arange(len(part)), counts)
                s = slope(np.bincount(row, w[column], len(part)), part["toxic"].to_numpy())
                g += np.bincount(column, s[row], len(w))
                total += s.sum()
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "g": [g.tobytes()], "total": [total]})

    found = rows.mapInPandas(task, "part int, g binary, total double").toArrow().sort_by("part").to_pylist()  # PARTS rows or fewer
    shared.destroy(blocking=True)  # the next step has another: its files go at once
    return np.sum([np.frombuffer(r["g"]) for r in found], 0), float(sum(r["total"] for r in found))


def _regress(rows: DataFrame, n: int, ratios: np.ndarray, base: float) -> tuple[np.ndarray, float]:
    """Logistic regression with ridge on present features scaled by their ratios: accelerated full gradients, step from the largest curvature."""
    v = np.random.default_rng(0).normal(size=len(ratios))
    for _ in range(POWER_STEPS):
        v /= np.linalg.norm(v)
        v = _gradient(rows, ratios * v, lambda m, y: m / n)[0] * ratios
    rate = 1 / (0.3 * (np.linalg.norm(v) + 1) + DECAY)  # 0.25 bounds the curvature of the loss; the rest allows for the few rounds
    w, b, tw, tb, t = np.zeros(len(ratios)), base, np.zeros(len(ratios)), base, 1.0
    for _ in range(STEPS):
        g, gb = _gradient(rows, ratios * tw, lambda m, y, tb=tb: (1 / (1 + np.exp(-np.clip(m + tb, -700, 700))) - y) / n)
        nw, nb = tw - rate * (g * ratios + DECAY * tw), tb - rate * gb
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        tw, tb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return (w * ratios).astype(np.float32), float(b)


def score_text(text: str | None, model: Model, used: np.ndarray) -> float:
    """The score of one text; used marks the buckets that are features."""
    found = _present(text, used)
    z = model.intercept + (float(model.weights[found[0]].sum(dtype=np.float64)) if found else 0.0)
    return float(1 / (1 + np.exp(-np.clip(z, -700, 700)))) if np.isfinite(z) else 0.0


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))  # plain values: tasks need no copy of the package

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = Model(*shared.value)
        used = model.weights != 0
        for texts in batches:
            yield pd.Series([score_text(t, model, used) for t in texts], dtype=np.float64)

    return docs.select("doc_id", of("text").alias("score"))


@query("op1_toxicity")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
