r"""Language identification by averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its hashed character n-grams; a linear layer and a softmax over the learned languages follow. Embeddings
and layer are trained by stochastic gradient descent in numpy on whole texts of a hash-drawn sample of at most `TRAIN_ROWS` training documents.
A part of that sample calibrates: a temperature makes the scores probabilities, and the rejection threshold is the score that at
most `FALSE_REJECTIONS` of the rightly labelled calibration texts fall short of, so clean documents stay. Those are fewer than 1,000 texts, hence
it is the score of the least certain of them, or 0.5 if that is lower.

Defined results: a text that is null or has no letter is `und` with score 0.0 and is rejected; without training rows every text is; null
languages and documents of the held-out fold are not learned from; repeated documents are judged each; an empty table gives no rows;
`identify` looks at no further column, `drop_unidentified` passes all through.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorefold.llm import query
from scorefold.llm.common import held_out, ship, stored, table
from scorefold.llm.grams import buckets

SIZES = range(2, 4)
BITS = 15
WIDTH = 16
TRAIN_ROWS = 4_000
#: One training row in five calibrates.
CALIBRATES = 5
EPOCHS, RATE = 6, 0.5
FALSE_REJECTIONS = 0.001  # of at most 800 calibration texts this is the minimum: no rightly labelled one falls short of the threshold
UNDETERMINED = "und"

ship(__name__)


class Model(NamedTuple):
    langs: list[str]
    logits: np.ndarray  # embeddings times layer: bucket x language
    bias: np.ndarray
    temperature: float
    threshold: float


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their shares of the text's n-grams."""
    parts = list(buckets(text, SIZES, BITS))
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    n = np.bincount(np.concatenate(parts), minlength=1 << BITS)
    used = np.flatnonzero(n)
    return used.astype(np.int32), (n[used] / n.sum()).astype(np.float32)


def _bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        bags = [_bag(t) for t in b["text"]]
        yield pd.DataFrame({"doc_id": b["doc_id"], "lang": b["lang"], "ids": [x[0] for x in bags], "shares": [x[1] for x in bags]})


def fit(docs: DataFrame, rows: int = TRAIN_ROWS, seed: int = 5) -> Model:
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    ids = stored(known.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).distinct(), "langid-ids")
    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = known.select("doc_id", "lang", "text").join(F.broadcast(ids), "doc_id")
    bags = sample.mapInPandas(_bags, f"doc_id {kind}, lang string, ids array<int>, shares array<float>").toArrow().to_pandas()  # at most about `rows` bags
    bags = bags[bags["ids"].map(len) > 0].sort_values(["doc_id", "lang"]).reset_index(drop=True)
    langs = sorted(set(bags["lang"]))
    if not langs:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros(0), 1.0, 1.0)
    y = bags["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held = order[::CALIBRATES] if len(y) >= 10 * CALIBRATES else order
    train = np.setdiff1d(order, held) if len(y) >= 10 * CALIBRATES else order
    table_ = rng.uniform(-1 / WIDTH, 1 / WIDTH, (1 << BITS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((WIDTH, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    steps, at = EPOCHS * len(train), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(train):
            used, share = bags["ids"][i], np.asarray(bags["shares"][i])
            x = share @ table_[used]
            p = np.exp((z := x @ layer + bias) - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            rate = RATE * (1 - at / steps)
            back = layer @ p
            layer -= rate * np.outer(x, p)
            bias -= rate * 0.1 * p
            table_[used] -= rate * len(used) * np.outer(share, back) / max(1.0, len(used) * share.max())
            at += 1
    logits = table_ @ layer
    z = np.array([np.asarray(bags["shares"][i]) @ logits[bags["ids"][i]] + bias for i in held], np.float64)
    temperature = min((float(np.exp(t)) for t in np.linspace(-4, 4, 161)), key=lambda t: _loss(z / t, y[held]))
    p = _softmax(z / temperature)
    right = p.max(1)[p.argmax(1) == y[held]]
    threshold = float(np.quantile(right, FALSE_REJECTIONS, method="lower")) if len(right) else 0.0
    # below one over the number of languages nothing can fall; a text as uncertain as that is undecided
    return Model(langs, logits, bias, temperature, min(threshold, 0.5))


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    """Cross entropy against labels smoothed by the rule of succession, so that a perfect fit is not taken for certainty."""
    p = np.log(_softmax(z) + 1e-300)
    doubt = 1 / (len(y) + 2)
    return float(-((1 - doubt) * p[np.arange(len(y)), y] + doubt * p.mean(1)).mean())


def predict(text: str | None, model: Model) -> tuple[str, float]:
    if not model.langs or not has_letter(text):
        return UNDETERMINED, 0.0
    total, n = np.zeros(len(model.langs)), 0
    for part in buckets(text, SIZES, BITS):
        total += np.bincount(part, minlength=1 << BITS) @ model.logits if len(part) > 1 << BITS else model.logits[part].sum(0, dtype=np.float64)
        n += len(part)
    p = _softmax((total / n + model.bias) / model.temperature)
    return model.langs[int(p.argmax())], float(p.max())


def _judge(model: Model, spark):
    """A column function of texts: struct(lang_pred, score, rejected)."""
    shared = spark.sparkContext.broadcast(tuple(model))  # plain values: tasks need no copy of the package

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def judged(text: pd.Series) -> pd.DataFrame:
        model = Model(*shared.value)
        found = [predict(t, model) for t in text]
        return pd.DataFrame({"lang_pred": [x[0] for x in found], "score": [x[1] for x in found], "rejected": [x[0] == UNDETERMINED or x[1] < model.threshold for x in found]})

    return judged


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row of docs."""
    return docs.select("doc_id", _judge(model, docs.sparkSession)("text").alias("_g")).select("doc_id", "_g.*")


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """docs without the rows whose language is rejected; all columns stay as they are."""
    return docs.where(~_judge(fit(docs), docs.sparkSession)("text")["rejected"])


@query("op5_language_id")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs, fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
