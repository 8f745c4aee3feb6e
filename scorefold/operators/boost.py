"""Boosted trees of many fits at once: a level of the trees of all fits (folds, settings of a grid) is one job, not one job a fit.

Rows become byte codes of at most 32 bins a feature and stay in executor memory, as many parts as the session has cores. A job adds up, per fit, node, feature
and bin, the weights and pseudo-residuals of its rows; only these sums meet in the driver, which picks the splits. Losses, first tree and leaves are those of
MLlib's learners: variance gain, mean leaves, a first tree on the label itself with weight one, later ones on the negative gradient with the learning rate.
Bins differ: quantiles of all rows, where MLlib takes those of a sample.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorefold.session import checkpointed

BINS = 32  # MLlib's default
CHUNK = 250_000  # rows of one array
RENEW = 50  # rounds after which scores are made anew from all trees, so that lineage stays short
ALL_LEFT = 255  # threshold of a node that is not split


@dataclass(frozen=True)
class Fit:
    """A fit: depth and number of its trees, learning rate, loss ("log" for labels 0 and 1, "absolute"), and the fold that it leaves out."""

    depth: int
    rounds: int
    rate: float = 0.1
    loss: str = "log"
    without: int | None = None


Tree = tuple[np.ndarray, np.ndarray, np.ndarray]  # feature and largest code on the left per inner node (level by level), value per leaf


def cuts(df: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """Per feature the values up to which its bins reach: every value of a feature of few values, else quantiles."""
    few = df.agg(*[F.approx_count_distinct(f, 0.02).alias(f) for f in features]).first()
    few = [f for f in features if few[f] <= BINS + 8]
    sets = df.agg(F.lit(0).alias("__0"), *[F.collect_set(f).alias(f) for f in few]).first().asDict()  # some 40 values each
    sets = {f: np.sort(np.array(sets[f], float)) for f in few if len(sets[f]) <= BINS}
    many = [f for f in features if f not in sets]
    found = dict(zip(many, df.approxQuantile(many, [i / BINS for i in range(1, BINS)], 1 / (100 * BINS)) if many else []))
    return [sets[f][:-1] if f in sets else np.unique(found[f]) for f in features]


def _codes(pdf: pd.DataFrame, features: Sequence[str], at: Sequence[np.ndarray]) -> np.ndarray:
    x = np.empty((len(features), len(pdf)), np.uint8)
    for i, f in enumerate(features):
        x[i] = np.searchsorted(at[i], pdf[f].to_numpy(float))
    return x


def _packs(at: Sequence[np.ndarray]) -> list[list[int]]:
    """Features whose joint codes fit into the bins of one, so that one count serves them all: features of few bins first."""
    out, room = [], 0
    for j in sorted(range(len(at)), key=lambda j: len(at[j])):
        bins = len(at[j]) + 1
        if bins > room:
            out.append([])
            room = BINS
        out[-1].append(j)
        room //= bins
    return out


def _packed(x: np.ndarray, at: Sequence[np.ndarray], packs: Sequence[Sequence[int]]) -> np.ndarray:
    z = np.zeros((len(packs), x.shape[1]), np.uint8)
    for g, pack in enumerate(packs):
        for j in pack:
            z[g] = z[g] * (len(at[j]) + 1) + x[j]
    return z


def _unpacked(sums: np.ndarray, at: Sequence[np.ndarray], packs: Sequence[Sequence[int]]) -> np.ndarray:
    """Sums per feature and bin out of sums per joint code."""
    out = np.zeros((*sums.shape[:2], len(at), BINS, 2))
    for g, pack in enumerate(packs):
        bins = [len(at[j]) + 1 for j in pack]
        joint = sums[:, :, g, : int(np.prod(bins))].reshape(*sums.shape[:2], *bins, 2)
        for i, j in enumerate(pack):
            out[:, :, j, : bins[i]] = joint.sum(tuple(2 + o for o in range(len(pack)) if o != i))
    return out


def _leaf(x: np.ndarray, tree: Tree, levels: int) -> np.ndarray:
    """Number of each row's node within the level below ``levels`` levels."""
    node, rows = np.zeros(x.shape[1], np.intp), np.arange(x.shape[1])
    for level in range(levels):
        i = node + (1 << level) - 1
        node = 2 * node + (x[tree[0][i], rows] > tree[1][i])
    return node


def _add(x: np.ndarray, score: np.ndarray, fits: Sequence[Fit], trees: Sequence[Tree | None], nth: int) -> None:
    for k, (fit, tree) in enumerate(zip(fits, trees)):
        if tree is not None:
            score[k] += (1.0 if nth == 0 else fit.rate) * tree[2][_leaf(x, tree, fit.depth)]


def _target(y: np.ndarray, score: np.ndarray, loss: str, nth: int) -> np.ndarray:
    if loss == "log":
        y = 2 * y - 1
        return y if nth == 0 else 4 * y / (1 + np.exp(2 * y * score))
    return y if nth == 0 else np.where(y - score < 0, -1.0, 1.0)


def _sums(chunks: Iterator, fits: Sequence[Fit], trees: Sequence[Tree | None], level: int, nth: int) -> Iterator[np.ndarray]:
    """(fit, node, joint code of packed features, weight and weighted target) of a part's rows, for the fits that have this level. Weights of whole trees
    are those of the first round and left out later."""
    out = None
    for x, z, y, w, fold, score in chunks:
        if out is None:
            out = np.zeros((len(fits), 1 << level, len(z), BINS, 2))
        for k, (fit, tree) in enumerate(zip(fits, trees)):
            if tree is None or fit.depth <= level:
                continue
            wk = w if fit.without is None else w * (fold != fit.without)
            wt = wk * _target(y, score[k], fit.loss, nth)
            base = _leaf(x, tree, level) * BINS
            for g in range(len(z)):
                i = base + z[g]
                for s, v in ((0, wk), (1, wt)) if nth == 0 or level else ((1, wt),):
                    out[k, :, g, :, s] += np.bincount(i, v, BINS << level).reshape(-1, BINS)
    if out is not None:
        yield out


def _grow(tree: Tree, sums: np.ndarray, level: int, last: bool) -> None:
    """Splits the nodes of a level by the largest gain in variance; the first feature and bin of equal ones."""
    feature, upto, leaf = tree
    left = sums.cumsum(2)
    total = left[:, :1, -1:, :]
    right = total - left
    mean2 = lambda a: np.divide(a[..., 1] ** 2, a[..., 0], out=np.zeros(a.shape[:-1]), where=a[..., 0] > 0)
    gain = np.where((left[..., 0] > 0) & (right[..., 0] > 0), mean2(left) + mean2(right) - mean2(total), -1.0)
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(1)
    for node, b in enumerate(best):
        f, c = divmod(int(b), BINS)
        n, s = total[node, 0, 0]
        split = n > 0 and flat[node, b] > 1e-12 * n
        i = (1 << level) - 1 + node
        feature[i], upto[i] = (f, c) if split else (0, ALL_LEFT)
        if last:
            mean = lambda a: a[1] / a[0] if a[0] else 0.0
            leaf[2 * node : 2 * node + 2] = (mean(left[node, f, c]), mean(right[node, f, c])) if split else mean((n, s))


def _chunks(df: DataFrame, features: Sequence[str], at: Sequence[np.ndarray], packs: Sequence[Sequence[int]], label: str, fold: str | None) -> RDD:
    """Arrays of codes, joint codes, labels, weights and folds. Equal rows are one row with their number as its weight."""

    def coded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            x = np.ascontiguousarray(_codes(p, features, at).T)
            yield pd.DataFrame({"x": [r.tobytes() for r in x], "y": p["__y"], "fold": p["__fold"]})

    def packed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for a in range(0, len(p), CHUNK):
                c = p.iloc[a : a + CHUNK]
                x = np.frombuffer(b"".join(c["x"]), np.uint8).reshape(len(c), -1).T
                yield pd.DataFrame({"x": [x.tobytes()], "y": [c["y"].to_numpy(float).tobytes()], "w": [c["n"].to_numpy(float).tobytes()], "fold": [c["fold"].to_numpy(np.int16).tobytes()]})

    def arrays(r) -> tuple:
        x = np.frombuffer(r["x"], np.uint8).reshape(len(features), -1)
        return x, _packed(x, at, packs), np.frombuffer(r["y"]), np.frombuffer(r["w"]), np.frombuffer(r["fold"], np.int16)

    d = df.select(*features, F.col(label).cast("double").alias("__y"), (F.lit(0) if fold is None else F.col(fold)).cast("int").alias("__fold"))
    rows = d.where(F.col("__y").isNotNull()).mapInPandas(coded, "x binary, y double, fold int").groupBy("x", "y", "fold").agg(F.count(F.lit(1)).alias("n"))
    parts = df.sparkSession.sparkContext.defaultParallelism
    return checkpointed(rows.repartition(parts).mapInPandas(packed, "x binary, y binary, w binary, fold binary")).rdd.map(arrays)


def fitted(df: DataFrame, features: Sequence[str], label: str, fits: Sequence[Fit], fold: str | None = None) -> tuple[list[np.ndarray], list[list[Tree]]]:
    """(cuts, trees per fit) of all fits on the same rows; a fit leaves out the rows of its fold."""
    at = cuts(df, features)
    packs = _packs(at)
    rows = _chunks(df, features, at, packs, label, fold).persist(StorageLevel.MEMORY_AND_DISK)
    done: list[list[Tree | None]] = []

    def scored(upto: int):
        made = list(done[:upto])

        def one(c):
            score = np.zeros((len(fits), len(c[2])))
            for n, trees in enumerate(made):
                _add(c[0], score, fits, trees, n)
            return *c[:5], score

        return rows.map(one)

    def stepped(state: RDD, trees: list[Tree | None], n: int) -> RDD:
        def one(c):
            score = c[5].copy()
            _add(c[0], score, fits, trees, n)
            return *c[:5], score

        return state.map(one)

    state, old, weights = scored(0).persist(StorageLevel.MEMORY_AND_DISK), None, None
    for n in range(max(f.rounds for f in fits)):
        trees = [(np.zeros((1 << f.depth) - 1, np.int32), np.full((1 << f.depth) - 1, ALL_LEFT, np.uint8), np.zeros(1 << f.depth)) if n < f.rounds else None for f in fits]
        for level in range(max(f.depth for f, t in zip(fits, trees) if t is not None)):
            sums = state.mapPartitions(lambda it, t=trees, v=level, n=n: _sums(it, fits, t, v, n)).collect()  # a part's sums do not grow with its rows
            total = sum(sums[1:], sums[0])
            if level == 0:
                weights = total[..., 0].copy() if n == 0 else weights
                total[..., 0] = weights
            total = _unpacked(total, at, packs)
            for k, (f, t) in enumerate(zip(fits, trees)):
                if t is not None and f.depth > level:
                    _grow(t, total[k], level, level == f.depth - 1)
            if old is not None:
                old.unpersist()
                old = None
        done.append(trees)
        old, state = state, (scored(n + 1) if (n + 1) % RENEW == 0 else stepped(state, trees, n)).persist(StorageLevel.MEMORY_AND_DISK)
    old.unpersist()
    rows.unpersist()
    return at, [[t[k] for t in done if t[k] is not None] for k in range(len(fits))]


def scores(pdf: pd.DataFrame, features: Sequence[str], at: Sequence[np.ndarray], fit: Fit, trees: Sequence[Tree], rounds: Sequence[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(rounds, score of each row after them): the sum of trees, or with the log loss the probability of label 1."""
    x, s = _codes(pdf, features, at), np.zeros((1, len(pdf)))
    for n, tree in enumerate(trees):
        _add(x, s, [fit], [tree], n)
        if n + 1 in (rounds or (len(trees),)):
            yield n + 1, 1 / (1 + np.exp(-2 * s[0])) if fit.loss == "log" else s[0].copy()


def held_out(df: DataFrame, features: Sequence[str], at: Sequence[np.ndarray], fits: Sequence[Fit], trees: Sequence[Sequence[Tree]], fold: str, out: str) -> DataFrame:
    """df with each row's score under the fit that left its fold out."""
    model = df.sparkSession.sparkContext.broadcast((list(at), list(fits), list(trees)))

    def one(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, fits, trees = model.value
        for p in parts:
            got = np.full(len(p), np.nan)
            for k, fit in enumerate(fits):
                rows = (p[fold] == fit.without).to_numpy()
                if rows.any():
                    got[rows] = next(scores(p[rows], features, at, fit, trees[k]))[1]
            yield p.assign(**{out: got})

    return df.mapInPandas(one, ", ".join(f"`{n}` {t}" for n, t in [*df.dtypes, (out, "double")]))
