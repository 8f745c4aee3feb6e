"""Cross-fitted isotonic recalibration refitted inside every bootstrap replicate, and its dependence on the draw of the folds.

A replicate repeats whole clusters and a cluster keeps its fold, so the refit is a weighted isotonic fit on the distinct forecasts of the other folds, with
the draws as weights. Clusters are cut into slices; a task turns (slice, chunk of replicates) into histograms of all replicates of the chunk at once, and
the histograms of a (run, chunk) are added up one row at a time before they are pooled. Work per replicate is distinct forecasts x folds, not rows.

A run with more than `WIDE` distinct forecasts would not fit one task that way: its replicates go through the sliced fits of `calibration` instead, with the
same result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorefold.functions.columns import hash_int
from scorefold.operators.calibration import crossfit_isotonic, width_bin
from scorefold.operators.ordered import positions
from scorefold.operators.resample import draw_indices, numbered_clusters, percentile_interval
from scorefold.session import checkpointed

#: Distinct forecasts of a run that one task may pool, clusters of a slice, replicates of a chunk.
WIDE, SLICE, CHUNK = 2_000, 256, 50


def pool_weighted(n: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Weighted isotonic fit of the means s / n in the given order, one value per entry; all n > 0."""
    size, total, count = [], [], []
    for w, t in zip(n.tolist(), s.tolist()):
        c = 1
        while size and total[-1] * w >= t * size[-1]:
            w, t, c = w + size.pop(), t + total.pop(), c + count.pop()
        size.append(w)
        total.append(t)
        count.append(c)
    return np.repeat(np.clip(np.array(total) / np.array(size), 0.0, 1.0), count)


def crossfit_loss(x: np.ndarray, n: np.ndarray, s: np.ndarray) -> float:
    """Squared-error sum of the cross-fit: n, s (folds x distinct forecasts) are weights and weighted positives; NaN where a fold has no other rows."""
    total = 0.0
    for k in range(len(n)):
        m, t = n.sum(0) - n[k], s.sum(0) - s[k]
        have = m > 0
        if not have.any():
            return np.nan
        q = np.interp(x, x[have], pool_weighted(m[have], t[have]))
        total += float((s[k] * (1 - q) ** 2 + (n[k] - s[k]) * q**2).sum())
    return total


def replicate_losses(df: DataFrame, by: Sequence[str], series: Sequence[str], cluster: str, x: str, y: str, fold: str, k: int, reps: int, seed: int) -> DataFrame:
    """(by, series, rep, loss, weight): squared-error sum of the refitted cross-fit and the replicate's weight; rep -1 is the sample itself.

    Draws belong to ``by``, so the series (arms, a baseline) of one ``by`` share them and their difference is paired. Labels are 0 / 1.
    """
    by, run = list(by), [*by, *series]
    rows = checkpointed(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*run, cluster, fold, F.col(x).cast("double").alias("__x")).agg(
        F.count(F.lit(1)).cast("double").alias("__n"), F.sum(F.col(y).cast("double")).alias("__s")))
    clusters = checkpointed(numbered_clusters(rows, by, cluster))
    cells = rows.join(clusters.drop("g"), [*by, cluster])
    drawn = draw_indices(clusters, by, reps, seed).groupBy(*by, "rep", "idx").agg(F.count(F.lit(1)).alias("w"))
    drawn = drawn.unionByName(clusters.select(*by, F.lit(-1).alias("rep"), "idx", F.lit(1).cast("bigint").alias("w")))
    width = rows.groupBy(*run).agg(F.count_distinct("__x").alias("__v"))
    wide = checkpointed(width.where(F.col("__v") > WIDE).select(*run))
    out = _pooled(cells.join(F.broadcast(wide), run, "left_anti"), drawn, by, run, fold, k)
    return out.unionByName(_sliced(cells.join(F.broadcast(wide), run, "left_semi"), drawn, by, run, fold, k)) if wide.limit(1).count() else out


def _sliced(cells: DataFrame, drawn: DataFrame, by: list[str], run: list[str], fold: str, k: int) -> DataFrame:
    one = cells.join(drawn, [*by, "idx"]).groupBy(*run, "rep", fold, "__x").agg(F.sum(F.col("w") * F.col("__n")).alias("__n"), F.sum(F.col("w") * F.col("__s")).alias("__s"))
    one = checkpointed(one.withColumn("__y", F.col("__s") / F.col("__n")))
    fit = crossfit_isotonic(one, [*run, "rep"], "__x", "__y", fold, k, "__q", F.col("__n"))
    both = one.join(fit, [*run, "rep", fold, "__x"], "left")
    q = F.col("__q")
    loss = F.sum(F.col("__s") * (1 - q) * (1 - q) + (F.col("__n") - F.col("__s")) * q * q)
    lost = F.max(q.isNull().cast("int")) > 0
    return both.groupBy(*run, "rep").agg(F.when(lost, float("nan")).otherwise(loss).alias("loss"), F.sum("__n").alias("weight"))


def _pooled(cells: DataFrame, drawn: DataFrame, by: list[str], run: list[str], fold: str, k: int) -> DataFrame:
    part = (F.col("idx") / SLICE).cast("bigint").alias("__slice")
    c = cells.groupBy(*run, part).agg(F.collect_list(F.struct("idx", F.col(fold).cast("int").alias("f"), F.col("__x").alias("x"), F.col("__n").alias("n"), F.col("__s").alias("s"))).alias("c"))
    d = drawn.groupBy(*by, part, F.floor(F.col("rep") / CHUNK).alias("__chunk")).agg(F.collect_list(F.struct("rep", "idx", "w")).alias("d"))
    keyed = c.join(d, [*by, "__slice"]).withColumn("__key", F.to_json(F.struct(*run)))
    parts = keyed.select(F.col("__key").alias("key"), F.col("__chunk").alias("chunk"), *[F.col(f"c.{a}").alias(f"c_{a}") for a in ("idx", "f", "x", "n", "s")], *[F.col(f"d.{a}").alias(f"d_{a}") for a in ("rep", "idx", "w")])

    def histograms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                first = r.chunk * CHUNK
                ids, at = np.unique(r.c_idx, return_inverse=True)
                w = np.zeros((CHUNK, len(ids)))
                place = np.searchsorted(ids, r.d_idx)
                place[place == len(ids)] = 0
                hit = ids[place] == np.asarray(r.d_idx)
                w[(np.asarray(r.d_rep) - first)[hit], place[hit]] = np.asarray(r.d_w)[hit]
                cell, of = np.unique(np.stack([np.asarray(r.c_f, float), np.asarray(r.c_x, float)], 1), axis=0, return_inverse=True)
                n, s = np.zeros((len(cell), CHUNK)), np.zeros((len(cell), CHUNK))
                np.add.at(n, of.ravel(), (w[:, at] * np.asarray(r.c_n)).T)
                np.add.at(s, of.ravel(), (w[:, at] * np.asarray(r.c_s)).T)
                yield pd.DataFrame({"key": r.key, "chunk": r.chunk, "f": cell[:, 0].astype(np.int32), "x": cell[:, 1], "n": list(n), "s": list(s)})

    def losses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, {}

        def done():
            key, chunk = at
            x = np.unique([v for _, v in held])
            n, s = np.zeros((k, len(x), CHUNK)), np.zeros((k, len(x), CHUNK))
            for (f, v), (a, b) in held.items():
                i = np.searchsorted(x, v)
                n[f, i], s[f, i] = a, b
            live = np.flatnonzero(n.sum((0, 1)) > 0)
            return pd.DataFrame({"key": key, "rep": chunk * CHUNK + live, "loss": [crossfit_loss(x, n[:, :, r], s[:, :, r]) for r in live], "weight": n.sum((0, 1))[live]})

        for b in batches:
            for r in b.itertuples():
                if at != (r.key, r.chunk):
                    if at is not None:
                        yield done()
                    at, held = (r.key, r.chunk), {}
                old = held.get((r.f, r.x))
                held[r.f, r.x] = (np.asarray(r.n), np.asarray(r.s)) if old is None else (old[0] + r.n, old[1] + r.s)
        if at is not None:
            yield done()

    hist = parts.repartition("key", "chunk").mapInPandas(histograms, "key string, chunk bigint, f int, x double, n array<double>, s array<double>")
    out = hist.repartition("key", "chunk").sortWithinPartitions("key", "chunk").mapInPandas(losses, "key string, rep bigint, loss double, weight double")
    names = cells.select(*run).distinct().withColumn("__key", F.to_json(F.struct(*run)))
    return out.join(names, out["key"] == names["__key"]).select(*run, F.col("rep").cast("int").alias("rep"), "loss", "weight")


def loss_difference(losses: DataFrame, by: Sequence[str], series: str, a: str, b: str) -> DataFrame:
    """(by, point, lo, hi, dropped, excludes_zero) of the mean refitted loss of series b less that of a, replicate by replicate."""
    mean = lambda s: F.max(F.when(F.col(series) == s, F.col("loss") / F.col("weight")))
    v = checkpointed(losses.groupBy(*by, "rep").agg((mean(b) - mean(a)).alias("v")))
    point = v.where("rep < 0").select(*by, F.col("v").alias("point"))
    out = point.join(percentile_interval(v.where("rep >= 0"), by, "v"), list(by))
    return out.withColumn("excludes_zero", ((F.col("lo") > 0) | (F.col("hi") < 0)).cast("int"))


# --- fold draws -------------------------------------------------------------------------------------------------------
def fold_draws(df: DataFrame, cluster: str, k: int, seeds: Sequence[int]) -> DataFrame:
    """(fold_seed, cluster, fold): a fold of every cluster for each seed, as `group_folds` draws it."""
    c = df.select(cluster).distinct().withColumn("fold_seed", F.explode(F.array(*map(F.lit, seeds))))
    c = positions(c.withColumn("__h", hash_int("fold_seed", cluster)), ["fold_seed"], ["__h", cluster], "__pos", "__n")
    q, r = F.floor(F.col("__n") / k), F.pmod("__n", F.lit(k))
    head = r * (q + 1)
    f = F.when(F.col("__pos") < head, F.floor(F.col("__pos") / (q + 1))).otherwise(r + F.floor((F.col("__pos") - head) / F.greatest(q, F.lit(1))))
    return c.select("fold_seed", cluster, f.cast("int").alias("fold"))


def fold_sweep_errors(df: DataFrame, run: Sequence[str], cluster: str, x: str, y: str, k: int, seeds: Sequence[int]) -> DataFrame:
    """(run, fold_seed, ece): equal-width calibration error of the cross-fitted forecasts under every draw of the folds."""
    run = list(run)
    cells = checkpointed(df.where(F.col(x).isNotNull()).groupBy(*run, cluster, x).agg(F.count(F.lit(1)).alias("__n"), F.sum(F.col(y).cast("double")).alias("__s")))
    drawn = checkpointed(cells.join(fold_draws(cells, cluster, k, seeds), cluster).groupBy(*run, "fold_seed", "fold", x).agg(F.sum("__n").alias("__n"), F.sum("__s").alias("__s")))
    fit = crossfit_isotonic(drawn.withColumn("__y", F.col("__s") / F.col("__n")), [*run, "fold_seed"], x, "__y", "fold", k, "__q", F.col("__n"))
    both = drawn.join(fit, [*run, "fold_seed", "fold", x])
    bins = both.groupBy(*run, "fold_seed", width_bin("__q").alias("bin")).agg(F.abs(F.sum(F.col("__n") * F.col("__q")) - F.sum("__s")).alias("d"), F.sum("__n").alias("n"))
    return checkpointed(bins.groupBy(*run, "fold_seed").agg((F.sum("d") / F.sum("n")).alias("ece")))


def fold_sweep(errors: DataFrame, by: Sequence[str], series: str, reference: str) -> DataFrame:
    """(by, series, draws, min, median, max, below): range over the fold draws, and the share of draws below the reference series of the same draw."""
    ref = errors.where(F.col(series) == reference).select(*by, "fold_seed", F.col("ece").alias("__ref"))
    both = errors.join(ref, [*by, "fold_seed"], "left")
    return both.groupBy(*by, series).agg(
        F.count(F.lit(1)).alias("draws"), F.min("ece").alias("ece_min"), F.median("ece").alias("ece_median"), F.max("ece").alias("ece_max"), F.avg((F.col("ece") < F.col("__ref")).cast("double")).alias("below"))


def runs_below(errors: DataFrame, by: Sequence[str], series: str, reference: str) -> DataFrame:
    """(runs_below, draws): in how many fold draws so many runs lie below their reference series."""
    ref = errors.where(F.col(series) == reference).select(*by, "fold_seed", F.col("ece").alias("__ref"))
    runs = errors.where(F.col(series) != reference).join(ref, [*by, "fold_seed"])
    per = runs.groupBy("fold_seed").agg(F.sum((F.col("ece") < F.col("__ref")).cast("int")).alias("runs_below"))
    return per.groupBy("runs_below").agg(F.count(F.lit(1)).alias("draws"))
