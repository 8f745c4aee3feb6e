"""Simulated draws that need counts, positions or ranks only: no row of a table meets a draw.

A draw's random part is made in chunks of draws, each with a numpy generator seeded by what the chunk is (run, slice of forecasts, first draw), so a retried
task draws the same; what a chunk hands on are sums per draw. Work is spread over (slice, chunk) and bounded by `FORECASTS` x `CHUNK` numbers in a task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorefold.operators.calibration import BINS, EDGES, forecast_counts, odds_shift, solve
from scorefold.operators.ordered import positions
from scorefold.operators.resample import percentile_interval
from scorefold.operators.scores import spearman
from scorefold.session import checkpointed

#: Distinct forecasts of a slice, and draws of a chunk.
FORECASTS, CHUNK = 1024, 500
#: Members whose ranks are permuted together; a member is a model or a run, not a row.
MEMBERS = 5_000


def _seeded(seed: int, *what) -> np.random.Generator:
    return np.random.default_rng([seed, *(zlib.crc32(x.encode()) if isinstance(x, str) else int(x) for x in what)])


def _run_key(by: Sequence[str]) -> Column:
    return F.to_json(F.struct(*by)) if by else F.lit("")


def _bin_sums(d: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sums of d (forecasts x draws) by the equal-width bin of q (the same shape), draws x bins."""
    at = np.searchsorted(EDGES, q, side="left") + BINS * np.arange(d.shape[1])
    return np.bincount(at.ravel(), weights=d.ravel(), minlength=BINS * d.shape[1]).reshape(-1, BINS)


def _shifted(q: np.ndarray, delta: np.ndarray) -> np.ndarray:
    """odds_shift of every forecast by every draw's delta."""
    q = np.repeat(q[:, None], len(delta), 1)
    inner = (q > 0) & (q < 1)
    with np.errstate(divide="ignore", over="ignore"):
        return np.where(inner, 1 / (1 + np.exp(-(np.log(q / (1 - q)) + delta))), q)


def _simulated(parts: DataFrame, seed: int) -> DataFrame:
    """(run, draw, hits, d0 ..): per slice and draw the simulated positives, and forecasts less positives by bin; with `delta`, of the shifted forecasts."""
    refit = "delta" in parts.columns

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                q, n = np.asarray(row.q, np.float64), np.asarray(row.n, np.int64)
                hits = _seeded(seed, row.run, row.slice, row.start).binomial(n[:, None], q[:, None], (len(q), row.draws))
                shown = _shifted(q, np.asarray(row.delta, np.float64)) if refit else np.repeat(q[:, None], row.draws, 1)
                sums = _bin_sums(n[:, None] * shown - hits, shown)
                yield pd.DataFrame({"run": row.run, "draw": row.start + np.arange(row.draws), "hits": hits.sum(0), **{f"d{k}": sums[:, k] for k in range(BINS)}})

    schema = "run string, draw bigint, hits bigint, " + ", ".join(f"d{k} double" for k in range(BINS))
    out = parts.mapInPandas(task, schema)
    return out.groupBy("run", "draw").agg(F.sum("hits").alias("hits"), *(F.sum(f"d{k}").alias(f"d{k}") for k in range(BINS)))


def chance_band(df: DataFrame, by: Sequence[str], p: str, observed: DataFrame, draws: int = 20_000, seed: int = 1, tie: float = 1e-12) -> DataFrame:
    """The observed equal-width calibration error (``observed``: *by, ece) against its 95th percentile under labels drawn from the forecasts, and the share of
    draws at or above it. ``plain`` holds the forecasts fixed; ``refit`` shifts their odds in every draw to the mean of that draw's labels, the null for
    forecasts whose mean was fitted (draws of one class are left out).

    Labels of equal forecasts are drawn as one binomial count. The shift depends on a draw through its number of positives only, so it is solved once for
    each number that occurs.
    """
    hist = forecast_counts(df, by, p).select(_run_key(by).alias("run"), "p", "n")
    size = checkpointed(hist.groupBy("run").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("forecasts")))
    slices = F.ceil(F.col("forecasts") / F.lit(FORECASTS))
    cut = hist.join(size, "run").select("run", F.pmod(F.xxhash64("p"), slices).alias("slice"), "p", "n")
    cells = cut.groupBy("run", "slice").agg(F.sort_array(F.collect_list(F.struct("p", "n"))).alias("c"))  # about FORECASTS entries
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(draws - 1).cast("bigint"), F.lit(CHUNK).cast("bigint")))
    parts = cells.select("run", "slice", F.col("c.p").alias("q"), F.col("c.n").alias("n"), starts.alias("start"))
    parts = parts.withColumn("draws", F.least(F.lit(draws) - F.col("start"), F.lit(CHUNK)).cast("int")).repartition("run", "slice", "start")
    plain = checkpointed(_simulated(parts, seed))

    hits = plain.join(size, "run").where((F.col("hits") > 0) & (F.col("hits") < F.col("rows"))).select("run", "draw", "hits", "rows")
    targets = hits.select("run", "hits", (F.col("hits") / F.col("rows")).alias("target")).distinct()
    delta = solve(hist.join(targets, "run"), ["run", "hits"], lambda q, d: odds_shift(q, d) - F.col("target"), -40.0, 40.0)
    shift = hits.join(delta, ["run", "hits"]).select("run", "draw", (F.floor(F.col("draw") / CHUNK) * CHUNK).alias("start"), "delta")
    # a draw of one class has no shift: it is simulated unshifted and left out below
    every = plain.select("run", "draw", (F.floor(F.col("draw") / CHUNK) * CHUNK).alias("start")).join(shift.drop("start"), ["run", "draw"], "left")
    chunks = every.groupBy("run", "start").agg(F.array_sort(F.collect_list(F.struct("draw", F.coalesce("delta", F.lit(0.0)).alias("delta")))).alias("s"))
    again = _simulated(parts.join(chunks.select("run", "start", F.col("s.delta").alias("delta")), ["run", "start"]), seed)
    again = again.join(shift.select("run", "draw"), ["run", "draw"], "left_semi")

    seen = observed.select(*by, _run_key(by).alias("__run"), F.col("ece").alias("observed"))

    def summary(sim: DataFrame, name: str) -> DataFrame:
        error = sum((F.abs(f"d{k}") for k in range(1, BINS)), F.abs("d0"))
        e = sim.join(size, "run").select("run", (error / F.col("rows")).alias("e")).join(seen.select(F.col("__run").alias("run"), "observed"), "run")
        at = F.avg((F.col("e") >= F.col("observed") - tie).cast("double"))
        return e.groupBy(F.col("run").alias("__run")).agg(F.percentile("e", F.lit(0.95)).alias(f"{name}_p95"), at.alias(f"{name}_share"))  # one value for each draw

    out = seen.join(summary(plain, "plain"), "__run").join(summary(again, "refit"), "__run", "left")
    inside = lambda n: (F.col("observed") <= F.col(f"{n}_p95")).cast("int").alias(f"inside_{n}")
    return out.select(*by, "observed", "plain_p95", "plain_share", "refit_p95", "refit_share", inside("plain"), inside("refit"))


def _row_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks within each row, ties averaged."""
    order = np.argsort(x, axis=1, kind="stable")
    s = np.take_along_axis(x, order, 1)
    n = x.shape[1]
    at = np.arange(n)
    fresh = np.concatenate([np.ones((len(x), 1), bool), s[:, 1:] != s[:, :-1]], 1)
    first = np.maximum.accumulate(np.where(fresh, at, 0), 1)
    ends = np.concatenate([fresh[:, 1:], np.ones((len(x), 1), bool)], 1)
    last = np.minimum.accumulate(np.where(ends, at, n)[:, ::-1], 1)[:, ::-1]
    out = np.empty(x.shape)
    np.put_along_axis(out, order, (first + last) / 2 + 1, 1)
    return out


def shared_baseline_null(df: DataFrame, ident: str, a: str, b: str, draws: int = 20_000, seed: int = 1) -> DataFrame:
    """Permutation range of the rank correlation of a with b - a when b is shuffled over the members, beside the observed value.

    A chunk of draws permutes the members' values as one matrix. Members are models or runs: more than `MEMBERS` raise an error rather than grow a task.
    """
    rows = checkpointed(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(ident, F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")))
    if rows.count() > MEMBERS:
        raise ValueError(f"more than {MEMBERS} members")
    one = rows.agg(F.sort_array(F.collect_list(F.struct(F.col(ident).alias("i"), "a", "b"))).alias("m"))  # at most MEMBERS entries
    chunk = F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(CHUNK)))
    parts = one.select(F.col("m.a").alias("a"), F.col("m.b").alias("b"), chunk.alias("start")).repartition("start")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for row in p.itertuples():
                x, y = np.asarray(row.a), np.asarray(row.b)
                n = min(CHUNK, draws - row.start)
                shuffled = _seeded(seed, row.start).permuted(np.repeat(y[None, :], n, 0), axis=1)
                r = _row_ranks(np.round(shuffled - x, 12))
                u = _row_ranks(x[None, :])[0]
                u, r = u - u.mean(), r - r.mean(1, keepdims=True)
                with np.errstate(invalid="ignore", divide="ignore"):
                    yield pd.DataFrame({"rho": (r @ u) / np.sqrt((u @ u) * (r * r).sum(1))})

    null = parts.mapInPandas(task, "rho double").where(F.col("rho").isNotNull() & ~F.isnan("rho"))
    q = F.percentile("rho", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    summary = null.agg(q[0].alias("lo"), q[1].alias("median"), q[2].alias("hi"), F.count(F.lit(1)).alias("draws"))
    obs = spearman(rows.withColumn("__d", F.round(F.col("b") - F.col("a"), 12)), [], "a", "__d").select(F.col("rho").alias("observed"))
    return summary.crossJoin(F.broadcast(obs)).withColumn("inside", F.col("observed").between(F.col("lo"), F.col("hi")).cast("int"))


def median_difference(df: DataFrame, by: Sequence[str], ident: str, value: str, group: Column, reps: int = 20_000, seed: int = 1) -> DataFrame:
    """Interval of the difference of two groups' medians (1 less 0) under resampling of rows.

    A resample's middle values are order statistics of n uniform draws, so their places in the sorted rows are drawn directly (a beta variable, and for even n
    the smallest of the draws above it) and looked up by an equi-join: two places for each replicate, whatever the number of rows.
    """
    rows = df.withColumn("__g", group.cast("int")).where(F.col("__g").isin(0, 1) & F.col(value).isNotNull()).select(*by, "__g", ident, F.col(value).cast("double").alias("v"))
    placed = checkpointed(positions(rows, [*by, "__g"], ["v", ident], "pos", "n"))
    sizes = placed.groupBy(*by, "__g").agg(F.max("n").alias("n"))
    parts = sizes.select(F.to_json(F.struct(*by, "__g")).alias("run"), "n", F.explode(F.sequence(F.lit(0), F.lit(reps - 1), F.lit(CHUNK))).alias("start")).repartition("run", "start")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for row in p.itertuples():
                n, m = int(row.n), min(CHUNK, reps - row.start)
                rng, k = _seeded(seed, row.run, row.start), (int(row.n) + 1) // 2
                low = rng.beta(k, n - k + 1, m)
                high = low if n % 2 else 1 - (1 - low) * rng.beta(n - k, 1, m)
                place = lambda u: np.minimum((u * n).astype(np.int64), n - 1)
                yield pd.DataFrame({"run": row.run, "rep": np.tile(row.start + np.arange(m), 2), "pos": np.concatenate([place(low), place(high)])})

    drawn = parts.mapInPandas(task, "run string, rep bigint, pos bigint")
    keyed = placed.select(*by, "__g", F.to_json(F.struct(*by, "__g")).alias("__run"), F.col("pos").alias("__pos"), "v")
    middle = drawn.join(keyed, (F.col("__run") == drawn["run"]) & (F.col("__pos") == drawn["pos"])).drop("run", "pos").groupBy(*by, "rep", "__g").agg(F.avg("v").alias("m"))
    d = middle.groupBy(*by, "rep").agg((F.max(F.when(F.col("__g") == 1, F.col("m"))) - F.max(F.when(F.col("__g") == 0, F.col("m")))).alias("v"))
    return percentile_interval(d, by, "v")
