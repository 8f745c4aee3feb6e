"""Calibration, probability shifts, isotonic recalibration and decision thresholds of stated probabilities."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorefold.functions.columns import HASH_RANGE, hash_int
from scorefold.operators.ordered import SLICES, neighbour, neighbours_both, positions, running, slice_count, sliced
from scorefold.operators.scores import average_precision, count_if
from scorefold.session import checkpointed

BINS = 10
EDGES = tuple(i * 0.1 for i in range(1, BINS))  # as doubles: 3 * 0.1 is 0.30000000000000004, which is where 0.3 must fall below


# --- reliability ------------------------------------------------------------------------------------------------------
def width_bin(p: Column | str) -> Column:
    """Equal-width bin 0..9, right-closed with the first bin closed: the number of inner edges below p."""
    x = F.col(p) if isinstance(p, str) else p
    out = F.lit(0)
    for e in EDGES:
        out = out + (x > F.lit(e)).cast("int")
    return out


def reliability_width(df: DataFrame, by: Sequence[str], p: str = "score", y: str = "label") -> DataFrame:
    return df.where(F.col(p).isNotNull()).groupBy(*by, width_bin(p).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))


def reliability_count(df: DataFrame, by: Sequence[str], ident: str, p: str = "score", y: str = "label", bins: int = BINS) -> DataFrame:
    """Equal-count bins of the sorted forecasts; the first bins take the remainder, one row each."""
    r = positions(df.where(F.col(p).isNotNull()), by, [p, ident], "__pos", "__n")
    q, rem = F.floor(F.col("__n") / bins), F.pmod("__n", F.lit(bins))
    head = rem * (q + 1)
    b = F.when(F.col("__pos") < head, F.floor(F.col("__pos") / (q + 1))).otherwise(rem + F.floor((F.col("__pos") - head) / F.greatest(q, F.lit(1))))
    return r.groupBy(*by, b.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min(p).alias("min_p"), F.max(p).alias("max_p"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))


def calibration(df: DataFrame, by: Sequence[str], ident: str, p: str = "score", y: str = "label") -> DataFrame:
    """Base rate, mean forecast, Brier score, both calibration errors and the Murphy terms of the equal-width bins."""
    rows = df.where(F.col(p).isNotNull())
    yy = F.col(y).cast("double")
    base = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(yy).alias("base_rate"), F.avg(p).alias("mean_p"), F.avg((F.col(p) - yy) ** 2).alias("brier"))
    gap = F.abs(F.col("mean_p") - F.col("rate"))
    width = reliability_width(rows, by, p, y).join(base.select(*by, F.col("n").alias("__n"), "base_rate"), list(by))
    wk = F.col("n") / F.col("__n")
    w = width.groupBy(*by).agg(
        F.sum(wk * gap).alias("ece_width"), F.sum(wk * (F.col("mean_p") - F.col("rate")) ** 2).alias("reliability"),
        F.sum(wk * F.col("rate") * (1 - F.col("rate"))).alias("refinement"), F.sum(wk * (F.col("rate") - F.col("base_rate")) ** 2).alias("resolution"))
    count = reliability_count(rows, by, ident, p, y)
    c = count.groupBy(*by).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece_count"))
    out = base.join(w, list(by)).join(c, list(by))
    return out.withColumn("uncertainty", F.col("base_rate") * (1 - F.col("base_rate")))


# --- shifts of the odds -----------------------------------------------------------------------------------------------
def odds_shift(p: Column, delta: Column) -> Column:
    """Add delta to the log-odds; a stated 0 or 1 stays."""
    return F.when((p > 0) & (p < 1), 1.0 / (1.0 + F.exp(0 - (F.log(p / (1 - p)) + delta)))).otherwise(p)


def solve(hist: DataFrame, by: Sequence[str], excess: Callable[[Column, Column], Column], lo: float, hi: float, grid: int = 32, passes: int = 9,
           slack: float = 0.0) -> DataFrame:
    """Per group the root of an increasing function: the weighted sum over (p, n) of ``excess(p, d)``.

    Each pass evaluates a grid of shifts in one aggregate over the distinct forecasts and narrows the bracket by the grid
    size; nine passes of 32 narrow 80 units to 1e-12, and no group's forecasts are gathered.
    """
    bracket = hist.select(*by).distinct().withColumns({"lo": F.lit(lo), "hi": F.lit(hi)})
    for _ in range(passes):
        step = (F.col("hi") - F.col("lo")) / grid
        pts = bracket.select(*by, step.alias("step"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(grid)), lambda i: F.col("lo") + i * step)).alias("d"))
        val = hist.join(pts, list(by)).groupBy(*by, "d", "step").agg(F.sum(F.col("n") * excess(F.col("p"), F.col("d"))).alias("v"))
        below = val.groupBy(*by).agg(F.max(F.when(F.col("v") <= 0.0 - slack, F.col("d"))).alias("__lo"), F.min("d").alias("__first"), F.max("step").alias("step"))
        bracket = checkpointed(below.select(*by, F.coalesce("__lo", "__first").alias("lo"), (F.coalesce("__lo", "__first") + F.col("step")).alias("hi")))
    return bracket.select(*by, ((F.col("lo") + F.col("hi")) / 2).alias("delta"))


def forecast_counts(df: DataFrame, by: Sequence[str], p: str) -> DataFrame:
    return checkpointed(df.where(F.col(p).isNotNull()).groupBy(*by, F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n")))


def delta_to_mean(df: DataFrame, by: Sequence[str], p: str, target: DataFrame) -> DataFrame:
    """Per group the shift that makes the mean forecast equal the target (``target``: *by, target)."""
    hist = forecast_counts(df, by, p).join(target, list(by))
    return solve(hist, by, lambda q, d: odds_shift(q, d) - F.col("target"), -40.0, 40.0)


def prior_em(df: DataFrame, by: Sequence[str], p: str, source_prior: float) -> DataFrame:
    """Fixed point of the EM estimate of the target prior: the prior equals the mean of the forecasts shifted to it.

    The log-likelihood is concave in the prior, so the fixed point is the one sign change of prior - mean.
    """
    src = float(np.log(source_prior / (1 - source_prior)))
    prior = lambda d: 1.0 / (1.0 + F.exp(0 - (d + src)))
    # both sides saturate far out, where their difference is rounding noise: the slack keeps the search off that end
    root = solve(forecast_counts(df, by, p), by, lambda q, d: prior(d) - odds_shift(q, d), -40.0, 40.0, slack=1e-12)
    return root.select(*by, "delta", prior(F.col("delta")).alias("prior"))


# --- folds and isotonic fits ------------------------------------------------------------------------------------------
def group_folds(df: DataFrame, cluster: str, k: int, seed: int, fold: str = "fold") -> DataFrame:
    """A fold per cluster in seeded hash order, sizes in clusters as even as possible; no cluster meets two folds."""
    c = df.select(cluster).distinct().withColumn("__h", hash_int(seed, cluster))
    c = positions(c, [], ["__h", cluster], "__pos", "__n")
    q, r = F.floor(F.col("__n") / k), F.pmod("__n", F.lit(k))
    head = r * (q + 1)
    f = F.when(F.col("__pos") < head, F.floor(F.col("__pos") / (q + 1))).otherwise(r + F.floor((F.col("__pos") - head) / F.greatest(q, F.lit(1))))
    return df.join(c.select(cluster, f.cast("int").alias(fold)), cluster)


SLICE_ROWS = 10_000  # blocks that one task pools without help


def _pool_adjacent(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pool adjacent violators of blocks (x_lo, x_hi, n, s) sorted by x: merge while a mean reaches the next one."""
    x_lo, x_hi, n, s = (pdf[c].to_numpy() for c in ("x_lo", "x_hi", "n", "s"))
    first, size, total = np.empty(len(n), np.int64), np.empty(len(n)), np.empty(len(n))  # a stack of blocks
    top = -1
    for i, (w, t) in enumerate(zip(n.tolist(), s.tolist())):
        at = i
        while top >= 0 and total[top] * w >= t * size[top]:
            at, w, t = first[top], size[top] + w, total[top] + t
            top -= 1
        top += 1
        first[top], size[top], total[top] = at, w, t
    first = first[: top + 1]
    return pd.DataFrame({"x_lo": x_lo[first], "x_hi": x_hi[np.append(first[1:], len(n)) - 1], "n": size[: top + 1], "s": total[: top + 1]})


def isotonic_blocks(df: DataFrame, by: Sequence[str], x: str, y: str, weight: Column | None = None, slices: int | None = SLICES) -> DataFrame:
    """Blocks (x_lo, x_hi, value, n) of the weighted isotonic fit per group.

    Distinct x are counted first; then rounds pool the blocks of contiguous slices, each slice in its own task, with other slice
    boundaries in every round, until no neighbours violate the order. Pooling in any order gives the same fit. A run that spans many
    slices shrinks to a block per slice in the first round, so the rounds are few; what already rises is read once and stays spread.
    """
    by = list(by)
    w = F.lit(1.0) if weight is None else weight.cast("double")
    hist = df.where(F.col(x).isNotNull()).groupBy(*by, F.col(x).cast("double").alias("x_lo")).agg(F.sum(w).alias("n"), F.sum(w * F.col(y).cast("double")).alias("s"))
    blocks = checkpointed(hist.where(F.col("n") > 0).select(*by, "x_lo", F.col("x_lo").alias("x_hi"), "n", "s"))
    keys = {c: t for c, t in blocks.dtypes if c in by}
    schema = ", ".join([*[f"{c} {t}" for c, t in keys.items()], "x_lo double, x_hi double, n double, s double"])

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = _pool_adjacent(pdf.sort_values("x_lo"))
        for c, v in zip(by, key):
            out[c] = v
        return out[[*by, "x_lo", "x_hi", "n", "s"]]

    for turn in itertools.count():
        parts = max(1, min(slice_count(blocks, slices), blocks.count() // SLICE_ROWS))  # as many tasks as the blocks left are worth
        cut = sliced(blocks, by, ["x_lo"], parts, salt=turn).select(*by, F.col("__slice").alias("part"), "x_lo", "x_hi", "n", "s")
        blocks = checkpointed(cut.groupBy(*by, "part").applyInPandas(fit, schema))
        after = neighbour(blocks, by, ["x_lo"], {"__n": F.col("n"), "__s": F.col("s")}, ahead=True)
        if not after.where(F.col("s") * F.col("__n") >= F.col("__s") * F.col("n")).limit(1).count():
            break
    return blocks.select(*by, "x_lo", "x_hi", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("s") / F.col("n"))).alias("value"), "n")


def isotonic_predict(blocks: DataFrame, probes: DataFrame, by: Sequence[str], x: str, out: str) -> DataFrame:
    """Fitted value of each distinct probe: the block's value inside a block, linear between blocks, clipped outside."""
    by = list(by)
    ends = F.array_distinct(F.array(F.struct(F.col("x_lo").alias("x"), F.col("value").alias("v")), F.struct(F.col("x_hi").alias("x"), F.col("value").alias("v"))))
    t = blocks.select(*by, F.explode(ends).alias("t")).select(*by, F.col("t.x").alias("__x"), F.lit(0).alias("__side"), F.col("t").alias("__t"))
    p = probes.select(*by, F.col(x).cast("double").alias("__x")).distinct().withColumn("__side", F.lit(1))
    both = t.unionByName(p, allowMissingColumns=True)
    b = neighbours_both(checkpointed(both), by, ["__x", "__side"], F.col("__t"), "__a", "__b").where(F.col("__side") == 1)
    x0, x1, v0, v1 = F.col("__a.x"), F.col("__b.x"), F.col("__a.v"), F.col("__b.v")
    v = F.when(x0.isNull(), v1).when(x1.isNull() | (x0 == F.col("__x")) | (x1 == x0), v0).otherwise(v0 + (v1 - v0) * (F.col("__x") - x0) / (x1 - x0))
    return b.select(*by, F.col("__x").alias(x), v.alias(out))


def isotonic(df: DataFrame, by: Sequence[str], x: str, y: str, out: str = "fitted", weight: Column | None = None) -> DataFrame:
    """In-sample isotonic value of every distinct x."""
    return isotonic_predict(isotonic_blocks(df, by, x, y, weight), df.where(F.col(x).isNotNull()), by, x, out)


def crossfit_isotonic(df: DataFrame, by: Sequence[str], x: str, y: str, fold: str, k: int, out: str = "recalibrated", weight: Column | None = None) -> DataFrame:
    """Out-of-fold recalibrated value per (by, fold, x): each fold is read off the fit to the other folds."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    cells = df.where(F.col(x).isNotNull()).groupBy(*by, fold, x).agg(F.sum(w).alias("__n"), F.sum(w * F.col(y).cast("double")).alias("__s"))
    others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col(fold))
    train = cells.select(*by, F.explode(others).alias("__fold"), x, "__n", "__s").withColumn("__y", F.col("__s") / F.col("__n"))
    blocks = isotonic_blocks(train.withColumnRenamed("__fold", fold), [*by, fold], x, "__y", F.col("__n"))
    return isotonic_predict(blocks, cells, [*by, fold], x, out)


def corp_decomposition(df: DataFrame, by: Sequence[str], p: str = "score", y: str = "label") -> DataFrame:
    """Miscalibration and discrimination from the in-sample isotonic fit."""
    rows = df.where(F.col(p).isNotNull())
    fit = isotonic(rows, by, p, y, "__f")
    cells = rows.groupBy(*by, p).agg(F.count(F.lit(1)).alias("__n"), F.sum(F.col(y).cast("double")).alias("__s")).join(fit, [*by, p])
    loss = lambda q: F.sum(F.col("__n") * q * q - 2 * q * F.col("__s") + F.col("__s"))  # labels are 0 / 1
    n, base = F.sum("__n"), F.sum("__s") / F.sum("__n")
    g = cells.groupBy(*by).agg(n.alias("n"), (loss(F.col(p)) / n).alias("brier"), (loss(F.col("__f")) / n).alias("brier_fitted"), (base * (1 - base)).alias("uncertainty"))
    return g.withColumns({"miscalibration": F.col("brier") - F.col("brier_fitted"), "discrimination": F.col("uncertainty") - F.col("brier_fitted")})


def chance_band(df: DataFrame, by: Sequence[str], ident: str, p: str, observed: DataFrame, draws: int, seed: int, tie: float = 1e-12) -> DataFrame:
    """95th percentile of the equal-width calibration error under labels drawn from the forecasts, and the share of draws at
    or above the observed error (``observed``: *by, ece). One row per draw and bin leaves each task."""
    rows = df.where(F.col(p).isNotNull()).select(*by, ident, p, width_bin(p).alias("bin"))
    reps = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = hash_int(seed, "rep", *by, ident) / F.lit(HASH_RANGE)
    hit = (u < F.col(p)).cast("double")
    bins = reps.groupBy(*by, "rep", "bin").agg(F.sum(F.col(p) - hit).alias("d"), F.count(F.lit(1)).alias("n"))
    per = bins.groupBy(*by, "rep").agg((F.sum(F.abs("d")) / F.sum("n")).alias("ece_draw")).join(observed, list(by))
    return per.groupBy(*by).agg(
        F.max("ece").alias("observed"), F.percentile("ece_draw", F.lit(0.95)).alias("p95"), F.avg((F.col("ece_draw") >= F.col("ece") - tie).cast("double")).alias("tail_share"))


# --- thresholds -------------------------------------------------------------------------------------------------------
def _cut_table(df: DataFrame, by: Sequence[str], score: str, y: str) -> DataFrame:
    """Every cut per group: index, cut value (-inf, midpoints, +inf) and rows classified right by ``score >= cut``."""
    hist = df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("s")).agg(F.sum((F.col(y) == 1).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n"))
    r = running(checkpointed(hist), by, ["s"], {"cp": F.col("pos"), "cn": F.col("n"), "idx": F.lit(1).cast("bigint")}, totals=True)
    r = neighbour(r, by, ["s"], {"nxt": F.col("s")}, ahead=True)
    after = r.select(*by, F.col("idx"), F.when(F.col("nxt").isNull(), float("inf")).otherwise((F.col("s") + F.col("nxt")) / 2).alias("cut"),
                     ((F.col("cp_total") - F.col("cp")) + (F.col("cn") - F.col("cp"))).alias("right"), F.col("cn_total").alias("rows"))
    first = hist.groupBy(*by).agg(F.sum("pos").alias("right"), F.sum("n").alias("rows")).select(*by, F.lit(0).cast("bigint").alias("idx"), F.lit(float("-inf")).alias("cut"), "right", "rows")
    return first.unionByName(after)


def best_threshold(df: DataFrame, by: Sequence[str], score: str, y: str, rule: str = "lower_middle") -> DataFrame:
    """Accuracy-maximising cut per group, infinite cuts included. Among tied cuts the lower middle one; the older ``median``
    rule averages the middle ones instead."""
    cuts = checkpointed(_cut_table(df, by, score, y))
    top = cuts.groupBy(*by).agg(F.max("right").alias("right"))
    tied = positions(cuts.join(top, [*by, "right"]), by, ["idx"], "__pos", "__n")
    lo, hi = F.floor((F.col("__n") - 1) / 2), F.floor(F.col("__n") / 2)
    pick = (F.col("__pos") == lo) if rule == "lower_middle" else ((F.col("__pos") == lo) | (F.col("__pos") == hi))
    return tied.where(pick).groupBy(*by).agg(F.avg("cut").alias("cut"), (F.max("right") / F.max("rows")).alias("accuracy"), F.max("__n").alias("ties"))


RADIX = 16  # blocks of 16 ** level cuts


def _levels(top: int) -> int:
    """Levels that tile every range of indices up to ``top``: the highest has one block."""
    return len(f"{top:x}") + 1


def _range_blocks(a: Column, b: Column, levels: int) -> Column:
    """Array of (lv, blk) of the aligned blocks that tile the index range a .. b."""
    empty = F.array().cast("array<struct<lv:int,blk:bigint>>")
    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"), empty.alias("out"))

    def level(acc: Column, lv: Column) -> Column:
        lo, hi = acc["a"], acc["b"]
        up = lo + F.pmod(-lo, F.lit(RADIX))  # first aligned block at or above lo
        down = hi + 1 - F.pmod(hi + 1, F.lit(RADIX))  # first index past the aligned part
        span = lambda x, y: F.when(x <= y, F.sequence(x, y)).otherwise(F.array().cast("array<bigint>"))
        left = span(lo, F.least(up - 1, hi))
        right = span(F.greatest(down, up, lo), hi)
        here = F.transform(F.concat(left, right), lambda k: F.struct(lv.cast("int").alias("lv"), k.alias("blk")))
        return F.struct(F.shiftright(up, 4).alias("a"), (F.shiftright(down, 4) - 1).alias("b"), F.concat(acc["out"], here).alias("out"))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), start, level)
    return done["out"]


def leave_group_out_threshold(df: DataFrame, group: str, score: str, y: str) -> DataFrame:
    """Best cut (lower middle of the tied ones) for each group, fitted to all other groups' rows.

    No group meets every cut. Taking a group out changes the rows classified right only at the group's own scores and shifts
    the common curve by a constant between them. So a group's cut axis is its own scores, taken one by one, and the ranges
    between them, each tiled by aligned blocks whose maximum and number of maxima are computed once for all groups. A score
    held by the group alone leaves no cut behind.
    """
    rows = df.where(F.col(score).isNotNull()).select(F.col(group).alias("g"), F.col(score).cast("double").alias("s"), (F.col(y) == 1).cast("bigint").alias("p"))
    own = checkpointed(rows.groupBy("g", "s").agg(F.sum("p").alias("pos"), F.count(F.lit(1)).alias("n")))
    allv = own.groupBy("s").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("holders"))
    table = checkpointed(running(allv, [], ["s"], {"cp": F.col("pos"), "cn": F.col("n"), "idx": F.lit(1).cast("bigint")}, totals=True))
    curve = table.select("idx", (F.col("cp_total") - F.col("cp") + F.col("cn") - F.col("cp")).alias("t"))  # cut above the idx-th score

    # blocks: maximum, number of maxima and, for the look-up, the rank of each maximum inside its block
    levels = _levels(table.agg(F.max("idx")).first()[0] or 0)
    lv = curve.withColumn("lv", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumn("blk", F.floor(F.col("idx") / F.pow(F.lit(float(RADIX)), F.col("lv"))))
    counts = lv.groupBy("lv", "blk", "t").agg(F.count(F.lit(1)).alias("c"))
    best = counts.groupBy("lv", "blk").agg(F.max("t").alias("t"), F.max_by("c", "t").alias("c"))
    best = checkpointed(best)
    ranked = positions(lv.join(best.select("lv", "blk", "t"), ["lv", "blk", "t"]), ["lv", "blk"], ["idx"], "rank")

    # a group's own scores with the constant it takes off above each of them
    o = own.join(table.select("s", "idx", "holders"), "s")
    o = running(o, ["g"], ["idx"], {"ocp": F.col("pos"), "ocn": F.col("n")}, totals=True)
    o = o.withColumn("off", F.col("ocp_total") - F.col("ocp") + F.col("ocn") - F.col("ocp"))
    o = checkpointed(neighbour(o, ["g"], ["idx"], {"nxt": F.col("idx")}, ahead=True))
    last = table.agg(F.max("idx").alias("top"), F.max("cp_total").alias("all_pos"))
    groups = o.groupBy("g").agg(F.max("ocp_total").alias("own_pos"), F.min("idx").alias("first"), F.max("ocn_total").alias("own_n"))
    below = groups.crossJoin(F.broadcast(last))
    point0 = below.select("g", F.lit(0).cast("bigint").alias("start"), (F.col("all_pos") - F.col("own_pos")).alias("v"), F.lit(1).cast("bigint").alias("c"), F.lit(None).cast("int").alias("lv"), F.lit(None).cast("bigint").alias("blk"))
    points = o.where("holders > 1").join(curve, "idx").select("g", F.col("idx").alias("start"), (F.col("t") - F.col("off")).alias("v"), F.lit(1).cast("bigint").alias("c"), F.lit(None).cast("int").alias("lv"), F.lit(None).cast("bigint").alias("blk"))
    head = below.select("g", F.lit(1).cast("bigint").alias("a"), (F.col("first") - 1).alias("b"), F.col("own_pos").alias("off"))
    tail = o.crossJoin(F.broadcast(last)).select("g", (F.col("idx") + 1).alias("a"), (F.coalesce("nxt", F.col("top") + 1) - 1).alias("b"), "off")
    ranges = head.unionByName(tail).where("a <= b").select("g", "off", F.explode(_range_blocks(F.col("a"), F.col("b"), levels)).alias("r")).select("g", "off", "r.lv", "r.blk")
    pieces = ranges.join(best, ["lv", "blk"]).select("g", (F.col("blk") * F.pow(F.lit(float(RADIX)), F.col("lv"))).cast("bigint").alias("start"), (F.col("t") - F.col("off")).alias("v"), "c", "lv", "blk")
    pieces = checkpointed(point0.unionByName(points).unionByName(pieces))

    top = pieces.groupBy("g").agg(F.max("v").alias("v"))
    tied = running(pieces.join(top, ["g", "v"]), ["g"], ["start"], {"upto": F.col("c")}, totals=True)
    want = F.floor((F.col("upto_total") - 1) / 2)
    hit = tied.where((want < F.col("upto")) & (want >= F.col("upto") - F.col("c"))).withColumn("rank", want - (F.col("upto") - F.col("c")))
    inner = hit.where("lv is not null").join(ranked.select("lv", "blk", "rank", F.col("idx").alias("at")), ["lv", "blk", "rank"]).select("g", "v", "at")
    chosen = inner.unionByName(hit.where("lv is null").select("g", "v", F.col("start").alias("at")))

    # the cut lies halfway to the next score that is left: own-only scores directly above are skipped as one island
    solo = positions(o.where("holders = 1").select("g", "idx"), ["g"], ["idx"], "__r")
    isle = solo.groupBy("g", (F.col("idx") - F.col("__r")).alias("__i")).agg(F.min("idx").alias("from"), F.max("idx").alias("to"))
    nxt = chosen.withColumn("from", F.col("at") + 1).join(isle.select("g", "from", "to"), ["g", "from"], "left").withColumn("up", F.coalesce("to", F.col("at")) + 1)
    s_at = lambda n, k: table.select(F.col("idx").alias(k), F.col("s").alias(n))
    out = nxt.join(s_at("s_lo", "at"), "at", "left").join(s_at("s_hi", "up"), "up", "left").join(groups.select("g", "own_n"), "g").crossJoin(F.broadcast(table.agg(F.max("cn_total").alias("rows"))))
    cut = F.when(F.col("s_lo").isNull(), float("-inf")).when(F.col("s_hi").isNull(), float("inf")).otherwise((F.col("s_lo") + F.col("s_hi")) / 2)
    return out.select(F.col("g").alias(group), cut.alias("cut"), F.when(F.col("rows") > F.col("own_n"), F.col("v") / (F.col("rows") - F.col("own_n"))).alias("train_accuracy"))


def apply_threshold(df: DataFrame, cuts: DataFrame, by: Sequence[str], score: str, out: str = "said") -> DataFrame:
    return df.join(cuts.select(*by, "cut"), list(by)).withColumn(out, (F.col(score) >= F.col("cut")).cast("int"))


# --- month priors and simple comparators ------------------------------------------------------------------------------
def month_prior(train: DataFrame, items: DataFrame, month: str, label: str) -> DataFrame:
    """Positive rate per month of the training rows onto the items; an unseen month gets the overall rate."""
    per = train.groupBy(month).agg(F.avg(F.col(label).cast("double")).alias("__m"))
    overall = train.agg(F.avg(F.col(label).cast("double")).alias("__a"))
    return items.join(F.broadcast(per), month, "left").crossJoin(F.broadcast(overall)).withColumn("prior", F.coalesce("__m", "__a")).drop("__m", "__a")


def climatology(train: DataFrame, drivers: Sequence[str], month: str) -> DataFrame:
    """Month x driver mean and deviation, long form."""
    long = train.select(month, F.explode(F.create_map(*[x for d in drivers for x in (F.lit(d), F.col(d).cast("double"))])).alias("driver", "v"))
    return long.groupBy(month, "driver").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.count("v").alias("n"))


def long_drivers(df: DataFrame, keep: Sequence[str], drivers: Mapping[str, Column]) -> DataFrame:
    pairs = [x for n, c in drivers.items() for x in (F.lit(n), c.cast("double"))]
    return df.select(*keep, F.explode(F.create_map(*pairs)).alias("driver", "z"))


def single_driver_scan(long: DataFrame, label: str, min_rows: int = 10) -> DataFrame:
    """Average precision of +z and -z per driver, where there are enough rows and two classes."""
    ok = long.where(F.col("z").isNotNull()).groupBy("driver").agg(F.count(F.lit(1)).alias("n"), F.min(label).alias("a"), F.max(label).alias("b"))
    ok = ok.where((F.col("n") >= min_rows) & (F.col("a") != F.col("b"))).select("driver", "n")
    both = long.where(F.col("z").isNotNull()).withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumn("__s", F.col("z") * F.col("sign"))
    ap = average_precision(both, ["driver", "sign"], "__s", label).select("driver", "sign", "ap")
    return ap.groupBy("driver").agg(F.max(F.when(F.col("sign") == 1, F.col("ap"))).alias("ap_plus"), F.max(F.when(F.col("sign") == -1, F.col("ap"))).alias("ap_minus")).join(ok, "driver")


def signed_rank_score(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Sign of each driver chosen by average precision on the training rows, applied to the test rows (long form)."""
    scan = single_driver_scan(train, label, 1)
    sign = scan.select("driver", F.when(F.col("ap_plus") >= F.col("ap_minus"), 1).otherwise(-1).alias("sign"))
    return test.join(F.broadcast(sign), "driver").withColumn("signed", F.col("z") * F.col("sign"))  # one row per driver


def constant_and_naive(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """Always-yes and always-no accuracy and F1, the best F1 over all thresholds, and the no-skill average precision."""
    rows = df.where(F.col(score).isNotNull())
    hist = rows.groupBy(*by, (F.lit(0.0) - F.col(score)).alias("__neg")).agg(F.sum((F.col(label) == 1).cast("bigint")).alias("p"), F.count(F.lit(1)).alias("n"))
    r = running(hist, by, ["__neg"], {"tp": F.col("p"), "seen": F.col("n")}, totals=True)
    f1 = 2.0 * F.col("tp") / (F.col("seen") + F.col("tp_total"))
    g = r.groupBy(*by).agg(F.max("seen_total").alias("n"), F.max("tp_total").alias("positives"), F.max(f1).alias("best_f1"))
    n, p = F.col("n"), F.col("positives")
    return g.withColumns({"yes_accuracy": p / n, "yes_f1": 2.0 * p / (n + p), "no_accuracy": (n - p) / n, "no_skill_ap": p / n})
