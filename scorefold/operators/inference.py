"""Exact and permutation tests over counts, and multiplicity adjustment. The counting is grouped aggregation; the tests are
column expressions on the few count rows that remain."""

from __future__ import annotations

import math
import sys
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scorefold.functions.columns import HASH_DIGITS, hash_int
from scorefold.operators.ordered import percentiles, positions, value_counts
from scorefold.operators.scores import count_if, spearman
from scorefold.session import checkpointed

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of the package

HASH_BITS = 8  # leading bits of a hash by which the rows of a draw are counted


# --- distributions as columns -----------------------------------------------------------------------------------------
TERMS = 400  # of a continued fraction; past convergence a further term changes nothing
TINY = 1e-300
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905,
           -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)  # fixed values: g = 7, nine coefficients


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def log_gamma(x: Column) -> Column:
    """log Gamma(x) for x >= 0.5 by Lanczos' sum."""
    y = x - 1.0
    parts = F.lit(LANCZOS[0])
    for i, v in enumerate(LANCZOS[1:], 1):
        parts = parts + F.lit(v) / (y + i)
    t = y + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (y + 0.5) * F.log(t) - t + F.log(parts)


def _fraction(steps: Callable[[Column], tuple[Column, Column]], first: Column, terms: Column | None = None) -> Column:
    """Modified Lentz evaluation of first + a1 / (b1 + a2 / (b2 + ...)), with steps(i) = (a_i, b_i), over so many terms."""
    guard = lambda v: F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)
    start = F.struct(guard(first).alias("f"), guard(first).alias("c"), F.lit(0.0).alias("d"))

    def step(acc: Column, i: Column) -> Column:
        a, b = steps(i)
        return let(F.struct((1 / guard(b + a * acc["d"])).alias("d"), guard(b + a / acc["c"]).alias("c")),
                   lambda n: F.struct((acc["f"] * n["c"] * n["d"]).alias("f"), n["c"].alias("c"), n["d"].alias("d")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS) if terms is None else terms), start, step)["f"]


def chi2_upper(x: Column, dof: Column) -> Column:
    """Upper tail of the chi-square distribution, Q(dof / 2, x / 2): one minus the lower series below dof + 2, a continued fraction
    in log space above, so that a far tail is small and right instead of the rest of a subtraction."""

    def tail(v: Column) -> Column:
        a, h = v["a"], v["h"]
        front = a * F.log(h) - h - log_gamma(a)
        start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
        grow = lambda acc, n: let(acc["t"] * h / (a + n), lambda t: F.struct(t.alias("t"), (acc["s"] + t).alias("s")))
        series = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS) + F.ceil(4 * F.sqrt(a)).cast("int")), start, grow)["s"]
        low = F.greatest(F.lit(0.0), 1.0 - F.exp(front) * series / a)
        high = F.exp(front) / _fraction(lambda i: (-i * (i - a), h + 2 * i + 1 - a), h + 1 - a)
        return F.when(h < a + 1, low).otherwise(high)

    p = let(F.struct((dof / 2.0).alias("a"), (F.greatest(x, F.lit(0.0)) / 2.0).alias("h")), tail)
    return F.when(x <= 0, 1.0).otherwise(p)


def normal_two_sided(z: Column) -> Column:
    return chi2_upper(z * z, F.lit(1))


def binomial_half_two_sided(k: Column, n: Column) -> Column:
    """Two-sided exact binomial test at one half: twice P(X <= s) = I_1/2(n - s, s + 1) with s = min(k, n - k), one formula for every
    n; 1 when there are no trials or s is next to n / 2. The continued fraction needs terms like the root of n."""

    def tail(v: Column) -> Column:
        a, b = v["n"] - v["s"], v["s"] + 1
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) - (a + b) * F.lit(math.log(2.0))) / a

        def step(i: Column) -> tuple[Column, Column]:
            m = F.floor(i / 2).cast("double")
            odd = -(a + m) * (a + b + m) / (2 * (a + 2 * m) * (a + 2 * m + 1))
            even = m * (b - m) / (2 * (a + 2 * m - 1) * (a + 2 * m))
            return F.when(F.pmod(i, F.lit(2)) == 1, odd).otherwise(even), F.lit(1.0)

        return front / _fraction(step, F.lit(1.0), TERMS + F.ceil(4 * F.sqrt(v["n"])).cast("int"))

    small = F.least(k, n - k)
    p = let(F.struct(small.cast("double").alias("s"), n.cast("double").alias("n")), tail)
    return F.when((n == 0) | (2 * small + 1 >= n), 1.0).otherwise(F.least(F.lit(1.0), 2.0 * p))


def fisher_two_sided(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided Fisher exact p of [[a, b], [c, d]]: tables no likelier than the observed one, margins fixed.

    The table's probability has one mode, so these are two tails: one starts at the observed count, the start of the other is found by
    bisection. Each is summed by ratios of neighbours over fifteen standard deviations, beyond which nothing is left.
    """
    r, q, n = (a + b).cast("double"), (a + c).cast("double"), (a + b + c + d).cast("double")
    logs = lambda xs: F.transform(F.array(*xs), lambda x: log_gamma(x + 1))  # one expression for all of them
    lo, hi = F.greatest(F.lit(0.0), r + q - n), F.least(r, q)
    mode = F.least(hi, F.greatest(lo, F.floor((r + 1) * (q + 1) / (n + 2)).cast("double")))
    spread = F.sqrt(r * q * (n - r) * (n - q) / F.greatest(F.lit(1.0), n * n * (n - 1)))
    known = {"a": a.cast("double"), "r": r, "q": q, "n": n, "lo": lo, "hi": hi, "mode": mode, "terms": F.lit(200) + F.ceil(15 * spread).cast("int"), "tops": logs([r, n - r, q, n - q, n])}

    def solve(v: Column) -> Column:
        a, r, q, n, lo, hi, mode = (v[x] for x in ("a", "r", "q", "n", "lo", "hi", "mode"))
        top = v["tops"][0] + v["tops"][1] + v["tops"][2] + v["tops"][3] - v["tops"][4]
        logp = lambda k: top - F.aggregate(logs([k, r - k, q - k, n - r - q + k]), F.lit(0.0), lambda s, x: s + x)
        right = a > mode  # the observed tail is the right one

        def tail(k: Column, up: Column) -> Column:
            """P(k), P(k +- 1), ... added up; 0 where k lies outside."""
            ratio = lambda x: F.when(up, (r - x) * (q - x) / ((x + 1) * (n - r - q + x + 1))).otherwise(x * (n - r - q + x) / ((r - x + 1) * (q - x + 1)))
            start = F.struct(k.alias("k"), F.lit(1.0).alias("t"), F.lit(0.0).alias("s"))
            move = lambda acc, _: F.struct((acc["k"] + F.when(up, 1).otherwise(-1)).alias("k"), F.when((acc["k"] >= lo) & (acc["k"] <= hi), acc["t"] * ratio(acc["k"])).otherwise(0.0).alias("t"), (acc["s"] + acc["t"]).alias("s"))
            total = F.aggregate(F.sequence(F.lit(1), v["terms"]), start, move)["s"]
            return F.when((k < lo) | (k > hi), 0.0).otherwise(F.exp(logp(k)) * total)

        def other(limit: Column) -> Column:
            """The first count on the far side, from the mode on, that is no likelier than the observed one; bisection between a count
            that is likelier (or lies before the mode) and one that is not (or lies outside)."""
            start = F.struct(F.when(right, mode + 1).otherwise(mode - 1).alias("near"), F.when(right, lo - 1).otherwise(hi + 1).alias("far"))

            def halve(acc: Column, _: Column) -> Column:
                mid = F.floor((acc["near"] + acc["far"]) / 2).cast("double")
                mid = F.when(mid == acc["near"], acc["far"]).otherwise(mid)
                likelier = lambda m: (m >= lo) & (m <= hi) & (logp(m) > limit)
                return let(mid, lambda m: F.when(likelier(m), F.struct(m.alias("near"), acc["far"].alias("far"))).otherwise(F.struct(acc["near"].alias("near"), m.alias("far"))))

            return F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, halve)["far"]

        ends = F.array(F.struct(a.alias("k"), right.alias("up")), F.struct(let(logp(a) + 1e-7, other).alias("k"), (~right).alias("up")))
        both = F.aggregate(F.transform(ends, lambda e: tail(e["k"], e["up"])), F.lit(0.0), lambda s, x: s + x)
        return F.when(a == mode, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both))

    return let(F.struct(*[x.alias(k) for k, x in known.items()]), solve)


# --- tests ------------------------------------------------------------------------------------------------------------
def mcnemar_exact(pairs: DataFrame, by: Sequence[str], a: Column, b: Column) -> DataFrame:
    """Discordant counts of two paired booleans and the exact two-sided p."""
    g = pairs.groupBy(*by).agg(count_if(b & ~a).alias("b_only"), count_if(a & ~b).alias("a_only"))
    n = F.col("b_only") + F.col("a_only")
    return g.withColumn("p", binomial_half_two_sided(F.col("b_only"), n))


def failure_counts(log: DataFrame, by: Sequence[str], stratum: str, event: Column) -> DataFrame:
    return log.groupBy(*by, stratum).agg(count_if(event).alias("failed"), count_if(~event).alias("ok"))


def fisher_2x2(counts: DataFrame, by: Sequence[str], stratum: str) -> DataFrame:
    """Odds ratio and exact p where a group has exactly two strata (first one in stratum order against the second)."""
    n = counts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("strata"), F.min_by(F.struct("failed", "ok"), stratum).alias("x"), F.max_by(F.struct("failed", "ok"), stratum).alias("y"))
    n = n.where(F.col("strata") == 2)
    a, b, c, d = F.col("x.failed"), F.col("x.ok"), F.col("y.failed"), F.col("y.ok")
    odds = F.when(b * c > 0, a * d / (b * c).cast("double")).when(a * d > 0, F.lit(float("inf")))
    return n.select(*by, odds.alias("odds_ratio"), fisher_two_sided(a, b, c, d).alias("p"))


def chi2_rx2(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Chi-square statistic, degrees of freedom, smallest expected count and p of a strata x (failed, ok) table."""
    tot = counts.groupBy(*by).agg(F.sum("failed").alias("tf"), F.sum("ok").alias("tk"), F.count(F.lit(1)).alias("strata"))
    j = counts.join(tot, list(by)).where((F.col("tf") > 0) & (F.col("tk") > 0) & (F.col("strata") >= 2))
    row, n = F.col("failed") + F.col("ok"), F.col("tf") + F.col("tk")
    ef, ek = row * F.col("tf") / n, row * F.col("tk") / n
    g = j.groupBy(*by).agg(
        F.sum((F.col("failed") - ef) ** 2 / ef + (F.col("ok") - ek) ** 2 / ek).alias("stat"), (F.count(F.lit(1)) - 1).alias("dof"),
        F.min(F.least(ef, ek)).alias("min_expected"), F.sum(row).alias("n"))
    return g.withColumn("p", chi2_upper(F.col("stat"), F.col("dof")))


def chi2_permutation(log: DataFrame, by: Sequence[str], ident: str, stratum: str, event: Column, draws: int, seed: int) -> DataFrame:
    """Monte Carlo p with both margins kept: in every draw the rows with the smallest hashes fail, as many as failed in truth.

    Rows of a draw are counted by the leading bits of their hashes. The count says in which bucket the last failing row lies; only that bucket's rows,
    one in 2 ** HASH_BITS, are put in order, by the sliced positions.
    """
    rows = checkpointed(log.select(*by, ident, stratum, event.cast("int").alias("__e")))
    counts = rows.groupBy(*by, stratum).agg(F.sum("__e").alias("failed"), (F.count(F.lit(1)) - F.sum("__e")).alias("ok"))
    truth = chi2_rx2(counts, by).select(*by, F.col("stat").alias("observed"))
    tot = counts.groupBy(*by).agg(F.sum("failed").alias("tf"), F.sum("ok").alias("tk"))
    reps = rows.join(truth.select(*by), list(by), "left_semi").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("__h", hash_int(seed, "rep", ident))
    reps = reps.withColumn("__b", F.shiftright("__h", 4 * HASH_DIGITS - HASH_BITS))
    hist = checkpointed(reps.groupBy(*by, "rep", stratum, "__b").agg(F.count(F.lit(1)).alias("n")))
    before = W.partitionBy(*by, "rep").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)  # 2 ** HASH_BITS rows at most
    cum = hist.groupBy(*by, "rep", "__b").agg(F.sum("n").alias("__in")).withColumn("__below", F.coalesce(F.sum("__in").over(before), F.lit(0)))
    last = cum.join(tot, list(by)).where((F.col("__below") < F.col("tf")) & (F.col("__below") + F.col("__in") >= F.col("tf")))
    last = checkpointed(last.select(*by, "rep", F.col("__b").alias("__last"), (F.col("tf") - F.col("__below")).alias("__more")))  # a row per draw
    n = F.col("n")
    whole = hist.join(last, [*by, "rep"]).where(F.col("__b") != F.col("__last"))
    whole = whole.select(*by, "rep", stratum, F.when(F.col("__b") < F.col("__last"), n).otherwise(0).alias("failed"), F.when(F.col("__b") > F.col("__last"), n).otherwise(0).alias("ok"))
    cut = checkpointed(reps.join(last, [*by, "rep"]).where(F.col("__b") == F.col("__last")).select(*by, "rep", "__h", ident, stratum, "__more"))
    fails = F.col("__pos") < F.col("__more")
    part = positions(cut, [*by, "rep"], ["__h", ident], "__pos").select(*by, "rep", stratum, fails.cast("bigint").alias("failed"), (~fails).cast("bigint").alias("ok"))
    hit = whole.unionByName(part).groupBy(*by, "rep", stratum).agg(F.sum("failed").alias("failed"), F.sum("ok").alias("ok"))
    stat = chi2_rx2(hit, [*by, "rep"]).join(truth, list(by))
    g = stat.groupBy(*by).agg(F.max("observed").alias("observed"), count_if(F.col("stat") >= F.col("observed") - 1e-12).alias("hits"), F.count(F.lit(1)).alias("draws"))
    return g.withColumn("p", (F.col("hits") + 1) / (F.col("draws") + 1))


def permutation_by_counts(counts: DataFrame, by: Sequence[str], stratum: str, draws: int, seed: int, chunk: int = 1000) -> DataFrame:
    """(by, perm_p): Monte Carlo p of the strata x (failed, ok) table with both margins kept.

    Which rows fail matters only through how many of each stratum do, so the counts are drawn (hypergeometric) and no row meets a
    draw. Draws are spread over tasks in chunks; a chunk's generator is seeded by (seed, run, chunk), so a retry draws the same.
    """
    cells = counts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(stratum).cast("string").alias("s"), "failed", "ok"))).alias("cells"))
    key = F.to_json(F.struct(*by)) if by else F.lit("")
    parts = cells.select(key.alias("run"), F.col("cells.failed").alias("failed"), F.col("cells.ok").alias("ok"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(chunk))).alias("start"))
    parts = parts.repartition("run", "start")

    def task(batches):
        for b in batches:
            hits = []
            for run, failed, ok, start in zip(b["run"], b["failed"], b["ok"], b["start"]):
                rows = np.asarray(failed, np.int64) + np.asarray(ok, np.int64)
                rng = np.random.default_rng([seed, zlib.crc32(run.encode()), int(start)])
                drawn = rng.multivariate_hypergeometric(rows, int(np.sum(failed)), size=min(chunk, draws - int(start)), method="marginals")
                hits.append(int((_chi2_of(drawn, rows) >= _chi2_of(np.asarray(failed)[None], rows) - 1e-12).sum()))
            yield pd.DataFrame({"run": b["run"], "hits": hits})

    hit = parts.mapInPandas(task, "run string, hits bigint").groupBy("run").agg(((F.sum("hits") + 1) / (draws + 1.0)).alias("perm_p"))
    return cells.select(*by, key.alias("run")).join(hit, "run").drop("run")


def _chi2_of(failed: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Chi-square statistics of many (failed) x stratum tables with the same row totals."""
    share = failed.sum(1, keepdims=True) / rows.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = (failed - rows * share) ** 2 / (rows * share) + (failed - rows * share) ** 2 / (rows * (1 - share))
    return np.where(np.isfinite(terms), terms, 0.0).sum(1)


def failures_by_stratum(log: DataFrame, by: Sequence[str], stratum: str, event: Column, draws: int = 20_000, seed: int = 1) -> DataFrame:
    """Independence test of failure and stratum per run: Fisher for two strata, chi-square otherwise, Holm over all runs. Where an
    expected count is below five, ``perm_p`` holds the permutation p, as the chi-square approximation is unreliable there."""
    c = failure_counts(log, by, stratum, event)
    chi = chi2_rx2(c, by).select(*by, F.lit("chi-square").alias("test"), "n", "stat", "min_expected", "dof", "p")
    fish = fisher_2x2(c, by, stratum).select(*by, F.col("p").alias("fisher_p"), "odds_ratio")
    j = chi.join(fish, list(by), "left")
    two = F.col("fisher_p").isNotNull()
    j = j.withColumn("test", F.when(two, "fisher").otherwise(F.col("test"))).withColumn("p", F.coalesce("fisher_p", "p")).drop("fisher_p")
    thin = chi.where((F.col("min_expected") < 5)).join(fish, list(by), "left_anti").select(*by)
    perm = permutation_by_counts(c.join(thin, list(by), "left_semi"), by, stratum, draws, seed)
    j = j.join(perm, list(by), "left")
    return holm(j, [], "p", list(by))


def holm(df: DataFrame, family: Sequence[str], p: str, order: Sequence[str], out: str = "p_holm") -> DataFrame:
    """Step-down adjusted p inside a family of tests (a family is a list of tests, not of rows)."""
    fam = W.partitionBy(*family) if family else W.partitionBy(F.lit(0))
    ranked = df.withColumn("__r", F.row_number().over(fam.orderBy(p, *order))).withColumn("__m", F.count(F.lit(1)).over(fam))
    step = F.least(F.lit(1.0), (F.col("__m") - F.col("__r") + 1) * F.col(p))
    return ranked.withColumn(out, F.max(step).over(fam.orderBy("__r").rowsBetween(W.unboundedPreceding, 0))).drop("__r", "__m")


def shared_baseline_null(df: DataFrame, ident: str, a: str, b: str, draws: int, seed: int) -> DataFrame:
    """Permutation range of corr(a, b - a) when b is shuffled over the members, beside the observed value."""
    pos = positions(df.select(ident, a, b), [], [ident], "__i")
    reps = pos.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    shuffled = positions(reps.select("rep", ident, b).withColumn("__h", hash_int(seed, "rep", ident)), ["rep"], ["__h", ident], "__i")
    j = reps.select("rep", "__i", a).join(shuffled.select("rep", "__i", F.col(b).alias("__b")), ["rep", "__i"]).withColumn("__d", F.round(F.col("__b") - F.col(a), 12))
    null = spearman(j, ["rep"], a, "__d")
    q = F.percentile("rho", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    summary = null.agg(q[0].alias("lo"), q[1].alias("median"), q[2].alias("hi"), F.count(F.lit(1)).alias("draws"))
    obs = spearman(df.withColumn("__d", F.round(F.col(b) - F.col(a), 12)), [], a, "__d").select(F.col("rho").alias("observed"))
    return summary.crossJoin(F.broadcast(obs)).withColumn("inside", F.col("observed").between(F.col("lo"), F.col("hi")).cast("int"))


def halfwidth(p: Column, n: Column) -> Column:
    return 1.96 * F.sqrt(p * (1 - p) / n)


def reachable(value: Column, n: Column, digits: int) -> Column:
    """Whether some k / n shows as the value at the given number of decimals."""
    k = F.round(value * n)
    return F.exists(F.array(k - 1, k, k + 1), lambda x: F.round(x / n, digits) == F.round(value, digits))


def mann_whitney(df: DataFrame, by: Sequence[str], value: str, group: str) -> DataFrame:
    """U of group 1, two-sided normal p with tie and continuity correction, rank-biserial correlation, median difference. A key that
    lacks one of the groups has no row; p is 1 where all values are equal."""
    rows = df.where(F.col(value).isNotNull())
    h = value_counts(rows, by, value, ones=(F.col(group) == 1).cast("bigint"))
    rank = F.col("cum") - (F.col("n") - 1) / 2.0
    g = h.groupBy(*by).agg(
        F.sum("ones").alias("n1"), (F.sum("n") - F.sum("ones")).alias("n0"), F.sum(F.col("ones") * rank).alias("__r"), F.sum(F.col("n") ** 3 - F.col("n")).alias("__t")).where("n1 > 0 AND n0 > 0")
    n1, n0 = F.col("n1"), F.col("n0")
    n = n1 + n0
    u = F.col("__r") - n1 * (n1 + 1) / 2.0
    sd = F.sqrt(n1 * n0 / 12.0 * ((n + 1) - F.col("__t") / (n * (n - 1))))
    z = F.greatest(F.abs(F.col("u") - n1 * n0 / 2.0) - 0.5, F.lit(0.0)) / F.when(sd > 0, sd)
    g = g.withColumn("u", u).withColumn("p", F.least(F.lit(1.0), F.coalesce(normal_two_sided(z), F.lit(1.0))))
    g = g.withColumn("rank_biserial", 1.0 - 2.0 * F.col("u") / (n1 * n0)).drop("__r", "__t")
    med = percentiles(rows, [*by, group], value, {"m": 0.5}).groupBy(*by).agg(
        (F.max(F.when(F.col(group) == 1, F.col("m"))) - F.max(F.when(F.col(group) == 0, F.col("m")))).alias("median_difference"))
    return g.join(med, list(by)) if by else g.crossJoin(F.broadcast(med))
