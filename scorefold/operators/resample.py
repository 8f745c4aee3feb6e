"""Cluster bootstrap as relational work: replicates x clusters, never replicates x rows.

Per cluster only the sums a statistic needs are kept. A replicate draws cluster numbers by hash, meets the cluster sums in an
equi-join and adds them up; all statistics of a replicate share its draw, so contrasts stay paired. The index of a draw is
``md5(seed|group|rep|j) mod G``: the same table on every engine and on every retry.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorefold.functions.columns import HASH_RANGE, hash_int
from scorefold.operators.ordered import percentiles, positions, slice_count
from scorefold.operators.scores import average_precision, count_if
from scorefold.session import checkpointed

DRAW_CHUNK = 1 << 16
SMALL_SUMS = 250_000  # clusters whose sums (some 60 bytes each) are broadcast, so that draws are added up where they are made and not shuffled
Z975 = 1.959963984540054  # fixed value: normal quantile at 0.975


@dataclass(frozen=True)
class ClusterStat:
    """A bootstrap statistic: sums to keep per cluster, and formulas over the replicate's sums of the same names."""

    sums: Mapping[str, Column]
    formulas: Mapping[str, Column]


def numbered_clusters(df: DataFrame, by: Sequence[str], cluster: str) -> DataFrame:
    """(by, cluster, idx, g): clusters numbered from 0 in key order, with their count. The numbering reads its input several times, so the distinct
    clusters are written first and the plan of ``df`` occurs once, however long it is."""
    return positions(checkpointed(df.select(*by, cluster).distinct()), by, [cluster], "idx", "g")


def draw_indices(clusters: DataFrame, by: Sequence[str], reps: int, seed: int) -> DataFrame:
    """(by, rep, idx): G draws with replacement per replicate. Chunks of draws are spread over tasks before they are expanded, so no
    row and no task holds a replicate's draws, however fine the clusters are.

    Spark takes the expanded draws for as small as what they are expanded from and would broadcast them: joins with them name their method."""
    g = clusters.groupBy(*by).agg(F.max("g").alias("g"))
    r = g.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    r = r.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("g") - 1, F.lit(DRAW_CHUNK).cast("bigint"))))
    r = r.repartition(slice_count(clusters), *by, "rep", "__from")  # a given number: by their bytes the chunks would be put together in one task
    d = r.withColumn("j", F.explode(F.sequence(F.col("__from"), F.least(F.col("g"), F.col("__from") + DRAW_CHUNK) - 1)))
    return d.select(*by, "rep", F.pmod(hash_int(seed, *by, "rep", "j"), F.col("g")).alias("idx"))


def cluster_draws(df: DataFrame, by: Sequence[str], cluster: str, reps: int, seed: int) -> DataFrame:
    """(by, rep, cluster, w): how often each cluster was drawn; absent clusters have no row."""
    c = checkpointed(numbered_clusters(df, by, cluster))
    w = draw_indices(c, by, reps, seed).groupBy(*by, "rep", "idx").agg(F.count(F.lit(1)).alias("w"))
    return w.join(c.drop("g").hint("shuffle_hash"), [*by, "idx"]).select(*by, "rep", cluster, "w")


def poisson_weights(df: DataFrame, by: Sequence[str], cluster: str, reps: int, seed: int) -> DataFrame:
    """(by, rep, cluster, w) with independent Poisson(1) weights: for very many clusters, where G draws per replicate are not
    worth their shuffle. Cluster totals vary around G instead of equalling it."""
    u = hash_int(seed, *by, "rep", cluster) / F.lit(HASH_RANGE)
    cdf, term, total = [], math.exp(-1.0), 0.0
    while total + term > total:  # until the table stops growing: no weight that a double can tell is left out
        total += term
        cdf.append(total)
        term /= len(cdf)
    w = F.size(F.filter(F.array(*map(F.lit, cdf)), lambda x: x <= u))
    base = df.select(*by, cluster).distinct().withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    return base.withColumn("w", w.cast("bigint")).where("w > 0")


def cluster_sums(df: DataFrame, by: Sequence[str], cluster: str, stat: ClusterStat) -> DataFrame:
    """(by, cluster, sums..., idx, g): a statistic's sums per numbered cluster. The one pass over ``df``: replicates and point estimates start from this table."""
    per = checkpointed(df.groupBy(*by, cluster).agg(*[F.sum(x).alias(n) for n, x in stat.sums.items()]))
    return checkpointed(positions(per, by, [cluster], "idx", "g"))


def replicates(sums: DataFrame, by: Sequence[str], cluster: str, stat: ClusterStat, reps: int, seed: int) -> DataFrame:
    """(by, rep, formulas...) of every replicate over cluster_sums; a missing cluster is drawn like any other and adds nothing."""
    per = sums.where(F.col(cluster).isNotNull()).select(*by, "idx", *stat.sums)
    per = per.hint("broadcast" if sums.count() <= SMALL_SUMS else "shuffle_hash")
    s = draw_indices(sums, by, reps, seed).join(per, [*by, "idx"]).groupBy(*by, "rep").agg(*[F.sum(n).alias(n) for n in stat.sums])
    return s.select(*by, "rep", *[f.alias(n) for n, f in stat.formulas.items()])


def point_estimates(sums: DataFrame, by: Sequence[str], stat: ClusterStat) -> DataFrame:
    s = sums.groupBy(*by).agg(*[F.sum(n).alias(n) for n in stat.sums])
    return s.select(*by, *[f.alias(n) for n, f in stat.formulas.items()])


def percentile_interval(reps: DataFrame, by: Sequence[str], value: str, ci: float = 95.0) -> DataFrame:
    """Percentile interval over the finite replicates and how many were dropped (a group holds one value per replicate)."""
    a = (1 - ci / 100.0) / 2
    ok = F.col(value).isNotNull() & ~F.isnan(value)
    q = F.percentile(F.when(ok, F.col(value)), F.array(F.lit(a), F.lit(1 - a)))
    return reps.groupBy(*by).agg(q[0].alias("lo"), q[1].alias("hi"), count_if(~F.coalesce(ok, F.lit(False))).alias("dropped"))


def bootstrap(df: DataFrame, by: Sequence[str], cluster: str, stat: ClusterStat, reps: int, seed: int) -> DataFrame:
    """Long table (by, statistic, point, lo, hi, dropped) of every formula, all on the same draws."""
    names = list(stat.formulas)
    pairs = [x for n in names for x in (F.lit(n), F.col(n).cast("double"))]
    sums = cluster_sums(df, by, cluster, stat)
    r = replicates(sums, by, cluster, stat, reps, seed)
    r = r.select(*by, "rep", F.explode(F.create_map(*pairs)).alias("statistic", "v"))
    p = point_estimates(sums, by, stat).select(*by, F.explode(F.create_map(*pairs)).alias("statistic", "point"))
    return p.join(percentile_interval(r, [*by, "statistic"], "v"), [*by, "statistic"])


# --- ready statistics -------------------------------------------------------------------------------------------------
def ratio(num: Column, den: Column | None = None) -> ClusterStat:
    """Mean of a value, or ratio of two sums."""
    d = F.when(num.isNotNull(), 1) if den is None else den
    return ClusterStat({"num": num, "den": d}, {"value": F.when(F.col("den") > 0, F.col("num") / F.col("den"))})


def paired_difference(a: Column, b: Column, subset: Column | None = None) -> ClusterStat:
    """mean(b) - mean(a) on the rows of a subset; undefined in a replicate without such rows."""
    on = F.lit(True) if subset is None else subset
    keep = on & a.isNotNull() & b.isNotNull()
    sums = {"sa": F.when(keep, a.cast("double")), "sb": F.when(keep, b.cast("double")), "n": keep.cast("int")}
    return ClusterStat(sums, {"difference": F.when(F.col("n") > 0, (F.col("sb") - F.col("sa")) / F.col("n"))})


def slope_stat(x: Column, v: Column, subset: Column, name: str = "slope") -> ClusterStat:
    """Least-squares slope from moments."""
    w = lambda c: F.when(subset, c.cast("double"))
    sums = {"n": subset.cast("int"), "sx": w(x), "sv": w(v), "sxx": w(x * x), "sxv": w(x * v)}
    den = F.col("n") * F.col("sxx") - F.col("sx") ** 2
    return ClusterStat(sums, {name: F.when((F.col("n") >= 2) & (den > 1e-9), (F.col("n") * F.col("sxv") - F.col("sx") * F.col("sv")) / den)})


def bootstrap_twoway(df: DataFrame, by: Sequence[str], a: str, b: str, value: Column, reps: int, seed: int) -> DataFrame:
    """Interval of a mean when both crossed factors are resampled: cell weight = product of the two draws."""
    cells = checkpointed(df.where(value.isNotNull()).groupBy(*by, a, b).agg(F.sum(value.cast("double")).alias("s"), F.count(F.lit(1)).alias("n")))
    wa = cluster_draws(cells, by, a, reps, seed).withColumnRenamed("w", "__wa")
    wb = cluster_draws(cells, by, b, reps, seed + 1).withColumnRenamed("w", "__wb")
    j = cells.join(wa, [*by, a]).join(wb, [*by, "rep", b])
    w = F.col("__wa") * F.col("__wb")
    r = j.groupBy(*by, "rep").agg((F.sum(w * F.col("s")) / F.sum(w * F.col("n"))).alias("v"))
    spine = cells.select(*by).distinct().withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    full = spine.join(r, [*by, "rep"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))  # an empty draw counts as no difference
    p = cells.groupBy(*by).agg((F.sum("s") / F.sum("n")).alias("point"))
    return p.join(percentile_interval(full, by, "v"), list(by))


def bootstrap_ap(df: DataFrame, by: Sequence[str], cluster: str, scores: Sequence[str], label: str, reps: int, seed: int) -> DataFrame:
    """Average precision of each score column and, with two, of their difference: (by, statistic, point, lo, hi, dropped).

    Rows are merged to (cluster, score, label) counts, then weighted by the replicate's cluster counts.
    """
    keep = df
    for s in scores:
        keep = keep.where(F.col(s).isNotNull())
    keep = checkpointed(keep.select(*by, cluster, label, *scores))
    w = checkpointed(cluster_draws(keep, by, cluster, reps, seed))
    out, point = None, None
    for s in scores:
        cells = keep.groupBy(*by, cluster, F.col(s).alias("__s"), label).agg(F.count(F.lit(1)).alias("__n"))
        rep = cells.join(w, [*by, cluster]).groupBy(*by, "rep", "__s", label).agg(F.sum(F.col("__n") * F.col("w")).alias("__w"))
        ap = average_precision(rep, [*by, "rep"], "__s", label, F.col("__w"), out=f"ap_{s}").select(*by, "rep", f"ap_{s}")
        pt = average_precision(keep, by, s, label, out=f"ap_{s}").select(*by, f"ap_{s}")
        out = ap if out is None else out.join(ap, [*by, "rep"])
        point = pt if point is None else point.join(pt, list(by))
    names = [f"ap_{s}" for s in scores]
    if len(scores) == 2:
        diff = F.col(names[1]) - F.col(names[0])
        out, point, names = out.withColumn("difference", diff), point.withColumn("difference", diff), [*names, "difference"]
    pairs = [x for n in names for x in (F.lit(n), F.col(n))]
    r = out.select(*by, "rep", F.explode(F.create_map(*pairs)).alias("statistic", "v"))
    p = point.select(*by, F.explode(F.create_map(*pairs)).alias("statistic", "point"))
    return p.join(percentile_interval(r, [*by, "statistic"], "v"), [*by, "statistic"])


def bootstrap_iid_spearman(df: DataFrame, by: Sequence[str], ident: str, x: str, y: str, reps: int, seed: int) -> DataFrame:
    """Row-level bootstrap of a rank correlation: replicate weights on distinct (x, y) cells, then weighted ranks."""
    from scorefold.operators.scores import weighted_spearman

    rows = checkpointed(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, ident, x, y))
    w = cluster_draws(rows, by, ident, reps, seed)
    cells = rows.hint("shuffle_hash").join(w, [*by, ident]).groupBy(*by, "rep", x, y).agg(F.sum("w").alias("w"))
    r = weighted_spearman(checkpointed(cells), [*by, "rep"], x, y, "w")
    return percentile_interval(r, by, "rho")


def bootstrap_median_difference(df: DataFrame, by: Sequence[str], ident: str, value: str, group: Column, reps: int, seed: int) -> DataFrame:
    """Row-level bootstrap of the difference of two groups' medians (members are a handful of runs per group)."""
    rows = checkpointed(df.withColumn("__g", group.cast("int")).where(F.col("__g").isNotNull()).select(*by, ident, "__g", value))
    w = cluster_draws(rows, [*by, "__g"], ident, reps, seed)
    med = percentiles(rows.hint("shuffle_hash").join(w, [*by, "__g", ident]), [*by, "rep", "__g"], value, {"m": 0.5}, weight=F.col("w"))
    d = med.groupBy(*by, "rep").agg((F.max(F.when(F.col("__g") == 1, F.col("m"))) - F.max(F.when(F.col("__g") == 0, F.col("m")))).alias("v"))
    return percentile_interval(d, by, "v")


# --- small numbers of clusters ----------------------------------------------------------------------------------------
@lru_cache
def t_quantiles(top: int = 200) -> tuple[float, ...]:
    """0.975 quantiles of Student's t for 1 .. top degrees of freedom, by bisection on the finite series of its CDF."""

    def cdf(t: float, v: int) -> float:
        th = math.atan(t / math.sqrt(v))
        c, s = math.cos(th), math.sin(th)
        term, total = (c, c) if v % 2 else (1.0, 1.0)
        for k in range(3 if v % 2 else 2, v - 1, 2):
            term *= c * c * (k - 1) / k
            total += term
        area = (2 / math.pi) * (th + (s * total if v > 1 else 0.0)) if v % 2 else s * total
        return 0.5 + area / 2

    out = []
    for v in range(1, top + 1):
        lo, hi = 0.0, 20.0
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if cdf(mid, v) < 0.975 else (lo, mid)
        out.append((lo + hi) / 2)
    return tuple(out)


def small_g_factor(g: Column) -> Column:
    """t(G-1) / z times sqrt(G / (G-1)); beyond the table the first terms of the expansion in 1 / df."""
    q = t_quantiles()
    df = (g - 1).cast("double")
    z = Z975
    tail = z + (z**3 + z) / 4 / df + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / (df * df)
    t = F.when(g - 1 <= len(q), F.element_at(F.array(*[F.lit(x) for x in q]), F.greatest(g - 1, F.lit(1)).cast("int"))).otherwise(tail)
    return F.when(g >= 2, t / z * F.sqrt(g / (g - 1))).otherwise(1.0)


def widen_small_g(intervals: DataFrame, g: str) -> DataFrame:
    """Midpoint, point-centred and asymmetric widening of (point, lo, hi), with excludes-zero flags."""
    f = small_g_factor(F.col(g))
    half, mid, pt = (F.col("hi") - F.col("lo")) / 2, (F.col("hi") + F.col("lo")) / 2, F.col("point")
    out = intervals.withColumn("factor", f)
    out = out.withColumns({
        "lo_mid": mid - half * F.col("factor"), "hi_mid": mid + half * F.col("factor"), "lo_point": pt - half * F.col("factor"), "hi_point": pt + half * F.col("factor"),
        "lo_asym": pt - (pt - F.col("lo")) * F.col("factor"), "hi_asym": pt + (F.col("hi") - pt) * F.col("factor")})
    ex = lambda a, b: ((F.col(a) > 0) | (F.col(b) < 0)).cast("int")
    return out.withColumns({"excludes_zero": ex("lo", "hi"), "excludes_zero_mid": ex("lo_mid", "hi_mid")})


def naive_vs_cluster_width(df: DataFrame, by: Sequence[str], stat: ClusterStat, item: str, cluster: str, coarse: str, reps: int, seed: int) -> DataFrame:
    """Interval widths with items, clusters and coarse blocks as resampling units, and the width ratios."""
    def one(unit: str, n: int) -> DataFrame:
        b = bootstrap(df, by, unit, stat, reps, seed + n)
        return b.select(*by, "statistic", "point", F.lit(["item", "cluster", "coarse"][n]).alias("unit"), (F.col("hi") - F.col("lo")).alias("width"))

    u = one(item, 0).unionByName(one(cluster, 1)).unionByName(one(coarse, 2))
    w = u.groupBy(*by, "statistic").agg(F.max("point").alias("point"), *[F.max(F.when(F.col("unit") == k, F.col("width"))).alias(f"width_{k}") for k in ("item", "cluster", "coarse")])
    return w.withColumns({"cluster_over_item": F.col("width_cluster") / F.col("width_item"), "coarse_over_item": F.col("width_coarse") / F.col("width_item")})


def cluster_structure(df: DataFrame, by: Sequence[str], cluster: str) -> DataFrame:
    """Clusters, largest and mean size, share of items in clusters of several."""
    n = df.groupBy(*by, cluster).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*by).agg(
        F.count(F.lit(1)).alias("clusters"), F.max("n").alias("max_size"), F.avg("n").alias("mean_size"),
        (F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("share_in_multi"))


def verdict(lo: Column, hi: Column, ref: float | Column = 0.0) -> Column:
    return F.when(lo > ref, "above").when(hi < ref, "below").otherwise("spans")


def partial_verdict_summary(cells: DataFrame, by: Sequence[str], member: str) -> DataFrame:
    """Per cell the number of members above / below / spanning, the smallest adjusted p and who has it, and whether every
    member lies on one side. ``cells``: by, member, difference, verdict, p_adjusted."""
    v = F.col("verdict")
    return cells.groupBy(*by).agg(
        F.count(F.lit(1)).alias("members"), count_if(v == "above").alias("above"), count_if(v == "below").alias("below"), count_if(v == "spans").alias("spans"),
        F.min("difference").alias("min_difference"), F.max("difference").alias("max_difference"), F.min("p_adjusted").alias("min_p"),
        F.min_by(member, F.struct("p_adjusted", member)).alias("min_p_member"), F.bool_and(F.col("difference") < 0).cast("int").alias("all_trail"),
        F.bool_and(F.col("difference") > 0).cast("int").alias("all_lead"))
