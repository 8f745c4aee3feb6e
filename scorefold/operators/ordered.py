"""Order-dependent operators that stay parallel inside one group.

A plain ``Window.partitionBy(key).orderBy(...)`` sends a whole group to one task, which is fine when the group has a
proven bound (the days of one incident) and fatal when one key holds a third of the rows. The functions below cut a
group into ordered slices first:

1. *boundaries*: per large group, the order values with the smallest hash, as many as its share of the rows asks for. This
   is a uniform sample that does not depend on partitioning or on retries, and Spark trims it before the shuffle (window
   group limit). Groups below a fair share of one task are left whole;
2. a row's slice is the number of boundaries below its order value;
3. windows run inside (group, slice); what crosses slices (a total, an edge row) is one aggregate row per slice.

The input is read once per step, so a costly one is written to the checkpoint folder first: the functions that build
distinct-value counts do that themselves, and a table scan needs no such copy.

Every function expects the order value to be unique inside its group: add an id as the last order column, or aggregate
to distinct values first. Order columns ascend; pass ``0 - col`` to descend.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scorefold.session import checkpointed

SLICES = None  # as many slices as the session has shuffle partitions, see slice_count
MAX_SLICES = 999  # Spark trims ranks below 1000 before the shuffle
SMALL_GROUP = 10_000  # rows that one task orders without help

_O, _B, _K = "__order", "__bounds", "__slice"


def slice_count(df: DataFrame, slices: int | None = SLICES) -> int:
    """Slices per group: the given number, else the session's shuffle partitions, so that a hot group spreads over the
    whole cluster."""
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if slices is None else slices
    return min(wanted, MAX_SLICES)


def _cols(order: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _order_struct(order: Sequence[Column | str]) -> Column:
    return F.struct(*[c.alias(f"o{i}") for i, c in enumerate(_cols(order))])


def _grouped(by: Sequence[str]):
    return W.partitionBy(*by) if by else W.partitionBy(F.lit(0))


def sliced(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], slices: int | None = SLICES, salt: int = 0) -> DataFrame:
    """Add ``__order`` (the order struct) and ``__slice`` (0 .. slices-1), slices being contiguous in the order; another ``salt``
    draws other boundaries."""
    by, slices = list(by), slice_count(df, slices)
    base = df.withColumn(_O, _order_struct(order))
    if slices <= 1:
        return base.withColumn(_K, F.lit(0))
    rows, quota, spread = base.select(*by, _O), F.lit(slices), W.orderBy(F.xxhash64(F.lit(salt), _O), F.col(_O))
    if by:
        rows, quota, spread = rows.join(F.broadcast(_large_groups(base, by, slices)), by), F.col("__k"), W.partitionBy(*by).orderBy(F.xxhash64(F.lit(salt), _O), F.col(_O))
    picked = rows.withColumn("__n", F.row_number().over(spread)).where(F.col("__n") < slices).where(F.col("__n") < quota)
    bounds = picked.groupBy(*by).agg(F.sort_array(F.collect_list(_O)).alias(_B))
    # two-level look-up: every stride-th boundary first, then the boundaries of that block
    stride = math.isqrt(slices) + 1
    heads = F.filter(_B, lambda b, i: F.pmod(i, F.lit(stride)) == 0)
    below = lambda arr: F.size(F.filter(arr, lambda b: b < F.col(_O)))
    block = below(F.col("__heads"))
    cut = F.when(block > 0, (block - 1) * stride + below(F.slice(_B, F.greatest(block - 1, F.lit(0)) * stride + 1, stride))).otherwise(0)
    bounds = F.broadcast(bounds.withColumn("__heads", heads))  # at most two boundaries per slice of the whole table
    joined = base.join(bounds, by, "left") if by else base.crossJoin(bounds)
    return joined.withColumn(_K, cut).drop(_B, "__heads")


def _large_groups(df: DataFrame, by: list[str], slices: int) -> DataFrame:
    """(by, __k): groups above a fair share of the table, with slices in proportion to their size.

    A group below a fair share of one task needs no slicing. At most ``slices`` groups are larger, and their slices add up to
    at most twice that number, so this table and the boundaries are small whatever the data.
    """
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    total = n.agg(F.sum("__n").alias("__t"))
    big = n.crossJoin(F.broadcast(total)).where((F.col("__n") > SMALL_GROUP) & (F.col("__n") * slices > F.col("__t")))
    return big.select(*by, F.ceil(F.col("__n") * slices / F.col("__t")).alias("__k"))


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column | str],
    sums: Mapping[str, Column],
    slices: int | None = SLICES,
    totals: bool = False,
) -> DataFrame:
    """Inclusive running sums per group in the given order; ``totals`` also adds ``<name>_total`` per group.

    With ``slices=1`` this is one plain window, for groups whose size is bounded.
    """
    by, names, slices = list(by), list(sums), slice_count(df, slices)
    base = df.withColumns({f"__v_{n}": c for n, c in sums.items()})
    if slices <= 1:
        w = _grouped(by).orderBy(*_cols(order)).rowsBetween(W.unboundedPreceding, 0)
        out = base.withColumns({n: F.sum(f"__v_{n}").over(w) for n in names})
        if totals:
            out = out.withColumns({f"{n}_total": F.sum(f"__v_{n}").over(_grouped(by)) for n in names})
        return out.drop(*[f"__v_{n}" for n in names])
    cut = sliced(base, by, order, slices)
    per_slice = cut.groupBy(*by, _K).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in names])
    before = _grouped(by).orderBy(_K).rowsBetween(W.unboundedPreceding, -1)
    carried = per_slice.select(
        *by,
        _K,
        *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__s_{n}") for n in names],
        *([F.sum(f"__t_{n}").over(_grouped(by)).alias(f"{n}_total") for n in names] if totals else []),
    )
    inside = W.partitionBy(*by, _K).orderBy(_O).rowsBetween(W.unboundedPreceding, 0)
    out = cut.withColumns({f"__l_{n}": F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0)) for n in names})
    out = out.join(carried, by + [_K])
    out = out.withColumns({n: F.col(f"__s_{n}") + F.col(f"__l_{n}") for n in names})
    return out.drop(_O, _K, *[f"{p}{n}" for n in names for p in ("__v_", "__s_", "__l_")])


def positions(
    df: DataFrame, by: Sequence[str], order: Sequence[Column | str], pos: str = "pos", size: str | None = None,
    slices: int | None = SLICES,
) -> DataFrame:
    """0-based position of each row in its group's order, and optionally the group's size."""
    out = running(df, by, order, {"__rank1": F.lit(1).cast("bigint")}, slices, totals=size is not None)
    out = out.withColumn(pos, F.col("__rank1") - 1).drop("__rank1")
    return out.withColumnRenamed("__rank1_total", size) if size is not None else out


def table_positions(df: DataFrame, order: Sequence[Column | str], pos: str = "pos") -> DataFrame:
    """0-based position of each row in the order of the whole table: one range shuffle and one sort per part, written before the parts' sizes are added up, so
    that a retry finds the same parts."""
    parts = slice_count(df)
    cut = df.repartitionByRange(parts, *_cols(order)).sortWithinPartitions(*_cols(order))
    cut = checkpointed(cut.withColumn("__id", F.monotonically_increasing_id()))  # the part's number above 33 bits of the row's number in it
    cut = cut.withColumns({"__part": F.shiftright("__id", 33), "__in": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = cut.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return cut.join(F.broadcast(starts), "__part").withColumn(pos, F.col("__start") + F.col("__in")).drop("__id", "__part", "__in", "__start")


def neighbour(
    df: DataFrame, by: Sequence[str], order: Sequence[Column | str], payload: Mapping[str, Column], ahead: bool = False,
    slices: int | None = SLICES,
) -> DataFrame:
    """``lag`` (or ``lead`` with ``ahead``) by one row inside the group: adds each payload column of the adjacent row."""
    by, slices = list(by), slice_count(df, slices)
    shift = F.lead if ahead else F.lag
    base = df.withColumn("__pl", F.struct(*[c.alias(n) for n, c in payload.items()]))
    if slices <= 1:
        out = base.withColumn("__nb", shift("__pl").over(_grouped(by).orderBy(*_cols(order))))
    else:
        cut = sliced(base, by, order, slices)
        edge = (F.min_by if ahead else F.max_by)("__pl", _O).alias("__edge")
        edges = cut.groupBy(*by, _K).agg(edge)
        edges = edges.select(*by, _K, shift("__edge").over(_grouped(by).orderBy(_K)).alias("__far"))
        near = shift("__pl").over(W.partitionBy(*by, _K).orderBy(_O))
        out = cut.withColumn("__near", near).join(edges, by + [_K])
        out = out.withColumn("__nb", F.coalesce("__near", "__far")).drop(_O, _K, "__near", "__far")
    return out.withColumns({n: F.col(f"__nb.{n}") for n in payload}).drop("__pl", "__nb")


def carried(
    df: DataFrame, by: Sequence[str], order: Sequence[Column | str], value: Column, out: str, backward: bool = False,
    slices: int | None = SLICES,
) -> DataFrame:
    """Last non-null ``value`` at or before each row (``backward``: first non-null at or after it)."""
    by, slices = list(by), slice_count(df, slices)
    pick = F.first if backward else F.last
    span = (0, W.unboundedFollowing) if backward else (W.unboundedPreceding, 0)
    far_span = (1, W.unboundedFollowing) if backward else (W.unboundedPreceding, -1)
    base = df.withColumn("__cv", value)
    if slices <= 1:
        w = _grouped(by).orderBy(*_cols(order)).rowsBetween(*span)
        return base.withColumn(out, pick("__cv", ignorenulls=True).over(w)).drop("__cv")
    cut = sliced(base, by, order, slices)
    present = F.when(F.col("__cv").isNotNull(), F.col(_O))
    edges = cut.groupBy(*by, _K).agg((F.min_by if backward else F.max_by)("__cv", present).alias("__e"))
    edges = edges.select(
        *by, _K, pick("__e", ignorenulls=True).over(_grouped(by).orderBy(_K).rowsBetween(*far_span)).alias("__far")
    )
    near = pick("__cv", ignorenulls=True).over(W.partitionBy(*by, _K).orderBy(_O).rowsBetween(*span))
    res = cut.withColumn("__near", near).join(edges, by + [_K])
    return res.withColumn(out, F.coalesce("__near", "__far")).drop(_O, _K, "__near", "__far", "__cv")


def neighbours_both(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], value: Column, before: str, after: str, slices: int | None = SLICES) -> DataFrame:
    """Last non-null ``value`` at or before, and first at or after, each row - one slicing for both directions."""
    by = list(by)
    cut = sliced(df.withColumn("__cv", value), by, order, slices)
    present = F.when(F.col("__cv").isNotNull(), F.col(_O))
    edges = cut.groupBy(*by, _K).agg(F.max_by("__cv", present).alias("__e0"), F.min_by("__cv", present).alias("__e1"))
    over = _grouped(by).orderBy(_K)
    edges = edges.select(
        *by, _K,
        F.last("__e0", ignorenulls=True).over(over.rowsBetween(W.unboundedPreceding, -1)).alias("__f0"),
        F.first("__e1", ignorenulls=True).over(over.rowsBetween(1, W.unboundedFollowing)).alias("__f1"),
    )
    inside = W.partitionBy(*by, _K).orderBy(_O)
    res = cut.withColumns({
        "__n0": F.last("__cv", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0)),
        "__n1": F.first("__cv", ignorenulls=True).over(inside.rowsBetween(0, W.unboundedFollowing)),
    }).join(edges, by + [_K])
    res = res.withColumns({before: F.coalesce("__n0", "__f0"), after: F.coalesce("__n1", "__f1")})
    return res.drop(_O, _K, "__cv", "__n0", "__n1", "__f0", "__f1")


def asof_sum(
    probe: DataFrame, hist: DataFrame, by: Sequence[str], probe_at: str, hist_at: str, value: str, out: str, probe_id: Sequence[str],
    slices: int | None = SLICES,
) -> DataFrame:
    """For every probe row, the sum of ``hist.value`` in its group strictly before ``probe_at`` - no pairs are formed.

    Both sides are stacked and summed in one ordered pass, so the cost is linear in their total size.
    """
    by = list(by)
    h = hist.select(*by, F.col(hist_at).alias("__at"), F.lit(1).alias("__side"), F.col(value).cast("bigint").alias("__w"))
    h = h.groupBy(*by, "__at", "__side").agg(F.sum("__w").alias("__w"))
    p = probe.withColumns({"__at": F.col(probe_at), "__side": F.lit(0), "__w": F.lit(0).cast("bigint")})
    both = checkpointed(p.unionByName(h, allowMissingColumns=True))
    summed = running(both, by, ["__at", "__side", *probe_id], {out: F.col("__w")}, slices)
    return summed.where(F.col("__side") == 0).drop("__at", "__side", "__w")


def value_counts(df: DataFrame, by: Sequence[str], value: str, slices: int | None = SLICES, weight: Column | None = None, **sums: Column) -> DataFrame:
    """Distinct values per group with counts ``n`` (or sums of whole weights, and extra sums), running counts ``cum`` / ``cum_<sum>`` and totals."""
    by = list(by)
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    hist = checkpointed(df.groupBy(*by, value).agg(n.alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()]))
    return running(
        hist, by, [value], {"cum": F.col("n"), **{f"cum_{k}": F.col(k) for k in sums}}, slices, totals=True
    )


def percentiles(
    df: DataFrame, by: Sequence[str], value: str, wanted: Mapping[str, float], slices: int | None = SLICES, weight: Column | None = None
) -> DataFrame:
    """Exact linearly interpolated percentiles per group from distinct-value counts: no group meets one task. A row of whole ``weight`` w counts as w rows."""
    by = list(by)
    hist = value_counts(df.where(F.col(value).isNotNull()), by, value, slices, weight)
    at = {k: F.lit(float(p)) * (F.col("cum_total") - 1) for k, p in wanted.items()}
    parts = []
    for k, idx in at.items():
        parts.append(F.min(F.when(F.col("cum") > F.floor(idx), F.col(value))).alias(f"__lo_{k}"))
        parts.append(F.min(F.when(F.col("cum") > F.ceil(idx), F.col(value))).alias(f"__hi_{k}"))
        parts.append(F.max(idx - F.floor(idx)).alias(f"__f_{k}"))
    agg = hist.groupBy(*by).agg(*parts)
    return agg.select(
        *by,
        *[
            (F.col(f"__lo_{k}") + (F.col(f"__hi_{k}") - F.col(f"__lo_{k}")) * F.col(f"__f_{k}")).alias(k)
            for k in wanted
        ],
    )


def top_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int | Column, rank: str = "rk", keep: int | None = None) -> DataFrame:
    """First ``k`` rows per group. With a literal ``k`` Spark cuts each map task to ``k`` rows before the shuffle;
    ``keep`` gives that literal bound when ``k`` itself is a per-row quota."""
    w = W.partitionBy(*by).orderBy(*order) if by else W.orderBy(*order)
    out = df.withColumn(rank, F.row_number().over(w))
    if keep is not None:
        out = out.where(F.col(rank) <= keep)
    return out.where(F.col(rank) <= k)


def average_ranks(df: DataFrame, by: Sequence[str], value: str, rank: str = "avg_rank", slices: int | None = SLICES) -> DataFrame:
    """(by, value, n, avg_rank): ranks with ties averaged, one row per distinct value."""
    h = value_counts(df, by, value, slices)
    return h.select(*by, value, "n", (F.col("cum") - (F.col("n") - 1) / 2.0).alias(rank), F.col("cum_total").alias("size"))
