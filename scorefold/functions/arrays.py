"""Array columns: series summaries, anomalies, report features, change classes, frame statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorefold.functions.columns import c


def observed(arr: Column | str) -> Column:
    return F.filter(c(arr), lambda x: x.isNotNull())


def observed_days(arr: Column | str) -> Column:
    return F.size(observed(arr)).cast("bigint")


def array_mean(arr: Column) -> Column:
    return F.when(F.size(arr) > 0, F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / F.size(arr))


def series_summary(arr: Column | str, k: int = 6) -> Column:
    """Struct (last, mean, low, high, n) over the observed days; ``last`` holds the last k entries of the window."""
    o = observed(arr)
    return F.struct(
        F.slice(c(arr), F.greatest(F.size(c(arr)) - k + 1, F.lit(1)), k).alias("last"), array_mean(o).alias("mean"),
        F.array_min(o).alias("low"), F.array_max(o).alias("high"), F.size(o).cast("bigint").alias("n"),
    )


def anomaly(last: Column | str, mean: Column | str, sd: Column | str) -> Column:
    return F.when(c(sd) > 0, (c(last) - c(mean)) / c(sd))


def report_features(today: str = "today", prev: str = "prev", acres: str = "acres", pct: str = "pct", day: str = "day_of_run",
                    new: str = "new_acres", aerial: str = "aerial") -> dict[str, Column]:
    """Seven report-day quantities: logs of count, area, day, change, new area and aircraft, clipped containment."""
    one, zero = F.lit(1.0), F.lit(0.0)
    return {
        "f_pers": F.log(F.greatest(c(today), one)),
        "f_acres": F.when(c(acres).isNotNull(), F.log1p(F.greatest(c(acres), zero))),
        "f_pct": F.when(c(pct).isNotNull(), F.least(F.greatest(c(pct), zero), F.lit(100.0))),
        "f_day": F.log(F.greatest(c(day), F.lit(1)).cast("double")),
        "f_change": F.when(c(prev).isNotNull(), F.log(F.greatest(c(today), one) / F.greatest(c(prev), one))),
        "f_new": F.when(c(new).isNotNull(), F.log1p(F.greatest(c(new), zero))),
        "f_aerial": F.when(c(aerial).isNotNull(), F.log1p(F.greatest(c(aerial), zero))),
    }


RC_CLIP = 1.5  # fixed value: bound of the log ratio to the previous day


def lin_features(today: str = "today", prev: str = "prev", acres: str = "acres", pct: str = "pct", day: str = "day_of_run",
                 new: str = "new_acres", aerial: str = "aerial") -> dict[str, Column]:
    """Seventeen-column design: logs, clipped change, missing indicators and one-hot containment bands."""
    from scorefold.functions.columns import PCT_EDGES, band

    change = F.log(F.greatest(c(today), F.lit(1.0)) / F.greatest(c(prev), F.lit(1.0)))  # greatest skips nulls: guard prev
    rc = F.when(c(prev).isNotNull(), F.greatest(F.lit(-RC_CLIP), F.least(F.lit(RC_CLIP), change))).otherwise(0.0)
    log1 = lambda x: F.when(c(x) >= 0, F.log1p(c(x))).otherwise(0.0)
    miss = lambda x: c(x).isNull().cast("double")
    out = {
        "log_personnel": F.log(F.greatest(c(today), F.lit(1.0))), "log_day_of_run": F.log(F.greatest(c(day), F.lit(1)).cast("double")),
        "recent_change": rc, "abs_recent_change": F.abs(rc), "flat_yesterday": (rc == 0).cast("double"),
        "log1p_new_acres": log1(new), "new_acres_missing": miss(new), "log1p_acres": log1(acres), "acres_missing": miss(acres),
        "log1p_aerial": log1(aerial), "aerial_missing": miss(aerial),
    }
    b = band(pct, PCT_EDGES)
    for i in range(len(PCT_EDGES) + 1):
        out[f"pct_band_{i}"] = (b == str(i)).cast("double")
    out["pct_missing"] = (b == "unknown").cast("double")
    return out


def tree_features(today: str = "today", prev: str = "prev", acres: str = "acres", pct: str = "pct", day: str = "day_of_run",
                  new: str = "new_acres", aerial: str = "aerial") -> dict[str, Column]:
    """Eight-column design of the boosted move model: logs, containment and clipped change, NULL where missing."""
    lin = lin_features(today, prev, acres, pct, day, new, aerial)
    log1 = lambda x: F.when(c(x) >= 0, F.log1p(c(x)))
    known = lambda n: F.when(c(prev).isNotNull(), lin[n])
    return {
        "t_personnel": lin["log_personnel"], "t_pct": F.when(~F.isnan(c(pct).cast("double")), c(pct).cast("double")), "t_day_of_run": lin["log_day_of_run"],
        "t_change": known("recent_change"), "t_abs_change": known("abs_recent_change"), "t_new_acres": log1(new), "t_acres": log1(acres), "t_aerial": log1(aerial),
    }


HOLD, BIG = 0.10, 0.25  # fixed values: held within a tenth, large beyond a quarter


def change_class(ratio: Column | str, ways: int = 3) -> Column:
    """``u`` unknown, ``f`` fell, ``h`` held, ``r`` rose; five-way adds ``F`` / ``R`` beyond a quarter."""
    r = c(ratio)
    out = F.when(r.isNull(), "u")
    if ways == 5:
        out = out.when(r < 1 - BIG, "F").when(r < 1 - HOLD, "f").when(r > 1 + BIG, "R").when(r > 1 + HOLD, "r")
    else:
        out = out.when(r < 1 - HOLD, "f").when(r > 1 + HOLD, "r")
    return out.otherwise("h")


def ratio(today: Column | str, prev: Column | str) -> Column:
    return F.when(c(prev).isNotNull(), c(today) / F.greatest(c(prev), F.lit(1.0)))


def exact_class(today: Column | str, prev: Column | str, ways: int = 3) -> Column:
    """Change class with the held class split into exactly equal (``e``) and slightly changed (``s``)."""
    base = change_class(ratio(today, prev), ways)
    return F.when(c(prev).isNull(), "u").when(c(today) == c(prev), "e").when(base == "h", "s").otherwise(base)


def streak_class(today: Column | str, prev: Column | str, prev2: Column | str, ways: int = 3) -> Column:
    """Exact class with a two-day exact hold marked ``ee``."""
    base = exact_class(today, prev, ways)
    return F.when((base == "e") & F.coalesce(c(prev2) == c(today), F.lit(False)), "ee").otherwise(base)


def grew(acres: Column | str, acres_prev: Column | str, new_acres: Column | str) -> Column:
    """``y`` / ``n`` / ``u``: did the area grow over the last day."""
    a = F.when(c(acres).isNotNull() & c(acres_prev).isNotNull(), c(acres) > c(acres_prev)).otherwise(c(new_acres) > 0)
    return F.when(a.isNull(), "u").when(a, "y").otherwise("n")


# --- frames -----------------------------------------------------------------------------------------------------------
def frame_saturation(arr: Column | str, band: float) -> Column:
    """Struct (high, low, at_high, band_below): extremes, elements at the maximum and in the band just below it."""
    a, hi = c(arr), F.array_max(c(arr))
    return F.struct(
        hi.alias("high"), F.array_min(a).alias("low"), F.size(F.filter(a, lambda x: x == hi)).cast("bigint").alias("at_high"),
        F.size(F.filter(a, lambda x: (x >= hi - 1.5 * band) & (x < hi - 0.5 * band))).cast("bigint").alias("band_below"),
    )


def array_diff_stats(a: Column | str, ref: Column | str, width: int, block: int, cut: float) -> Column:
    """Struct (mean_abs, share_over, block_max): mean absolute difference, share above the cut, largest block mean of a
    row-major frame of the given width, blocks of ``block`` x ``block``."""
    d = F.zip_with(c(a), c(ref), lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    per_row = width // block
    blocks = F.sequence(F.lit(0), (F.size(d) / (block * block)).cast("int") - 1)

    def block_mean(b: Column) -> Column:
        def cell(i: Column) -> Column:
            row = F.floor(b / per_row) * block + F.floor(i / block)
            return F.get(d, (row * width + F.pmod(b, F.lit(per_row)) * block + F.pmod(i, F.lit(block))).cast("int"))

        idx = F.sequence(F.lit(0), F.lit(block * block - 1))
        return F.aggregate(idx, F.lit(0.0), lambda acc, i: acc + cell(i)) / float(block * block)

    over = F.size(F.filter(d, lambda x: x > cut)) / F.size(d)
    return F.struct(array_mean(d).alias("mean_abs"), over.alias("share_over"), F.array_max(F.transform(blocks, block_mean)).alias("block_max"))
