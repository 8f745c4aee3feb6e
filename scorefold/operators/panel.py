"""Daily panels: validity, collapsing filings, runs of consecutive days, day pairs, windows of arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

FIELDS = ("personnel", "state", "start_year", "acres", "pct", "new_acres", "aerial", "terrain")
KEY = ("incident_id", "report_date")


def valid_filings(df: DataFrame) -> DataFrame:
    """Filings with a date and a positive count. Runs before the collapse: it changes which value is last."""
    return df.where(F.col("report_date").isNotNull() & (F.col("personnel") > 0))


def population_split(daily: DataFrame, home: int, lo: int = 2015, hi: int = 2020) -> tuple[DataFrame, DataFrame]:
    """(evaluation population, history): history starts earlier or is in the home state, and shares no incident."""
    evaluation = daily.where(F.col("start_year").between(lo, hi) & (F.col("state") != home))
    past = daily.where((F.col("start_year") < lo) | (F.col("state") == home))
    return evaluation, exclude_incidents(past, evaluation)


def exclude_incidents(pool: DataFrame, evaluation: DataFrame, key: str = "incident_id") -> DataFrame:
    return pool.join(evaluation.select(key).distinct(), key, "left_anti")


def collapse_daily(df: DataFrame, fields: Sequence[str] = FIELDS, order: str = "ord") -> DataFrame:
    """One row per (incident, day): the last non-null value of every column in file order.

    ``max_by`` aggregates map-side, so an incident with very many filings costs nothing extra after the shuffle.
    """
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields]
    return df.groupBy(*KEY).agg(*last)


def runs(daily: DataFrame) -> DataFrame:
    """Maximal stretches of consecutive days: run start, day within the run (from 1) and run length.

    The windows are per incident over distinct days, so a group is bounded by the calendar.
    """
    by_day = W.partitionBy("incident_id").orderBy("report_date")
    island = F.date_sub("report_date", F.row_number().over(by_day))
    run = W.partitionBy("incident_id", "__island")
    out = daily.withColumn("__island", island)
    return (
        out.withColumn("run_start", F.min("report_date").over(run))
        .withColumn("day_of_run", F.row_number().over(run.orderBy("report_date")).cast("bigint"))
        .withColumn("run_length", F.count(F.lit(1)).over(run))
        .drop("__island")
    )


def day_pairs(with_runs: DataFrame) -> DataFrame:
    """(day, next day) pairs inside runs, with the previous one or two days; a run's last day gives no pair."""
    w = W.partitionBy("incident_id", "run_start").orderBy("report_date")
    out = with_runs.select(
        F.concat(F.col("incident_id").cast("string"), F.lit("@"), F.col("report_date").cast("string")).alias("analogue_id"),
        "incident_id", "report_date", "state", "start_year",
        F.col("personnel").alias("today"),
        F.lead("personnel").over(w).alias("next"),
        F.lag("personnel").over(w).alias("prev"),
        F.lag("personnel", 2).over(w).alias("prev2"),
        "acres", F.lag("acres").over(w).alias("acres_prev"),
        "pct", F.lag("pct").over(w).alias("pct_prev"),
        "new_acres", "aerial", "day_of_run", "run_length",
    )
    return out.where(F.col("next").isNotNull())


def prior_day(daily: DataFrame, k: int, value: str = "personnel", out: str = "prior") -> DataFrame:
    """The value exactly k days before, NULL when that day was not reported."""
    w = W.partitionBy("incident_id").orderBy("report_date")
    hit = None
    for step in range(1, k + 1):  # the day k before is at most k rows back
        there = F.lag("report_date", step).over(w) == F.date_sub("report_date", k)
        v = F.lag(value, step).over(w)
        hit = F.when(there, v) if hit is None else hit.when(there, v)
    return daily.withColumn(out, hit)


def last_n(with_runs: DataFrame, value: str, n: int = 4, out: str = "last_days") -> DataFrame:
    """The last n values of the run up to the row, oldest first, nulls kept, clipped at the run start."""
    w = W.partitionBy("incident_id", "run_start").orderBy("report_date").rowsBetween(1 - n, 0)
    kept = F.collect_list(F.struct(F.col(value).alias("v"))).over(w)
    return with_runs.withColumn(out, F.transform(kept, lambda s: s["v"]))


def first_differences(df: DataFrame, arr: str, n: int = 4, prefix: str = "d") -> DataFrame:
    """Left-pad the array with nulls to n values and add its n-1 successive differences."""
    pad = F.concat(F.array_repeat(F.lit(None).cast("double"), n - F.size(arr)), F.col(arr))
    out = df.withColumn("__pad", pad)
    vals = {f"{prefix}_v{i}": F.get("__pad", F.lit(i)) for i in range(n)}
    diffs = {f"{prefix}_d{i}": F.get("__pad", F.lit(i)) - F.get("__pad", F.lit(i - 1)) for i in range(1, n)}
    return out.withColumns({**vals, **diffs}).drop("__pad")


def even_picks(with_runs: DataFrame, k: int = 6, lo: int = 3, min_len: int = 10) -> DataFrame:
    """Rows of each long run at positions trunc(linspace(lo, n-2, min(k, n-4))), distinct."""
    n = F.col("run_length")
    m = F.least(F.lit(k), n - 4)
    step = F.when(m > 1, (n - 2 - lo) / (m - 1)).otherwise(0.0)
    at = F.transform(F.sequence(F.lit(0).cast("bigint"), m - 1), lambda i: F.floor(lo + i * step))
    return with_runs.where(n >= min_len).where(F.array_contains(at, F.col("day_of_run") - 1))


def build_items(with_runs: DataFrame) -> DataFrame:
    """Evaluation items: the picked days of long runs with the rounded next-day target and the report context."""
    w = W.partitionBy("incident_id", "run_start").orderBy("report_date")
    base = last_n(last_n(with_runs, "personnel", out="personnel_last_days"), "acres", out="acres_last_days")
    base = base.withColumn("__next", F.lead("personnel").over(w)).withColumn("target_date", F.date_add("report_date", 1))
    picked = even_picks(base)
    return picked.select(
        F.concat(F.lit("alloc-"), F.col("incident_id").cast("string"), F.lit("-"), F.col("report_date").cast("string")).alias("item_id"),
        "incident_id", "state", "start_year", "report_date", "target_date",
        F.bround("__next", 0).alias("target"),
        F.bround("personnel", 0).alias("persistence"),
        "day_of_run", "run_length", "acres", "pct", "new_acres", "aerial", "terrain",
        F.transform("personnel_last_days", lambda x: F.bround(x, 0)).alias("personnel_last_days"),
        "acres_last_days",
    )


def group_mean_scale(items: DataFrame, group: str, value: str, out: str = "scale") -> DataFrame:
    """Mean target of the item's group over all items. A join to the group means, so a hot group is split by AQE."""
    return items.join(items.groupBy(group).agg(F.avg(value).alias(out)), group)


# --- fixed windows of driver series -----------------------------------------------------------------------------------
def _series(rows: str, field: str) -> Column:
    return F.transform(rows, lambda r: r[field])


def window_arrays(days: DataFrame, drivers: Sequence[str], static: Sequence[str] = ()) -> DataFrame:
    """One row per sample: an array per driver in day order, the first static value, window start and end.

    A sample holds one row per day of a fixed window, which bounds the arrays.
    """
    rows = F.array_sort(F.collect_list(F.struct("day", *drivers)))
    out = days.groupBy("sample").agg(
        rows.alias("__r"), F.min("day").alias("window_start"), F.max("day").alias("window_end"),
        *[F.min_by(s, F.when(F.col(s).isNotNull(), F.col("day"))).alias(s) for s in static],
    )
    return out.withColumns({d: _series("__r", d) for d in drivers}).drop("__r")


def block_checks(days: DataFrame, constant: Sequence[str] = (), expected: int = 30) -> DataFrame:
    """Per sample: rows, whether all day gaps are one, whether the constant columns are constant, full length."""
    w = W.partitionBy("sample").orderBy("day")
    gap = F.datediff("day", F.lag("day").over(w))
    g = days.withColumn("__gap", gap).groupBy("sample").agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(F.coalesce((F.col("__gap") != 1).cast("int"), F.lit(0))).alias("has_gap"),
        *[(F.min(x) != F.max(x)).cast("int").alias(f"varies_{x}") for x in constant],
    )
    return g.withColumn("full_length", (F.col("rows") == expected).cast("int"))
