"""Queries over the daily panel and the driver windows."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scorefold.functions import columns as C
from scorefold.operators import panel as P
from scorefold.operators import scores as S
from scorefold.plans.registry import query
from scorefold.sources import standins as V

HOME = 0


def daily(spark, sf):
    return P.collapse_daily(P.valid_filings(V.reports(spark, sf)))


def runs(spark, sf):
    return P.runs(daily(spark, sf))


def pairs(spark, sf):
    return P.day_pairs(runs(spark, sf))


def d2s(*names):
    return [F.col(n).cast("string").alias(n) for n in names]


@query("valid_filings", f"WITH {V.REPORTS} SELECT state, count(*) AS n, round(sum(personnel), 4) AS total FROM valid GROUP BY state")
def _(spark, sf):
    v = P.valid_filings(V.reports(spark, sf))
    return v.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("personnel"), 4).alias("total"))


@query("population_split", f"""WITH {V.REPORTS},
ev AS (SELECT * FROM daily WHERE start_year BETWEEN 2015 AND 2020 AND state <> {HOME}),
hist AS (SELECT * FROM daily WHERE (start_year < 2015 OR state = {HOME}) AND incident_id NOT IN (SELECT incident_id FROM ev))
SELECT 'evaluation' AS part, start_year, count(*) AS rows_n, count(DISTINCT incident_id) AS incidents FROM ev GROUP BY start_year
UNION ALL SELECT 'history', start_year, count(*), count(DISTINCT incident_id) FROM hist GROUP BY start_year""")
def _(spark, sf):
    ev, hist = P.population_split(daily(spark, sf), HOME)
    one = lambda d, n: d.groupBy("start_year").agg(F.count(F.lit(1)).alias("rows_n"), F.countDistinct("incident_id").alias("incidents")).withColumn("part", F.lit(n))
    return one(ev, "evaluation").unionByName(one(hist, "history"))


@query("collapse_daily", f"""WITH {V.REPORTS} SELECT incident_id, CAST(report_date AS VARCHAR) AS report_date, personnel, state, start_year, round(acres, 4) AS acres,
pct, new_acres, aerial, terrain FROM daily""")
def _(spark, sf):
    return daily(spark, sf).select("incident_id", *d2s("report_date"), "personnel", "state", "start_year", F.round("acres", 4).alias("acres"),
                                   "pct", "new_acres", "aerial", "terrain")


@query("runs", f"WITH {V.REPORTS} SELECT incident_id, CAST(report_date AS VARCHAR) AS report_date, CAST(run_start AS VARCHAR) AS run_start, day_of_run, run_length FROM runs")
def _(spark, sf):
    return runs(spark, sf).select("incident_id", *d2s("report_date", "run_start"), "day_of_run", "run_length")


@query("day_pairs", f"""WITH {V.PAIRS} SELECT analogue_id, today, next, prev, prev2, round(acres_prev, 4) AS acres_prev, pct_prev, day_of_run FROM pairs""")
def _(spark, sf):
    return pairs(spark, sf).select("analogue_id", "today", "next", "prev", "prev2", F.round("acres_prev", 4).alias("acres_prev"), "pct_prev", "day_of_run")


@query("prior_day", f"""WITH {V.REPORTS} SELECT a.incident_id, CAST(a.report_date AS VARCHAR) AS report_date, b.personnel AS one_day, c.personnel AS two_days
FROM daily a LEFT JOIN daily b ON a.incident_id = b.incident_id AND b.report_date = a.report_date - 1
LEFT JOIN daily c ON a.incident_id = c.incident_id AND c.report_date = a.report_date - 2""")
def _(spark, sf):
    d = P.prior_day(P.prior_day(daily(spark, sf), 1, out="one_day"), 2, out="two_days")
    return d.select("incident_id", *d2s("report_date"), "one_day", "two_days")


LAST4 = V.REPORTS + """, l4 AS (SELECT *, row_number() OVER w AS rn, lag(personnel, 3) OVER w AS x0, lag(personnel, 2) OVER w AS x1, lag(personnel, 1) OVER w AS x2, personnel AS x3
FROM runs WINDOW w AS (PARTITION BY incident_id, run_start ORDER BY report_date))"""


@query("last_four_days", f"""WITH {LAST4} SELECT incident_id, CAST(report_date AS VARCHAR) AS report_date, least(rn, 4) AS n,
round(coalesce(x0, 0) + coalesce(x1, 0) + coalesce(x2, 0) + x3, 6) AS total, coalesce(x0, x1, x2, x3) AS oldest FROM l4""")
def _(spark, sf):
    d = P.last_n(runs(spark, sf), "personnel")
    tot = F.aggregate("last_days", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return d.select("incident_id", *d2s("report_date"), F.size("last_days").cast("bigint").alias("n"), F.round(tot, 6).alias("total"),
                    F.element_at("last_days", 1).alias("oldest"))


@query("first_differences", f"""WITH {LAST4} SELECT incident_id, CAST(report_date AS VARCHAR) AS report_date, x0 AS p_v0, x1 AS p_v1, x2 AS p_v2, x3 AS p_v3,
round(x1 - x0, 6) AS p_d1, round(x2 - x1, 6) AS p_d2, round(x3 - x2, 6) AS p_d3 FROM l4""")
def _(spark, sf):
    d = P.first_differences(P.last_n(runs(spark, sf), "personnel"), "last_days", prefix="p")
    return d.select("incident_id", *d2s("report_date"), *[f"p_v{i}" for i in range(4)], *[F.round(f"p_d{i}", 6).alias(f"p_d{i}") for i in (1, 2, 3)])


PICKS = """picks AS (SELECT * FROM (SELECT *, least(6, run_length - 4) AS m,
  lead(personnel) OVER (PARTITION BY incident_id, run_start ORDER BY report_date) AS nxt,
  lag(personnel) OVER (PARTITION BY incident_id, run_start ORDER BY report_date) AS prv,
  lag(personnel, 2) OVER (PARTITION BY incident_id, run_start ORDER BY report_date) AS prv2,
  lag(acres) OVER (PARTITION BY incident_id, run_start ORDER BY report_date) AS acres_prv
  FROM runs WHERE run_length >= 10)
  WHERE list_contains([CAST(floor(3 + i * CASE WHEN m > 1 THEN (run_length - 5) / (m - 1)::DOUBLE ELSE 0 END) AS BIGINT) FOR i IN range(m)], day_of_run - 1))"""
ITEMS = V.REPORTS + ", " + PICKS + """,
aitems AS (SELECT 'alloc-' || incident_id || '-' || CAST(report_date AS VARCHAR) AS item_id, incident_id, state, start_year, report_date, report_date + 1 AS target_date,
 round_even(nxt, 0) AS target, round_even(personnel, 0) AS persistence, round_even(prv, 0) AS prev, round_even(prv2, 0) AS prev2, day_of_run, run_length, acres, acres_prv AS acres_prev, pct, new_acres, aerial FROM picks)"""


@query("even_picks", f"WITH {V.REPORTS}, {PICKS} SELECT incident_id, CAST(report_date AS VARCHAR) AS report_date, day_of_run, run_length FROM picks")
def _(spark, sf):
    return P.even_picks(runs(spark, sf)).select("incident_id", *d2s("report_date"), "day_of_run", "run_length")


@query("build_items", f"""WITH {ITEMS} SELECT item_id, CAST(target_date AS VARCHAR) AS target_date, target, persistence, prev, day_of_run, run_length, round(acres, 4) AS acres, round(acres_prev, 4) AS acres_prev FROM aitems""")
def _(spark, sf):
    it = P.build_items(runs(spark, sf))
    return it.select("item_id", *d2s("target_date"), "target", "persistence",
                     F.get("personnel_last_days", F.size("personnel_last_days") - 2).alias("prev"), "day_of_run", "run_length",
                     F.round("acres", 4).alias("acres"), F.round(F.get("acres_last_days", F.size("acres_last_days") - 2), 4).alias("acres_prev"))


@query("group_mean_scale", f"WITH {ITEMS} SELECT item_id, target, round(avg(target) OVER (PARTITION BY incident_id), 6) AS scale FROM aitems")
def _(spark, sf):
    it = P.group_mean_scale(P.build_items(runs(spark, sf)), "incident_id", "target")
    return it.select("item_id", "target", F.round("scale", 6).alias("scale"))


@query("persistence_by_state", f"""WITH {V.PAIRS}, s AS (SELECT *, avg(next) OVER (PARTITION BY incident_id) AS scale FROM pairs)
SELECT state, count(*) AS items, count(*) AS parsed, round(avg(abs(next - today)), 6) AS mae, round(avg(abs(next - today) / scale), 6) AS mae_scaled,
round(avg(CASE WHEN abs(next - today) / greatest(next, 1) <= 0.25 THEN 1.0 ELSE 0 END), 6) AS within_25,
round(median(abs(ln((today + 1) / (next + 1)))), 6) AS median_abs_log_ratio,
round(avg(abs(next - today) / scale) FILTER (abs(next - today) / greatest(today, 1) > 0.1), 6) AS mae_scaled_moving,
0.0::DOUBLE AS beats_persistence FROM s GROUP BY state""")
def _(spark, sf):
    p = P.group_mean_scale(pairs(spark, sf), "incident_id", "next")
    log = p.select("state", F.col("next").alias("target"), F.col("today").alias("persistence"), F.col("today").alias("prediction"), "scale")
    return S.rounded(S.regression_scores(log, ["state"]))


# --- bands and keys ---------------------------------------------------------------------------------------------------
def band_sql(x, edges):
    return f"CASE WHEN {x} IS NULL THEN 'unknown' " + " ".join(f"WHEN {x} < {e} THEN '{i}'" for i, e in enumerate(edges)) + f" ELSE '{len(edges)}' END"


KEY_SQL = " || '|' || ".join(band_sql(x, e) for x, e in (("acres", C.ACRE_EDGES), ("pct", C.PCT_EDGES)))
PERS_SQL = band_sql("today", C.PERS_EDGES)


@query("band_key", f"WITH {V.PAIRS} SELECT {KEY_SQL} || '|' || {PERS_SQL} AS key, count(*) AS n, round(avg(next / greatest(today, 1)), 6) AS mean_ratio FROM pairs GROUP BY 1")
def _(spark, sf):
    p = pairs(spark, sf).withColumn("key", C.band_key("acres", "pct", "today"))
    return p.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("next") / F.greatest("today", F.lit(1))), 6).alias("mean_ratio"))


@query("band", f"WITH {V.REPORTS} SELECT {band_sql('acres', C.ACRE_EDGES)} AS acre_band, {band_sql('pct', C.PCT_EDGES)} AS pct_band, count(*) AS n FROM reports GROUP BY ALL")
def _(spark, sf):
    r = V.reports(spark, sf)
    return r.groupBy(C.band("acres", C.ACRE_EDGES).alias("acre_band"), C.band("pct", C.PCT_EDGES).alias("pct_band")).agg(F.count(F.lit(1)).alias("n"))


# --- driver windows ---------------------------------------------------------------------------------------------------
@query("window_arrays", f"""WITH {V.DRIVER_DAYS} SELECT sample, count(*) AS n_days, CAST(min(day) AS VARCHAR) AS window_start, CAST(max(day) AS VARCHAR) AS window_end,
count(click) AS click_days, round(sum(click), 6) AS click_sum, round(arg_max(error, day) FILTER (error IS NOT NULL), 6) AS last_error FROM ddays GROUP BY sample""")
def _(spark, sf):
    w = P.window_arrays(V.driver_days(spark, sf), V.DRIVERS)
    obs = F.filter("click", lambda x: x.isNotNull())
    last = S.last_valid("error")
    return w.select("sample", F.size("click").cast("bigint").alias("n_days"), *d2s("window_start", "window_end"), F.size(obs).cast("bigint").alias("click_days"),
                    F.round(F.aggregate(obs, F.lit(0.0), lambda a, x: a + x), 6).alias("click_sum"), F.round(last["value"], 6).alias("last_error"))


@query("block_checks", f"""WITH {V.DRIVER_DAYS}, g AS (SELECT *, day - lag(day) OVER (PARTITION BY sample ORDER BY day) AS gap, sample % 4 AS cell FROM ddays)
SELECT sample, count(*) AS rows, max(CASE WHEN gap <> 1 THEN 1 ELSE 0 END) AS has_gap, CASE WHEN min(cell) <> max(cell) THEN 1 ELSE 0 END AS varies_cell,
CASE WHEN count(*) = 30 THEN 1 ELSE 0 END AS full_length FROM g GROUP BY sample""")
def _(spark, sf):
    return P.block_checks(V.driver_days(spark, sf).withColumn("cell", F.col("sample") % 4), ["cell"])
