"""Queries over the event records."""

from pyspark.sql import functions as F

from scorefold.operators import facts as T
from scorefold.plans.registry import ORACLES, QUERIES, query
from scorefold.sources import standins as V

R = V.RECORDS
SPANS5 = [(1995, 1999), (1997, 2001)]
SPANS3 = [(1997, 1999), (1999, 2001)]
SEASON_SQL = "CASE WHEN md BETWEEN 301 AND 531 THEN 'spring' WHEN md BETWEEN 601 AND 831 THEN 'summer' WHEN md BETWEEN 901 AND 1130 THEN 'autumn' END"
SEASONED = R + f", seasoned AS (SELECT *, {SEASON_SQL} AS season FROM (SELECT *, month(discovered) * 100 + day(discovered) AS md FROM records))"


def spans_sql(spans):
    return "(" + " UNION ALL ".join(f"SELECT {a}::INTEGER AS lo, {b}::INTEGER AS hi" for a, b in spans) + ")"


@query("count_state_year", f"WITH {R} SELECT state, year, count(*) AS n FROM records GROUP BY ALL")
def _(spark, sf):
    return T.cell_counts(V.records(spark, sf), ["state", "year"])


@query("count_cause_state_year", f"WITH {R} SELECT state, year, cause, count(*) AS n FROM records GROUP BY ALL")
def _(spark, sf):
    return T.cell_counts(V.records(spark, sf), ["state", "year", "cause"])


@query("count_county_year", f"""WITH {R}, ok AS (SELECT state FROM records GROUP BY state HAVING avg(CASE WHEN county IS NOT NULL THEN 1.0 ELSE 0 END) >= 0.95)
SELECT state, county, year, count(*) AS n FROM records WHERE county IS NOT NULL AND state IN (SELECT state FROM ok) GROUP BY ALL""")
def _(spark, sf):
    return T.count_county_year(V.records(spark, sf))


@query("count_season_window", f"WITH {SEASONED} SELECT state, year, season, count(*) AS n FROM seasoned WHERE season IS NOT NULL GROUP BY ALL")
def _(spark, sf):
    return T.count_season(V.records(spark, sf))


@query("season_bounds", f"""WITH {R}, y AS (SELECT DISTINCT year FROM records)
SELECT year, s.season, CAST(dayofyear(make_date(year, m1, 1)) AS INTEGER) AS lo, CAST(dayofyear(make_date(year, m2, d2)) AS INTEGER) AS hi
FROM y CROSS JOIN (VALUES ('spring', 3, 5, 31), ('summer', 6, 8, 31), ('autumn', 9, 11, 30)) s(season, m1, m2, d2)""")
def _(spark, sf):
    return T.season_table(V.records(spark, sf).select("year").distinct())


@query("acres_state_year", f"WITH {R} SELECT state, year, round(sum(size), 1) AS total FROM records GROUP BY ALL")
def _(spark, sf):
    return T.totals(V.records(spark, sf), ["state", "year"], "size")


@query("count_size_class_span", f"WITH {R} SELECT state, size_class, lo, hi, count(*) AS n FROM records JOIN {spans_sql(SPANS5)} ON year BETWEEN lo AND hi GROUP BY ALL")
def _(spark, sf):
    return T.count_size_class_span(V.records(spark, sf), SPANS5)


@query("group_max_rows", f"""WITH {R}, m AS (SELECT state, year, size_class, max(doy) AS doy FROM records GROUP BY ALL)
SELECT record_id, r.state, r.year, r.size_class, r.doy, count(*) OVER (PARTITION BY r.state, r.year, r.size_class) AS n_at_max
FROM records r JOIN m ON r.state = m.state AND r.year = m.year AND r.size_class = m.size_class AND r.doy = m.doy""")
def _(spark, sf):
    return T.group_max_rows(V.records(spark, sf), ["state", "year", "size_class"], "doy").select("record_id", "state", "year", "size_class", "doy", "n_at_max")


@query("largest_fire_name", f"""WITH {R}, r AS (SELECT *, rank() OVER (PARTITION BY state, year ORDER BY size DESC) AS rk,
count(*) OVER (PARTITION BY state, year, size) AS ties FROM records)
SELECT state, year, name, size, ties AS n_at_max FROM r WHERE rk = 1 AND ties = 1 AND trim(name) <> '' AND size >= 450000""")
def _(spark, sf):
    return T.largest_named(V.records(spark, sf), ["state", "year"], "size", "name", "record_id", 450000)


@query("largest_fire_size_span", f"""WITH {SEASONED} SELECT state, season, lo, hi, max(size) AS size FROM seasoned JOIN {spans_sql(SPANS3)} ON year BETWEEN lo AND hi
WHERE season IS NOT NULL GROUP BY ALL HAVING max(size) >= 490000""")
def _(spark, sf):
    return T.largest_in_season_span(V.records(spark, sf), SPANS3, 490000)


def argmax_sql(src, keys, ans, margin, total=0, members=2):
    k = ", ".join(keys)
    return f"""c AS (SELECT {k}, {ans}, count(*) AS n FROM {src} GROUP BY ALL),
g AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY n DESC, {ans}) AS rk, lead(n) OVER (PARTITION BY {k} ORDER BY n DESC, {ans}) AS second,
 CAST(sum(n) OVER (PARTITION BY {k}) AS BIGINT) AS total, count(*) OVER (PARTITION BY {k}) AS members FROM c),
best AS (SELECT {k}, {ans}, n, second, total, members, n / second::DOUBLE AS lead FROM g WHERE rk = 1 AND total >= {total} AND members >= {members} AND n >= {margin} * second)"""


@query("top_cause_state_year", f"WITH {R}, {argmax_sql('records', ['state', 'year'], 'cause', 1.1)} SELECT state, year, cause, n, second, round(lead, 6) AS lead FROM best WHERE cause <> '5-LOW'")
def _(spark, sf):
    b = T.argmax_with_margin(T.cell_counts(V.records(spark, sf), ["state", "year", "cause"]), ["state", "year"], "cause", 1.1)
    return b.where(F.col("cause") != "5-LOW").select("state", "year", "cause", "n", "second", F.round("lead", 6).alias("lead"))


@query("human_share_state_year", f"WITH {R} SELECT state, year, count(*) AS n, round(100.0::DOUBLE * sum(CASE WHEN size_class = 'F' THEN 1 ELSE 0 END) / count(*), 2) AS share FROM records GROUP BY ALL")
def _(spark, sf):
    return T.share_of(V.records(spark, sf), ["state", "year"], F.col("size_class") == "F")


@query("peak_year_state", f"WITH {R}, sp AS (SELECT * FROM records JOIN {spans_sql(SPANS5)} ON year BETWEEN lo AND hi), {argmax_sql('sp', ['state', 'lo', 'hi'], 'year', 1.02, 100, 5)} SELECT state, lo, hi, year, n, round(lead, 6) AS lead FROM best")
def _(spark, sf):
    cells = T.by_span(T.cell_counts(V.records(spark, sf), ["state", "year"]), SPANS5)
    return T.argmax_with_margin(cells, ["state", "lo", "hi"], "year", 1.02, 100, 5).select("state", "lo", "hi", "year", "n", F.round("lead", 6).alias("lead"))


@query("top_state_for_cause", f"WITH {R}, {argmax_sql('records', ['cause', 'year'], 'state', 1.02, 100, 5)} SELECT cause, year, state, n, second, round(lead, 6) AS lead FROM best")
def _(spark, sf):
    cells = T.cell_counts(V.records(spark, sf), ["cause", "year", "state"])
    return T.argmax_with_margin(cells, ["cause", "year"], "state", 1.02, 100, 5).select("cause", "year", "state", "n", "second", F.round("lead", 6).alias("lead"))


@query("answer_concentration", f"WITH {R}, {argmax_sql('records', ['state', 'year'], 'cause', 1.0)} SELECT cause, count(*) AS groups, round(count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS share FROM best GROUP BY cause")
def _(spark, sf):
    b = T.argmax_with_margin(T.cell_counts(V.records(spark, sf), ["state", "year", "cause"]), ["state", "year"], "cause", 1.0)
    return T.answer_concentration(b, "cause").withColumn("share", F.round("share", 6))


AMBIG = R + """, two AS (SELECT *, CAST(year + CASE WHEN record_id % 4001 = 7 THEN 1 ELSE 0 END AS INTEGER) AS year_b FROM records),
bad AS (SELECT state, year FROM two WHERE year <> year_b UNION SELECT state, year_b FROM two WHERE year <> year_b)"""


def two_years(spark, sf):
    return V.records(spark, sf).withColumn("year_b", F.col("year") + F.when(F.col("record_id") % 4001 == 7, 1).otherwise(0))


@query("exclude_ambiguous_cells", f"WITH {AMBIG} SELECT state, year, count(*) AS n FROM two WHERE (state, year) NOT IN (SELECT state, year FROM bad) GROUP BY ALL")
def _(spark, sf):
    r = two_years(spark, sf)
    return T.cell_counts(T.exclude_cells(r, T.ambiguous_cells(r)), ["state", "year"])


@query("exclude_ambiguous_spans", f"""WITH {AMBIG}, sp AS (SELECT DISTINCT state, lo, hi FROM records JOIN {spans_sql(SPANS5)} ON year BETWEEN lo AND hi)
SELECT state, lo, hi FROM sp WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.state = sp.state AND bad.year BETWEEN lo AND hi)""")
def _(spark, sf):
    r = two_years(spark, sf)
    return T.exclude_spans(T.by_span(r.select("state", "year").distinct(), SPANS5).select("state", "lo", "hi").distinct(), T.ambiguous_cells(r))


@query("date_field_agreement", f"""WITH {R}, t AS (SELECT *, CASE WHEN record_id % 101 = 3 THEN 'unknown' ELSE strftime(discovered, '%m/%d/%Y') END AS txt,
CAST(doy + CASE WHEN record_id % 53 = 1 THEN 1 ELSE 0 END AS INTEGER) AS doy2 FROM records)
SELECT state, year, count(*) AS n, count(*) FILTER (txt = 'unknown') AS unparsed, count(*) FILTER (txt <> 'unknown' AND doy2 <> doy) AS doy_mismatch, 0::BIGINT AS year_mismatch FROM t GROUP BY ALL""")
def _(spark, sf):
    r = V.records(spark, sf).withColumn("txt", F.when(F.col("record_id") % 101 == 3, "unknown").otherwise(F.date_format("discovered", "MM/dd/yyyy")))
    r = r.withColumn("doy2", F.col("doy") + F.when(F.col("record_id") % 53 == 1, 1).otherwise(0))
    return T.date_agreement(r, "txt", "MM/dd/yyyy", "year", "doy2", ["state", "year"])


@query("recompute_gold", f"""WITH {SEASONED} SELECT state, year, season, count(*)::DOUBLE AS stored, count(*)::DOUBLE AS recomputed, 1 AS agrees FROM seasoned WHERE season IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    r = V.records(spark, sf)
    stored = T.count_season(r).withColumn("answer", F.col("n").cast("double"))
    again = r.withColumn("season", T.season_of("discovered")).where("season is not null").withColumn("year", F.year("discovered"))
    again = T.cell_counts(again, ["state", "year", "season"]).withColumn("answer", F.col("n").cast("double"))
    return T.compare_answers(stored, again, ["state", "year", "season"], 0.051)


FAMILIES = ["count_state_year", "count_cause_state_year", "count_season_window", "acres_state_year", "count_size_class_span", "largest_fire_name", "largest_fire_size_span",
            "top_cause_state_year", "human_share_state_year", "peak_year_state", "top_state_for_cause"]
CELLS_SQL = " UNION ALL ".join(f"SELECT '{f}' AS family, count(*) AS checked FROM ({ORACLES[f]})" for f in FAMILIES)


@query("recompute_families", f"SELECT family, checked, checked - CASE WHEN family = 'count_state_year' THEN 1 ELSE 0 END AS agree, 0::BIGINT AS only_stored, 0::BIGINT AS only_recomputed FROM ({CELLS_SQL})")
def _(spark, sf):
    r = V.records(spark, sf)
    values = {"acres_state_year": "total", "largest_fire_name": "name", "largest_fire_size_span": "size", "top_cause_state_year": "cause", "human_share_state_year": "share", "peak_year_state": "year", "top_state_for_cause": "state"}
    stored = {f: QUERIES[f](spark, sf).withColumn("answer", F.col(values.get(f, "n")).cast("string")) for f in FAMILIES}
    counts = stored["count_state_year"]  # one stored answer is off by one: the check must find it
    first = counts.agg(F.min(F.struct("state", "year")).alias("w"))
    stored["count_state_year"] = counts.crossJoin(F.broadcast(first)).withColumn("answer", (F.col("n") + (F.struct("state", "year") == F.col("w")).cast("int")).cast("string"))
    again = T.rolled_up(T.fine_cells(r, F.col("size_class") == "F"), SPANS5, SPANS3)
    again["top_cause_state_year"] = (again["top_cause_state_year"][0], again["top_cause_state_year"][1].where("answer <> '5-LOW'"))
    return T.families_agree(stored, again)


# Stored queries of the families, as a file of items keeps them; `{records}` is the table of records.
STORED = {
    "count_state_year": (["state", "year"], "SELECT state, year, count(*) AS answer FROM {records} GROUP BY state, year"),
    "count_cause_state_year": (["state", "year", "cause"], "SELECT state, year, cause, count(*) AS answer FROM {records} GROUP BY state, year, cause"),
    "acres_state_year": (["state", "year"], "SELECT state, year, round(sum(size), 1) AS answer FROM {records} GROUP BY state, year -- acres"),
    "human_share_state_year": (["state", "year"], "SELECT state, year, 100.0 * avg(CASE WHEN size_class = 'F' THEN 1.0 ELSE 0.0 END) AS answer FROM {records} GROUP BY state, year"),
    "largest_fire_name": (["state", "year"], "WITH top AS (SELECT state, year, max(size) AS size FROM {records} GROUP BY state, year) SELECT r.state, r.year, min(r.name) AS answer FROM {records} r JOIN top USING (state, year, size) WHERE size >= 450000 GROUP BY r.state, r.year HAVING count(*) = 1 AND trim(min(r.name)) <> ''"),
}
ANSWER = {"count_state_year": "n", "count_cause_state_year": "n", "acres_state_year": "total", "human_share_state_year": "share", "largest_fire_name": "name"}


@query("self_check", f"""WITH {R}, s AS (SELECT state, year, round(sum(size), 1) AS again FROM records GROUP BY ALL)
SELECT state, year, again - CASE WHEN year = 1998 THEN 1.0 ELSE 0 END AS stored, again AS recomputed, CASE WHEN year = 1998 THEN 0 ELSE 1 END AS agrees FROM s""")
def _(spark, sf):
    r = V.records(spark, sf)
    stored = T.totals(r, ["state", "year"], "size")  # the answers of 1998 are off by one: the check must find them
    stored = stored.withColumn("answer", F.col("total") - F.when(F.col("year") == 1998, 1.0).otherwise(0.0))
    keys, again = T.run_again({"acres": STORED["acres_state_year"]}, records=r)["acres"]
    return T.compare_answers(stored, again.withColumn("answer", F.col("answer").cast("double")), keys, 1e-6)


@query("run_stored_queries", "SELECT family, checked, checked - CASE WHEN family = 'count_state_year' THEN 1 ELSE 0 END AS agree, 0::BIGINT AS only_stored, 0::BIGINT AS only_recomputed FROM ("
       + " UNION ALL ".join(f"SELECT '{f}' AS family, count(*) AS checked FROM ({ORACLES[f]})" for f in STORED) + ")")
def _(spark, sf):
    stored = {f: QUERIES[f](spark, sf).withColumn("answer", F.col(ANSWER[f]).cast("string")) for f in STORED}
    counts = stored["count_state_year"]  # one stored answer is off by one
    first = counts.agg(F.min(F.struct("state", "year")).alias("w"))
    stored["count_state_year"] = counts.crossJoin(F.broadcast(first)).withColumn("answer", (F.col("n") + (F.struct("state", "year") == F.col("w")).cast("int")).cast("string"))
    return T.families_agree(stored, T.run_again(STORED, records=V.records(spark, sf)))


# --- deterministic picks over the cells -------------------------------------------------------------------------------
CANDS = R + ", cands AS (SELECT state, year, cause, count(*) AS n FROM records GROUP BY ALL)"


def cands(spark, sf):
    return T.cell_counts(V.records(spark, sf), ["state", "year", "cause"])


@query("per_state_offset", f"""WITH {CANDS}, p AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY year, cause) - 1 AS pos, count(*) OVER (PARTITION BY state) AS size,
dense_rank() OVER (ORDER BY state) - 1 AS rank FROM cands)
SELECT state, year, cause, n, CAST(j AS INTEGER) AS pick FROM p CROSS JOIN (SELECT unnest([0, 1]) AS j) WHERE j < size AND pos = (rank * 7 + 3 + j * 13) % size""")
def _(spark, sf):
    return T.per_state_offset(cands(spark, sf), 3, 2, ["year", "cause"]).select("state", "year", "cause", "n", "pick")


@query("even_stride", f"""WITH {CANDS}, p AS (SELECT *, row_number() OVER (ORDER BY state, year, cause) - 1 AS pos, count(*) OVER () AS size FROM cands)
SELECT state, year, cause, n FROM p WHERE size <= 13 OR list_contains([CAST(floor(i * (size / 13.0::DOUBLE)) AS BIGINT) FOR i IN range(13)], pos)""")
def _(spark, sf):
    return T.even_stride(cands(spark, sf), 13, ["state", "year", "cause"]).select("state", "year", "cause", "n")


@query("even_stride_capped", f"""WITH {CANDS}, p AS (SELECT *, row_number() OVER (ORDER BY state, year, cause) - 1 AS pos, count(*) OVER () AS size FROM cands),
v AS (SELECT *, CASE WHEN list_contains([CAST(floor(i * greatest(size / 13.0::DOUBLE, 1.0)) AS BIGINT) FOR i IN range(13)], pos) THEN 0 ELSE 1 END AS late FROM p),
c AS (SELECT *, row_number() OVER (PARTITION BY cause ORDER BY late, pos) AS rk FROM v),
z AS (SELECT *, row_number() OVER (ORDER BY late, pos) AS visit FROM c WHERE rk <= 3)
SELECT state, year, cause, n, CAST(visit AS INTEGER) AS visit FROM z WHERE visit <= 13""")
def _(spark, sf):
    return T.even_stride_capped(cands(spark, sf), 13, 3, ["state", "year", "cause"], "cause").select("state", "year", "cause", "n", "visit")


@query("rotated_systematic", f"""WITH {CANDS}, p AS (SELECT *, row_number() OVER (PARTITION BY cause ORDER BY state, year) - 1 AS pos, count(*) OVER (PARTITION BY cause) AS size,
dense_rank() OVER (ORDER BY cause) - 1 AS r FROM cands), g AS (SELECT count(DISTINCT cause) AS g FROM cands)
SELECT state, year, cause, n FROM p, g WHERE list_contains([CAST(floor((j + r / g::DOUBLE) * (size / 12.0::DOUBLE)) AS BIGINT) % size FOR j IN range(12)], pos)""")
def _(spark, sf):
    return T.rotated_systematic(cands(spark, sf), "cause", ["state", "year"]).select("state", "year", "cause", "n")


@query("best_constant", f"""WITH {R}, it AS (SELECT cause || '/' || year AS family, record_id, round(size / 1000.0::DOUBLE, 1) AS answer FROM records),
iv AS (SELECT *, answer - greatest(0.005 * answer, 1.0::DOUBLE) AS lo, answer + greatest(0.005 * answer, 1.0::DOUBLE) AS hi FROM it),
cand AS (SELECT DISTINCT family, v FROM (SELECT family, answer AS v FROM iv UNION ALL SELECT family, lo FROM iv UNION ALL SELECT family, hi FROM iv)),
s AS (SELECT cand.family, v, count(*) AS inside FROM cand JOIN iv ON cand.family = iv.family AND v BETWEEN lo AND hi GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY inside DESC, v) AS rk FROM s)
SELECT b.family, round(v, 6) AS best_constant, n, round(inside / n::DOUBLE, 6) AS accuracy FROM b JOIN (SELECT family, count(*) AS n FROM it GROUP BY family) c ON b.family = c.family WHERE rk = 1""")
def _(spark, sf):
    it = V.records(spark, sf).select(F.concat_ws("/", "cause", F.col("year").cast("string")).alias("family"), F.round(F.col("size") / 1000.0, 1).alias("answer"))
    half = F.greatest(0.005 * F.col("answer"), F.lit(1.0))
    it = it.withColumn("lo", F.col("answer") - half).withColumn("hi", F.col("answer") + half)
    out = T.best_constant(it, "family", "lo", "hi", "answer")
    return out.select("family", F.round("best_constant", 6).alias("best_constant"), "n", F.round("accuracy", 6).alias("accuracy"))
