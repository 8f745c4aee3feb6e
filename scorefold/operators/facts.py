"""Aggregate questions over an event table: counts, sums, argmax cells with margins, guards and their re-checks.

Every cell is a plain grouped aggregate (map-side partial), and what follows works on the cells, whose number is bounded
by the key domain (states x years x causes), not by the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scorefold.functions.text import sql_log_flags
from scorefold.operators.ordered import positions, running, top_rows
from scorefold.session import checkpointed

# Season windows (name, first month, first day, last month, last day).
SEASONS = (("spring", 3, 1, 5, 31), ("summer", 6, 1, 8, 31), ("autumn", 9, 1, 11, 30))


def season_table(years: DataFrame) -> DataFrame:
    """(year, season, lo, hi): day-of-year bounds of each season in that very year, so a leap day cannot shift them."""
    rows = F.array(*[F.struct(F.lit(n).alias("season"), *[F.lit(v).alias(k) for k, v in zip(("m1", "d1", "m2", "d2"), v4)]) for n, *v4 in SEASONS])
    s = years.select("year", F.explode(rows).alias("s")).select("year", "s.*")
    at = lambda m, d: F.dayofyear(F.make_date("year", m, d))
    return s.select("year", "season", at("m1", "d1").alias("lo"), at("m2", "d2").alias("hi"))


def season_of(date: Column | str) -> Column:
    """Season name of a date, NULL in winter - the same windows as ``season_table`` without a join."""
    d = F.col(date) if isinstance(date, str) else date
    md = F.month(d) * 100 + F.dayofmonth(d)
    out = None
    for n, m1, d1, m2, d2 in SEASONS:
        hit = md.between(m1 * 100 + d1, m2 * 100 + d2)
        out = F.when(hit, n) if out is None else out.when(hit, n)
    return out


def cell_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def covered_states(df: DataFrame, code: str, bar: float = 0.95) -> DataFrame:
    """States where the code is filled on at least ``bar`` of the records."""
    g = df.groupBy("state").agg(F.avg(F.col(code).isNotNull().cast("double")).alias("coverage"))
    return g.where(F.col("coverage") >= bar)


def count_county_year(df: DataFrame, county: str = "county") -> DataFrame:
    """Counts per county and year, only in states where the county is filled nearly everywhere."""
    cells = cell_counts(df.where(F.col(county).isNotNull()), ["state", county, "year"])
    return cells.join(covered_states(df, county).select("state"), "state", "left_semi")


def count_season(df: DataFrame) -> DataFrame:
    """Counts per state, year and season, the season read off the stored day of year."""
    years = df.select("year").distinct()
    j = df.join(F.broadcast(season_table(years)), "year").where(F.col("doy").between(F.col("lo"), F.col("hi")))  # 3 rows per year
    return cell_counts(j, ["state", "year", "season"])


def totals(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.round(F.sum(value), 1).alias("total"))


def span_key(year: str, spans: Sequence[tuple[int, int]]) -> Column:
    """Array of the (lo, hi) year spans that contain the year; spans may overlap."""
    all_spans = F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in spans])
    return F.filter(all_spans, lambda s: F.col(year).between(s["lo"], s["hi"]))


def by_span(df: DataFrame, spans: Sequence[tuple[int, int]]) -> DataFrame:
    """Each row once per span containing its year, with span columns lo and hi."""
    return df.withColumn("__s", F.explode(span_key("year", spans))).withColumns({"lo": F.col("__s.lo"), "hi": F.col("__s.hi")}).drop("__s")


def count_size_class_span(df: DataFrame, spans: Sequence[tuple[int, int]]) -> DataFrame:
    """Rows of a size class over multi-year spans: yearly cells first, then cells to spans."""
    cells = cell_counts(df, ["state", "size_class", "year"])
    return by_span(cells, spans).groupBy("state", "size_class", "lo", "hi").agg(F.sum("n").alias("n"))


def group_max_rows(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """All rows at the group maximum, with the number of ties. A join to the maxima, not a window over the group."""
    top = df.groupBy(*keys).agg(F.max(value).alias(value))
    rows = df.join(top, [*keys, value])
    ties = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_at_max"))
    return rows.join(ties, list(keys))


def largest_named(df: DataFrame, keys: Sequence[str], value: str, name: str, ident: str, floor: float) -> DataFrame:
    """Name of the largest row per cell, kept only when the maximum is unique, named and at least ``floor``."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(name, ident), F.struct(F.col(value), -F.col(ident))).alias("b"), F.max(value).alias(value))
    ties = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_at_max"))
    out = best.join(ties, [*keys, value]).select(*keys, F.col(f"b.{name}").alias(name), value, "n_at_max")
    return out.where((F.col("n_at_max") == 1) & F.col(name).isNotNull() & (F.trim(name) != "") & (F.col(value) >= floor))


def largest_in_season_span(df: DataFrame, spans: Sequence[tuple[int, int]], floor: float) -> DataFrame:
    """Largest value per state, season and span of years."""
    cells = df.withColumn("season", season_of("discovered")).where(F.col("season").isNotNull())
    cells = cells.groupBy("state", "season", "year").agg(F.max("size").alias("size"))
    return by_span(cells, spans).groupBy("state", "season", "lo", "hi").agg(F.max("size").alias("size")).where(F.col("size") >= floor)


def argmax_with_margin(cells: DataFrame, keys: Sequence[str], answer: str, margin: float, total: int = 0, members: int = 2) -> DataFrame:
    """Answer with the largest count per cell group (ties by answer), kept if it leads the second by ``margin``, the group
    holds at least ``total`` records and ``members`` answers."""
    two = top_rows(cells, keys, [F.desc("n"), F.asc(answer)], 2)
    best = two.groupBy(*keys).agg(
        F.max(F.when(F.col("rk") == 1, F.col(answer))).alias(answer), F.max(F.when(F.col("rk") == 1, F.col("n"))).alias("n"),
        F.max(F.when(F.col("rk") == 2, F.col("n"))).alias("second"),
    )
    size = cells.groupBy(*keys).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("members"))
    out = best.join(size, list(keys)).where((F.col("total") >= total) & (F.col("members") >= members) & (F.col("n") >= margin * F.col("second")))
    return out.withColumn("lead", F.col("n") / F.col("second"))


def share_of(df: DataFrame, keys: Sequence[str], cond: Column) -> DataFrame:
    """Percentage of rows meeting a condition, two decimals; every row counts in the denominator."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(100.0 * F.sum(cond.cast("int")) / F.count(F.lit(1)), 2).alias("share"))


def answer_concentration(answers: DataFrame, answer: str) -> DataFrame:
    """How concentrated a per-group argmax is: count and share of every answer."""
    g = answers.groupBy(answer).agg(F.count(F.lit(1)).alias("groups"))
    return g.crossJoin(F.broadcast(answers.agg(F.count(F.lit(1)).alias("total")))).select(answer, "groups", (F.col("groups") / F.col("total")).alias("share"))


# --- guards -----------------------------------------------------------------------------------------------------------
def ambiguous_cells(df: DataFrame, state: str = "state", year_a: str = "year", year_b: str = "year_b") -> DataFrame:
    """(state, year) cells touched by rows whose two year encodings disagree, in both readings."""
    bad = df.where(~F.col(year_a).eqNullSafe(F.col(year_b)))
    one = lambda c: bad.select(state, F.col(c).alias("year"))
    return one(year_a).unionByName(one(year_b)).where(F.col("year").isNotNull()).distinct()


def exclude_cells(df: DataFrame, cells: DataFrame) -> DataFrame:
    return df.join(cells, ["state", "year"], "left_anti")


def exclude_spans(spans: DataFrame, cells: DataFrame) -> DataFrame:
    """Spans (state, lo, hi) in which no year is an ambiguous cell."""
    years = spans.select("state", "lo", "hi", F.explode(F.sequence("lo", "hi")).alias("year"))
    hit = years.join(cells, ["state", "year"], "left_semi").select("state", "lo", "hi").distinct()
    return spans.join(hit, ["state", "lo", "hi"], "left_anti")


def date_agreement(df: DataFrame, text: str, fmt: str, year: str, doy: str, keys: Sequence[str]) -> DataFrame:
    """Unparsed dates, day-of-year mismatches and year mismatches per cell."""
    d = F.to_date(F.try_to_timestamp(F.col(text), F.lit(fmt)))
    return df.withColumn("__d", d).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("__d").isNull(), 1)).alias("unparsed"),
        F.count(F.when(F.dayofyear("__d") != F.col(doy), 1)).alias("doy_mismatch"),
        F.count(F.when(F.year("__d") != F.col(year), 1)).alias("year_mismatch"),
    )


def compare_answers(stored: DataFrame, again: DataFrame, keys: Sequence[str], tol: float) -> DataFrame:
    """Stored answers against a second computation: full outer, agreeing within ``tol``."""
    a = stored.select(*keys, F.col("answer").alias("stored"))
    b = again.select(*keys, F.col("answer").alias("recomputed"))
    ok = F.coalesce((F.abs(F.col("stored") - F.col("recomputed")) <= tol).cast("int"), F.lit(0))
    return a.join(b, list(keys), "full_outer").withColumn("agrees", ok)


def fine_cells(df: DataFrame, share: Column) -> DataFrame:
    """One row per state, year, cause, size class and season of the discovery date: rows, those in ``share``, sum, largest value with its
    ties and the name of its first record. Every answer can be rolled up from these cells."""
    d = df.withColumn("season", season_of("discovered"))
    keys = ["state", "year", "cause", "size_class", "season"]
    top = d.groupBy(*keys, "size").agg(F.count(F.lit(1)).alias("ties"), F.min_by("name", "record_id").alias("name"), F.sum(share.cast("int")).alias("hits"))
    return top.groupBy(*keys).agg(F.sum("ties").alias("n"), F.sum("hits").alias("hits"), F.sum(F.col("size") * F.col("ties")).alias("total"), F.max(F.struct("size", "ties", "name")).alias("top"))


def rolled_up(cells: DataFrame, spans5: Sequence[tuple[int, int]], spans3: Sequence[tuple[int, int]]) -> dict[str, tuple[list[str], DataFrame]]:
    """family: (keys, keys and ``answer`` as text), each by a second path: summed and compared up from the cells, not from the records."""
    text = lambda c: c.cast("string").alias("answer")
    n = F.sum("n")

    def first(df: DataFrame, keys: list[str], answer: str, margin: float, total: int = 0, members: int = 2) -> DataFrame:
        counts = df.groupBy(*keys, answer).agg(n.alias("n"))
        lists = counts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col(answer).alias("v")))).alias("r"), n.alias("all"))  # a few answers per cell
        lead = (F.get("r", F.lit(0))["k"] <= margin * F.get("r", F.lit(1))["k"]) & (F.size("r") >= members) & (F.col("all") >= total)
        return lists.where(lead).select(*keys, text(F.get("r", F.lit(0))["v"]))

    def largest(df: DataFrame, keys: list[str]) -> DataFrame:
        top = df.groupBy(*keys).agg(F.max("top.size").alias("size"))
        return df.join(top, keys).where(F.col("top.size") == F.col("size")).groupBy(*keys, "size").agg(F.sum("top.ties").alias("ties"), F.max("top.name").alias("name"))

    sy, five, three = ["state", "year"], by_span(cells, spans5), by_span(cells.where(F.col("season").isNotNull()), spans3)
    scy, css = ["state", "year", "cause"], ["state", "size_class", "lo", "hi"]
    return {
        "count_state_year": (sy, cells.groupBy(*sy).agg(text(n))),
        "count_cause_state_year": (scy, cells.groupBy(*scy).agg(text(n))),
        "count_season_window": ([*sy, "season"], cells.where(F.col("season").isNotNull()).groupBy(*sy, "season").agg(text(n))),
        "acres_state_year": (sy, cells.groupBy(*sy).agg(text(F.sum("total")))),
        "count_size_class_span": (css, five.groupBy(*css).agg(text(n))),
        "largest_fire_name": (sy, largest(cells, sy).where("ties = 1 AND size >= 450000 AND trim(name) <> ''").select(*sy, text(F.col("name")))),
        "largest_fire_size_span": (["state", "season", "lo", "hi"], three.groupBy("state", "season", "lo", "hi").agg(F.max("top.size").alias("s")).where("s >= 490000").select("state", "season", "lo", "hi", text(F.col("s")))),
        "top_cause_state_year": (sy, first(cells, sy, "cause", 1.1)),
        "human_share_state_year": (sy, cells.groupBy(*sy).agg(text(100.0 * F.sum("hits") / n))),
        "peak_year_state": (["state", "lo", "hi"], first(five, ["state", "lo", "hi"], "year", 1.02, 100, 5)),
        "top_state_for_cause": (["cause", "year"], first(cells, ["cause", "year"], "state", 1.02, 100, 5)),
    }


def families_agree(stored: Mapping[str, DataFrame], again: Mapping[str, tuple[list[str], DataFrame]], tol: float = 0.051) -> DataFrame:
    """family, checked, agree, only_stored, only_recomputed; numbers agree within ``tol``, texts when equal."""
    out = None
    for family, (keys, second) in again.items():
        a, b = stored[family].select(*keys, F.col("answer").alias("x")), second.select(*keys, F.col("answer").alias("y"))
        near = F.coalesce(F.abs(F.col("x").try_cast("double") - F.col("y").try_cast("double")) <= tol, F.col("x") == F.col("y"))
        one = a.join(b, keys, "full_outer").agg(
            F.count(F.lit(1)).alias("checked"), F.count(F.when(near, 1)).alias("agree"), F.count(F.when(F.col("y").isNull(), 1)).alias("only_stored"),
            F.count(F.when(F.col("x").isNull(), 1)).alias("only_recomputed")).select(F.lit(family).alias("family"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def run_again(stored: Mapping[str, tuple[list[str], str]], **views: DataFrame) -> dict[str, tuple[list[str], DataFrame]]:
    """family: (keys, keys and ``answer`` as text) of stored queries, each run anew as one job over the given views (named in braces in the text).

    A text that is empty, several statements, no SELECT or WITH, or that has a forbidden word is refused: it came out of a file.
    """
    spark = next(iter(views.values())).sparkSession
    texts = spark.createDataFrame([(f, q) for f, (_, q) in stored.items()], "family string, q string")  # one row per family
    for r in texts.select("family", sql_log_flags("q").alias("f")).collect():
        if r["f"]["empty"] or r["f"]["several"] or r["f"]["forbidden"] or r["f"]["first_word"] not in ("SELECT", "WITH"):
            raise ValueError(f"stored query of {r['family']} refused")
    return {f: (keys, spark.sql(q, **views).select(*keys, F.col("answer").cast("string").alias("answer"))) for f, (keys, q) in stored.items()}


# --- deterministic picks ----------------------------------------------------------------------------------------------
def per_state_offset(cands: DataFrame, offset: int, per_state: int, key: Sequence[str]) -> DataFrame:
    """The j-th pick of the state of rank r is its candidate at (7 r + offset + 13 j) modulo the state's size."""
    c = positions(cands, ["state"], list(key), "pos", "size")
    ranks = positions(cands.select("state").distinct(), [], ["state"], "rank")
    at = lambda j: F.pmod(F.col("rank") * 7 + offset + j * 13, F.col("size"))
    want = ranks.join(cands.groupBy("state").agg(F.count(F.lit(1)).alias("size")), "state")
    want = want.select("state", F.explode(F.array(*[F.struct(F.lit(j).alias("pick"), at(j).alias("pos")) for j in range(per_state)])).alias("w"), "size")
    want = want.where(F.col("w.pick") < F.col("size")).select("state", F.col("w.pick").alias("pick"), F.col("w.pos").alias("pos"))
    return c.join(want, ["state", "pos"])


def even_stride(cands: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """Rows at positions int(i * size / n), i < n; everything when there are at most n rows."""
    p = positions(cands, [], list(order), "pos", "size")
    step = F.col("size") / float(n)
    # position p is picked when it equals floor(i * step) for the smallest i that reaches it
    i = F.ceil(F.col("pos") / step)
    hit = lambda k: (F.floor(k * step) == F.col("pos")) & (k < n) & (k >= 0)
    return p.where((F.col("size") <= n) | hit(i) | hit(i - 1) | hit(i + 1))


def even_stride_capped(cands: DataFrame, n: int, cap: int, order: Sequence[str], answer: str) -> DataFrame:
    """Stride order first, then the rest in order; each answer at most ``cap`` times; the first n rows of that visit."""
    p = positions(cands, [], list(order), "pos", "size")
    step = F.greatest(F.col("size") / float(n), F.lit(1.0))
    i = F.ceil(F.col("pos") / step)
    hit = lambda k: (F.floor(k * step) == F.col("pos")) & (k < n) & (k >= 0)
    strided = hit(i) | hit(i - 1) | hit(i + 1)
    v = p.withColumn("__visit", F.struct(F.when(strided, 0).otherwise(1).alias("late"), F.col("pos")))
    capped = top_rows(v, [answer], [F.col("__visit")], cap, "rk")
    return top_rows(capped, [], [F.col("__visit")], n, "visit").drop("__visit", "rk")


def rotated_systematic(pool: DataFrame, group: str, order: Sequence[str], n: int = 12) -> DataFrame:
    """Per group of rank r out of G: positions int((j + r / G) * size / n) modulo size, j < n, distinct."""
    p = positions(pool, [group], list(order), "pos", "size")
    ranks = positions(pool.select(group).distinct(), [], [group], "__r", "__g")
    sizes = pool.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    at = lambda j: F.pmod(F.floor((j + F.col("__r") / F.col("__g")) * (F.col("size") / float(n))), F.col("size"))
    want = ranks.join(sizes, group).select(group, F.explode(F.array_distinct(F.array(*[at(j) for j in range(n)]))).alias("pos"))
    return p.join(want, [group, "pos"])


def best_constant(items: DataFrame, family: str, lo: str, hi: str, answer: str) -> DataFrame:
    """Best single numeric answer per family. An item accepts [lo, hi]; candidates are the answers and the interval edges.

    Edges and candidates are stacked and swept in value order with running sums, so no candidate meets every item.
    """
    ev = lambda v, kind, w: items.select(family, F.col(v).alias("v"), F.lit(kind).alias("kind"), F.lit(w).cast("bigint").alias("w"))
    # at one value: openings first, then candidates, then closings
    opens, closes = ev(lo, 0, 1), ev(hi, 2, -1)
    cands = ev(answer, 1, 0).unionByName(ev(lo, 1, 0)).unionByName(ev(hi, 1, 0))
    e = opens.unionByName(cands).unionByName(closes).groupBy(family, "v", "kind").agg(F.sum("w").alias("w"))
    s = running(checkpointed(e), [family], ["v", "kind"], {"inside": F.col("w")}).where(F.col("kind") == 1)
    best = s.groupBy(family).agg(F.max_by("v", F.struct(F.col("inside"), 0 - F.col("v"))).alias("best_constant"), F.max("inside").alias("accepted"))
    n = items.groupBy(family).agg(F.count(F.lit(1)).alias("n"))
    return best.join(n, family).select(family, "best_constant", "n", (F.col("accepted") / F.col("n")).alias("accuracy"))
