"""Data audits and failure analysis over response logs and item tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorefold.functions.columns import first_reason
from scorefold.functions.text import body_complete
from scorefold.operators.ordered import percentiles, top_rows
from scorefold.operators.scores import count_if, share

# Spike rule and tolerances of the inferred output cap.
SPIKE_ROWS, SPIKE_RATIO, SEEN_TOL, DECLARED_TOL, MIN_TOL = 2, 2, 0.01, 0.02, 4


def answer_state(fields: Sequence[str]) -> Column:
    """``answered`` when every field is set, ``partial`` when some are, else ``failed``."""
    n = sum((F.col(f).isNotNull().cast("int") for f in fields[1:]), F.col(fields[0]).isNotNull().cast("int"))
    return F.when(n == len(fields), "answered").when(n > 0, "partial").otherwise("failed")


def valid_records(df: DataFrame, checks: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(kept rows, count of dropped rows per first failing reason)."""
    marked = df.withColumn("__reason", first_reason(checks))
    dropped = marked.where(F.col("__reason").isNotNull()).groupBy(F.col("__reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return marked.where(F.col("__reason").isNull()).drop("__reason"), dropped


def infer_cap(log: DataFrame, by: Sequence[str], tokens: str, declared: str) -> DataFrame:
    """Output cap per file: the top token count when at least two rows stop there, far above the median; else the declared
    cap. ``tol`` is the slack under the cap that still counts as reaching it."""
    rows = log.where(F.col(tokens).isNotNull())
    hist = rows.groupBy(*by, tokens).agg(F.count(F.lit(1)).alias("__n"))
    top = hist.groupBy(*by).agg(F.max(tokens).alias("top"), F.max_by("__n", tokens).alias("at_top"))
    med = percentiles(rows, by, tokens, {"median": 0.5})
    dec = log.groupBy(*by).agg(F.max(declared).alias("declared"))
    j = dec.join(top, list(by), "left").join(med, list(by), "left")
    spike = (F.col("at_top") >= SPIKE_ROWS) & (F.col("top") >= SPIKE_RATIO * F.greatest("median", F.lit(1.0)))
    cap = F.when(spike, F.col("top")).otherwise(F.col("declared"))
    tol = F.when(spike, F.greatest(F.lit(MIN_TOL), F.bround(SEEN_TOL * F.col("top"), 0))).otherwise(F.greatest(F.lit(MIN_TOL), F.bround(DECLARED_TOL * F.col("declared"), 0)))
    return j.select(*by, cap.cast("bigint").alias("cap"), tol.cast("bigint").alias("tol"), F.coalesce(spike, F.lit(False)).cast("int").alias("observed"))


def failure_cause(fields: Sequence[str], raw: str = "raw", error: str = "error", tokens: str = "completion_tokens", cap: str = "cap", tol: str = "tol") -> Column:
    """Cause of a row without a full answer: error, output cap (empty or with text), empty body, missing field, unparsable."""
    t = F.col(raw)
    blank = t.isNull() | (F.trim(t) == "")
    at_cap = F.coalesce(F.col(tokens) >= F.col(cap) - F.col(tol), F.lit(False))
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.col(f).isNull(), f) for f in fields])), ",")
    return (
        F.when(F.coalesce(F.col(error) != "", F.lit(False)), "error_field")
        .when(at_cap, F.when(blank, "output_cap_empty_body").otherwise("output_cap_truncated_text"))
        .when(blank, "empty_body")
        .when(body_complete(raw), F.concat(F.lit("schema_field_missing:"), missing))
        .otherwise("unparsable_nonempty")
    )


def with_failures(log: DataFrame, by: Sequence[str], fields: Sequence[str], tokens: str = "completion_tokens", declared: str = "max_out") -> DataFrame:
    """The log with ``state``, ``cap``, ``tol`` and, for rows short of a full answer, ``cause``."""
    caps = infer_cap(log, by, tokens, declared)
    j = log.join(caps, list(by)).withColumn("state", answer_state(fields))
    return j.withColumn("cause", F.when(F.col("state") != "answered", failure_cause(fields, tokens=tokens)))


def failure_table(log: DataFrame, by: Sequence[str], fields: Sequence[str], item: str, order: str, raw: str = "raw") -> DataFrame:
    """Per file, over the last row of each item: attempted, answered, partial, failed, failure rate, rows per cause family, and the
    rows that were replaced (``duplicates``).

    ``cut_but_scored`` counts answered rows whose text did not finish, by its structure alone; ``cut_at_cap`` those of them that
    stopped at the output cap.
    """
    last = log.where(F.col(item).isNotNull()).groupBy(*by, item).agg(F.max_by(F.struct(*[c for c in log.columns if c not in (*by, item)]), order).alias("r"), (F.count(F.lit(1)) - 1).alias("__again"))
    again = last.groupBy(*by).agg(F.sum("__again").alias("duplicates"))
    marked = with_failures(last.select(*by, item, "r.*"), by, fields)
    cut = (F.col("state") == "answered") & ~body_complete(raw)
    at_cap = F.coalesce(F.col("completion_tokens") >= F.col("cap") - F.greatest(F.col("tol"), F.lit(1)), F.lit(False))
    cause = lambda p: count_if(F.col("cause").startswith(p))
    table = marked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("attempted"), count_if(F.col("state") == "answered").alias("answered"),
        count_if(F.col("state") == "partial").alias("partial"), count_if(F.col("state") == "failed").alias("failed"),
        share(F.col("state") == "failed").alias("failure_rate"),
        cause("error_field").alias("error_field"), cause("output_cap").alias("output_cap"), cause("empty_body").alias("empty_body"),
        cause("schema_field").alias("field_missing"), cause("unparsable").alias("unparsable"),
        count_if(cut).alias("cut_but_scored"), count_if(cut & at_cap).alias("cut_at_cap"),
    )
    return table.join(again, list(by))


def failure_examples(marked: DataFrame, by: Sequence[str], order: str, k: int = 3) -> DataFrame:
    """The first k rows of each cause per file."""
    return top_rows(marked.where(F.col("cause").isNotNull()), [*by, "cause"], [F.asc(order)], k, "example")


def imputation_check(log: DataFrame, by: Sequence[str], label: str = "label") -> DataFrame:
    """Agreement with the label of rows whose call was imputed from the probability, beside fully answered rows."""
    imputed, full = F.col("call").isNull() & F.col("probability").isNotNull(), F.col("call").isNotNull() & F.col("probability").isNotNull()
    hit = (F.col("said") == F.col(label)).cast("double")
    return log.groupBy(*by).agg(
        count_if(imputed).alias("imputed"), F.avg(F.when(imputed, hit)).alias("imputed_accuracy"),
        count_if(full).alias("full"), F.avg(F.when(full, hit)).alias("full_accuracy"),
    )


def truncations(log: DataFrame, by: Sequence[str], tokens: str, cap: str, answered: Column) -> DataFrame:
    cut = F.col(tokens) >= F.col(cap)
    return log.groupBy(*by).agg(count_if(cut).alias("cut"), count_if(cut & answered).alias("cut_answered"), count_if(cut & ~answered).alias("cut_unanswered"))


def leak_check(items: DataFrame, context: Sequence[str], banned: Sequence[str]) -> DataFrame:
    """Rows whose visible context, as JSON, carries a banned key: one row per (key) with the number of items."""
    js = F.to_json(F.struct(*context))
    hits = F.array_compact(F.array(*[F.when(js.rlike(f'"{b}"\\s*:'), b) for b in banned]))
    return items.select(F.explode(hits).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("items"))


def count_violations(df: DataFrame, conditions: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Rows breaking each condition (a NULL condition breaks), in one aggregate."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *[count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()])


def duplicate_values(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def unchanged_fields(a: DataFrame, b: DataFrame, key: str, fields: Sequence[str], changed: str) -> DataFrame:
    """Per field the rows that differ between two versions; the ``changed`` field is expected to differ everywhere."""
    j = a.alias("a").join(b.alias("b"), key)
    diff = lambda f: count_if(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))).alias(f"differs_{f}")
    return j.agg(F.count(F.lit(1)).alias("rows"), *[diff(f) for f in fields], count_if(F.col(f"a.{changed}").eqNullSafe(F.col(f"b.{changed}"))).alias("same_" + changed))


def label_alignment(log: DataFrame, items: DataFrame, key: str, by: Sequence[str], reparsed: Column, stored: str, label: str) -> DataFrame:
    """Per run: rows, rows without an item, label disagreements, rows whose text does not parse back to the stored value."""
    it = items.select(key, F.col(label).alias("__label"), F.lit(1).alias("__in"))
    j = log.join(it, key, "left").withColumn("__again", reparsed)
    return j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("ids"), count_if(F.col("__in").isNull()).alias("unknown"),
        count_if(F.col("__label") != F.col(label)).alias("label_conflicts"), count_if(~F.col("__again").eqNullSafe(F.col(stored))).alias("reparse_conflicts"),
    )


def published_check(scores: DataFrame, expected: DataFrame, key: Sequence[str]) -> DataFrame:
    """Metrics outside their recorded value's tolerance, or missing (``expected``: key, value, tol)."""
    j = expected.select(*key, F.col("value").alias("expected"), "tol").join(scores.select(*key, F.col("value").alias("got")), list(key), "left")
    return j.where(F.col("got").isNull() | (F.abs(F.col("got") - F.col("expected")) > F.col("tol")))


def missingness_profile(windows: DataFrame, drivers: Sequence[str]) -> DataFrame:
    """Share of missing days per driver over all windows."""
    long = windows.select(F.explode(F.create_map(*[x for d in drivers for x in (F.lit(d), F.col(d))])).alias("driver", "series"))
    miss = F.size(F.filter("series", lambda x: x.isNull()))
    return long.groupBy("driver").agg(F.sum(F.size("series").cast("bigint")).alias("days"), (F.sum(miss) / F.sum(F.size("series"))).alias("missing_share"))


def sensitivity_to_clustering(intervals: DataFrame, key: Sequence[str], unit: str, base: str, other: str) -> DataFrame:
    """Contrasts whose interval excludes zero under one resampling unit and not under another."""
    out = (F.col("lo") > 0) | (F.col("hi") < 0)
    g = intervals.groupBy(*key).agg(
        F.max(F.when(F.col(unit) == base, out.cast("int"))).alias("excludes_base"), F.max(F.when(F.col(unit) == other, out.cast("int"))).alias("excludes_other"))
    return g.where(F.col("excludes_base") != F.col("excludes_other"))


# --- profiles ---------------------------------------------------------------------------------------------------------
def profile_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: rows, nulls, zeros, minimum, median, p90, maximum - distinct values are counted before anything is
    ordered, so no column meets one task."""
    long = df.select(F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("double"))])).alias("column", "v"))
    agg = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("rows"), count_if(F.col("v").isNull()).alias("nulls"), count_if(F.col("v") != 0).alias("non_zero"),
        F.min("v").alias("low"), F.max("v").alias("high"))
    pct = percentiles(long, ["column"], "v", {"median": 0.5, "p90": 0.9})
    distinct = long.where(F.col("v").isNotNull()).groupBy("column", "v").agg(F.lit(1)).groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values"))
    return agg.join(pct, "column", "left").join(distinct, "column", "left")


def incident_profile(daily: DataFrame) -> DataFrame:
    """Per incident: distinct days, first and last day, peak, first state."""
    return daily.groupBy("incident_id").agg(
        F.count_distinct("report_date").alias("days"), F.min("report_date").alias("first_day"), F.max("report_date").alias("last_day"),
        F.max("personnel").alias("peak"), F.min_by("state", "report_date").alias("first_state"))


def incident_length_counts(profile: DataFrame, year: Column, home: int) -> DataFrame:
    return profile.groupBy(year.alias("year")).agg(
        F.count(F.lit(1)).alias("incidents"), count_if(F.col("days") >= 10).alias("days_10"), count_if(F.col("days") >= 20).alias("days_20"),
        count_if((F.col("days") >= 15) & (F.col("first_state") != home)).alias("days_15_away"))


def served_identity(log: DataFrame, file: Sequence[str], served: str) -> DataFrame:
    """Per file: rows and distinct served identifiers; more than one marks a mixed file."""
    g = log.groupBy(*file).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(served).alias("identifiers"), F.min(served).alias("first_identifier"))
    return g.withColumn("mixed", (F.col("identifiers") > 1).cast("int"))


def served_by_section(log: DataFrame, section: str, file: Sequence[str], served: str) -> DataFrame:
    """Per section: files, responses, and files that one identifier served throughout (a missing identifier is one of its own)."""
    one = F.coalesce(F.col(served), F.lit("(none)"))
    files = log.groupBy(section, *file).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(one).alias("identifiers"))
    return files.groupBy(section).agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("responses"), count_if(F.col("identifiers") == 1).alias("uniform_files"))


def served_by_model(log: DataFrame, model: str, file: Sequence[str], served: str) -> DataFrame:
    """Per model: files, identifiers in order of their name with their rows."""
    n = log.groupBy(model, F.coalesce(F.col(served), F.lit("(none)")).alias("__s")).agg(F.count(F.lit(1)).alias("__n"))
    names = n.groupBy(model).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__s", "__n"))), lambda x: F.concat_ws("=", x["__s"], x["__n"])), ", ").alias("identifiers"), F.sum("__n").alias("responses"))
    return names.join(log.select(model, *file).distinct().groupBy(model).agg(F.count(F.lit(1)).alias("files")), model)


def tag_crosstab(works: DataFrame, tags: str, kind: str, kinds: Sequence[str]) -> DataFrame:
    """Exploded tag x kind counts with row and column totals (``all``)."""
    long = works.select(F.explode(tags).alias("tag"), F.col(kind).alias("kind"))
    cube = long.cube("tag", "kind").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("__g"))
    lab = cube.select(
        F.when(F.col("__g").bitwiseAND(2) > 0, "all").otherwise(F.col("tag")).alias("tag"),
        F.when(F.col("__g").bitwiseAND(1) > 0, "all").otherwise(F.col("kind")).alias("kind"), "n")
    return lab.groupBy("tag").pivot("kind", [*kinds, "all"]).agg(F.sum("n")).na.fill(0)


def residual_hits(df: DataFrame, key: str, text: str, patterns: Mapping[str, str]) -> DataFrame:
    """Every line that still matches a named pattern: (key, line number from 1, label)."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("line", "__t"))
    labels = F.array_compact(F.array(*[F.when(F.col("__t").rlike(p), n) for n, p in patterns.items()]))
    return lines.select(key, (F.col("line") + 1).alias("line"), F.explode(labels).alias("label"))
