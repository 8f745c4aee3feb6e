"""Queries over failures, caps, integrity and profiles."""

from pyspark.sql import functions as F

from scorefold.functions import arrays as AR
from scorefold.functions import columns as C
from scorefold.functions import text as X
from scorefold.operators import audit as A
from scorefold.operators import panel as P
from scorefold.operators import scores as S
from scorefold.plans.cohort import scored
from scorefold.plans.panel import HOME, daily
from scorefold.plans.registry import query
from scorefold.sources import standins as V


def responses(spark, sf):
    """Response log with raw text, token counts, declared caps, errors and served identifiers."""
    l, d, m = scored(spark, sf), F.col("item_id"), F.col("model")
    p, c = F.col("probability"), F.col("call")
    both = F.concat(F.lit('{"probability": '), F.format_string("%.2f", p), F.lit(', "fire": '), F.when(c == 1, "true").otherwise("false"), F.when(d % 29 != 0, "}").otherwise(""))
    raw = F.when(p.isNotNull() & c.isNotNull(), both).when(p.isNotNull(), F.concat(F.lit('{"probability": '), F.format_string("%.2f", p), F.lit("}")))
    raw = F.coalesce(raw, F.when(d % 34 == 0, "").when(d % 51 == 0, '{"probability": ').otherwise("no idea"))
    tokens = F.when(d % 10 == 0, 1024).otherwise((d * 31 + m * 17) % 300 + 50)
    tokens = F.when((m == 3) & (tokens == 1024), 700 + d % 90).otherwise(tokens)
    return (
        l.withColumn("raw", raw).withColumn("completion_tokens", F.when(d % 41 != 0, tokens))
        .withColumn("max_out", F.lit(1024).cast("bigint")).withColumn("error", F.when((d % 19 == 0) & (m == 1), "timeout"))
        .withColumn("reasoning_tokens", F.when((m != 2) | (d % 7 != 0), (d * 13 + m) % 211)).withColumn("answered", p.isNotNull() & c.isNotNull())
        .withColumn("served", F.concat(F.lit("m"), m.cast("string"), F.when((m == 1) & (d % 100 > 50), "-b").otherwise("-a")))
    )


RESP = V.PAIRED + """,
resp AS (SELECT *, CAST(CASE WHEN item_id % 41 <> 0 THEN CASE WHEN item_id % 10 = 0 THEN CASE WHEN model = 3 THEN 700 + item_id % 90 ELSE 1024 END ELSE (item_id * 31 + model * 17) % 300 + 50 END END AS BIGINT) AS completion_tokens,
  CAST(1024 AS BIGINT) AS max_out, CASE WHEN item_id % 19 = 0 AND model = 1 THEN 'timeout' END AS error,
  CASE WHEN model <> 2 OR item_id % 7 <> 0 THEN (item_id * 13 + model) % 211 END AS reasoning_tokens, probability IS NOT NULL AND call IS NOT NULL AS answered,
  'm' || model || CASE WHEN model = 1 AND item_id % 100 > 50 THEN '-b' ELSE '-a' END AS served,
  CASE WHEN probability IS NOT NULL AND call IS NOT NULL THEN '{"probability": ' || printf('%.2f', probability) || ', "fire": ' || CASE WHEN call = 1 THEN 'true' ELSE 'false' END || CASE WHEN item_id % 29 <> 0 THEN '}' ELSE '' END
   WHEN probability IS NOT NULL THEN '{"probability": ' || printf('%.2f', probability) || '}' WHEN item_id % 34 = 0 THEN '' WHEN item_id % 51 = 0 THEN '{"probability": ' ELSE 'no idea' END AS raw,
  CASE WHEN probability IS NOT NULL AND call IS NOT NULL THEN 'answered' WHEN probability IS NOT NULL OR call IS NOT NULL THEN 'partial' ELSE 'failed' END AS state FROM scored),
capt AS (SELECT model, arm, completion_tokens, count(*) AS n FROM resp WHERE completion_tokens IS NOT NULL GROUP BY ALL),
cap0 AS (SELECT model, arm, max(completion_tokens) AS top, arg_max(n, completion_tokens) AS at_top FROM capt GROUP BY ALL),
cap1 AS (SELECT model, arm, median(completion_tokens) AS med, max(max_out) AS declared FROM resp GROUP BY ALL),
caps AS (SELECT cap0.model, cap0.arm, CAST(CASE WHEN at_top >= 2 AND top >= 2 * greatest(med, 1) THEN top ELSE declared END AS BIGINT) AS cap,
  CAST(CASE WHEN at_top >= 2 AND top >= 2 * greatest(med, 1) THEN greatest(4, round_even(0.01 * top, 0)) ELSE greatest(4, round_even(0.02 * declared, 0)) END AS BIGINT) AS tol,
  CASE WHEN at_top >= 2 AND top >= 2 * greatest(med, 1) THEN 1 ELSE 0 END AS observed FROM cap0 JOIN cap1 ON cap0.model = cap1.model AND cap0.arm = cap1.arm),
marked AS (SELECT resp.*, cap, tol, coalesce(completion_tokens >= cap - tol, false) AS at_cap,
  CASE WHEN state <> 'answered' THEN CASE WHEN coalesce(error, '') <> '' THEN 'error_field' WHEN coalesce(completion_tokens >= cap - tol, false) THEN CASE WHEN trim(raw) = '' THEN 'output_cap_empty_body' ELSE 'output_cap_truncated_text' END
   WHEN trim(raw) = '' THEN 'empty_body' WHEN raw LIKE '%}' THEN 'schema_field_missing:' || array_to_string(list_filter([CASE WHEN probability IS NULL THEN 'probability' END, CASE WHEN call IS NULL THEN 'call' END], lambda x: x IS NOT NULL), ',')
   ELSE 'unparsable_nonempty' END END AS cause FROM resp JOIN caps ON resp.model = caps.model AND resp.arm = caps.arm)"""

BY, FIELDS = ["model", "arm"], ["probability", "call"]


def marked(spark, sf):
    return A.with_failures(responses(spark, sf), BY, FIELDS)


@query("answer_state", f"WITH {RESP} SELECT model, arm, state, count(*) AS n FROM resp GROUP BY ALL")
def _(spark, sf):
    return responses(spark, sf).groupBy(*BY, A.answer_state(FIELDS).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("infer_cap", f"WITH {RESP} SELECT model, arm, cap, tol, observed FROM caps")
def _(spark, sf):
    return A.infer_cap(responses(spark, sf), BY, "completion_tokens", "max_out")


@query("failure_cause", f"WITH {RESP} SELECT model, arm, cause, count(*) AS n FROM marked WHERE cause IS NOT NULL GROUP BY ALL")
def _(spark, sf):
    return marked(spark, sf).where("cause is not null").groupBy(*BY, "cause").agg(F.count(F.lit(1)).alias("n"))


@query("failure_table", f"""WITH {RESP} SELECT model, arm, count(*) AS attempted, count(*) FILTER (state = 'answered') AS answered, count(*) FILTER (state = 'partial') AS partial, count(*) FILTER (state = 'failed') AS failed,
round(count(*) FILTER (state = 'failed') / count(*)::DOUBLE, 6) AS failure_rate, count(*) FILTER (cause = 'error_field') AS error_field, count(*) FILTER (cause LIKE 'output_cap%') AS output_cap, count(*) FILTER (cause = 'empty_body') AS empty_body,
count(*) FILTER (cause LIKE 'schema_field%') AS field_missing, count(*) FILTER (cause LIKE 'unparsable%') AS unparsable, count(*) FILTER (state = 'answered' AND item_id % 29 = 0) AS cut_but_scored, count(*) FILTER (state = 'answered' AND item_id % 29 = 0 AND at_cap) AS cut_at_cap,
count(*) FILTER (item_id % 37 = 0) AS duplicates FROM marked GROUP BY ALL""")
def _(spark, sf):
    log = responses(spark, sf).withColumn("at", F.lit(1))
    old = log.where("item_id % 37 = 0").withColumns({"at": F.lit(0), "probability": F.lit(None).cast("double"), "raw": F.lit(""), "error": F.lit("timeout")})  # replaced rows
    return S.rounded(A.failure_table(log.unionByName(old), BY, FIELDS, "item_id", "at"))


@query("failure_examples", f"WITH {RESP}, r AS (SELECT model, arm, cause, item_id, row_number() OVER (PARTITION BY model, arm, cause ORDER BY item_id) AS example FROM marked WHERE cause IS NOT NULL) SELECT model, arm, cause, item_id, CAST(example AS INTEGER) AS example FROM r WHERE example <= 3")
def _(spark, sf):
    return A.failure_examples(marked(spark, sf), BY, "item_id").select(*BY, "cause", "item_id", "example")


@query("imputation_check", f"""WITH {RESP} SELECT model, arm, count(*) FILTER (call IS NULL AND probability IS NOT NULL) AS imputed, round(avg(CAST(said = label AS INTEGER)) FILTER (call IS NULL AND probability IS NOT NULL), 6) AS imputed_accuracy,
count(*) FILTER (answered) AS full, round(avg(CAST(said = label AS INTEGER)) FILTER (answered), 6) AS full_accuracy FROM resp GROUP BY ALL""".replace(" AS full,", ' AS "full",'))
def _(spark, sf):
    return S.rounded(A.imputation_check(responses(spark, sf), BY))


@query("truncations", f"WITH {RESP} SELECT model, arm, count(*) FILTER (completion_tokens >= max_out) AS cut, count(*) FILTER (completion_tokens >= max_out AND answered) AS cut_answered, count(*) FILTER (completion_tokens >= max_out AND NOT answered) AS cut_unanswered FROM resp GROUP BY ALL")
def _(spark, sf):
    return A.truncations(responses(spark, sf), BY, "completion_tokens", "max_out", F.col("answered"))


TOK = """tok AS (SELECT model, arm, count(*) AS n, count(reasoning_tokens) AS n_reasoning, count(*) FILTER (completion_tokens >= max_out - 16) AS near_cap, count(*) FILTER (completion_tokens >= max_out - 16 AND answered) AS near_cap_answered,
median(reasoning_tokens) AS median_reasoning, median(completion_tokens) AS median_completion, CAST(list_extract(list_sort(list(reasoning_tokens) FILTER (reasoning_tokens IS NOT NULL)), CAST(floor(0.9::DOUBLE * (count(reasoning_tokens) - 1)) AS BIGINT) + 1) AS DOUBLE) AS p90_reasoning FROM resp GROUP BY ALL),
tokc AS (SELECT *, CASE WHEN n = n_reasoning THEN CAST(CAST(floor(median_reasoning + 0.5) AS BIGINT) AS VARCHAR) ELSE 'n/r' END AS table_cell FROM tok)"""


def toks(spark, sf):
    return S.token_stats(responses(spark, sf), BY, "reasoning_tokens", "completion_tokens", "max_out", 16)


@query("token_stats", f"WITH {RESP}, {TOK} SELECT * FROM tokc")
def _(spark, sf):
    return toks(spark, sf)


@query("model_token_summary", f"""WITH {RESP}, {TOK} SELECT model, min(CAST(floor(median_reasoning + 0.5) AS BIGINT)) FILTER (table_cell <> 'n/r') AS cell_min, max(CAST(floor(median_reasoning + 0.5) AS BIGINT)) FILTER (table_cell <> 'n/r') AS cell_max,
count(*) FILTER (table_cell = 'n/r') AS cells_not_reported, CAST(sum(n) AS BIGINT) AS responses, CAST(sum(n_reasoning) AS BIGINT) AS responses_with_reasoning,
coalesce(string_agg(arm || '=' || near_cap, ',' ORDER BY arm) FILTER (near_cap > 0), '') AS near_cap FROM tokc GROUP BY model""")
def _(spark, sf):
    m = S.model_token_summary(toks(spark, sf), ["model"], ["arm"])
    txt = F.array_join(F.transform(F.array_sort(F.map_entries("near_cap")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return m.withColumn("near_cap", txt)


@query("served_identity_audit", f"WITH {RESP} SELECT model, arm, count(*) AS rows, count(DISTINCT served) AS identifiers, min(served) AS first_identifier, CASE WHEN count(DISTINCT served) > 1 THEN 1 ELSE 0 END AS mixed FROM resp GROUP BY ALL")
def _(spark, sf):
    return A.served_identity(responses(spark, sf), BY, "served")


@query("served_by_section", f"WITH {RESP}, f AS (SELECT arm, model, count(*) AS r, count(DISTINCT served) AS i FROM resp GROUP BY ALL) SELECT arm, count(*) AS files, CAST(sum(r) AS BIGINT) AS responses, count(*) FILTER (i = 1) AS uniform_files FROM f GROUP BY arm")
def _(spark, sf):
    return A.served_by_section(responses(spark, sf), "arm", ["model"], "served")


@query("served_by_model", f"WITH {RESP}, f AS (SELECT model, served, count(*) AS r FROM resp GROUP BY ALL) SELECT f.model, string_agg(served || '=' || r, ', ' ORDER BY served) AS identifiers, CAST(sum(r) AS BIGINT) AS responses, max(files) AS files FROM f JOIN (SELECT model, count(DISTINCT arm) AS files FROM resp GROUP BY model) n ON n.model = f.model GROUP BY f.model")
def _(spark, sf):
    return A.served_by_model(responses(spark, sf), "model", ["arm"], "served")


@query("answer_counts", f"WITH {RESP} SELECT model, arm, count(*) AS n, count(*) FILTER (error IS NOT NULL) AS errors, count(*) FILTER (probability IS NULL AND error IS NULL) AS unparsed, count(*) FILTER (completion_tokens >= max_out) AS truncated, round(avg(item_id % 4), 6) AS mean_calls, count(*) FILTER (item_id % 4 = 0) AS no_call_items FROM resp GROUP BY ALL")
def _(spark, sf):
    log = responses(spark, sf).withColumn("stop", F.when(F.col("completion_tokens") >= F.col("max_out"), "length").otherwise("end")).withColumn("calls", F.col("item_id") % 4)
    return S.rounded(S.answer_counts(log, BY, "probability", "error", "stop", "calls"))


@query("label_alignment", f"WITH {RESP} SELECT model, arm, count(*) AS rows, count(DISTINCT item_id) AS ids, 0::BIGINT AS unknown, 0::BIGINT AS label_conflicts, 0::BIGINT AS reparse_conflicts FROM resp GROUP BY ALL")
def _(spark, sf):
    again = X.parse_prob_call("raw")["probability"]
    return A.label_alignment(responses(spark, sf), V.paired_items(spark, sf), "item_id", BY, again, "probability", "label")


# --- item tables ------------------------------------------------------------------------------------------------------
@query("valid_records", """WITH r AS (SELECT *, CASE WHEN acctbal IS NULL OR acctbal <= 0 THEN 'not positive' WHEN seg NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN 'other segment' WHEN nk > 20 THEN 'outside' END AS reason FROM (SELECT c_acctbal AS acctbal, c_mktsegment AS seg, c_nationkey AS nk FROM customer))
SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM r GROUP BY ALL""")
def _(spark, sf):
    c = V.table(spark, sf, "customer")
    checks = [("not positive", F.coalesce(F.col("c_acctbal") <= 0, F.lit(True))), ("other segment", ~F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "HOUSEHOLD")), ("outside", F.col("c_nationkey") > 20)]
    kept, dropped = A.valid_records(c, checks)
    return dropped.unionByName(kept.agg(F.count(F.lit(1)).alias("n")).withColumn("reason", F.lit("kept")))


@query("leak_check", "SELECT 'lang' AS key, count(*) AS items FROM documents UNION ALL SELECT 'score', count(*) FROM documents WHERE source = 'src3'")
def _(spark, sf):
    d = V.table(spark, sf, "documents").withColumn("score", F.when(F.col("source") == "src3", 1)).withColumn("inner", F.struct("score", "n_chars"))
    return A.leak_check(d, ["lang", "inner"], ["lang", "score", "answer"])


@query("shape_check", f"""WITH {V.DRIVER_DAYS}, w AS (SELECT sample, count(*) AS n, min(day) AS a, max(day) AS b, sum(CASE WHEN click > 60 THEN 1 ELSE 0 END) AS hot FROM ddays GROUP BY sample)
SELECT count(*) AS rows, count(*) FILTER (n <> 30) AS length, count(*) FILTER (b - a <> 29) AS span, count(*) FILTER (NOT hot > 0) AS label FROM w""")
def _(spark, sf):
    w = P.window_arrays(V.driver_days(spark, sf), V.DRIVERS)
    return A.count_violations(w, {"length": F.size("click") == 30, "span": F.datediff("window_end", "window_start") == 29, "label": F.exists("click", lambda x: x > 60)})


@query("integrity_check", "SELECT lang, count(*) AS rows, count(*) FILTER (text IS NULL OR trim(text) = '') AS empty_text, count(*) FILTER (source IS NULL) AS no_source, count(*) FILTER (NOT source IN ('src0', 'src1', 'src2', 'src3')) AS not_an_option FROM documents GROUP BY lang")
def _(spark, sf):
    d = V.table(spark, sf, "documents")
    return A.count_violations(d, {"empty_text": F.trim("text") != "", "no_source": F.col("source").isNotNull(), "not_an_option": F.col("source").isin("src0", "src1", "src2", "src3")}, ["lang"])


@query("duplicate_values", "SELECT md5(text) AS question, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def _(spark, sf):
    d = V.table(spark, sf, "documents")
    return A.duplicate_values(d.select(F.md5("text").alias("question")), ["question"])


@query("missingness_profile", f"WITH {V.DRIVER_DAYS} " + " UNION ALL ".join(f"SELECT '{d}' AS driver, count(*) AS days, round(count(*) FILTER ({d} IS NULL) / count(*)::DOUBLE, 6) AS missing_share FROM ddays" for d in V.DRIVERS))
def _(spark, sf):
    return S.rounded(A.missingness_profile(P.window_arrays(V.driver_days(spark, sf), V.DRIVERS), V.DRIVERS))


COLS = ("personnel", "acres", "pct", "new_acres", "aerial")


@query("profile_columns", f"WITH {V.REPORTS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column, count(*) AS rows, count(*) FILTER ({c} IS NULL) AS nulls, count(*) FILTER ({c} <> 0) AS non_zero, round(min({c}), 6) AS low, round(max({c}), 6) AS high, round(median({c}), 6) AS median, round(quantile_cont({c}, 0.9), 6) AS p90, count(DISTINCT {c}) AS distinct_values FROM reports" for c in COLS).replace(" AS column,", ' AS "column",'))
def _(spark, sf):
    return S.rounded(A.profile_columns(V.reports(spark, sf), COLS))


@query("incident_profile", f"WITH {V.REPORTS} SELECT incident_id, count(DISTINCT report_date) AS days, CAST(min(report_date) AS VARCHAR) AS first_day, CAST(max(report_date) AS VARCHAR) AS last_day, max(personnel) AS peak, arg_min(state, report_date) AS first_state FROM daily GROUP BY ALL")
def _(spark, sf):
    p = A.incident_profile(daily(spark, sf))
    return p.withColumns({"first_day": F.col("first_day").cast("string"), "last_day": F.col("last_day").cast("string")})


@query("incident_length_counts", f"""WITH {V.REPORTS}, p AS (SELECT incident_id, count(DISTINCT report_date) AS days, arg_min(state, report_date) AS first_state, min(start_year) AS year FROM daily GROUP BY ALL)
SELECT CAST(2012 + incident_id % 9 AS BIGINT) AS year, count(*) AS incidents, count(*) FILTER (days >= 10) AS days_10, count(*) FILTER (days >= 20) AS days_20, count(*) FILTER (days >= 15 AND first_state <> {HOME}) AS days_15_away FROM p GROUP BY 1""")
def _(spark, sf):
    return A.incident_length_counts(A.incident_profile(daily(spark, sf)), F.col("incident_id") % 9 + 2012, HOME)


LANGS = ["de", "en", "es", "fr"]


TAGS = ["the", "les", "der", "los", "and"]
LETTER = r"[\p{L}\p{M}\p{N}_]"  # what a word is made of; `\b` knows ASCII letters only in DuckDB and in later Javas, and finds `les` in `modèles`


@query("tag_crosstab", f"""WITH e AS (SELECT DISTINCT doc_id, tag, lang FROM (SELECT doc_id, lang, unnest([w FOR w IN regexp_extract_all(lower(text), '{LETTER}+') IF w IN ({', '.join(f"'{t}'" for t in TAGS)})]) AS tag FROM documents))
SELECT coalesce(tag, 'all') AS tag, """ + ", ".join(f"count(*) FILTER (lang = '{l}') AS {l}" for l in LANGS) + """, count(*) AS "all" FROM e GROUP BY ROLLUP (tag)""")
def _(spark, sf):
    d = V.table(spark, sf, "documents")
    whole = rf"(?<!{LETTER})(?:{'|'.join(TAGS)})(?!{LETTER})"
    tags = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(whole), F.lit(0)))
    return A.tag_crosstab(d.withColumn("tags", tags), "tags", "lang", LANGS)


@query("published_check", """WITH g AS (SELECT l_returnflag AS k, round(avg(l_discount), 6) AS v FROM lineitem GROUP BY ALL) SELECT k, 0.05::DOUBLE AS expected, 0.00001::DOUBLE AS tol, v AS got FROM g WHERE abs(v - 0.05) > 0.00001""")
def _(spark, sf):
    g = V.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(F.round(F.avg("l_discount"), 6).alias("value"))
    exp = g.select("k", F.lit(0.05).alias("value"), F.lit(0.00001).alias("tol"))
    return A.published_check(g, exp, ["k"])


# --- small column functions -------------------------------------------------------------------------------------------
@query("offset_bucket", f"WITH {V.FRAMES} SELECT (CASE WHEN offset_seconds > 0 THEN 'after' ELSE 'before' END) || ' ' || CASE WHEN abs(offset_seconds) <= 600 THEN '0 to 10 min' WHEN abs(offset_seconds) <= 1500 THEN '10 to 25 min' ELSE '25 min or more' END AS bucket, count(*) AS n FROM frames GROUP BY 1")
def _(spark, sf):
    return V.frames(spark, sf).groupBy(C.offset_bucket("offset_seconds").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("recall_risk", "SELECT o_orderstatus, CASE WHEN o_totalprice >= 100000 THEN 'high' WHEN o_totalprice >= 10000 THEN 'moderate' ELSE 'low' END AS risk, count(*) AS n FROM orders GROUP BY ALL")
def _(spark, sf):
    return V.table(spark, sf, "orders").groupBy("o_orderstatus", C.recall_risk("o_totalprice").alias("risk")).agg(F.count(F.lit(1)).alias("n"))


@query("path_parts", r"SELECT page_id, split_part(p, '/', 1) AS site, split_part(p, '/', 2) AS unit, list_extract(string_split(p, '/'), -1) AS file FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS p FROM pages)")
def _(spark, sf):
    p = V.table(spark, sf, "pages").withColumn("p", C.path_parts(F.regexp_replace("url", r"^https?://", "")))
    return p.select("page_id", "p.site", F.coalesce("p.unit", F.lit("")).alias("unit"), "p.file")


@query("event_key", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def _(spark, sf):
    o = V.table(spark, sf, "orders")
    seq = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), F.lit("site_"), F.col("o_custkey").cast("string"), F.lit("_cam"), (F.col("o_orderkey") % 3).cast("string"))
    return o.groupBy(F.regexp_extract(C.event_key(seq), r"site_(\d+)", 1).cast("bigint").alias("o_custkey")).agg(F.count(F.lit(1)).alias("n"))


@query("incident_from_id", f"WITH {V.REPORTS} SELECT CAST(incident_id AS VARCHAR) AS incident, count(*) AS n FROM daily GROUP BY 1")
def _(spark, sf):
    d = daily(spark, sf).withColumn("item_id", F.concat_ws("-", F.lit("alloc"), F.col("incident_id").cast("string"), F.col("report_date").cast("string")))
    return d.groupBy(C.incident_from_id("item_id").alias("incident")).agg(F.count(F.lit(1)).alias("n"))


@query("block_key", """SELECT CAST(CAST(floor((o_totalprice / 1000 - 250) / 25) AS BIGINT) AS VARCHAR) || '/' || CAST(CAST(floor((o_custkey % 90 - 45) / 25.0) AS BIGINT) AS VARCHAR) || '@' || strftime(o_orderdate, '%Y-%m') AS block, count(*) AS n FROM orders GROUP BY 1""")
def _(spark, sf):
    o = V.table(spark, sf, "orders")
    k = C.block_key(F.col("o_totalprice") / 1000 - 250, F.col("o_custkey") % 90 - 45, F.to_date("o_orderdate"), 25.0)
    return o.groupBy(k.alias("block")).agg(F.count(F.lit(1)).alias("n"))


@query("sig_round", "SELECT l_orderkey, l_linenumber, CAST(printf('%.3e', sqrt(l_extendedprice)) AS DOUBLE) AS v FROM lineitem")
def _(spark, sf):
    return V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", C.sig_round(F.sqrt("l_extendedprice"), 4).alias("v"))


HEX = "0123456789abcdef"


@query("stable_fold", f"""WITH h AS (SELECT doc_id, sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents)
SELECT doc_id, CAST((6 * list_sum([strpos('{HEX}', substr(h, CAST(i AS BIGINT), 1)) - 1 FOR i IN range(1, 64)]) + strpos('{HEX}', substr(h, 64, 1)) - 1) % 10 AS INTEGER) AS fold FROM h""")
def _(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", C.stable_fold("doc_id").alias("fold"))


@query("stable_seed", """WITH b AS (SELECT doc_id, concat_ws('|', source, lang, doc_id) AS t FROM documents),
x AS (SELECT doc_id, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(t) + 1), lambda i: CAST(ord(t[i]) AS BIGINT))),
 lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))) AS r FROM b)
SELECT doc_id, (20260915 + xor(r, 4294967295::BIGINT)) % 4294967296 AS seed FROM x""")
def _(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", C.stable_seed(20260915, "source", "lang", "doc_id").alias("seed"))


@query("impute_call", f"WITH {V.PAIRED} SELECT model, arm, said, count(*) AS n, round(sum(score), 6) AS total FROM scored WHERE said IS NOT NULL GROUP BY ALL")
def _(spark, sf):
    return S.rounded(scored(spark, sf).where("said is not null").groupBy("model", "arm", "said").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total")))


@query("moved", f"WITH {V.NUMERIC} SELECT run, count(*) FILTER (abs(target - persistence) / greatest(persistence, 1) > 0.1) AS moved, count(*) AS n FROM nlog GROUP BY run")
def _(spark, sf):
    return V.numeric_log(spark, sf).groupBy("run").agg(S.count_if(C.moved("target", "persistence")).alias("moved"), F.count(F.lit(1)).alias("n"))


@query("rounding_kinds", "SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity / 2 + 0.5) AS BIGINT) AS half_up, round_even(l_quantity / 2, 0) AS half_even, CAST(printf('%.1f', l_discount + 0.03) AS DOUBLE) AS shown FROM lineitem")
def _(spark, sf):
    l = V.table(spark, sf, "lineitem")
    return l.select("l_orderkey", "l_linenumber", C.round_half_up(F.col("l_quantity") / 2).alias("half_up"), C.round_half_even(F.col("l_quantity") / 2).alias("half_even"), C.shown(F.col("l_discount") + 0.03, 1).alias("shown"))


@query("series_summary", f"""WITH {V.DRIVER_DAYS}, r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY day DESC) AS back FROM ddays)
SELECT sample, round(avg(click), 6) AS mean, round(min(click), 6) AS low, round(max(click), 6) AS high, count(click) AS n, round(coalesce(sum(click) FILTER (back <= 6), 0), 6) AS last_sum, min(back) FILTER (click IS NOT NULL) - 1 AS days_back FROM r GROUP BY sample""")
def _(spark, sf):
    w = P.window_arrays(V.driver_days(spark, sf), V.DRIVERS).withColumn("s", AR.series_summary("click"))
    return w.select("sample", *[F.round(f"s.{c}", 6).alias(c) for c in ("mean", "low", "high")], "s.n", F.round(F.aggregate("s.last", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))), 6).alias("last_sum"), S.last_valid("click")["days_back"].alias("days_back"))


@query("observed_days", f"WITH {V.DRIVER_DAYS} SELECT sample, count(error) AS error_days, count(view) AS view_days FROM ddays GROUP BY sample")
def _(spark, sf):
    return P.window_arrays(V.driver_days(spark, sf), V.DRIVERS).select("sample", AR.observed_days("error").alias("error_days"), AR.observed_days("view").alias("view_days"))


FEATS = ["f_pers", "f_acres", "f_pct", "f_day", "f_change", "f_new", "f_aerial"]
FEAT_SQL = """CASE WHEN prev IS NOT NULL THEN ln(greatest(today, 1) / greatest(prev, 1)) END AS f_change, ln(greatest(today, 1)) AS f_pers, CASE WHEN acres IS NOT NULL THEN ln(1 + greatest(acres, 0)) END AS f_acres,
 CASE WHEN pct IS NOT NULL THEN least(greatest(pct, 0), 100) END AS f_pct, ln(greatest(day_of_run, 1)) AS f_day, CASE WHEN new_acres IS NOT NULL THEN ln(1 + greatest(new_acres, 0)) END AS f_new, CASE WHEN aerial IS NOT NULL THEN ln(1 + greatest(aerial, 0)) END AS f_aerial"""


@query("report_features", f"WITH {V.PAIRS}, f AS (SELECT analogue_id, {FEAT_SQL} FROM pairs) SELECT analogue_id, " + ", ".join(f"round({f}, 6) AS {f}" for f in FEATS) + " FROM f")
def _(spark, sf):
    from scorefold.plans.panel import pairs

    p = pairs(spark, sf)
    return p.select("analogue_id", *[F.round(c, 6).alias(n) for n, c in AR.report_features().items()])


@query("lin_features", f"""WITH {V.PAIRS}, f AS (SELECT *, CASE WHEN prev IS NULL THEN 0 ELSE greatest(-1.5, least(1.5, ln(greatest(today, 1) / greatest(prev, 1)))) END AS rc FROM pairs)
SELECT analogue_id, round(rc, 6) AS recent_change, CASE WHEN rc = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS flat_yesterday, round(CASE WHEN acres >= 0 THEN ln(1 + acres) ELSE 0 END, 6) AS log1p_acres, CASE WHEN acres IS NULL THEN 1.0::DOUBLE ELSE 0.0 END AS acres_missing,
CASE WHEN pct < 10 THEN 1.0::DOUBLE ELSE 0.0 END AS pct_band_0, CASE WHEN pct >= 90 THEN 1.0::DOUBLE ELSE 0.0 END AS pct_band_4, CASE WHEN pct IS NULL THEN 1.0::DOUBLE ELSE 0.0 END AS pct_missing FROM f""")
def _(spark, sf):
    from scorefold.plans.panel import pairs

    f = AR.lin_features()
    want = ["recent_change", "flat_yesterday", "log1p_acres", "acres_missing", "pct_band_0", "pct_band_4", "pct_missing"]
    return pairs(spark, sf).select("analogue_id", *[F.round(f[n], 6).alias(n) for n in want])


CLS = """cls AS (SELECT *, CASE WHEN prev IS NOT NULL THEN today / greatest(prev, 1) END AS r FROM pairs),
cl AS (SELECT *, CASE WHEN r IS NULL THEN 'u' WHEN r < 1 - 0.1::DOUBLE THEN 'f' WHEN r > 1 + 0.1::DOUBLE THEN 'r' ELSE 'h' END AS p3, CASE WHEN r IS NULL THEN 'u' WHEN r < 0.75 THEN 'F' WHEN r < 1 - 0.1::DOUBLE THEN 'f' WHEN r > 1.25 THEN 'R' WHEN r > 1 + 0.1::DOUBLE THEN 'r' ELSE 'h' END AS p5,
 CASE WHEN acres IS NOT NULL AND acres_prev IS NOT NULL THEN CASE WHEN acres > acres_prev THEN 'y' ELSE 'n' END WHEN new_acres IS NOT NULL THEN CASE WHEN new_acres > 0 THEN 'y' ELSE 'n' END ELSE 'u' END AS a FROM cls),
cx AS (SELECT *, CASE WHEN r IS NULL THEN 'u' WHEN today = prev THEN CASE WHEN prev2 = today THEN 'ee' ELSE 'e' END WHEN p3 = 'h' THEN 's' ELSE p3 END AS p5s FROM cl)"""


@query("change_class", f"WITH {V.PAIRS}, {CLS} SELECT p3, p5, p5s, a, count(*) AS n FROM cx GROUP BY ALL")
def _(spark, sf):
    from scorefold.plans.panel import pairs

    r = AR.ratio("today", "prev")
    return pairs(spark, sf).groupBy(AR.change_class(r).alias("p3"), AR.change_class(r, 5).alias("p5"), AR.streak_class("today", "prev", "prev2").alias("p5s"), AR.grew("acres", "acres_prev", "new_acres").alias("a")).agg(F.count(F.lit(1)).alias("n"))


@query("closed_form_rule", """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN CASE WHEN o_totalprice < 100000 THEN 'none' WHEN o_totalprice < 300000 THEN 'smoldering' ELSE 'flaming' END
WHEN '2-HIGH' THEN CASE WHEN o_totalprice < 200000 THEN 'no' ELSE 'yes' END ELSE '' END AS answer FROM orders""")
def _(spark, sf):
    v = F.col("o_totalprice")
    rules = {"1-URGENT": F.when(v < 100000, "none").when(v < 300000, "smoldering").otherwise("flaming"), "2-HIGH": F.when(v < 200000, "no").otherwise("yes")}
    return V.table(spark, sf, "orders").select("o_orderkey", F.coalesce(C.rule_table("o_orderpriority", rules), F.lit("")).alias("answer"))


@query("at_ceiling", "SELECT l_returnflag, count(*) FILTER (abs(l_discount - 0.1) < 5e-4) AS clipped, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark, sf):
    return V.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(S.count_if(C.at_ceiling("l_discount", 0.1)).alias("clipped"), F.count(F.lit(1)).alias("n"))


@query("usage_tokens", "SELECT event_type, count(*) AS n, CAST(sum(coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0)) AS BIGINT) AS total, count(*) FILTER (json_extract_string(props, '$.stop') IS NULL) AS no_reason FROM events GROUP BY ALL")
def _(spark, sf):
    e = V.table(spark, sf, "events").withColumn("usage", F.from_json("props", "completion_tokens bigint, output_tokens bigint, k bigint, stop string"))
    used = F.coalesce("usage.completion_tokens", "usage.output_tokens", "usage.k", F.lit(0))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(used).alias("total"), S.count_if(F.col("usage.stop").isNull()).alias("no_reason"))
