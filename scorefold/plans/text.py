"""Queries over text: answers built from whole document texts, logged queries, redaction and prompts."""

from pyspark.sql import functions as F

from scorefold.functions import columns as C
from scorefold.functions import text as X
from scorefold.operators import audit as A
from scorefold.operators import cohort as K
from scorefold.operators import panel as P
from scorefold.operators import scores as S
from scorefold.plans.panel import ITEMS, runs
from scorefold.plans.registry import query
from scorefold.sources import standins as V

OPTIONS = ["en", "src1", "src11", "mixed"]
KINDS = ["integer", "acres", "percent", "categorical", "string"]
KIND_SQL = "CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"


def shaped(d):
    """Answer texts of every shape the parsers meet, each carrying the whole document text in front."""
    n, i, t, s = F.col("n_chars"), F.col("doc_id"), F.col("text"), F.col("source")
    fold = F.regexp_replace(t, "\r", "")
    return d.withColumn(
        "raw",
        F.when(i % 11 == 0, F.concat(fold, F.lit("\nANSWER: "), n.cast("string")))
        .when(i % 11 == 1, F.concat(fold, F.lit("\nANSWER: the total is "), n.cast("string"), F.lit(",250.5 acres")))
        .when(i % 11 == 2, F.concat(F.lit("answer : none\n"), fold, F.lit("\n  Answer: "), (n % 100).cast("string"), F.lit("."), (i % 10).cast("string"), F.lit("%")))
        .when(i % 11 == 3, F.concat(fold, F.lit("\nANSWER: unknown.")))
        .when(i % 11 == 4, fold)
        .when(i % 11 == 5, F.lit("  "))
        .when(i % 11 == 6, F.concat(fold, F.lit(" so the ANSWER: "), s))
        .when(i % 11 == 7, F.concat(fold, F.lit("\nANSWER: '"), s, F.lit("'.")))
        .when(i % 11 == 8, F.concat(fold, F.lit("\nANSWER: it is "), F.upper(s), F.lit(" here")))
        .when(i % 11 == 9, F.concat(F.lit("I count "), n.cast("string"), F.lit(" then -"), (i % 97).cast("string"), F.lit("\n\n")))
        .otherwise(F.lit(None).cast("string")),
    ).withColumn("kind", F.element_at(F.array(*[F.lit(k) for k in KINDS]), (i % 5 + 1).cast("int")))


SHAPED = f"""d0 AS (SELECT *, replace(text, chr(13), '') AS fold FROM documents),
shaped AS (SELECT *, CASE doc_id % 11
 WHEN 0 THEN fold || chr(10) || 'ANSWER: ' || n_chars WHEN 1 THEN fold || chr(10) || 'ANSWER: the total is ' || n_chars || ',250.5 acres'
 WHEN 2 THEN 'answer : none' || chr(10) || fold || chr(10) || '  Answer: ' || (n_chars % 100) || '.' || (doc_id % 10) || '%'
 WHEN 3 THEN fold || chr(10) || 'ANSWER: unknown.' WHEN 4 THEN fold WHEN 5 THEN '  ' WHEN 6 THEN fold || ' so the ANSWER: ' || source
 WHEN 7 THEN fold || chr(10) || 'ANSWER: ''' || source || '''.' WHEN 8 THEN fold || chr(10) || 'ANSWER: it is ' || upper(source) || ' here'
 WHEN 9 THEN 'I count ' || n_chars || ' then -' || (doc_id % 97) || chr(10) || chr(10) END AS raw, {KIND_SQL} AS kind FROM d0)"""

NUM = r"[-+]?\d{1,3}(?:,\d{3})+(?:\.\d+)?|[-+]?\d+(?:\.\d+)?"
STRIP = """' ' || chr(9) || chr(10) || chr(13) || '''"`.:;,*()[]{}'"""
TYPED = SHAPED + f""",
c0 AS (SELECT *, trim(raw) AS t, trim(coalesce(list_extract(regexp_extract_all(trim(raw), '(?im)^\\s*ANSWER\\s*:\\s*(.+)$', 1), -1),
  list_extract(regexp_extract_all(trim(raw), '(?i)ANSWER\\s*:\\s*(.+)', 1), -1))) AS cand FROM shaped),
c1 AS (SELECT *, t IS NULL OR t = '' AS blank,
  coalesce(lower(regexp_replace(coalesce(cand, CASE WHEN lower(t) = 'unknown' THEN t END), '[^\\p{{L}}\\p{{N}}_]', '', 'g')) = 'unknown', false) AS unk,
  regexp_extract_all(CASE WHEN kind = 'percent' THEN replace(coalesce(cand, t), '%', ' ') ELSE coalesce(cand, t) END, '{NUM}') AS nums,
  coalesce(cand, list_extract(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> ''), -1)) AS target,
  kind IN ('integer', 'acres', 'percent') AS numeric FROM c0),
c2 AS (SELECT *, trim(target, {STRIP}) AS cleaned, CAST(replace(list_extract(nums, CASE WHEN cand IS NULL THEN -1 ELSE 1 END), ',', '') AS DOUBLE) AS num0 FROM c1),
c3 AS (SELECT *, CASE WHEN kind = 'integer' THEN round_even(num0, 0) ELSE num0 END AS num1,
  unk OR coalesce(NOT numeric AND lower(cleaned) = 'unknown', false) AS unk2,
  coalesce(""" + ", ".join(f"CASE WHEN lower(cleaned) = '{o}' THEN '{o}' END" for o in OPTIONS) + ", " + ", ".join(
    f"CASE WHEN regexp_matches(target, '(?i)(^|[^0-9A-Za-z_]){o}($|[^0-9A-Za-z_])') THEN '{o}' END" for o in sorted(OPTIONS, key=lambda o: -len(o))) + """, cleaned) AS category FROM c2),
typed AS (SELECT *, CASE WHEN NOT blank AND NOT unk2 AND numeric THEN num1 END AS num,
  CASE WHEN NOT blank AND unk2 THEN 'unknown' WHEN NOT blank AND NOT unk2 AND NOT numeric AND cleaned <> '' THEN CASE WHEN kind = 'categorical' THEN category ELSE cleaned END END AS txt,
  CASE WHEN NOT blank AND unk2 THEN 1 ELSE 0 END AS abstained,
  CASE WHEN blank THEN 'parse' WHEN NOT unk2 AND (CASE WHEN numeric THEN num1 IS NULL ELSE cleaned IS NULL OR cleaned = '' END) THEN 'parse' END AS failure FROM c3)"""


def typed(spark, sf):
    d = shaped(V.table(spark, sf, "documents"))
    opts = F.array(*[F.lit(o) for o in OPTIONS])
    return d.withColumn("p", X.parse_typed_answer("raw", "kind", opts)).select("*", "p.num", "p.txt", "p.abstained", "p.failure")


@query("parse_typed_answer", f"WITH {TYPED} SELECT doc_id, kind, num, md5(txt) AS txt, coalesce(abstained, 0) AS abstained, coalesce(failure, '') AS failure FROM typed")
def _(spark, sf):
    return typed(spark, sf).select("doc_id", "kind", "num", F.md5("txt").alias("txt"), F.coalesce("abstained", F.lit(0)).alias("abstained"), F.coalesce("failure", F.lit("")).alias("failure"))


RULES_SQL = "CASE kind WHEN 'integer' THEN 'exact_int' WHEN 'acres' THEN 'relative' WHEN 'percent' THEN 'absolute' WHEN 'categorical' THEN 'categorical_exact' ELSE 'string_normalized' END"
SCORED = TYPED + f""", sc AS (SELECT *, {RULES_SQL} AS rule, CAST(n_chars + doc_id % 2 AS DOUBLE) AS gold FROM typed),
nt AS (SELECT *, trim(regexp_replace(regexp_replace(upper(txt), '[^A-Z0-9]', ' ', 'g'), '\\s+', ' ', 'g')) AS np, trim(regexp_replace(regexp_replace(upper(source), '[^A-Z0-9]', ' ', 'g'), '\\s+', ' ', 'g')) AS ng FROM sc)"""


def with_rule(spark, sf):
    rule = F.element_at(F.create_map(*[F.lit(x) for kv in zip(KINDS, ("exact_int", "relative", "absolute", "categorical_exact", "string_normalized")) for x in kv]), F.col("kind"))
    return typed(spark, sf).withColumn("rule", rule).withColumn("gold", (F.col("n_chars") + F.col("doc_id") % 2).cast("double"))


@query("score_answer", f"""WITH {SCORED} SELECT doc_id, rule, coalesce(CAST(CASE rule WHEN 'exact_int' THEN round_even(num, 0) = gold WHEN 'relative' THEN abs(num - gold) <= greatest(0.005 * abs(gold), 1.0)
WHEN 'absolute' THEN abs(num - gold) <= 0.1::DOUBLE WHEN 'categorical_exact' THEN lower(trim(txt)) = lower(trim(source)) ELSE np = ng END AS INTEGER), 0) AS correct FROM nt""")
def _(spark, sf):
    d = with_rule(spark, sf)
    hit = X.score_answer("rule", "gold", "source", "num", "txt", F.lit(0.005), F.lit(1.0), F.lit(0.1))
    return d.select("doc_id", "rule", hit.alias("correct"))


@query("perturb", f"""WITH {SCORED} SELECT doc_id, rule, round(CASE rule WHEN 'exact_int' THEN round_even(gold, 0) + 2 WHEN 'relative' THEN gold + 2.5 * greatest(0.005 * abs(gold), 1.0) WHEN 'absolute' THEN gold + 2.5 * 0.1::DOUBLE ELSE gold END, 6) AS moved FROM nt""")
def _(spark, sf):
    return with_rule(spark, sf).select("doc_id", "rule", F.round(X.perturb("rule", "gold", F.lit(0.005), F.lit(1.0), F.lit(0.1)), 6).alias("moved"))


@query("norm_text", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(upper(replace(text, 'ß', 'SS')), '[^A-Z0-9]', ' ', 'g'), '\s+', ' ', 'g'))) AS folded FROM documents")
def _(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.md5(X.norm_text("text")).alias("folded"))


JS = """js AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"personnel": ' || CAST(event_id % 3000 AS VARCHAR) || ', "reasoning": "x"}' WHEN 1 THEN 'about 1,' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') || ' people'
 WHEN 2 THEN props WHEN 3 THEN 'none' ELSE '{"probability": 0.' || CAST(event_id % 10 AS VARCHAR) || ', "fire": ' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'False' END || '}' END AS raw FROM events)"""


def js(spark, sf):
    i = F.col("event_id")
    s = lambda x: x.cast("string")
    return V.table(spark, sf, "events").select(
        "event_id",
        F.when(i % 5 == 0, F.concat(F.lit('{"personnel": '), s(i % 3000), F.lit(', "reasoning": "x"}')))
        .when(i % 5 == 1, F.concat(F.lit("about 1,"), F.lpad(s(i % 1000), 3, "0"), F.lit(" people")))
        .when(i % 5 == 2, F.col("props")).when(i % 5 == 3, "none")
        .otherwise(F.concat(F.lit('{"probability": 0.'), s(i % 10), F.lit(', "fire": '), F.when(i % 2 == 0, "true").otherwise("False"), F.lit("}"))).alias("raw"))


@query("parse_number_answer", rf"""WITH {JS} SELECT event_id, TRY_CAST(coalesce(nullif(regexp_extract(raw, '"personnel"\s*:\s*(-?[\d.]+)', 1), ''), nullif(regexp_extract(replace(raw, ',', ''), '(-?\d+)', 1), '')) AS DOUBLE) AS num FROM js""")
def _(spark, sf):
    return js(spark, sf).select("event_id", X.parse_number_answer("raw").alias("num"))


@query("parse_prob_call", rf"""WITH {JS} SELECT event_id, TRY_CAST(nullif(regexp_extract(raw, '"probability"\s*:\s*([0-9]*\.?[0-9]+)', 1), '') AS DOUBLE) AS probability,
CASE lower(nullif(regexp_extract(raw, '(?i)"fire"\s*:\s*(true|false)', 1), '')) WHEN 'true' THEN 1.0 WHEN 'false' THEN 0.0 END::DOUBLE AS call FROM js""")
def _(spark, sf):
    p = X.parse_prob_call("raw")
    return js(spark, sf).select("event_id", p["probability"].alias("probability"), p["call"].cast("double").alias("call"))


BOOLS = """bl AS (SELECT page_id, lower(trim(CASE page_id % 5 WHEN 0 THEN '{"smoke": true}' WHEN 1 THEN 'No, ' || html WHEN 2 THEN html || ' there is no smoke' WHEN 3 THEN html || ' Smoke rises' ELSE html END)) AS t FROM pages)"""


@query("parse_bool_answer", rf"""WITH {BOOLS} SELECT page_id, CAST(CASE WHEN regexp_matches(t, '"smoke"\s*:\s*true') THEN 1 WHEN regexp_matches(t, '"smoke"\s*:\s*false') THEN 0
WHEN regexp_matches(t, 'no smoke') OR regexp_matches(t, '^no\b') THEN 0 WHEN regexp_matches(t, 'smoke') THEN 1 ELSE -1 END AS INTEGER) AS said FROM bl""")
def _(spark, sf):
    p, h, i = V.table(spark, sf, "pages"), F.col("html"), F.col("page_id")
    raw = F.when(i % 5 == 0, '{"smoke": true}').when(i % 5 == 1, F.concat(F.lit("No, "), h)).when(i % 5 == 2, F.concat(h, F.lit(" there is no smoke"))).when(i % 5 == 3, F.concat(h, F.lit(" Smoke rises"))).otherwise(h)
    return p.select("page_id", F.coalesce(X.parse_bool_answer(raw), F.lit(-1)).alias("said"))


CHOICES = ["none seen", "smoke 10-25 %", "smoke", "open flame"]
CH_RAW = """CASE doc_id % 7 WHEN 0 THEN '{"answer": "Smoke", "applicability_score": 0.' || (doc_id % 10) || '}' WHEN 1 THEN lang || ' {"answer": "I see open flame!", "applicability_score": 3}'
 WHEN 2 THEN '{"answer": "smoke 10-25 % or so"} ' || source WHEN 3 THEN 'There is open flame in ' || source WHEN 4 THEN 'maybe smoke or open flame' WHEN 5 THEN '' ELSE '{"answer": "cloud"' || lang END"""
nz = lambda x: f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9%<>.\\- ]', ' ', 'g'), '\\s+', ' ', 'g'))"
BY_LEN = sorted(CHOICES, key=lambda o: -len(o))
CHOICE_SQL = f"""ch0 AS (SELECT doc_id, {CH_RAW} AS raw FROM documents),
ch1 AS (SELECT *, regexp_extract(raw, '"answer"\\s*:\\s*"([^"]*)"', 1) AS a0, contains(raw, '"answer"') AS has, TRY_CAST(nullif(regexp_extract(raw, '"applicability_score"\\s*:\\s*([0-9.]+)', 1), '') AS DOUBLE) AS s0 FROM ch0),
ch2 AS (SELECT *, {nz('a0')} AS na, {nz('raw')} AS low FROM ch1),
ch3 AS (SELECT *, coalesce({', '.join(f"CASE WHEN na = '{o}' THEN '{o}' END" for o in CHOICES)}, {', '.join(f"CASE WHEN contains(na, '{o}') THEN '{o}' END" for o in BY_LEN)}) AS by_answer,
 list_filter([{', '.join(f"CASE WHEN regexp_matches(low, '(^|[^a-z0-9]){o}($|[^a-z0-9])') THEN '{o}' END" for o in CHOICES)}], lambda x: x IS NOT NULL) AS named FROM ch2),
ch AS (SELECT doc_id, CASE WHEN has THEN by_answer WHEN len(named) = 1 THEN named[1] END AS choice, CASE WHEN s0 IS NOT NULL THEN least(greatest(s0, 0.0), 1.0) END AS score, raw, has FROM ch3)"""


@query("parse_choice", f"WITH {CHOICE_SQL} SELECT doc_id, coalesce(choice, '') AS choice, score::DOUBLE AS score, CASE WHEN raw = '' THEN 'empty' WHEN choice IS NULL THEN CASE WHEN has THEN 'no_option' ELSE 'no_json' END ELSE '' END AS failure FROM ch")
def _(spark, sf):
    d, i, s = V.table(spark, sf, "documents"), F.col("doc_id"), F.col("doc_id").cast("string")
    raw = (
        F.when(i % 7 == 0, F.concat(F.lit('{"answer": "Smoke", "applicability_score": 0.'), (i % 10).cast("string"), F.lit("}")))
        .when(i % 7 == 1, F.concat("lang", F.lit(' {"answer": "I see open flame!", "applicability_score": 3}')))
        .when(i % 7 == 2, F.concat(F.lit('{"answer": "smoke 10-25 % or so"} '), "source"))
        .when(i % 7 == 3, F.concat(F.lit("There is open flame in "), "source"))
        .when(i % 7 == 4, "maybe smoke or open flame").when(i % 7 == 5, "").otherwise(F.concat(F.lit('{"answer": "cloud"'), "lang"))
    )
    p = X.parse_choice(raw, F.array(*[F.lit(o) for o in CHOICES]))
    return d.select("doc_id", F.coalesce(p["choice"], F.lit("")).alias("choice"), p["score"].alias("score"), F.coalesce(p["failure"], F.lit("")).alias("failure"))


@query("canon_option", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN source ELSE NULL END AS canon FROM documents WHERE source IS NOT NULL""")
def _(spark, sf):
    d = V.table(spark, sf, "documents").where(F.col("source").isNotNull())
    stated = F.when(F.col("doc_id") % 3 == 0, F.col("source")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("  "), F.upper("source"), F.lit(" "))).otherwise("none of them")
    return d.select("doc_id", C.canon_option(stated, F.array(F.lit("other"), F.col("source"))).alias("canon"))


# --- logged queries ---------------------------------------------------------------------------------------------------
LOGGED = """lg AS (SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'select count(*) from orders where k = ' || o_custkey WHEN 1 THEN 'INSERT INTO t VALUES (' || o_custkey || ')'
 WHEN 2 THEN 'SELECT 1; DROP TABLE x' WHEN 3 THEN 'WITH a AS (SELECT 2) SELECT * FROM a;  ' WHEN 4 THEN 'SELECT '';drop'' AS c, "create" FROM t' WHEN 5 THEN '-- delete' || chr(10) || 'select 1 /* update; */'
 WHEN 6 THEN '' ELSE 'pragma table_info(fires); select 2' END AS sql FROM orders)"""


def logged(spark, sf):
    o, i, k = V.table(spark, sf, "orders"), F.col("o_orderkey"), F.col("o_custkey").cast("string")
    return o.select(
        "o_orderkey",
        F.when(i % 8 == 0, F.concat(F.lit("select count(*) from orders where k = "), k)).when(i % 8 == 1, F.concat(F.lit("INSERT INTO t VALUES ("), k, F.lit(")")))
        .when(i % 8 == 2, "SELECT 1; DROP TABLE x").when(i % 8 == 3, "WITH a AS (SELECT 2) SELECT * FROM a;  ").when(i % 8 == 4, "SELECT ';drop' AS c, \"create\" FROM t")
        .when(i % 8 == 5, "-- delete\nselect 1 /* update; */").when(i % 8 == 6, "").otherwise("pragma table_info(fires); select 2").alias("sql"))


@query("sql_log_flags", f"""WITH {LOGGED} SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 6 THEN 1 ELSE 0 END AS empty, CASE o_orderkey % 8 WHEN 1 THEN 'INSERT' WHEN 3 THEN 'WITH' WHEN 6 THEN '' WHEN 7 THEN 'PRAGMA' ELSE 'SELECT' END AS first_word,
CASE o_orderkey % 8 WHEN 1 THEN 'INSERT' WHEN 2 THEN 'DROP' WHEN 7 THEN 'PRAGMA' ELSE '' END AS forbidden, CASE WHEN o_orderkey % 8 IN (2, 7) THEN 1 ELSE 0 END AS several FROM lg""")
def _(spark, sf):
    return logged(spark, sf).withColumn("f", X.sql_log_flags("sql")).select("o_orderkey", "f.*")


@query("logged_query_flags", rf"""WITH {LOGGED} SELECT o_orderkey, CAST(regexp_matches(sql, '(?i)\bfires\b') AS INTEGER) AS uses_fires, CAST(regexp_matches(sql, '(?i)\bselect\b.+\bfrom\b') AS INTEGER) AS code_like FROM lg""")
def _(spark, sf):
    return logged(spark, sf).select("o_orderkey", X.used_column(F.array("sql"), "fires").cast("int").alias("uses_fires"), X.code_like("sql").cast("int").alias("code_like"))


@query("body_complete", f"""WITH {JS}, b AS (SELECT *, trim(CASE WHEN event_id % 4 = 0 THEN '```json' || chr(10) || raw || chr(10) || '```' WHEN event_id % 4 = 1 THEN raw || '{{' ELSE raw END) AS body FROM js),
s AS (SELECT *, trim(regexp_replace(body, '^\\s*```[a-zA-Z]*\\s*|\\s*```\\s*$', '', 'g'), ' ' || chr(10)) AS x FROM b)
SELECT event_id, CAST(x <> '' AND len(x) - len(replace(x, '{{', '')) = len(x) - len(replace(x, '}}', '')) AND regexp_matches(x, '[}}\\]".]$') AS INTEGER) AS complete FROM s""")
def _(spark, sf):
    i, r = F.col("event_id"), F.col("raw")
    body = F.when(i % 4 == 0, F.concat(F.lit("```json\n"), r, F.lit("\n```"))).when(i % 4 == 1, F.concat(r, F.lit("{"))).otherwise(r)
    return js(spark, sf).select("event_id", X.body_complete(body).cast("int").alias("complete"))


@query("reached_format", rf"""WITH {JS} SELECT event_id, CAST(regexp_matches(raw, '(?i)"probability"\s*:') AND regexp_matches(raw, '(?i)"fire"\s*:\s*true') AS INTEGER) AS reached FROM js""")
def _(spark, sf):
    return js(spark, sf).select("event_id", X.reached_format("raw", [r'"probability"\s*:', r'"fire"\s*:\s*true']).cast("int").alias("reached"))


# --- pairs of texts ---------------------------------------------------------------------------------------------------
TURNS = r"""ta AS (SELECT conv_id, text AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations WHERE role = 'user'),
tb AS (SELECT conv_id, text AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations WHERE role = 'assistant'),
tp AS (SELECT ta.conv_id, ta.pos, a, b, list_distinct(regexp_extract_all(lower(a), '[\p{L}\p{N}_]+')) AS xa, list_distinct(regexp_extract_all(lower(b), '[\p{L}\p{N}_]+')) AS xb FROM ta JOIN tb ON ta.conv_id = tb.conv_id AND ta.pos = tb.pos)"""


def turns(spark, sf):
    c = V.table(spark, sf, "conversations")
    return K.pairs_by_position(c.where("role = 'user'"), c.where("role = 'assistant'"), ["conv_id"], "turn", "text").withColumn("pos", F.col("pos") + 1)


@query("jaccard_tokens", f"""WITH {TURNS} SELECT conv_id, pos, round(len(list_intersect(xa, xb)) / len(list_distinct(list_concat(xa, xb)))::DOUBLE, 6) AS jaccard, round(len(list_intersect(xa, xb)) / len(xa)::DOUBLE, 6) AS recall FROM tp""")
def _(spark, sf):
    j = X.jaccard_tokens("a_value", "b_value")
    return turns(spark, sf).select("conv_id", "pos", F.round(j["jaccard"], 6).alias("jaccard"), F.round(j["recall"], 6).alias("recall"))


NAMES = ["the", "and", "les", "der", "tion", "los"]


@query("entity_hits", f"""WITH {TURNS}, w AS (SELECT conv_id, pos, regexp_extract_all(a, '[\\p{{L}}\\p{{N}}_]+') AS wa, regexp_extract_all(b, '[\\p{{L}}\\p{{N}}_]+') AS wb FROM tp)
SELECT conv_id, pos, array_to_string(list_filter({NAMES}, lambda n: list_contains(wa, n)), ',') AS in_a, array_to_string(list_filter({NAMES}, lambda n: list_contains(wa, n) AND NOT list_contains(wb, n)), ',') AS only_a FROM w""")
def _(spark, sf):
    a, b = X.entity_hits("a_value", NAMES), X.entity_hits("b_value", NAMES)
    return turns(spark, sf).select("conv_id", "pos", F.array_join(a, ",").alias("in_a"), F.array_join(F.array_except(a, b), ",").alias("only_a"))


@query("unchanged_fields", """WITH v AS (SELECT doc_id, lang, source, text, upper(text) AS text2, CASE WHEN lang = 'de' THEN 'xx' ELSE lang END AS lang2 FROM documents)
SELECT count(*) AS rows, count(*) FILTER (lang <> lang2) AS differs_lang, 0::BIGINT AS differs_source, count(*) FILTER (text = text2) AS same_text FROM v""")
def _(spark, sf):
    d = V.table(spark, sf, "documents")
    b = d.withColumn("text", F.upper("text")).withColumn("lang", F.when(F.col("lang") == "de", "xx").otherwise(F.col("lang")))
    return A.unchanged_fields(d, b, "doc_id", ["lang", "source"], "text")


WORDS = ["tion", "the ", "eau"]


@query("probe_counts", "SELECT lang, " + ", ".join(f"CAST(sum((len(text) - len(replace(text, '{w}', ''))) // {len(w)}) AS BIGINT) AS n_{i}" for i, w in enumerate(WORDS)) + " FROM documents GROUP BY lang")
def _(spark, sf):
    d = V.table(spark, sf, "documents")
    return d.groupBy("lang").agg(*[F.sum(x).alias(f"n_{i}") for i, x in enumerate(X.probe_counts("text", WORDS).values())])


TIMES = """tm AS (SELECT event_id, ts, CASE event_id % 6 WHEN 0 THEN 'haze at Dawn and by noon' WHEN 1 THEN 'clear evening, seen 10 minutes later' WHEN 2 THEN 'at 14:05 smoke' WHEN 3 THEN 'morning fog' WHEN 4 THEN props ELSE 'afternoonish' END AS raw FROM events),
th AS (SELECT *, hour((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles') AS h FROM tm)"""


@query("time_words", f"""WITH {TIMES} SELECT event_id, CASE WHEN event_id % 6 IN (1, 2) OR event_id % 30 IN (5, 11, 17) THEN 1 ELSE 0 END AS elapsed, CASE event_id % 6 WHEN 0 THEN 'dawn,noon' WHEN 1 THEN 'evening' WHEN 3 THEN 'morning' ELSE '' END AS words,
CASE event_id % 6 WHEN 0 THEN CAST(h < 12 AND h >= 11 AS INTEGER) WHEN 1 THEN CAST(h >= 12 AS INTEGER) WHEN 3 THEN CAST(h < 12 AS INTEGER) ELSE -1 END AS fits FROM th""")
def _(spark, sf):
    e, i = V.table(spark, sf, "events"), F.col("event_id")
    raw = F.when(i % 6 == 0, "haze at Dawn and by noon").when(i % 6 == 1, "clear evening, seen 10 minutes later").when(i % 6 == 2, "at 14:05 smoke").when(i % 6 == 3, "morning fog").when(i % 6 == 4, F.col("props")).when(i % 30 == 5, "shot of 2019-08-01").when(i % 30 == 11, "stamp 1664700000").when(i % 30 == 17, "no overlay seen").when(i % 30 == 23, "12019-08-01 and 156470000").otherwise("afternoonish, timely")
    t = X.time_words(raw, "ts")
    return e.select("event_id", t["elapsed"].alias("elapsed"), t["words"].alias("words"), F.coalesce(t["fits"], F.lit(-1)).alias("fits"))


# --- redaction and prompts --------------------------------------------------------------------------------------------
RULES = [("tion", "[T]"), ("[T]er", "[TER]"), ("eau", "[E]")]
PATTERNS = {"mail": r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", "left": r"tion|eau", "digits": r"[0-9]{3}"}


@query("redact", "SELECT doc_id, md5(replace(replace(replace(text, 'tion', '[T]'), '[T]er', '[TER]'), 'eau', '[E]')) AS redacted FROM documents")
def _(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.md5(X.redact("text", RULES)).alias("redacted"))


RES = "ln AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS t FROM documents)"


@query("audit_residual", f"WITH {RES} " + " UNION ALL ".join(f"SELECT doc_id, CAST(line AS INTEGER) AS line, '{k}' AS label FROM ln WHERE regexp_matches(t, '{p}')" for k, p in PATTERNS.items()))
def _(spark, sf):
    return A.residual_hits(V.table(spark, sf, "documents"), "doc_id", "text", PATTERNS)


def prompt_cols(layout):
    show = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.1f", C.shown(c, 1)))
    pairs = [("people today", show("persistence")), ("area", show("acres")), ("contained percent", show("pct")), ("run day", F.col("day_of_run"))]
    return X.render_lines(pairs, F.concat(F.lit("Report of "), F.col("report_date").cast("string")), F.concat(F.lit("How many people on "), F.col("target_date").cast("string"), F.lit("?")), layout)


def sql_show(c):
    return f"CASE WHEN {c} IS NULL THEN 'none recorded' ELSE printf('%.1f', {c}) END"


P_ITEMS = [("people today", sql_show("persistence")), ("area", sql_show("acres")), ("contained percent", sql_show("pct")), ("run day", "CAST(day_of_run AS VARCHAR)")]
T_SQL, Q_SQL = "'Report of ' || CAST(report_date AS VARCHAR)", "'How many people on ' || CAST(target_date AS VARCHAR) || '?'"
LIST_SQL = " || chr(10) || ".join([T_SQL, *[f"'- {k}: ' || {v}" for k, v in P_ITEMS], Q_SQL])
TABLE_SQL = " || chr(10) || ".join([T_SQL, *[f"'{k} | ' || {v}" for k, v in P_ITEMS], Q_SQL])
PROSE_SQL = f"{T_SQL} || ' ' || " + " || '; ' || ".join(f"'{k} is ' || {v}" for k, v in P_ITEMS) + f" || ' ' || {Q_SQL}"


@query("render_prompt", f"WITH {ITEMS} SELECT item_id, {LIST_SQL} AS as_list, md5({TABLE_SQL}) AS as_table, {PROSE_SQL} AS as_prose FROM aitems")
def _(spark, sf):
    it = P.build_items(runs(spark, sf))
    return it.select("item_id", prompt_cols("list").alias("as_list"), F.md5(prompt_cols("table")).alias("as_table"), prompt_cols("prose").alias("as_prose"))


@query("render_with_base_rate", f"WITH {V.PAIRED}, r AS (SELECT avg(label) AS rate FROM items) SELECT item_id, 'Base rate: ' || printf('%.3f', rate) || chr(10) || 'Source ' || cluster AS prompt FROM items, r")
def _(spark, sf):
    it = V.paired_items(spark, sf)
    rate = it.agg(F.avg("label").alias("rate"))
    return it.crossJoin(F.broadcast(rate)).select("item_id", F.format_string("Base rate: %.3f\nSource %s", "rate", "cluster").alias("prompt"))


@query("grounding_text_counts", f"WITH {ITEMS}, p AS (SELECT {LIST_SQL} AS t FROM aitems) SELECT count(*) AS prompts, count(*) FILTER (contains(t, 'none recorded')) AS with_missing, CAST(sum(len(regexp_extract_all(t, '[0-9]+\\.[0-9]'))) AS BIGINT) AS decimals, CAST(min(len(list_filter(string_split(t, chr(10)), lambda x: starts_with(x, '- ')))) AS BIGINT) AS min_lines, CAST(max(len(list_filter(string_split(t, chr(10)), lambda x: starts_with(x, '- ')))) AS BIGINT) AS max_lines FROM p")
def _(spark, sf):
    p = P.build_items(runs(spark, sf)).select(prompt_cols("list").alias("t"))
    lines = F.size(F.filter(F.split("t", "\n"), lambda x: x.startswith("- "))).cast("bigint")
    return p.agg(F.count(F.lit(1)).alias("prompts"), S.count_if(F.contains("t", F.lit("none recorded"))).alias("with_missing"), F.sum(F.regexp_count("t", F.lit(r"[0-9]+\.[0-9]"))).alias("decimals"), F.min(lines).alias("min_lines"), F.max(lines).alias("max_lines"))
