"""Queries over cohorts, logs and sets."""

from pyspark.sql import functions as F

from scorefold.functions import columns as C
from scorefold.operators import cohort as K
from scorefold.operators import panel as P
from scorefold.operators import scores as S
from scorefold.plans.panel import ITEMS, runs
from scorefold.plans.registry import query
from scorefold.sources import standins as V

SEED = 20260915


def md5_int(*parts):
    return f"CAST(('0x' || substr(md5(concat_ws('|', {', '.join(str(p) for p in parts)})), 1, 15)) AS BIGINT)"


def items(spark, sf):
    return P.build_items(runs(spark, sf))


def scored(spark, sf):
    return V.response_log(spark, sf).withColumn("score", C.impute_score("probability", "call")).withColumn("said", C.impute_call("probability", "call"))


def paired(spark, sf):
    return K.pair_arms(scored(spark, sf), "bare", "grounded", ["item_id", "model"], ["label", "cluster", "stratum"], ["score", "said"], F.col("score").isNotNull())


@query("stratified_sample", f"""WITH {ITEMS}, h AS (SELECT *, {md5_int(f"'{SEED}'", 'item_id')} AS h FROM aitems),
a AS (SELECT *, row_number() OVER (PARTITION BY start_year, incident_id ORDER BY h, item_id) AS g FROM h),
b AS (SELECT *, row_number() OVER (PARTITION BY start_year ORDER BY h, item_id) AS sample_rank FROM a WHERE g <= 2)
SELECT item_id, start_year, CAST(sample_rank AS INTEGER) AS sample_rank FROM b WHERE sample_rank <= 50""")
def _(spark, sf):
    return K.stratified_sample(items(spark, sf), "start_year", "incident_id", "item_id", 50, 2, SEED).select("item_id", "start_year", "sample_rank")


@query("proportional_sample", f"""WITH {ITEMS}, q AS (SELECT start_year, greatest(1, round_even(60 * count(*) / (SELECT count(*) FROM aitems)::DOUBLE, 0)) AS quota FROM aitems GROUP BY start_year),
h AS (SELECT aitems.*, quota, {md5_int(f"'{SEED}'", 'item_id')} AS h FROM aitems JOIN q USING (start_year)),
a AS (SELECT *, row_number() OVER (PARTITION BY start_year, incident_id ORDER BY h, item_id) AS g FROM h),
b AS (SELECT *, row_number() OVER (PARTITION BY start_year ORDER BY h, item_id) AS sample_rank FROM a WHERE g <= 2)
SELECT item_id, start_year, CAST(sample_rank AS INTEGER) AS sample_rank, quota::DOUBLE AS quota FROM b WHERE sample_rank <= quota""")
def _(spark, sf):
    return K.proportional_sample(items(spark, sf), "start_year", "incident_id", "item_id", 60, 2, SEED).select("item_id", "start_year", "sample_rank", "quota")


@query("hash_sample", f"""WITH h AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY {md5_int("'11'", 'o_custkey', 'o_orderkey')}, o_orderkey) AS draw FROM orders)
SELECT o_custkey, o_orderkey, CAST(draw AS INTEGER) AS draw FROM h WHERE draw <= 6""")
def _(spark, sf):
    o = V.table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return K.hash_sample(o, "o_custkey", "o_orderkey", 6, 11)


@query("matched_false_positives", f"""WITH {V.PAIRED}, s AS (SELECT * FROM scored WHERE arm = 'grounded' AND score IS NOT NULL),
k AS (SELECT model, count(*) AS k FROM s WHERE label = 0 AND said = 1 GROUP BY model),
r AS (SELECT s.*, row_number() OVER (PARTITION BY model ORDER BY score DESC, item_id) AS rk FROM s WHERE label = 0)
SELECT item_id, r.model, CASE WHEN rk <= coalesce(k, 0) THEN 1 ELSE 0 END AS flag FROM r LEFT JOIN k ON r.model = k.model""")
def _(spark, sf):
    s = scored(spark, sf).where((F.col("arm") == "grounded") & F.col("score").isNotNull())
    k = s.where("label = 0 and said = 1").groupBy("model").agg(F.count(F.lit(1)).alias("k"))
    return K.matched_false_positives(s, k, ["model"], "score", "label", "item_id").select("item_id", "model", "flag")


@query("fold_filter", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_linenumber IN (1, 3) GROUP BY ALL")
def _(spark, sf):
    return K.fold_filter(V.table(spark, sf, "lineitem"), [1, 3], "l_linenumber").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("top_k_per_group", """SELECT o_orderpriority, o_orderkey, o_totalprice, CAST(rk AS INTEGER) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders) WHERE rk <= 15""")
def _(spark, sf):
    from scorefold.operators.ordered import top_rows

    o = V.table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return top_rows(o, ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 15)


@query("order_items", """SELECT item_id, row_number() OVER (ORDER BY day, label DESC, item_id) - 1 AS pos FROM (SELECT o_orderkey AS item_id, CAST(o_orderdate AS DATE) AS day, o_orderstatus AS label FROM orders)""")
def _(spark, sf):
    from scorefold.operators.ordered import positions

    o = V.table(spark, sf, "orders")
    o = o.select(F.col("o_orderkey").alias("item_id"), F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("label"))
    return positions(o, [], ["day", 0 - F.ascii("label"), "item_id"]).select("item_id", "pos")


# --- de-duplication: the event log as attempts per (user, kind) -------------------------------------------------------
ATTEMPTS = "attempts AS (SELECT user_id, event_type, event_id, value, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS failed FROM events)"


def attempts(spark, sf):
    e = V.table(spark, sf, "events")
    return e.select("user_id", "event_type", "event_id", "value", F.when(F.col("event_id") % 3 == 0, 1).otherwise(0).alias("failed"))


@query("dedupe_last", f"WITH {ATTEMPTS} SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM attempts GROUP BY ALL")
def _(spark, sf):
    return K.dedupe_last(attempts(spark, sf), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "value", "event_id")


@query("dedupe_success", f"""WITH {ATTEMPTS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY failed, CASE WHEN failed = 1 THEN -event_id ELSE event_id END) AS rk FROM attempts)
SELECT user_id, event_type, event_id, value, failed FROM r WHERE rk = 1""")
def _(spark, sf):
    return K.dedupe_success(attempts(spark, sf), ["user_id", "event_type"], "event_id", F.col("failed") == 1).select("user_id", "event_type", "event_id", "value", "failed")


# --- pairing ----------------------------------------------------------------------------------------------------------
@query("pair_arms", f"WITH {V.PAIRED} SELECT item_id, model, label, cluster, stratum, a_score, b_score, a_said, b_said FROM paired")
def _(spark, sf):
    return paired(spark, sf)


@query("target_conflicts", "SELECT o_custkey, min(o_orderstatus) AS lo, max(o_orderstatus) AS hi FROM orders GROUP BY o_custkey HAVING min(o_orderstatus) <> max(o_orderstatus)")
def _(spark, sf):
    return K.target_conflicts(V.table(spark, sf, "orders"), ["o_custkey"], "o_orderstatus")


@query("attach_items", """SELECT d.source AS src, coalesce(CAST(l.quality AS VARCHAR), 'none') AS quality, CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END AS item_missing, count(*) AS n
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL""")
def _(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", F.col("source").alias("src"))
    l = V.table(spark, sf, "labels").withColumn("cluster", F.col("quality").cast("string"))
    j = K.attach_items(d, l, "doc_id", "cluster")
    return j.groupBy("src", F.coalesce(F.col("quality").cast("string"), F.lit("none")).alias("quality"), "item_missing").agg(F.count(F.lit(1)).alias("n"))


@query("paired_split", f"""WITH {V.PAIRED}, a AS (SELECT DISTINCT model, item_id FROM scored WHERE arm = 'bare' AND score IS NOT NULL), b AS (SELECT DISTINCT model, item_id FROM scored WHERE arm = 'grounded' AND score IS NOT NULL),
g AS (SELECT coalesce(a.model, b.model) AS model, count(a.item_id) AS a_n, count(b.item_id) AS b_n, count(*) FILTER (a.item_id IS NOT NULL AND b.item_id IS NOT NULL) AS overlap FROM a FULL JOIN b ON a.model = b.model AND a.item_id = b.item_id GROUP BY 1)
SELECT *, CASE WHEN overlap = a_n AND overlap = b_n THEN 'same' WHEN overlap = a_n OR overlap = b_n THEN 'covered' ELSE 'split' END AS relation FROM g""")
def _(spark, sf):
    s = scored(spark, sf).where(F.col("score").isNotNull())
    return K.paired_split(s.where("arm = 'bare'"), s.where("arm = 'grounded'"), ["model", "item_id"], ["model"])


VARIANTS = ["bare", "grounded", "third"]
NWAY = V.PAIRED + """, three AS (SELECT item_id, model, label, arm AS variant, score FROM scored
 UNION ALL SELECT item_id, model, label, 'third', CASE WHEN item_id % 29 <> 0 THEN score END FROM scored WHERE arm = 'bare')"""


def three_variants(spark, sf):
    s = scored(spark, sf).select("item_id", "model", "label", F.col("arm").alias("variant"), "score")
    third = s.where("variant = 'bare'").withColumn("variant", F.lit("third")).withColumn("score", F.when(F.col("item_id") % 29 != 0, F.col("score")))
    return K.union_arms(s, third)


@query("n_way_aligned", f"""WITH {NWAY} SELECT item_id, model, max(score) FILTER (variant = 'bare') AS bare, max(score) FILTER (variant = 'grounded') AS grounded,
max(score) FILTER (variant = 'third') AS third FROM three WHERE score IS NOT NULL GROUP BY item_id, model HAVING count(DISTINCT variant) = 3""")
def _(spark, sf):
    return K.n_way_aligned(three_variants(spark, sf), "variant", ["item_id", "model"], "score", VARIANTS)


@query("union_arms", f"WITH {NWAY} SELECT variant, count(*) AS n, count(score) AS answered FROM three GROUP BY variant")
def _(spark, sf):
    return three_variants(spark, sf).groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("answered"))


@query("held_out", "SELECT source, lang, count(*) AS n FROM documents WHERE (doc_id) NOT IN (SELECT doc_id FROM labels) GROUP BY ALL")
def _(spark, sf):
    h = K.held_out(V.table(spark, sf, "documents"), V.table(spark, sf, "labels"), ["doc_id"])
    return h.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("exclude_incidents", "SELECT count(*) AS kept, count(DISTINCT o_custkey) AS groups FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-01')")
def _(spark, sf):
    o = V.table(spark, sf, "orders")
    k = P.exclude_incidents(o, o.where(F.col("o_orderdate") >= "2001-07-01"), "o_custkey")
    return k.agg(F.count(F.lit(1)).alias("kept"), F.countDistinct("o_custkey").alias("groups"))


@query("pairs_by_position", """WITH a AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations WHERE role = 'user'),
b AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations WHERE role = 'assistant')
SELECT a.conv_id, a.pos, length(a.text) AS a_len, length(b.text) AS b_len, CASE WHEN a.text = b.text THEN 1 ELSE 0 END AS same FROM a JOIN b ON a.conv_id = b.conv_id AND a.pos = b.pos""")
def _(spark, sf):
    c = V.table(spark, sf, "conversations")
    j = K.pairs_by_position(c.where("role = 'user'"), c.where("role = 'assistant'"), ["conv_id"], "turn", "text")
    return j.select("conv_id", "pos", F.length("a_value").cast("bigint").alias("a_len"), F.length("b_value").cast("bigint").alias("b_len"), "same")


REG = "reg AS (SELECT n_nationkey AS model, n_name AS label, CASE WHEN n_nationkey < 3 THEN 'core' ELSE 'added' END AS tier FROM nation)"


@query("select_models", f"WITH {V.PAIRED}, {REG} SELECT model, label FROM reg WHERE tier = 'added' AND model IN (SELECT model FROM log GROUP BY model HAVING count(DISTINCT arm) = 2)")
def _(spark, sf):
    n = V.table(spark, sf, "nation")
    reg = n.select(F.col("n_nationkey").alias("model"), F.col("n_name").alias("label"), F.when(F.col("n_nationkey") < 3, "core").otherwise("added").alias("tier"))
    return K.select_models(reg, V.response_log(spark, sf), "added", ["bare", "grounded"]).select("model", "label")


# --- sets -------------------------------------------------------------------------------------------------------------
STATE_SQL = V.PAIRED + """, st AS (SELECT *, model || '-' || arm AS run, CASE WHEN probability IS NOT NULL AND call IS NOT NULL THEN 'answered' WHEN probability IS NOT NULL OR call IS NOT NULL THEN 'partial' ELSE 'failed' END AS state
 FROM log WHERE NOT (arm = 'grounded' AND toxic = 1) AND NOT (model = 3 AND arm = 'bare' AND stratum = 'en'))"""


def with_state(spark, sf):
    from scorefold.operators.audit import answer_state

    l = V.response_log(spark, sf).where(~((F.col("arm") == "grounded") & (F.col("toxic") == 1)) & ~((F.col("model") == 3) & (F.col("arm") == "bare") & (F.col("stratum") == "en")))
    return l.withColumn("run", F.concat_ws("-", F.col("model").cast("string"), "arm")).withColumn("state", answer_state(["probability", "call"]))


@query("complete_runs", f"""WITH {STATE_SQL}, n AS (SELECT run, arm, count(*) AS attempted FROM st GROUP BY ALL)
SELECT run, arm, attempted, round(attempted / (max(attempted) OVER (PARTITION BY arm))::DOUBLE, 6) AS coverage, round(attempted / (max(attempted) OVER ())::DOUBLE, 6) AS task_coverage,
CASE WHEN attempted / (max(attempted) OVER (PARTITION BY arm))::DOUBLE >= 0.9 AND attempted / (max(attempted) OVER ())::DOUBLE >= 0.5 THEN 1 ELSE 0 END AS complete FROM n""")
def _(spark, sf):
    return S.rounded(K.complete_runs(with_state(spark, sf), ["run"], "arm"))


@query("common_set", f"""WITH {STATE_SQL}, p AS (SELECT item_id, count(*) AS a, count(*) FILTER (state = 'answered') AS s, count(*) FILTER (state <> 'failed') AS l FROM st GROUP BY item_id), r AS (SELECT count(DISTINCT run) AS runs FROM st),
c AS (SELECT count(*) AS attempted_any, count(*) FILTER (a = runs) AS attempted_all, count(*) FILTER (s = runs) AS answered_all, count(*) FILTER (l = runs) AS answered_or_partial_all FROM p, r)
SELECT *, attempted_any - attempted_all AS lost_to_design, attempted_all - answered_or_partial_all AS lost_to_failure, answered_or_partial_all - answered_all AS lost_to_imputation FROM c""")
def _(spark, sf):
    return K.common_set(with_state(spark, sf), "run", "item_id", "state")


@query("multi_failed", f"WITH {STATE_SQL} SELECT item_id, count(*) AS failed_runs FROM st WHERE state <> 'answered' GROUP BY item_id HAVING count(*) >= 2")
def _(spark, sf):
    return K.multi_failed(with_state(spark, sf), "item_id", F.col("state") != "answered")


@query("coverage", f"WITH {STATE_SQL}, e AS (SELECT items.item_id, m.model, a.arm FROM items CROSS JOIN (SELECT DISTINCT model FROM log) m CROSS JOIN (SELECT DISTINCT arm FROM log) a) SELECT model, arm, count(*) AS missing FROM (SELECT item_id, model, arm FROM e EXCEPT SELECT item_id, model, arm FROM st) GROUP BY ALL")
def _(spark, sf):
    expected = V.response_log(spark, sf).select("item_id", "model", "arm")
    return K.coverage(expected, with_state(spark, sf), ["item_id", "model", "arm"]).groupBy("model", "arm").agg(F.count(F.lit(1)).alias("missing"))


@query("pending_jobs", f"WITH {STATE_SQL}, e AS (SELECT item_id, model, arm FROM log) SELECT item_id, model, arm FROM e EXCEPT SELECT item_id, model, arm FROM st WHERE state = 'answered'")
def _(spark, sf):
    expected = V.response_log(spark, sf).select("item_id", "model", "arm")
    return K.pending_jobs(expected, with_state(spark, sf).where("state = 'answered'"), ["item_id", "model", "arm"])


@query("id_differences", "SELECT doc_id, 'a_only' AS side FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'b_only' FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents)")
def _(spark, sf):
    return K.id_differences(V.table(spark, sf, "documents"), V.table(spark, sf, "labels"), "doc_id")


@query("same_order", """WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS p FROM orders), b AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS p FROM orders)
SELECT count(*) AS positions, count(*) FILTER (a.o_orderkey <> b.o_orderkey) AS different FROM a JOIN b ON a.p = b.p""")
def _(spark, sf):
    o = V.table(spark, sf, "orders")
    by_date = o.select("o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("at"))
    return K.same_order(o.select("o_orderkey", F.struct(F.lit(None).cast("timestamp").alias("o_orderdate"), "o_orderkey").alias("at")), by_date, "o_orderkey", ["at"])


# --- upserts ----------------------------------------------------------------------------------------------------------
@query("upsert_runs", """WITH old AS (SELECT o_custkey AS run, count(*) AS n FROM orders GROUP BY ALL), new AS (SELECT o_custkey AS run, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01' GROUP BY ALL)
SELECT * FROM old WHERE run NOT IN (SELECT run FROM new) UNION ALL SELECT * FROM new""")
def _(spark, sf):
    o = V.table(spark, sf, "orders").withColumnRenamed("o_custkey", "run")
    count = lambda d: d.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    return K.upsert_runs(count(o), count(o.where(F.col("o_orderdate") >= "2001-01-01")), ["run"])


PATCH = """patch AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE o_totalprice + 1 END AS v FROM orders WHERE o_orderpriority = '2-HIGH'),
lg AS (SELECT o_orderkey, o_totalprice AS v FROM orders)"""


def patched(spark, sf):
    o = V.table(spark, sf, "orders")
    log = o.select("o_orderkey", F.col("o_totalprice").alias("v"))
    patch = o.where("o_orderpriority = '2-HIGH'").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).otherwise(F.col("o_totalprice") + 1).alias("v"))
    return K.apply_replacements(log, patch, ["o_orderkey"])


@query("apply_replacements", f"WITH {PATCH} SELECT lg.o_orderkey, coalesce(patch.v, lg.v) AS v FROM lg LEFT JOIN patch USING (o_orderkey)")
def _(spark, sf):
    return patched(spark, sf)[0]


@query("replaced_rows", f"WITH {PATCH} SELECT lg.o_orderkey, lg.v FROM lg JOIN patch USING (o_orderkey) WHERE lg.v <> patch.v")
def _(spark, sf):
    return patched(spark, sf)[1]
