"""Queries over readers, writers and the streaming ingest: logs are written from the given tables and read back."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorefold.plans.audit import RESP, responses
from scorefold.plans.registry import query
from scorefold.session import shared_folder
from scorefold.sources import readers as RD
from scorefold.sources import sinks as SK
from scorefold.sources import standins as V
from scorefold.streaming import ingest as X

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("text", T.StringType())])


def json_lines(spark, sf):
    """Documents as JSON lines, with blank, broken and bare-number lines among them."""
    d, i = V.table(spark, sf, "documents"), F.col("doc_id")
    js = F.to_json(F.struct("doc_id", "lang", "text"))
    line = F.when(i % 40 == 7, F.substring(js, 1, 12)).when(i % 40 == 9, "17").when(i % 40 == 11, "  ").otherwise(js)
    return d.select("lang", line.alias("value"))


@query("read_jsonl", "SELECT count(*) FILTER (doc_id % 40 NOT IN (7, 9, 11)) AS rows, count(*) FILTER (doc_id % 40 IN (7, 9)) AS bad, CAST(sum(CASE WHEN doc_id % 40 NOT IN (7, 9, 11) THEN len(text) END) AS BIGINT) AS chars FROM documents")
def _(spark, sf):
    path = shared_folder(spark, "jsonl")
    json_lines(spark, sf).select("value").write.text(path)
    rows, bad = RD.read_jsonl(spark, path, DOC)
    r = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("text").cast("bigint")).alias("chars"))
    return r.crossJoin(F.broadcast(bad.agg(F.sum("bad").alias("bad"))))


@query("parse_json_lines", "SELECT lang, count(*) FILTER (doc_id % 40 NOT IN (7, 9, 11)) AS rows, count(*) FILTER (doc_id % 40 IN (7, 9)) AS bad FROM documents GROUP BY lang")
def _(spark, sf):
    p = RD.parse_json_lines(json_lines(spark, sf).withColumnRenamed("lang", "l"), DOC)
    return p.groupBy(F.col("l").alias("lang")).agg(F.count(F.when(F.col("_bad") == 0, 1)).alias("rows"), F.sum("_bad").alias("bad"))


@query("read_arms", f"WITH {RESP} SELECT 'm' || model AS model, arm, 'main' AS variant, count(*) AS n FROM resp GROUP BY ALL")
def _(spark, sf):
    r = responses(spark, sf)
    run = F.concat(F.lit("responses-m"), F.col("model").cast("string"), F.lit("-"), F.col("arm"), F.lit(".jsonl"))
    path = shared_folder(spark, "arms")
    r.select(run.alias("run"), F.to_json(F.struct("item_id", "raw")).alias("value")).write.partitionBy("run").text(path)
    rows, _bad = RD.read_arms(spark, f"{path}/*/*", T.StructType([T.StructField("item_id", T.LongType()), T.StructField("raw", T.StringType())]))
    return rows.where("item_id IS NOT NULL").groupBy("model", "arm", "variant").agg(F.count(F.lit(1)).alias("n"))


@query("read_reports", """SELECT c_mktsegment, count(*) FILTER (c_custkey % 7 <> 5) AS dated, count(*) FILTER (c_custkey % 11 <> 3) AS numbered, round(sum(c_acctbal) FILTER (c_custkey % 11 <> 3), 2) AS total FROM customer GROUP BY ALL""")
def _(spark, sf):
    c, i = V.table(spark, sf, "customer"), F.col("c_custkey")
    day = F.date_add(F.lit("2015-01-01").cast("date"), (i % 900).cast("int"))
    txt = F.when(i % 7 == 5, "soon").when(i % 7 == 1, F.date_format(day, "M/d/yyyy")).when(i % 7 == 2, F.date_format(day, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    path = shared_folder(spark, "reports")
    c.select("c_mktsegment", "c_name", txt.alias("day"), F.when(i % 11 == 3, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("people")).write.option("header", True).csv(path)
    r = RD.read_reports(spark, path, ["c_mktsegment", "day", "people"], ["day"], ["people"])
    return r.groupBy("c_mktsegment").agg(F.count("day").alias("dated"), F.count("people").alias("numbered"), F.round(F.sum("people"), 2).alias("total"))


@query("read_records", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 1) AS total FROM orders GROUP BY ALL")
def _(spark, sf):
    r = RD.read_records(spark, f"{sf}/orders.parquet", ["o_orderstatus", "o_totalprice"])
    return r.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 1).alias("total"))


@query("read_labelled_union", "SELECT 1 AS label, count(*) AS n FROM events WHERE value > 50 UNION ALL SELECT 0, count(*) FROM events WHERE value <= 50")
def _(spark, sf):
    e = V.table(spark, sf, "events")
    return RD.labelled_union(e.where("value > 50"), e.where("value <= 50").drop("props")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("read_qa_pool", "SELECT p_type AS category, count(*) AS n FROM part WHERE p_partkey % 50 <> 0 GROUP BY ALL")
def _(spark, sf):
    p = V.table(spark, sf, "part")
    rec = p.select(F.when(F.col("p_partkey") % 50 != 0, F.col("p_partkey").cast("string")).alias("question_id"), F.col("p_type").alias("category"), F.array("p_name", "p_brand").alias("options"))
    path = shared_folder(spark, "pool")
    arrays = rec.groupBy(F.pmod(F.crc32("category"), F.lit(3)).alias("file")).agg(F.to_json(F.collect_list(F.struct("question_id", "category", "options")), {"pretty": "true"}).alias("value"))
    arrays.repartition(3, "file").write.partitionBy("file").text(path)  # one array over many lines per file
    schema = T.StructType([T.StructField("question_id", T.StringType()), T.StructField("category", T.StringType()), T.StructField("options", T.ArrayType(T.StringType()))])
    return RD.read_qa_pool(spark, f"{path}/*/*", schema).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("file_inventory")
def _(spark, sf):
    return RD.file_inventory(spark, f"{sf}/*.parquet").select("file", "bytes", "sha256")


LINE = "'{\"item_id\":' || item_id || ',\"model\":\"' || served || '\"}' || CASE WHEN item_id % 3 = 1 THEN chr(13) ELSE '' END"
LINES = f"""{RESP}, ln AS (SELECT 'run-' || model || '-' || arm || '.jsonl' AS file, item_id, served, CASE WHEN item_id % 31 = 5 THEN '  ' WHEN item_id % 29 = 3 THEN '17' ELSE {LINE} END AS v FROM resp WHERE item_id IS NOT NULL),
nd(file, l, pos, n, a, b) AS (SELECT file, 0, row_number() OVER (PARTITION BY file ORDER BY item_id, v) - 1, CAST(NULL AS BIGINT), sha256(v), sha256(rtrim(v, chr(13))) FROM ln
 UNION ALL SELECT file, l + 1, pos // 16, (max(m) + 16) // 16, sha256(string_agg(a, '' ORDER BY pos)), sha256(string_agg(b, '' ORDER BY pos)) FROM (SELECT *, max(pos) OVER (PARTITION BY file) AS m FROM nd) WHERE l = 0 OR m > 0 GROUP BY file, l, pos // 16)"""


@query("line_inventory", f"""WITH RECURSIVE {LINES}, top AS (SELECT file, arg_max(a, l) AS digest, arg_max(b, l) AS digest_lf FROM nd WHERE l > 0 AND n = 1 GROUP BY file)
SELECT file, count(*) FILTER (trim(v) <> '') AS rows, count(*) FILTER (v = '17') AS bad, string_agg(DISTINCT served, ',' ORDER BY served) FILTER (v LIKE '{{%') AS served, sum(strlen(v) + 1)::BIGINT AS bytes, any_value(digest) AS digest, any_value(digest_lf) AS digest_lf
FROM ln JOIN top USING (file) GROUP BY file""")
def _(spark, sf):
    r, i = responses(spark, sf), F.col("item_id")
    line = F.concat(F.lit('{"item_id":'), i.cast("string"), F.lit(',"model":"'), "served", F.lit('"}'), F.when(i % 3 == 1, "\r").otherwise(""))
    line = F.when(i % 31 == 5, "  ").when(i % 29 == 3, "17").otherwise(line)
    run = F.concat(F.lit("run-"), F.col("model").cast("string"), F.lit("-"), "arm", F.lit(".jsonl"))
    path = shared_folder(spark, "logs")
    # one file per run, in order of items: the writer names it, so the run's folder stands in for the name
    rows = r.select(run.alias("run"), line.alias("value"), "item_id").repartition("run").sortWithinPartitions("run", "item_id", "value")
    rows.select("run", "value").write.partitionBy("run").option("lineSep", "\n").text(path)
    inv = RD.line_inventory(spark, f"{path}/*/*", "model", 16, F.regexp_extract("_metadata.file_path", r"run=([^/]+)/", 1))
    return inv.select("file", "rows", "bad", "served", "bytes", "digest", "digest_lf")


@query("inventory_drift", "SELECT source || '.txt' AS file, CASE source WHEN 'src1' THEN 'changed' WHEN 'src2' THEN 'added' WHEN 'src3' THEN 'same_crlf' ELSE 'same' END AS status FROM (SELECT DISTINCT source FROM documents)")
def _(spark, sf):
    d = V.table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    now = d.select(F.concat("source", F.lit(".txt")).alias("file"), F.sha2("source", 256).alias("sha256"), F.sha2(F.concat("source", F.lit("\r\n")), 256).alias("sha256_crlf"))
    old = now.where("file <> 'src2.txt'").select("file", F.when(F.col("file") == "src1.txt", "x").when(F.col("file") == "src3.txt", F.col("sha256_crlf")).otherwise(F.col("sha256")).alias("sha256"))
    return RD.inventory_drift(now, old)


@query("variant_sections", "SELECT CASE WHEN regexp_matches(source, '^src1\\d$') THEN 'teens' WHEN regexp_matches(source, '^src[0-4]$') THEN 'low' ELSE 'other' END AS section, count(DISTINCT source) AS files, count(*) AS rows FROM documents GROUP BY 1")
def _(spark, sf):
    return RD.variant_sections(V.table(spark, sf, "documents"), "source", F.lit(1), {"teens": r"^src1\d$", "low": r"^src[0-4]$"})


@query("write_items", "SELECT lang, count(*) AS items, count(*) AS indexed FROM documents GROUP BY lang")
def _(spark, sf):
    base = shared_folder(spark, "items")
    d = V.table(spark, sf, "documents").select("doc_id", "lang", F.struct("source", "n_chars").alias("context"))
    SK.write_items(d, f"{base}/items")
    SK.write_index(d, f"{base}/index")
    back = spark.read.parquet(f"{base}/items").groupBy("lang").agg(F.count("context").alias("items"))
    index = spark.read.option("header", True).csv(f"{base}/index").groupBy("lang").agg(F.count("doc_id").alias("indexed"))
    return back.join(index, "lang")


STREAM = T.StructType([T.StructField(n, t) for n, t in (("model", T.StringType()), ("arm", T.StringType()), ("item_id", T.StringType()), ("seq", T.LongType()), ("error", T.StringType()), ("value", T.DoubleType()))])


@query("ingest_responses", """WITH a AS (SELECT 'm' || (user_id % 3) AS model, event_type AS arm, CAST(user_id AS VARCHAR) AS item_id, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'timeout' END AS error, value FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY model, arm, item_id ORDER BY error IS NOT NULL, CASE WHEN error IS NULL THEN seq ELSE -seq END) AS rk FROM a) SELECT model, arm, item_id, seq, coalesce(error, '') AS error, value FROM r WHERE rk = 1""")
def _(spark, sf):
    base = shared_folder(spark, "stream")
    e, i = V.table(spark, sf, "events"), F.col("event_id")
    log = e.select(F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), F.col("event_type").alias("arm"), F.col("user_id").cast("string").alias("item_id"),
                   i.alias("seq"), F.when(i % 3 == 0, "timeout").alias("error"), "value")
    log.repartitionByRange(4, "seq").write.json(f"{base}/log")
    X.ingest_responses(spark, f"{base}/log", f"{base}/target", f"{base}/state", STREAM, 2).awaitTermination()
    X.compact(spark, f"{base}/target")
    return X.current(spark, f"{base}/target").select("model", "arm", "item_id", "seq", F.coalesce("error", F.lit("")).alias("error"), "value")
