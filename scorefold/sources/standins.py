"""Views that give the driver tables the shapes the operators expect, in Spark and (for the twins) in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- situation reports ------------------------------------------------------------------------------------------------
def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several filings per (incident, day): an incident is a user of ``events``, a filing one event."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("user_id").alias("incident_id"),
        F.to_date("ts").alias("report_date"),
        F.col("event_id").alias("ord"),
        F.when(k % 17 != 0, F.col("value")).alias("personnel"),
        (F.col("user_id") % 5).cast("int").alias("state"),
        (F.col("user_id") % 9 + 2012).cast("int").alias("start_year"),
        F.when(k % 11 != 0, k * F.col("value") * 20).alias("acres"),
        F.when(k % 13 != 0, k.cast("double")).alias("pct"),
        F.when(k % 7 != 0, (F.col("event_id") % 50 * k).cast("double")).alias("new_acres"),
        F.when(k % 3 != 0, (F.col("event_id") % 13).cast("double")).alias("aerial"),
        F.when(k % 5 != 0, F.col("event_type")).alias("terrain"),
    )


REPORTS = """
reports AS (
  SELECT user_id AS incident_id, CAST(ts AS DATE) AS report_date, event_id AS ord,
    CASE WHEN k % 17 <> 0 THEN value END AS personnel, CAST(user_id % 5 AS INTEGER) AS state,
    CAST(2012 + user_id % 9 AS INTEGER) AS start_year,
    CASE WHEN k % 11 <> 0 THEN k * value * 20 END AS acres,
    CASE WHEN k % 13 <> 0 THEN CAST(k AS DOUBLE) END AS pct,
    CASE WHEN k % 7 <> 0 THEN CAST(event_id % 50 * k AS DOUBLE) END AS new_acres,
    CASE WHEN k % 3 <> 0 THEN CAST(event_id % 13 AS DOUBLE) END AS aerial,
    CASE WHEN k % 5 <> 0 THEN event_type END AS terrain
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
),
valid AS (SELECT * FROM reports WHERE report_date IS NOT NULL AND personnel > 0),
daily AS (
  SELECT incident_id, report_date,
    arg_max(personnel, ord) FILTER (personnel IS NOT NULL) AS personnel,
    arg_max(state, ord) AS state, arg_max(start_year, ord) AS start_year,
    arg_max(acres, ord) FILTER (acres IS NOT NULL) AS acres,
    arg_max(pct, ord) FILTER (pct IS NOT NULL) AS pct,
    arg_max(new_acres, ord) FILTER (new_acres IS NOT NULL) AS new_acres,
    arg_max(aerial, ord) FILTER (aerial IS NOT NULL) AS aerial,
    arg_max(terrain, ord) FILTER (terrain IS NOT NULL) AS terrain
  FROM valid GROUP BY ALL
),
islands AS (
  SELECT *, report_date - CAST(row_number() OVER (PARTITION BY incident_id ORDER BY report_date) AS INTEGER) AS island FROM daily
),
runs AS (
  SELECT *, min(report_date) OVER (PARTITION BY incident_id, island) AS run_start,
    row_number() OVER (PARTITION BY incident_id, island ORDER BY report_date) AS day_of_run,
    count(*) OVER (PARTITION BY incident_id, island) AS run_length
  FROM islands
)"""

PAIRS = REPORTS + """,
pairs AS (
  SELECT * FROM (
    SELECT incident_id || '@' || CAST(report_date AS VARCHAR) AS analogue_id, incident_id, report_date, state, start_year,
      personnel AS today, lead(personnel) OVER w AS next, lag(personnel) OVER w AS prev,
      lag(personnel, 2) OVER w AS prev2,
      acres, lag(acres) OVER w AS acres_prev, pct, lag(pct) OVER w AS pct_prev, new_acres, aerial, day_of_run, run_length
    FROM runs WINDOW w AS (PARTITION BY incident_id, run_start ORDER BY report_date)
  ) WHERE next IS NOT NULL
)"""

# --- event records ----------------------------------------------------------------------------------------------------
def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event record: an order, with its customer's nation as the state."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(F.broadcast(n), c.c_nationkey == n.n_nationkey)  # nation is a fixed list of 25 rows
        .select(
            F.col("o_orderkey").alias("record_id"),
            F.col("n_name").alias("state"),
            F.year("o_orderdate").alias("year"),
            F.to_date("o_orderdate").alias("discovered"),
            F.dayofyear("o_orderdate").alias("doy"),
            F.col("o_orderpriority").alias("cause"),
            F.col("o_orderstatus").alias("size_class"),
            F.col("o_totalprice").alias("size"),
            F.when(F.col("c_custkey") % 29 != 0, F.col("c_name")).alias("name"),
            F.when((F.col("c_nationkey") % 4 != 0) | (F.col("o_orderkey") % 3 != 0), F.col("c_mktsegment")).alias("county"),
        )
    )


RECORDS = """
records AS (
  SELECT o_orderkey AS record_id, n_name AS state, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_orderdate AS DATE) AS discovered,
    CAST(dayofyear(o_orderdate) AS INTEGER) AS doy, o_orderpriority AS cause, o_orderstatus AS size_class, o_totalprice AS size,
    CASE WHEN c_custkey % 29 <> 0 THEN c_name END AS name,
    CASE WHEN c_nationkey % 4 <> 0 OR o_orderkey % 3 <> 0 THEN c_mktsegment END AS county
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""

# --- paired response log ----------------------------------------------------------------------------------------------
MODELS = 4


def paired_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled items: label, cluster (source) and stratum (language) of every labelled document."""
    l, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return l.join(d, "doc_id").select(
        F.col("doc_id").alias("item_id"), F.col("quality").alias("label"), F.col("toxic").alias("toxic"),
        F.col("source").alias("cluster"), F.col("lang").alias("stratum"), "n_chars",
    )


def response_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long response log (item, model, arm): probability and call with missing answers, plus item attributes."""
    items = paired_items(spark, sf_dir)
    d = F.col("item_id")
    m = items.withColumn("model", F.explode(F.array(*[F.lit(i) for i in range(MODELS)])))
    m = m.withColumn("arm", F.explode(F.array(F.lit("bare"), F.lit("grounded"))))
    bare = F.when(d % 17 != 0, (d * 37 + 11 + 13 * F.col("model")) % 101 / 100.0)
    grounded = F.when(d % 19 != 0, (d * 53 + 7 + 29 * F.col("model")) % 101 / 100.0)
    prob = F.when(F.col("arm") == "bare", bare).otherwise(grounded)
    shift = F.when(F.col("arm") == "bare", 0).otherwise(3)
    call = F.when(d % 23 != 0, F.when((d + F.col("model") + shift) % 13 == 0, F.lit(1)).otherwise((prob >= 0.5).cast("int")))
    return m.withColumn("probability", prob).withColumn("call", call)


PAIRED = """
items AS (
  SELECT l.doc_id AS item_id, quality AS label, toxic, source AS cluster, lang AS stratum, n_chars
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id
),
log0 AS (
  SELECT items.*, CAST(m.model AS INTEGER) AS model, a.arm,
    CASE WHEN arm = 'bare' THEN CASE WHEN item_id % 17 <> 0 THEN ((item_id * 37 + 11 + 13 * m.model) % 101) / 100.0::DOUBLE END
         ELSE CASE WHEN item_id % 19 <> 0 THEN ((item_id * 53 + 7 + 29 * m.model) % 101) / 100.0::DOUBLE END END AS probability
  FROM items CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS model) m CROSS JOIN (SELECT unnest(['bare', 'grounded']) AS arm) a
),
log AS (
  SELECT *, CASE WHEN item_id % 23 <> 0 THEN
    CASE WHEN (item_id + model + CASE WHEN arm = 'bare' THEN 0 ELSE 3 END) % 13 = 0 THEN 1
         ELSE CASE WHEN probability >= 0.5 THEN 1 WHEN probability IS NOT NULL THEN 0 END END END AS call
  FROM log0
),
scored AS (
  SELECT *, coalesce(probability, CAST(call AS DOUBLE)) AS score,
    coalesce(call, CASE WHEN probability >= 0.5 THEN 1 WHEN probability IS NOT NULL THEN 0 END) AS said
  FROM log
),
paired AS (
  SELECT b.item_id, b.model, b.label, b.cluster, b.stratum, b.score AS a_score, g.score AS b_score, b.said AS a_said, g.said AS b_said
  FROM scored b JOIN scored g ON b.item_id = g.item_id AND b.model = g.model
  WHERE b.arm = 'bare' AND g.arm = 'grounded' AND b.score IS NOT NULL AND g.score IS NOT NULL
)"""

# --- numeric prediction log -------------------------------------------------------------------------------------------
def numeric_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("group_id"), F.to_date("o_orderdate").alias("day"),
        F.col("o_totalprice").alias("target"), F.col("o_orderpriority").alias("run"), F.col("o_orderstatus").alias("arm"),
    )


def numeric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric predictions: persistence is the group's previous value, scale the group mean over all its items."""
    from scorefold.operators.ordered import neighbour

    o = numeric_orders(spark, sf_dir)
    prev = neighbour(o, ["group_id"], ["day", "item_id"], {"persistence": F.col("target")})
    mean = o.groupBy("group_id").agg(F.avg("target").alias("scale"))
    out = prev.where(F.col("persistence").isNotNull()).join(mean, "group_id")
    factor = 0.9 + (F.col("item_id") % 21) / 100.0
    return out.withColumn("prediction", F.when(F.col("item_id") % 31 != 0, F.col("persistence") * factor))


NUMERIC = """
norders AS (
  SELECT o_orderkey AS item_id, o_custkey AS group_id, CAST(o_orderdate AS DATE) AS day, o_totalprice AS target,
    o_orderpriority AS run, o_orderstatus AS arm FROM orders
),
nlog AS (
  SELECT *, CASE WHEN item_id % 31 <> 0 THEN persistence * (0.9::DOUBLE + (item_id % 21) / 100.0::DOUBLE) END AS prediction FROM (
    SELECT *, lag(target) OVER (PARTITION BY group_id ORDER BY day, item_id) AS persistence,
      avg(target) OVER (PARTITION BY group_id) AS scale
    FROM norders) WHERE persistence IS NOT NULL
)"""

# --- frame sequences --------------------------------------------------------------------------------------------------
def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a sequence at signed second offsets, two minutes apart, in vector order."""
    from scorefold.operators.ordered import positions

    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), F.col("label").alias("sequence"), F.col("embedding").alias("pixels"))
    p = positions(v, ["sequence"], ["frame_id"])
    return p.select("frame_id", "sequence", ((F.col("pos") - 19) * 120 + F.col("frame_id") % 7 * 10).alias("offset_seconds"), "pixels")


FRAMES = """
frames AS (
  SELECT vec_id AS frame_id, label AS sequence,
    (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 20) * 120 + vec_id % 7 * 10 AS offset_seconds, embedding AS pixels
  FROM embeddings
)"""

# --- driver windows ---------------------------------------------------------------------------------------------------
DRIVERS = ("click", "error", "purchase", "signup", "view")


def driver_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean of each driver per sample (one row per sample and day)."""
    e = table(spark, sf_dir, "events")
    g = e.groupBy(F.col("user_id").alias("sample"), F.to_date("ts").alias("day"))
    return g.pivot("event_type", list(DRIVERS)).agg(F.avg("value"))


DRIVER_DAYS = """
ddays AS (
  SELECT user_id AS sample, CAST(ts AS DATE) AS day,
""" + ",\n".join(f"    avg(value) FILTER (event_type = '{d}') AS {d}" for d in DRIVERS) + """
  FROM events GROUP BY ALL
)"""
