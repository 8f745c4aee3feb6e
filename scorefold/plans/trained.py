"""Queries over trained comparators. Learners have no SQL twin; their outputs are compared as row counts and sanity scores."""

from pyspark.sql import functions as F

from scorefold.functions import arrays as AR
from scorefold.operators import retrieve as R
from scorefold.operators import scores as S
from scorefold.operators import trained as T
from scorefold.plans.calibration import labelled_days
from scorefold.plans.registry import query
from scorefold.plans.retrieve import SEED, drawable, pool, sides, training
from scorefold.session import checkpointed
from scorefold.sources import standins as V

FEATS = list(R.FEATURES)


def rows(spark, sf):
    p = pool(spark, sf).withColumns(AR.report_features()).withColumnRenamed("next", "target").withColumn("persistence", F.col("today"))
    mean = p.groupBy("incident_id").agg(F.avg("target").alias("scale"))
    return p.join(mean, "incident_id").select("analogue_id", "incident_id", "report_date", "target", "persistence", "scale", *FEATS)


@query("train_regressors")
def _(spark, sf):
    r = checkpointed(rows(spark, sf))
    preds = T.train_regressors(r.where("report_date < date'2024-01-20'"), r.where("report_date >= date'2024-01-20'"), FEATS, ["analogue_id"])
    return S.rounded(S.regression_scores(preds, ["run"]), 4)


@query("grouped_cv")
def _(spark, sf):
    return S.rounded(S.cv_metrics(T.grouped_cv(rows(spark, sf), FEATS, "incident_id", ["analogue_id"]), "run", "fold"), 4)


@query("train_classifiers")
def _(spark, sf):
    d = labelled_days(spark, sf).withColumn("part", F.dayofmonth("day"))
    out = T.train_classifiers(d.where("part <= 15"), d.where("part between 16 and 20"), d.where("part > 20"), list(V.DRIVERS), ["sample", "day"])
    return S.rounded(S.average_precision(out.withColumn("score", F.round("score", 9)), ["run"]), 4)


@query("movement_models")
def _(spark, sf):
    return S.rounded(T.movement_cv(pool(spark, sf)), 4)


@query("retrieve_quota_model")
def _(spark, sf):
    it, p = sides(spark, sf)
    models = T.fit_movement(checkpointed(T.movement_rows(training(spark, sf, p).drop("moved"))))
    it = T.with_move_probability(it, models)
    return R.retrieve_quota(it, drawable(p, "band", "pers_band"), "band", "pers_band", 6, SEED, "model").select("item_id", "grp", "analogue_id")


@query("predictions_as_log", "SELECT 'numeric' AS task, o_orderpriority AS model, 'trained' AS arm, count(*) AS n FROM (SELECT o_orderpriority, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders) WHERE prev IS NOT NULL GROUP BY o_orderpriority")
def _(spark, sf):
    log = T.predictions_as_log(V.numeric_log(spark, sf), "numeric", "trained", F.col("item_id"), F.col("prediction"))
    return log.groupBy("task", "model", "arm").agg(F.count(F.lit(1)).alias("n"))
