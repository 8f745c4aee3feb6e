"""Trained comparators with Spark's own learners and, where many boosted fits run, trees grown in shared jobs (``boost``): ratio and count regressors, event classifiers, movement models."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorefold.functions.arrays import lin_features, tree_features
from scorefold.functions.columns import PCT_EDGES, band
from scorefold.operators import boost
from scorefold.operators.calibration import group_folds
from scorefold.operators.retrieve import DOR_EDGES, MOVE, PHASE_SHRINK, outcome_ratio
from scorefold.operators.scores import auroc, average_precision
from scorefold.session import checkpointed


FITS_AT_ONCE = 5  # fits are independent, and a boosting round is a few short jobs


def _together(jobs: Sequence[Callable]) -> list:
    """Results of the jobs in their order, FITS_AT_ONCE at a time."""
    with ThreadPoolExecutor(FITS_AT_ONCE) as ex:
        return [f.result() for f in [ex.submit(inheritable_thread_target(SparkSession.active())(j)) for j in jobs]]


def _assembled(cols: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep")


def _filled(df: DataFrame, cols: Sequence[str], value: float = -1.0) -> DataFrame:
    """Trees split a sentinel off by themselves, so missing values become one."""
    return df.na.fill(value, list(cols))


def train_regressors(train: DataFrame, evaluation: DataFrame, features: Sequence[str], key: Sequence[str], iterations: int = 100, depth: int = 3, seed: int = 1) -> DataFrame:
    """Predictions of three learners on the evaluation rows (long form: key, target, persistence, scale, run, prediction).

    Boosted trees with absolute loss on the ratio to persistence and on the count; ridge regression on imputed, scaled features.
    """
    ratio = F.col("target") / F.greatest(F.col("persistence"), F.lit(1.0))
    t = checkpointed(train.withColumn("__ratio", ratio).where(F.col("target").isNotNull()))
    e = evaluation
    out = None
    labels = {"gbt_ratio": "__ratio", "gbt_count": "target"}
    gbt = lambda label: Pipeline(stages=[_assembled(features), GBTRegressor(labelCol=label, lossType="absolute", maxIter=iterations, maxDepth=depth, seed=seed, predictionCol="__p")])
    models = _together([lambda y=y: gbt(y).fit(_filled(t, features)) for y in labels.values()])
    for run, m in zip(labels, models):
        p = m.transform(_filled(e, features))
        value = F.col("__p") * F.greatest(F.col("persistence"), F.lit(1.0)) if run == "gbt_ratio" else F.col("__p")
        rows = p.select(*key, "target", "persistence", "scale", F.lit(run).alias("run"), value.alias("prediction"))
        out = rows if out is None else out.unionByName(rows)
    filled = [f"i_{f}" for f in features]
    ridge = Pipeline(stages=[
        Imputer(inputCols=list(features), outputCols=filled, strategy="median"), _assembled(filled, "raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True), LinearRegression(labelCol="__ratio", regParam=1.0, predictionCol="__p")])
    p = ridge.fit(t).transform(e)
    rows = p.select(*key, "target", "persistence", "scale", F.lit("ridge").alias("run"), (F.col("__p") * F.greatest(F.col("persistence"), F.lit(1.0))).alias("prediction"))
    return out.unionByName(rows)


def grouped_cv(train: DataFrame, features: Sequence[str], group: str, key: Sequence[str], folds: int = 5, seed: int = 1, iterations: int = 100) -> DataFrame:
    """Out-of-fold ratio predictions with whole groups held out (a fit per fold; the fits of all folds share their jobs)."""
    t = checkpointed(group_folds(_filled(train, features), group, folds, seed).withColumn("__ratio", F.col("target") / F.greatest(F.col("persistence"), F.lit(1.0))))
    fits = [boost.Fit(3, iterations, loss="absolute", without=k) for k in range(folds)]
    at, trees = boost.fitted(t, features, "__ratio", fits, "fold")
    p = boost.held_out(t, features, at, fits, trees, "fold", "__p")
    return p.select(*key, "target", "persistence", "scale", "fold", F.lit("gbt_ratio").alias("run"), (F.col("__p") * F.greatest(F.col("persistence"), F.lit(1.0))).alias("prediction"))


def first_rounds(fit: PipelineModel, n: int) -> PipelineModel:
    """The fit after its first n rounds. A round leaves earlier trees as they are, so this equals a fit of n rounds."""
    m = fit.stages[-1]
    sc = SparkContext._active_spark_context
    ml = sc._jvm.org.apache.spark.ml
    trees, weights = sc._gateway.new_array(ml.regression.DecisionTreeRegressionModel, n), sc._gateway.new_array(sc._jvm.double, n)
    all_trees, all_weights = m._java_obj.trees(), m.treeWeights
    for i in range(n):
        trees[i], weights[i] = all_trees[i], float(all_weights[i])
    j = ml.classification.GBTClassificationModel(m.uid, trees, weights)
    return PipelineModel([*fit.stages[:-1], GBTClassificationModel(j)])


def train_classifiers(train: DataFrame, validation: DataFrame, test: DataFrame, features: Sequence[str], key: Sequence[str], label: str = "label",
                      depths: Sequence[int] = (2, 3, 4, 5), iterations: Sequence[int] = (5, 10, 20, 40, 50, 100, 150, 200), seed: int = 1,
                      rates: Sequence[float] = (0.03, 0.05, 0.1, 0.2)) -> DataFrame:
    """Test scores (long form) of boosted trees, whose depth, learning rate and rounds are chosen by average precision on a validation split,
    and of logistic regression. One fit per depth and rate, all in the same jobs: its first rounds are the fits with fewer rounds."""
    t, v = checkpointed(_filled(train, features)), checkpointed(_filled(validation, features))
    fits = [boost.Fit(d, max(iterations), r) for d in depths for r in rates]
    at, trees = boost.fitted(t, features, label, fits)
    model = t.sparkSession.sparkContext.broadcast((at, trees))

    def tried(parts):
        """Rows of equal score and label counted, per fit and number of rounds."""
        at, trees = model.value
        for p in parts:
            for k, fit in enumerate(fits):
                for n, s in boost.scores(p, features, at, fit, trees[k], iterations):
                    yield pd.DataFrame({"fit": k, "rounds": n, label: p[label].astype(int), "score": s}).groupby(["fit", "rounds", label, "score"], as_index=False).size()

    s = v.where(F.col(label).isNotNull()).select(*features, label).mapInPandas(tried, f"fit int, rounds int, `{label}` int, score double, size long")
    aps = {(r["fit"], r["rounds"]): r["ap"] or 0.0 for r in average_precision(s, ["fit", "rounds"], "score", label, F.col("size")).select("fit", "rounds", "ap").collect()}  # a row per setting
    k, n = max(((k, n) for k in range(len(fits)) for n in iterations), key=lambda x: aps.get(x, 0.0))  # the first of equal ones

    def chosen(parts):
        at, trees = model.value
        for p in parts:
            yield p.assign(score=next(boost.scores(p, features, at, fits[k], trees[k][:n]))[1])

    logit = Pipeline(stages=[_assembled(features, "raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(labelCol=label, regParam=0.01)]).fit(t)
    e = _filled(test, features).select(*key, label, *[f for f in features if f not in (*key, label)])
    p = e.mapInPandas(chosen, ", ".join(f"`{c}` {kind}" for c, kind in [*e.dtypes, ("score", "double")])).select(*key, label, F.lit("gbt").alias("run"), "score")
    return p.unionByName(logit.transform(e).select(*key, label, F.lit("logistic").alias("run"), vector_to_array("probability")[1].alias("score")))


def movement_rows(pool: DataFrame) -> DataFrame:
    """Design rows of the movement models: features, moved and up flags of pool rows with a previous day."""
    x = outcome_ratio()
    return pool.where(F.col("prev").isNotNull()).withColumns({**lin_features(), "moved": (F.abs(x - 1) > MOVE).cast("int"), "up": (x > 1).cast("int")})


def fit_movement(rows: DataFrame) -> tuple:
    """(move model, direction model): logistic models of whether a row moves and, among moved rows, which way."""
    cols = list(lin_features())
    stages = lambda y: Pipeline(stages=[_assembled(cols, "raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(labelCol=y, regParam=0.001, maxIter=50)])
    return stages("moved").fit(rows), stages("up").fit(rows.where(F.col("moved") == 1))


def with_move_probability(df: DataFrame, models: tuple) -> DataFrame:
    """Adds p_move and p_up from the two models."""
    base = df.withColumns(lin_features())
    drop = [*lin_features(), "raw", "features", "rawPrediction", "probability", "prediction"]
    for m, name in zip(models, ("p_move", "p_up")):
        base = m.transform(base).withColumn(name, vector_to_array("probability")[1]).drop("raw", "features", "rawPrediction", "probability", "prediction")
    return base.drop(*[d for d in drop if d in base.columns])


def movement_cv(pool: DataFrame, folds: int = 5, seed: int = 1, iterations: int = 300) -> DataFrame:
    """Out-of-fold AUC of the move models (logistic, boosted, and the phase table) on all rows, and of the direction model on the rows that moved, with the
    share of them whose direction it has right; folds by incident, and a fold's direction model sees the moved rows of the others only.

    Logistic models have a unit penalty on the standardised weights, summed over the rows, and run until they converge. The boosted fits of all folds share
    their jobs."""
    lin, tree = list(lin_features()), list(tree_features())
    rows = movement_rows(pool).withColumns({**tree_features(), "phase": F.concat_ws("|", band("day_of_run", DOR_EDGES), band("pct", PCT_EDGES))})
    t = checkpointed(_filled(group_folds(rows, "incident_id", folds, seed).select("fold", "moved", "up", "phase", *lin, *tree), tree))
    score = lambda x: F.round(x, 9).alias("score")
    out = phase_scores(t, folds).select(F.lit("phase").alias("run"), F.col("moved").alias("hit"), score(F.col("p_move")))

    trained = {k: t.where(F.col("fold") != k) for k in range(folds)}
    n = t.groupBy("fold").agg(F.count(F.lit(1)).alias("moved"), F.sum("moved").alias("up")).collect()  # a row per fold
    rest = lambda k, y: sum(r[y] for r in n if r["fold"] != k)
    logistic = lambda y, k: Pipeline(stages=[_assembled(lin), LogisticRegression(labelCol=y, regParam=1.0 / max(rest(k, y), 1), maxIter=2000)])
    seen = {"moved": lambda d: d, "up": lambda d: d.where(F.col("moved") == 1)}
    both = [(y, k) for y in seen for k in range(folds)]
    models = _together([lambda y=y, k=k: logistic(y, k).fit(seen[y](trained[k])) for y, k in both])
    for (y, k), m in zip(both, models):
        p = m.transform(seen[y](t.where(F.col("fold") == k)))
        out = out.unionByName(p.select(F.lit({"moved": "logistic", "up": "direction"}[y]).alias("run"), F.col(y).alias("hit"), score(vector_to_array("probability")[1])))

    fits = [boost.Fit(3, iterations, 0.05, without=k) for k in range(folds)]
    at, trees = boost.fitted(t, tree, "moved", fits, "fold")
    p = boost.held_out(t.select("fold", "moved", *tree), tree, at, fits, trees, "fold", "__p")
    out = checkpointed(out.unionByName(p.select(F.lit("gbt").alias("run"), F.col("moved").alias("hit"), score(F.col("__p")))))
    right = out.where(F.col("run") == "direction").groupBy("run").agg(F.avg(((F.col("score") > 0.5).cast("int") == F.col("hit")).cast("double")).alias("accuracy"))
    return auroc(out, ["run"], "score", "hit").join(right, "run", "left")


def phase_scores(rows: DataFrame, folds: int) -> DataFrame:
    """rows (fold, moved, phase) with p_move: the move rate of their phase in the other folds, shrunken toward the rate of all their rows."""
    cells = rows.groupBy("phase", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("moved").alias("m"))  # day bands x containment bands x folds
    out = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("without")
    rest = cells.select("*", out).where(F.col("without") != F.col("fold"))
    rate = rest.groupBy("without").agg((F.sum("m") / F.sum("n")).alias("__g")).withColumnRenamed("without", "fold")
    mine = rest.groupBy("without", "phase").agg(F.sum("n").alias("__n"), F.sum("m").alias("__m")).withColumnRenamed("without", "fold")
    p = (F.coalesce("__m", F.lit(0)) + PHASE_SHRINK * F.col("__g")) / (F.coalesce("__n", F.lit(0)) + PHASE_SHRINK)
    return rows.join(F.broadcast(mine), ["fold", "phase"], "left").join(F.broadcast(rate), "fold").withColumn("p_move", p)


def predictions_as_log(preds: DataFrame, task: str, arm: str, item: Column, prediction: Column) -> DataFrame:
    """Comparator predictions in the response-log schema, so that every score and audit reads them like a model's."""
    return preds.select(
        F.lit(task).alias("task"), F.col("run").alias("model"), F.lit(arm).alias("arm"), F.lit(None).cast("string").alias("variant"), item.cast("string").alias("item_id"),
        F.lit(None).cast("string").alias("raw"), prediction.alias("prediction_num"), F.lit(None).cast("string").alias("error"), "target", "persistence", "scale")
