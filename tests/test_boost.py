"""Boosted trees grown in shared jobs against MLlib's learners, a fit at a time, and the number of their jobs."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from scorefold.operators import boost
from scorefold.operators import trained as T


@pytest.fixture(scope="module")
def rows(spark):
    """Features of few values, which both sides cut between all values; some rows occur more than once."""
    rng = np.random.default_rng(4)
    x = np.c_[rng.integers(0, 12, 600), rng.integers(0, 20, 600), rng.integers(0, 2, 600)].astype(float)
    y = (x[:, 0] + x[:, 1] * x[:, 2] / 3 + 4 * rng.random(600) > 9).astype(int)
    r = [(i, *map(float, a), int(k), float(a[0] * 2 + a[1] + v), i % 3) for i, (a, k, v) in enumerate(zip(x, y, rng.random(600)))]
    return spark.createDataFrame(r + [(1000 + t[0], *t[1:]) for t in r[:90]], "id int, a double, b double, c double, label int, v double, fold int").coalesce(2).cache()


COLS = ["a", "b", "c"]


def test_folds_equal_fits_of_mllib(spark, rows):
    for label, loss, gbt in (("label", "log", GBTClassifier(labelCol="label", maxIter=6, maxDepth=3, seed=1)), ("v", "absolute", GBTRegressor(labelCol="v", lossType="absolute", maxIter=6, maxDepth=3, seed=1, predictionCol="p"))):
        fits = [boost.Fit(3, 6, loss=loss, without=k) for k in range(3)]
        at, trees = boost.fitted(rows, COLS, label, fits, "fold")
        got = {r["id"]: r["s"] for r in boost.held_out(rows, COLS, at, fits, trees, "fold", "s").collect()}
        assert len(got) == rows.count()
        for k in range(3):
            m = Pipeline(stages=[T._assembled(COLS), gbt]).fit(rows.where(F.col("fold") != k)).transform(rows.where(F.col("fold") == k))
            for r in m.select("id", (vector_to_array("probability")[1] if loss == "log" else F.col("p")).alias("s")).collect():
                assert got[r["id"]] == pytest.approx(r["s"], abs=1e-9)


def test_settings_of_a_grid_equal_fits_of_their_own(spark, rows):
    fits = [boost.Fit(2, 5, 0.05), boost.Fit(4, 3, 0.2)]
    at, together = boost.fitted(rows, COLS, "label", fits)
    pdf = rows.toPandas()
    for fit, trees in zip(fits, together):
        _, (alone,) = boost.fitted(rows, COLS, "label", [fit])
        assert len(trees) == fit.rounds
        assert np.array_equal(next(boost.scores(pdf, COLS, at, fit, trees))[1], next(boost.scores(pdf, COLS, at, fit, alone))[1])


def test_scores_made_anew_equal_scores_carried_on(spark, rows, monkeypatch):
    fit, pdf = boost.Fit(2, 5), rows.toPandas()
    at, (carried,) = boost.fitted(rows, COLS, "label", [fit])
    monkeypatch.setattr(boost, "RENEW", 2)
    _, (anew,) = boost.fitted(rows, COLS, "label", [fit])
    assert np.allclose(next(boost.scores(pdf, COLS, at, fit, carried))[1], next(boost.scores(pdf, COLS, at, fit, anew))[1], atol=1e-12)


def jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, "count")
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_more_fits_need_no_more_jobs(spark, rows):
    fit = lambda n: jobs(spark, f"boost-{n}", lambda: boost.fitted(rows, COLS, "label", [boost.Fit(2, 4, r) for r in (0.1, 0.2, 0.3, 0.4)[:n]]))
    assert fit(4) == fit(1)


def test_a_feature_of_many_values_has_at_most_32_bins(spark):
    d = spark.range(5000).select((F.col("id") % 997).cast("double").alias("a"), (F.col("id") % 32).cast("double").alias("b"), F.lit(1.0).alias("c"))
    a, b, c = boost.cuts(d, ["a", "b", "c"])
    assert 28 <= len(a) < boost.BINS and list(b) == [float(i) for i in range(31)] and len(c) == 0


def test_packed_features_have_the_sums_of_each():
    rng = np.random.default_rng(2)
    at = [np.arange(n - 1.0) for n in (2, 32, 2, 13, 2, 2, 5, 2, 1)]
    x = np.array([rng.integers(0, len(a) + 1, 500) for a in at], np.uint8)
    packs = boost._packs(at)
    assert sorted(j for p in packs for j in p) == list(range(len(at))) and len(packs) < 5
    fit, w, y = boost.Fit(1, 1, loss="absolute"), rng.integers(1, 4, 500).astype(float), rng.random(500)
    (got,) = boost._sums([(x, boost._packed(x, at, packs), y, w, np.zeros(500), np.zeros((1, 500)))], [fit], [(np.zeros(1, int), np.zeros(1), np.zeros(2))], 0, 0)
    got = boost._unpacked(got, at, packs)[0, 0]
    for j in range(len(at)):
        assert np.allclose(got[j, :, 0], np.bincount(x[j], w, boost.BINS)) and np.allclose(got[j, :, 1], np.bincount(x[j], w * y, boost.BINS))
