"""Trained comparators: the work they are registered with, and rounds of a long fit against short fits."""

import inspect

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from scorefold.operators import trained as T


def default(f, name):
    return inspect.signature(f).parameters[name].default


def test_rounds_and_grid_are_those_of_the_reference():
    assert default(T.train_regressors, "iterations") == default(T.grouped_cv, "iterations") == 100
    assert default(T.movement_cv, "iterations") == 300
    assert set(default(T.train_classifiers, "rates")) == {0.03, 0.05, 0.1, 0.2}
    assert set(default(T.train_classifiers, "iterations")) >= {5, 10, 20, 40, 50, 100, 150, 200} and set(default(T.train_classifiers, "depths")) == {2, 3, 4, 5}


def days(spark, n=400):
    rng = np.random.default_rng(3)
    x = rng.random((n, 2))
    y = (x[:, 0] + 0.3 * rng.random(n) > 0.6).astype(int)
    return spark.createDataFrame([(i, float(a), float(b), int(k)) for i, ((a, b), k) in enumerate(zip(x, y))], "id int, a double, b double, label int")


def scores(m, df):
    return [r["s"] for r in m.transform(df).select("id", vector_to_array("probability")[1].alias("s")).orderBy("id").collect()]


def test_first_rounds_equal_a_short_fit(spark):
    df = days(spark).coalesce(2).cache()
    fit = lambda n: Pipeline(stages=[T._assembled(["a", "b"]), GBTClassifier(labelCol="label", maxDepth=2, maxIter=n, stepSize=0.2, seed=1)]).fit(df)
    long = fit(7)
    assert scores(T.first_rounds(long, 3), df) == pytest.approx(scores(fit(3), df), abs=1e-12)
    assert scores(T.first_rounds(long, 7), df) == scores(long, df)


def test_classifiers_search_the_learning_rate(spark):
    df = days(spark)
    part = lambda k: df.where(F.col("id") % 3 == k)
    search = lambda rates: T.train_classifiers(part(0), part(1), part(2), ["a", "b"], ["id"], depths=(2,), iterations=(1, 3), rates=rates)
    got = {r["run"]: r["n"] for r in search((0.05, 0.5)).groupBy("run").agg(F.count("*").alias("n")).collect()}
    assert got == {"gbt": part(2).count(), "logistic": part(2).count()}


def walks(spark, n=60, days=16):
    """A pool of incidents whose direction follows yesterday's and whose moves depend on the day and the containment; some values are missing."""
    rng, rows = np.random.default_rng(11), []
    for i in range(n):
        v = 50.0
        for d in range(1, days):
            prev, pct = v, float(rng.integers(0, 100))
            v *= float(np.exp(rng.choice([-0.3, 0.0, 0.3]))) if rng.random() < 0.8 - pct / 200 else 1.0
            nxt = v * float(np.exp(0.3 * np.sign(v - prev + 0.1 * rng.normal()))) if rng.random() < 0.9 - pct / 150 else v
            rows.append((i, v, nxt, prev, float(d), None if d % 7 == 0 else pct, d, None if d % 3 == 0 else float(d), None if d % 5 == 0 else float(i % 13)))
    return spark.createDataFrame(rows, "incident_id bigint, today double, next double, prev double, acres double, pct double, day_of_run bigint, new_acres double, aerial double").coalesce(2)


def test_movement_cv_covers_direction_and_phase(spark):
    pool = walks(spark).cache()
    got = {r["run"]: r for r in T.movement_cv(pool, folds=3, iterations=4).collect()}
    assert set(got) == {"logistic", "gbt", "phase", "direction"}
    rows = T.movement_rows(pool).cache()
    assert {got[r]["positives"] + got[r]["negatives"] for r in ("logistic", "gbt", "phase")} == {rows.count()}
    assert got["direction"]["positives"] + got["direction"]["negatives"] == rows.where("moved = 1").count()
    assert got["direction"]["positives"] == rows.where("moved = 1 AND up = 1").count()
    assert got["phase"]["auroc"] > 0.5 and got["logistic"]["accuracy"] is None
    d = T.group_folds(rows, "incident_id", 3, 1).toPandas()
    for run, y, part in (("logistic", "moved", d), ("direction", "up", d[d["moved"] == 1])):
        p = np.zeros(len(part))
        for k in range(3):
            out = (part["fold"] == k).to_numpy()
            p[out] = penalised(part[~out], part[out], y)
        hit = part[y].to_numpy() == 1
        above = p[hit][:, None] - p[~hit][None, :]
        assert got[run]["auroc"] == pytest.approx(np.mean(above > 1e-9) + np.mean(abs(above) <= 1e-9) / 2, abs=2e-3)
        if run == "direction":
            assert got[run]["accuracy"] == pytest.approx(np.mean((p > 0.5) == hit), abs=3e-3)


def penalised(train, test, y):
    """Probabilities of a logistic model with a unit penalty on standardised weights, by Newton's steps."""
    cols = list(T.lin_features())
    mu, sd = train[cols].mean(), train[cols].std(ddof=0).replace(0, 1)
    x, e = (np.c_[np.ones(len(t)), ((t[cols] - mu) / sd).to_numpy(float)] for t in (train, test))
    w, penalty = np.zeros(x.shape[1]), np.diag([0.0] + [1.0] * len(cols))
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (p - train[y].to_numpy()) + penalty @ w)
    return 1 / (1 + np.exp(-e @ w))


def test_phase_scores_leave_the_fold_out(spark):
    rows = [(0, 1, "a"), (0, 0, "a"), (1, 1, "a"), (1, 1, "b"), (2, 0, "b"), (2, 0, "a"), (2, 1, "c")]
    got = {(r["fold"], r["phase"]): r["p_move"] for r in T.phase_scores(spark.createDataFrame(rows, "fold int, moved int, phase string"), 3).collect()}
    for fold, _, phase in rows:
        rest = [(m, p) for f, m, p in rows if f != fold]
        own = [m for m, p in rest if p == phase]
        assert got[fold, phase] == pytest.approx((sum(own) + 20 * sum(m for m, _ in rest) / len(rest)) / (len(own) + 20))


def test_tree_features_are_missing_where_the_report_is(spark):
    d = walks(spark).withColumns(T.tree_features())
    assert len(T.tree_features()) == 8
    assert d.where("(t_pct IS NULL) <> (pct IS NULL) OR (t_new_acres IS NULL) <> (new_acres IS NULL) OR (t_aerial IS NULL) <> (aerial IS NULL) OR t_change IS NULL").count() == 0
