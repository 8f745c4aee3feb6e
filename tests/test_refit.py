"""Refitted losses and fold draws against plain loops; both ways of refitting agree."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorefold.operators import calibration as Q
from scorefold.operators import refit as RF

K, REPS, SEED = 3, 12, 9


def table(spark):
    rng = np.random.default_rng(4)
    rows = []
    for model in ("m", "n"):
        for i in range(60):
            c, y = f"c{i % 8}", int(rng.random() < 0.4)
            rows += [(model, arm, c, round(float(np.clip(0.2 + 0.4 * y + rng.normal(0, 0.3), 0, 1)), 1), y) for arm in ("bare", "grounded")]
    rows.append(("m", "bare", "c1", None, 1))
    return Q.group_folds(spark.createDataFrame(rows, "model string, arm string, cluster string, p double, y int"), "cluster", K, 5)


def isotonic(x, n, s):
    """Fitted values by the max-min formula, straight from the definition."""
    mean = lambda i, j: sum(s[i : j + 1]) / sum(n[i : j + 1])
    return [max(min(mean(j, k) for k in range(i, len(x))) for j in range(i + 1)) for i in range(len(x))]


def loss(rows, w):
    """rows: (cluster, fold, p, y); w: how often a cluster was drawn."""
    total = 0.0
    for k in range(K):
        by = defaultdict(lambda: [0.0, 0.0])
        for c, f, p, y in rows:
            if f != k and w[c]:
                by[p][0] += w[c]
                by[p][1] += w[c] * y
        x = sorted(by)
        if not x:
            return None
        fit = isotonic(x, [by[v][0] for v in x], [by[v][1] for v in x])
        total += sum(w[c] * (float(np.interp(p, x, fit)) - y) ** 2 for c, f, p, y in rows if f == k)
    return total


def draws(model, clusters, rep):
    ids = sorted(clusters)
    number = lambda j: int(hashlib.md5(f"{SEED}|{model}|{rep}|{j}".encode()).hexdigest()[:15], 16) % len(ids)
    return Counter(ids[number(j)] for j in range(len(ids)))


@pytest.mark.parametrize("wide", [RF.WIDE, 2])
def test_replicate_losses_equal_a_plain_loop(spark, monkeypatch, wide):
    for name, value in (("WIDE", wide), ("SLICE", 3), ("CHUNK", 5)):
        monkeypatch.setattr(RF, name, value)
    df = table(spark)
    rows = defaultdict(list)
    for r in df.where("p IS NOT NULL").collect():
        rows[r["model"], r["arm"]].append((r["cluster"], r["fold"], r["p"], r["y"]))
    got = {(r["model"], r["arm"], r["rep"]): r for r in RF.replicate_losses(df, ["model"], ["arm"], "cluster", "p", "y", "fold", K, REPS, SEED).collect()}
    assert len(got) == 4 * (REPS + 1)
    for (model, arm, rep), r in got.items():
        clusters = {c for c, *_ in rows[model, arm]}
        w = draws(model, clusters, rep) if rep >= 0 else Counter(clusters)
        want = loss(rows[model, arm], w)
        assert r["weight"] == sum(w[c] for c, *_ in rows[model, arm])
        assert np.isnan(r["loss"]) if want is None else abs(r["loss"] - want) < 1e-9
    both = RF.loss_difference(RF.replicate_losses(df, ["model"], ["arm"], "cluster", "p", "y", "fold", K, REPS, SEED), ["model"], "arm", "bare", "grounded")
    for r in both.collect():
        mean = lambda arm, rep: got[r["model"], arm, rep]["loss"] / got[r["model"], arm, rep]["weight"]
        d = [mean("grounded", b) - mean("bare", b) for b in range(REPS)]
        assert abs(r["point"] - (mean("grounded", -1) - mean("bare", -1))) < 1e-12
        assert np.allclose([r["lo"], r["hi"]], np.nanpercentile(d, [2.5, 97.5])) and r["dropped"] == int(np.isnan(d).sum())


def test_fold_draws_are_those_of_group_folds(spark):
    df = table(spark).drop("fold")
    got = {(r["fold_seed"], r["cluster"]): r["fold"] for r in RF.fold_draws(df, "cluster", K, [5, 6]).collect()}
    for seed in (5, 6):
        want = {r["cluster"]: r["fold"] for r in Q.group_folds(df.select("cluster").distinct(), "cluster", K, seed).collect()}
        assert {c: f for (s, c), f in got.items() if s == seed} == want


def test_fold_sweep_of_one_seed_equals_crossfit(spark):
    df = table(spark)
    one = {(r["model"], r["arm"]): r["ece"] for r in RF.fold_sweep_errors(df.drop("fold"), ["model", "arm"], "cluster", "p", "y", K, [5]).collect()}
    fit = Q.crossfit_isotonic(df, ["model", "arm"], "p", "y", "fold", K, "q")
    rows = df.join(fit, ["model", "arm", "fold", "p"]).withColumn("bin", Q.width_bin("q")).groupBy("model", "arm", "bin").agg(F.abs(F.sum(F.col("q") - F.col("y"))).alias("d"), F.count("*").alias("n"))
    for r in rows.groupBy("model", "arm").agg((F.sum("d") / F.sum("n")).alias("e")).collect():
        assert abs(one[r["model"], r["arm"]] - r["e"]) < 1e-12
    errors = spark.createDataFrame([("m", "a", 1, 0.2), ("m", "b", 1, 0.1), ("n", "a", 1, 0.2), ("n", "b", 1, 0.3), ("m", "a", 2, 0.2), ("m", "b", 2, 0.3), ("n", "a", 2, 0.1), ("n", "b", 2, 0.1)], "model string, arm string, fold_seed int, ece double")
    assert {(r["runs_below"], r["draws"]) for r in RF.runs_below(errors, ["model"], "arm", "a").collect()} == {(1, 1), (0, 1)}
    swept = {(r["model"], r["arm"]): r["below"] for r in RF.fold_sweep(errors, ["model"], "arm", "a").collect()}
    assert swept == {("m", "a"): 0.0, ("m", "b"): 0.5, ("n", "a"): 0.0, ("n", "b"): 0.0}
