"""Sliced windows against pandas, with one key holding most of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scorefold.operators import ordered as O


@pytest.fixture(autouse=True)
def slice_everything(monkeypatch):
    """Slice the test's groups although they are small."""
    monkeypatch.setattr(O, "SMALL_GROUP", 0)


@pytest.fixture(scope="module")
def hot():
    rng = np.random.default_rng(3)
    n = 3000
    df = pd.DataFrame({"g": np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", "c"], n)), "id": np.arange(n), "x": rng.integers(0, 40, n).astype(float), "v": rng.integers(0, 5, n)})
    return pd.concat([df, pd.DataFrame({"g": ["single"], "id": [n], "x": [1.0], "v": [2]})])


@pytest.mark.parametrize("slices", [1, 7, 32])
def test_running_and_positions(spark, hot, slices):
    sdf = spark.createDataFrame(hot)
    r = O.running(sdf, ["g"], ["x", "id"], {"s": F.col("v")}, slices, totals=True)
    r = O.positions(r, ["g"], ["x", "id"], "pos", "size", slices).toPandas().sort_values(["g", "x", "id"]).reset_index(drop=True)
    want = hot.sort_values(["g", "x", "id"]).reset_index(drop=True)
    assert (r["s"] == want.groupby("g")["v"].cumsum()).all()
    assert (r["s_total"] == want.groupby("g")["v"].transform("sum")).all()
    assert (r["pos"] == want.groupby("g").cumcount()).all()
    assert (r["size"] == want.groupby("g")["v"].transform("size")).all()


@pytest.mark.parametrize("ahead", [False, True])
def test_neighbour(spark, hot, ahead):
    r = O.neighbour(spark.createDataFrame(hot), ["g"], ["x", "id"], {"nb": F.col("id")}, ahead=ahead).toPandas().sort_values(["g", "x", "id"])
    want = hot.sort_values(["g", "x", "id"]).groupby("g")["id"].shift(-1 if ahead else 1)
    assert np.array_equal(r["nb"].to_numpy(float), want.to_numpy(float), equal_nan=True)


def test_neighbours_both_and_carried(spark, hot):
    d = hot.copy()
    d["y"] = np.where(d["v"] == 0, d["id"].astype(float), np.nan)
    sdf = spark.createDataFrame(d).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    r = O.neighbours_both(sdf, ["g"], ["x", "id"], F.col("y"), "prev", "next")
    r = O.carried(r, ["g"], ["x", "id"], F.col("y"), "last").toPandas().sort_values(["g", "x", "id"])
    w = d.sort_values(["g", "x", "id"])
    assert np.array_equal(r["prev"].to_numpy(float), w.groupby("g")["y"].ffill().to_numpy(), equal_nan=True)
    assert np.array_equal(r["last"].to_numpy(float), r["prev"].to_numpy(float), equal_nan=True)
    assert np.array_equal(r["next"].to_numpy(float), w.groupby("g")["y"].bfill().to_numpy(), equal_nan=True)


def test_percentiles_match_numpy(spark, hot):
    r = O.percentiles(spark.createDataFrame(hot), ["g"], "x", {"p10": 0.1, "p50": 0.5, "p99": 0.99}).toPandas().set_index("g")
    for g, x in hot.groupby("g")["x"]:
        assert np.allclose(r.loc[g, ["p10", "p50", "p99"]].to_numpy(float), np.percentile(x, [10, 50, 99]))


def test_average_ranks(spark, hot):
    r = O.average_ranks(spark.createDataFrame(hot), ["g"], "x").toPandas()
    want = hot.assign(r=hot.groupby("g")["x"].rank()).drop_duplicates(["g", "x"])[["g", "x", "r"]]
    j = r.merge(want, on=["g", "x"])
    assert len(j) == len(r) == len(want) and np.allclose(j["avg_rank"], j["r"])


def test_asof_sum(spark, hot):
    probe = hot.iloc[::3].rename(columns={"x": "at", "id": "pid"})[["g", "at", "pid"]]
    r = O.asof_sum(spark.createDataFrame(probe), spark.createDataFrame(hot), ["g"], "at", "x", "v", "s", ["pid"]).toPandas().set_index("pid")["s"]
    for _, p in probe.iloc[::25].iterrows():
        assert r[p["pid"]] == hot[(hot["g"] == p["g"]) & (hot["x"] < p["at"])]["v"].sum()


def test_hot_group_is_cut(spark, hot):
    c = O.sliced(spark.createDataFrame(hot), ["g"], ["x", "id"], 32).groupBy("g", "__slice").count().toPandas()
    assert (c["g"] == "hot").sum() > 10 and (c["g"] == "single").sum() == 1
    assert c[c["g"] == "hot"]["count"].max() < 0.4 * (hot["g"] == "hot").sum()


def test_no_keys(spark, hot):
    r = O.positions(spark.createDataFrame(hot), [], ["x", "id"]).toPandas().sort_values("pos")
    assert list(r["id"]) == list(hot.sort_values(["x", "id"])["id"])
