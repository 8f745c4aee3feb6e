"""The permutation test puts in order only the rows of the hash bucket in which a draw's last failing row lies."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from scorefold.operators import inference as I


def test_chi2_permutation_orders_one_bucket_of_a_draw(spark, monkeypatch):
    rng = np.random.default_rng(4)
    n, draws = 4000, 5
    d = pd.DataFrame({"m": np.where(np.arange(n) < 3700, 1, 2), "i": np.arange(n), "s": rng.choice(["a", "b", "c"], n), "e": rng.random(n) < 0.3})
    ordered = []
    plain = I.positions

    def counted(df, *args, **more):
        ordered.append(df.count())
        return plain(df, *args, **more)

    monkeypatch.setattr(I, "positions", counted)
    log = spark.createDataFrame(d)
    got = {r["m"]: r for r in I.chi2_permutation(log, ["m"], "i", "s", F.col("e"), draws, 9).collect()}
    assert sum(ordered) < n * draws / 50  # every row of every draw before
    h = log.select("i", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("rep")).withColumn("h", I.hash_int(9, "rep", "i")).toPandas()

    def stat(f, s):
        t = pd.crosstab(s, f).to_numpy(float)
        x = t.sum(1, keepdims=True) * t.sum(0) / t.sum()
        return ((t - x) ** 2 / x).sum()

    for m, part in d.groupby("m"):
        truth, hits = stat(part["e"], part["s"]), 0
        for _, draw in h.groupby("rep"):
            p = part.merge(draw, on="i").sort_values(["h", "i"])
            hits += stat(np.arange(len(p)) < p["e"].sum(), p["s"].to_numpy()) >= truth - 1e-12
        assert abs(got[m]["observed"] - truth) < 1e-9 and got[m]["hits"] == hits and got[m]["draws"] == draws
