"""Positions of a whole table against a plain sort."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from scorefold.operators import cohort as K
from scorefold.operators.ordered import table_positions


def test_table_positions_are_those_of_a_plain_sort(spark):
    d = pd.DataFrame({"k": np.random.default_rng(1).permutation(5000), "v": np.arange(5000) % 7})
    got = table_positions(spark.createDataFrame(d).repartition(5), ["v", "k"]).orderBy("pos").toPandas()
    want = d.sort_values(["v", "k"])
    assert got["pos"].tolist() == list(range(5000)) and got["k"].tolist() == want["k"].tolist()
    assert table_positions(spark.createDataFrame(d).limit(0), ["v", "k"]).count() == 0


def test_same_order_sorts_each_list_once_and_looks_up_no_boundaries(spark):
    a = spark.createDataFrame([(i, i) for i in range(60)], "k int, o int")
    b = a.withColumn("o", F.when(F.col("k") < 2, 1 - F.col("k")).otherwise(F.col("o")))
    out = K.same_order(a, b.where("k < 58"), "k", ["o"])
    assert out.first().asDict() == {"positions": 60, "different": 4}
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
