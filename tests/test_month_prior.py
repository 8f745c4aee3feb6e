"""The prior of a month is fitted on all of its training rows; only a month without any falls back to the overall rate."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from scorefold.plans.calibration import labelled_days
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"


def test_month_prior_full(spark):
    out = entry.queries()["month_prior_full"](spark, SF)
    assert compare(out, duck(SF), entry.oracle_sql()["month_prior_full"]) is None
    got = {r["month"]: r["prior"] for r in out.collect()}
    train = labelled_days(spark, SF).where("train")
    rate = {r["month"]: r["r"] for r in train.groupBy("month").agg(F.avg("label").alias("r")).collect()}
    assert 3 in rate and 7 not in rate and got[3] == pytest.approx(rate[3], abs=1e-6)
    assert got[7] == pytest.approx(train.agg(F.avg("label")).first()[0], abs=1e-6)
