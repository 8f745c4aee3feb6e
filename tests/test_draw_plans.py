"""Draws are many and look small to the planner: they must not be broadcast, and must not meet one task."""

import re

import pytest
from pyspark.sql import functions as F

from scorefold.operators import resample as R


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    return spark.range(400).select((i % 2).alias("model"), i.alias("item"), (i % 7).cast("double").alias("x"), (i * 5 % 11).cast("double").alias("y"), (i % 3 == 0).cast("int").alias("label"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def broadcast_draws(p):
    """Broadcast exchanges above an expansion of draws (`j` is a draw's number)."""
    lines, hit = p.splitlines(), []
    depth = lambda s: len(re.match(r"[\s:|+\-*]*", s).group())
    for at, line in enumerate(lines):
        if "BroadcastExchange" in line:
            for below in lines[at + 1:]:
                if depth(below) <= depth(line):
                    break
                if "explode(sequence(__from" in below:
                    hit.append(line)
    return hit


def test_replicates_do_not_broadcast_their_draws(rows):
    stat = R.ratio(F.col("x"))
    p = plan(R.replicates(R.cluster_sums(rows, ["model"], "item", stat), ["model"], "item", stat, 5, 1))
    assert "explode(sequence(__from" in p and not broadcast_draws(p)


def test_cluster_draws_are_not_broadcast(rows):
    p = plan(R.cluster_draws(rows, ["model"], "item", 5, 1))
    assert "explode(sequence(__from" in p and not broadcast_draws(p)
    w = R.cluster_draws(rows, ["model"], "item", 5, 1)
    p = plan(rows.hint("shuffle_hash").join(w, ["model", "item"]))
    assert not broadcast_draws(p)


def test_draws_are_expanded_by_many_tasks(spark, rows):
    old = R.DRAW_CHUNK
    R.DRAW_CHUNK = 8
    try:
        d = R.draw_indices(R.numbered_clusters(rows, ["model"], "item"), ["model"], 20, 3)
        used = d.select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        R.DRAW_CHUNK = old
    assert used == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_bootstrap_reads_its_input_once(rows, monkeypatch):
    seen = []
    monkeypatch.setattr(R, "checkpointed", lambda df, keep=R.checkpointed: (seen.append(df), keep(df))[1])
    out = R.bootstrap(rows, ["model"], "item", R.ratio(F.col("x")), 5, 1)
    assert "Range (0, 400" not in plan(out) and sum("Range (0, 400" in plan(d) for d in seen) == 1


def test_a_missing_cluster_is_drawn_and_adds_nothing(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), (None, 100.0)], "c string, v double")
    stat = R.ratio(F.col("v"))
    r = R.replicates(R.cluster_sums(df, [], "c", stat), [], "c", stat, 60, 2).collect()
    assert len(r) > 40 and all(1 <= x["value"] <= 3 for x in r)


def test_draws_of_few_clusters_are_added_up_where_they_are_made(rows, monkeypatch):
    stat = R.ratio(F.col("x"))
    sums = R.cluster_sums(rows, ["model"], "item", stat)
    one = R.replicates(sums, ["model"], "item", stat, 5, 1)
    assert "BroadcastHashJoin" in plan(one) and not broadcast_draws(plan(one)) and "ShuffledHashJoin" not in plan(one)
    monkeypatch.setattr(R, "SMALL_SUMS", 0)
    two = R.replicates(sums, ["model"], "item", stat, 5, 1)
    assert "ShuffledHashJoin" in plan(two) and sorted(one.collect()) == sorted(two.collect())


@pytest.mark.parametrize("name", ["rule_difference", "error_by_period", "same_draws", "retrieve_quota", "analogue_prediction"])
def test_a_query_over_items_and_pool_makes_one_panel(spark, name, monkeypatch):
    import __spark_entry__ as entry
    from scorefold.sources import standins as V

    made = []
    monkeypatch.setattr(V, "reports", lambda *a, keep=V.reports: (made.append(1), keep(*a))[1])
    entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert len(made) == 1
