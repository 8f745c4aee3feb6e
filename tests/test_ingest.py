"""Ingest with compactions before, between and after batches, and writers that meet at a commit."""

import os

import pytest
from pyspark.sql import functions as F

from scorefold.operators import facts
from scorefold.sources import readers
from scorefold.streaming import ingest as X

LOG = "model string, arm string, item_id string, seq bigint, error string, value double"


def batch(spark, n, items, failed=()):
    return spark.createDataFrame([("m", "bare", str(i), 100 * n + i, "timeout" if i in failed else None, float(n)) for i in items], LOG)


def settled(spark, target):
    rows = [tuple(r) for r in X.current(spark, target).select("item_id", "seq", "error", "value").collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return sorted(rows)


def test_compaction_beside_batches(spark, tmp_path):
    target = f"file://{tmp_path}/target"
    write = X.store_batch(target)
    write(batch(spark, 0, range(6), failed={1, 2}), 0)
    write(batch(spark, 1, [2, 6], failed=()), 1)
    before = settled(spark, target)
    X.compact(spark, target)
    assert settled(spark, target) == before and len(X.Live(spark, target).read()["folders"]) == 1
    write(batch(spark, 1, [2, 6]), 1)  # replayed after it was compacted: left out
    write(batch(spark, 2, [1, 7]), 2)
    assert len(X.Live(spark, target).read()["folders"]) == 2
    want = sorted([("0", 0, None, 0.0), ("1", 201, None, 2.0), ("2", 102, None, 1.0), ("3", 3, None, 0.0), ("4", 4, None, 0.0), ("5", 5, None, 0.0), ("6", 106, None, 1.0), ("7", 207, None, 2.0)])
    assert settled(spark, target) == want
    # old folders are not read any more: emptying one changes nothing
    for name in os.listdir(f"{tmp_path}/target/batch-0"):
        if name.endswith(".parquet"):
            open(f"{tmp_path}/target/batch-0/{name}", "wb").close()
    assert settled(spark, target) == want
    X.compact(spark, target)
    assert settled(spark, target) == want and X.Live(spark, target).read()["last_batch"] == 2
    left = X.pending(spark, target, spark.createDataFrame([("m", "bare", str(i)) for i in (0, 8)], "model string, arm string, item_id string"))
    assert [r["item_id"] for r in left.collect()] == ["8"]


def test_batch_that_lands_during_a_compaction_stays(spark, tmp_path, monkeypatch):
    target = f"file://{tmp_path}/target"
    write = X.store_batch(target)
    write(batch(spark, 0, range(3)), 0)
    write(batch(spark, 1, [3]), 1)
    settle = X.dedupe_success

    def while_it_runs(rows, *more):
        monkeypatch.setattr(X, "dedupe_success", settle)
        write(batch(spark, 2, [4]), 2)
        return settle(rows, *more)

    monkeypatch.setattr(X, "dedupe_success", while_it_runs)
    X.compact(spark, target)
    live = X.Live(spark, target).read()
    assert len(live["folders"]) == 2 and "batch-2" in live["folders"] and live["last_batch"] == 2
    assert [r[0] for r in settled(spark, target)] == ["0", "1", "2", "3", "4"]


def test_commits_of_two_writers_are_both_kept(spark, tmp_path):
    target = f"file://{tmp_path}/target"
    live, seen = X.Live(spark, target), []

    def slow(c):
        if not seen:  # another writer is first
            seen.append(1)
            X.Live(spark, target).commit(lambda d: {**d, "folders": [*d["folders"], "b"]})
        return {**c, "folders": [*c["folders"], "a"]}

    live.commit(slow)
    assert X.Live(spark, target).read() == {"version": 2, "folders": ["b", "a"], "last_batch": -1}
    for i in range(X.KEEP + 5):
        live.commit(lambda c, i=i: {**c, "last_batch": i})
    assert live.read()["last_batch"] == X.KEEP + 4 and len(live._versions()) == X.KEEP + 1
    with pytest.raises(ValueError):
        X.current(spark, f"file://{tmp_path}/empty")


def test_line_digests_do_not_depend_on_splits(spark, tmp_path):
    lines = ['{"model":"m%d","i":%d}' % (i % 2, i) for i in range(500)] + ["", "x", "[1]"]
    (tmp_path / "a.jsonl").write_bytes("\n".join(lines).encode() + b"\n")
    (tmp_path / "b.jsonl").write_bytes("\r\n".join(lines).encode() + b"\r\n")
    (tmp_path / "c.jsonl").write_bytes("\n".join(reversed(lines)).encode() + b"\n")
    found, before = [], spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "1k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found.append({r["file"]: r for r in readers.line_inventory(spark, f"{tmp_path}/*.jsonl", "model", 16).drop("modified").collect()})
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found[0] == found[1]
    a, b, c = (found[0][f"{x}.jsonl"] for x in "abc")
    assert (a["rows"], a["bad"], a["served"]) == (502, 2, "m0,m1") == (b["rows"], b["bad"], b["served"])
    assert a["digest"] != b["digest"] and a["digest_lf"] == b["digest_lf"] == a["digest"] and c["digest"] != a["digest"]


@pytest.mark.parametrize("text", ["", "DROP TABLE x", "SELECT 1; SELECT 2", "-- only a comment", "SELECT answer FROM {t} UNION SELECT 1 FROM (DELETE FROM x)"])
def test_stored_queries_are_guarded(spark, text):
    t = spark.range(3).select("id", F.col("id").alias("answer"))
    with pytest.raises(ValueError):
        facts.run_again({"f": (["id"], text)}, t=t)
    keys, again = facts.run_again({"f": (["id"], "SELECT id, answer + 1 AS answer FROM {t}")}, t=t)["f"]
    assert keys == ["id"] and sorted(r["answer"] for r in again.collect()) == ["1", "2", "3"]
