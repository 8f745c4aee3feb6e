"""Rows on which a query and its SQL twin used to part."""

import datetime as dt

import __spark_entry__ as entry
from tests.compare import duck


def both(spark, folder, name):
    got = entry.queries()[name](spark, str(folder))
    rel = duck(str(folder)).execute(entry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    return sorted(tuple(r[c] for c in cols) for r in got.collect()), sorted(rel.fetchall())


def test_a_tag_is_a_whole_word_in_any_script(spark, tmp_path):
    texts = ["les modèles", "modèles", "elles, éles, lesé", "Les_ LES", "(the) and-the", "deŕ los2 loś and", "", None]
    rows = [(i, t, "fr" if i % 2 else "en", "s", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(str(tmp_path / "w"))
    next((tmp_path / "w").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    got, want = both(spark, tmp_path, "tag_crosstab")
    assert got == want
    assert {r[0]: r[-1] for r in got} == {"les": 2, "the": 1, "and": 2, "all": 5}


def test_traced_values_halfway_go_up_in_both(spark, tmp_path):
    """Four clicks a day whose mean times 1.001 ends halfway between two sixth decimals."""
    day, rows, want = dt.datetime(2024, 1, 2, 3), [], {}
    for u in range(400):
        cents = [1000 + 7 * u, 333 + u, 29, 5 + (7 * u + u + 1000 + 333 + 29) % 2]
        cents[3] += (sum(cents) + 1) % 2  # an odd sum
        want[u * 10 + 3] = (sum(cents) * 1001 * 5 // 2 + 1 if sum(cents) * 1001 * 5 % 2 else sum(cents) * 1001 * 5 // 2)
        rows += [(len(rows) + k, day, u * 10 + 3, "click", c / 100, "{}") for k, c in enumerate(cents)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "w"))
    next((tmp_path / "w").glob("*.parquet")).rename(tmp_path / "events.parquet")
    got, sql = both(spark, tmp_path, "trace_to_source")
    assert got == sql and len(got) == 400
    assert {r[0]: round(r[2] * 1_000_000) for r in got} == want


def test_altered_zeros_are_traced_in_both(spark, tmp_path):
    """A mean of zero in an altered sample is listed, one in another sample is not."""
    day = dt.datetime(2024, 1, 2, 3)
    clicks = [(3, 0.0), (13, 0.0), (13, 0.0), (23, 0.0), (23, 0.02), (33, 5.0), (4, 0.0), (5, 7.0)]
    rows = [(i, day, u, "click", v, "{}") for i, (u, v) in enumerate(clicks)] + [(90, day, 43, "view", 1.0, "{}")]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "w"))
    next((tmp_path / "w").glob("*.parquet")).rename(tmp_path / "events.parquet")
    got, sql = both(spark, tmp_path, "trace_to_source")
    assert got == sql
    assert [(r[0], r[2], r[3]) for r in got] == [(3, 0.0, 0.0), (13, 0.0, 0.0), (23, 0.01001, 0.01), (33, 5.005, 5.0)]
