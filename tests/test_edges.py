"""Hand-computed edge rows: nulls, ties, empty groups, single clusters, log hygiene."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorefold.functions import columns as C
from scorefold.functions import text as X
from scorefold.operators import cohort as K
from scorefold.operators import inference as I
from scorefold.operators import joins as J
from scorefold.operators import panel as P
from scorefold.operators import resample as R
from scorefold.operators import retrieve as RT
from scorefold.operators import scores as S
from scorefold.sources import readers as RD


def day(s):
    return dt.date.fromisoformat(s)


REPORT = "incident_id long, report_date date, ord long, personnel double, state int, start_year int, acres double, pct double, new_acres double, aerial double, terrain string"


def reports(spark, rows):
    return spark.createDataFrame([(i, day(d) if d else None, o, p, 1, 2016, a, None, None, None, t) for i, d, o, p, a, t in rows], REPORT)


def test_last_non_null_per_column(spark):
    r = reports(spark, [(1, "2020-01-01", 1, 10.0, 5.0, None), (1, "2020-01-01", 2, 12.0, None, "x"), (1, None, 3, 9.0, 1.0, None), (1, "2020-01-02", 4, 0.0, 1.0, None)])
    got = P.collapse_daily(P.valid_filings(r)).collect()
    assert len(got) == 1 and (got[0].personnel, got[0].acres, got[0].terrain) == (12.0, 5.0, "x")


def test_runs_pairs_and_picks(spark):
    days = [day("2020-01-01") + dt.timedelta(i) for i in range(10)] + [day("2020-01-12")]
    d = spark.createDataFrame([(1, x, float(i), 1, 2016, None, None, None, None, None) for i, x in enumerate(days, 1)],
                              "incident_id long, report_date date, personnel double, state int, start_year int, acres double, pct double, new_acres double, aerial double, terrain string")
    runs = P.runs(d)
    assert sorted((r.day_of_run, r.run_length) for r in runs.collect()) == sorted([(i, 10) for i in range(1, 11)] + [(1, 1)])
    assert P.day_pairs(runs).count() == 9  # neither the last day nor the lone day gives a pair
    picked = sorted(r.day_of_run - 1 for r in P.even_picks(runs).collect())
    assert picked == sorted(set(np.linspace(3, 8, 6).astype(int)))
    assert [r.prior for r in P.prior_day(d, 2).orderBy("report_date").collect()][-1] == 10.0  # the 10th lies two days before the 12th


def test_even_picks_single(spark):
    d = spark.createDataFrame([(1, day("2020-01-01") + dt.timedelta(i), 1.0) for i in range(12)], "incident_id long, report_date date, personnel double")
    assert [r.day_of_run for r in P.even_picks(P.runs(d), k=1).collect()] == [4]


ANSWERS = [
    ("ANSWER: 480", "integer", 480.0, None), ("There are many.\nANSWER: ... is 1,234 in that year.", "integer", 1234.0, None), ("ANSWER: 601,674.5 acres", "acres", 601674.5, None),
    ("ANSWER: 67.87%", "percent", 67.87, None), ("ANSWER: 'Natural'.", "categorical", None, "Natural"), ('ANSWER: "CARLA LAKE"', "string", None, "CARLA LAKE"),
    ("first 7 then 42", "integer", 42.0, None), ("ANSWER: unknown", "integer", None, "unknown"), ("", "integer", None, None), ("ANSWER: 1\nANSWER: 2", "integer", 2.0, None),
    ("ANSWER: it was Debris and open burning, I think", "categorical", None, "Debris and open burning"),
]


def test_typed_answers(spark):
    d = spark.createDataFrame([(i, a, k) for i, (a, k, _, _) in enumerate(ANSWERS)], "i int, raw string, kind string")
    opts = F.array(*[F.lit(o) for o in ("Natural", "Debris", "Debris and open burning")])
    got = d.withColumn("p", X.parse_typed_answer("raw", "kind", opts)).select("i", "p.*").orderBy("i").collect()
    for g, (_, _, num, txt) in zip(got, ANSWERS):
        assert (g.num, g.txt) == (num, txt)
    assert got[7].abstained == 1 and got[8].failure == "parse"


@pytest.mark.parametrize("rule,gold,inside,outside", [("exact_int", 480.0, 480.4, 481.0), ("relative", 1000.0, 1005.0, 1005.1), ("relative", 10.0, 11.0, 11.2), ("absolute", 67.0, 67.05, 67.2)])
def test_tolerances(spark, rule, gold, inside, outside):
    d = spark.createDataFrame([(inside, 1), (outside, 0), (None, 0)], "p double, want int")
    s = X.score_answer(F.lit(rule), F.lit(gold), F.lit(None).cast("string"), "p", F.lit(None).cast("string"), F.lit(0.005), F.lit(1.0), F.lit(0.1))
    assert all(r.got == r.want for r in d.withColumn("got", s).collect())
    moved = d.limit(1).select(X.perturb(F.lit(rule), F.lit(gold), F.lit(0.005), F.lit(1.0), F.lit(0.1)).alias("p"))
    assert moved.select(X.score_answer(F.lit(rule), F.lit(gold), F.lit(None).cast("string"), "p", F.lit(None).cast("string"), F.lit(0.005), F.lit(1.0), F.lit(0.1)).alias("s")).first().s == 0


def test_text_tolerances(spark):
    d = spark.createDataFrame([("categorical_exact", "Natural", " natural ", 1), ("string_normalized", "CARLA LAKE", "Carla-Lake!", 1), ("string_normalized", "A", "B", 0)], "rule string, gold string, p string, want int")
    s = X.score_answer("rule", F.lit(None).cast("double"), "gold", F.lit(None).cast("double"), "p", F.lit(0.0), F.lit(0.0), F.lit(0.0))
    assert all(r.got == r.want for r in d.withColumn("got", s).collect())


def test_sql_flags(spark):
    rows = [("insert into t values (1)", "INSERT", "INSERT", 0), ("pragma x", "PRAGMA", "PRAGMA", 0), ("select 1; select 2", "SELECT", "", 1), ("with a as (select 1) select * from a;", "WITH", "", 0),
            ("select ';' , '-- drop'", "SELECT", "", 0), (None, "", "", 0), ("/* drop */ select 1 -- ; drop", "SELECT", "", 0)]
    got = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, q string").withColumn("f", X.sql_log_flags("q")).select("i", "f.*").orderBy("i").collect()
    assert [(g.first_word, g.forbidden, g.several) for g in got] == [r[1:] for r in rows]


def test_display_rounding_is_exact(spark):
    vals = [1.005, 2.675, 0.125, 0.375, 1.115, 0.5, 123.455, -0.125, 1e6 + 0.005]
    got = spark.createDataFrame([(v,) for v in vals], "v double").select("v", C.shown("v").alias("s")).collect()
    assert all(g.s == float("%.2f" % g.v) for g in got)


def test_scores_without_predictions_or_positives(spark):
    log = spark.createDataFrame([("a", 0.0, None, 0.0, 1.0), ("b", 0.0, 0.0, 0.0, 1.0), ("b", 10.0, 8.0, 0.0, 5.0)], "run string, target double, prediction double, persistence double, scale double")
    got = {r.run: r for r in S.regression_scores(log, ["run"]).collect()}
    assert got["a"].parsed == 0 and got["a"].mae is None
    assert got["b"].within_25 == 1.0 and got["b"].mae_scaled_moving == pytest.approx(0.4)
    flat = spark.createDataFrame([(0.5, 0), (0.5, 0)], "score double, label int")
    assert S.average_precision(flat, []).first().ap is None and S.auroc(flat, []).first().auroc is None
    tied = spark.createDataFrame([(0.5, 0), (0.5, 1), (0.5, 0), (0.5, 1)], "score double, label int")
    assert S.average_precision(tied, []).first().ap == 0.5 and S.auroc(tied, []).first().auroc == 0.5


def test_nearest_frame_rules(spark):
    f = spark.createDataFrame([("s", 1, -100), ("s", 2, 100), ("s", 3, 2000)], "sequence string, frame_id long, offset_seconds long")
    got = J.nearest_to_ladder(f, "sequence", "offset_seconds", "frame_id", [0, 60, 150], 600).collect()
    assert {(g.frame_id, g.target) for g in got} == {(1, 0), (2, 60)}  # tie to the first frame; the third target finds its frame taken


def test_candidate_on_the_report_day_is_excluded(spark):
    pool = spark.createDataFrame([(i, a, day(d), "k") for i, a, d in [(2, "2@1", "2020-01-08"), (2, "2@2", "2020-01-09"), (1, "1@1", "2020-01-01"), (3, "3@1", "2020-01-02")]], "incident_id long, analogue_id string, report_date date, key string")
    item = spark.createDataFrame([("i", 1, day("2020-01-10"), "k")], "item_id string, incident_id long, report_date date, key string")
    assert RT.eligible_counts(item, pool, "key").first().eligible == 2  # own incident and the pair whose outcome falls on the report day are out
    got = RT.draw_by_key(item, pool.withColumns({"today": F.lit(1.0), "next": F.lit(1.0)}), "key", 6, 1)
    assert {r.analogue_id for r in got.collect()} == {"2@1", "3@1"}


def test_log_hygiene(spark):
    log = spark.createDataFrame([("a", 1, "e", 1.0), ("a", 2, None, 2.0), ("a", 3, None, 3.0), ("b", 4, None, 4.0), ("b", 5, "e", 5.0), ("c", 6, "e", 6.0), ("c", 7, "e", 7.0)], "item string, seq long, error string, v double")
    got = {r["item"]: r.v for r in K.dedupe_success(log, ["item"], "seq", F.col("error").isNotNull()).collect()}
    assert got == {"a": 2.0, "b": 4.0, "c": 7.0}
    assert {r["item"]: r.v for r in K.dedupe_last(log, ["item"], "seq").collect()} == {"a": 3.0, "b": 5.0, "c": 7.0}
    lines = spark.createDataFrame([('{"item_id": "x"}',), ("17",), ("",), ('{"item_id": ',), ('"text"',)], "value string")
    p = RD.parse_json_lines(lines, T.StructType([T.StructField("item_id", T.StringType())]))
    assert sorted(r._bad for r in p.collect()) == [0, 1, 1, 1]


def test_replacements_are_idempotent(spark):
    log = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    patch = spark.createDataFrame([(2, "c")], "id long, v string")
    once, out = K.apply_replacements(log, patch, ["id"])
    assert {tuple(r) for r in once.collect()} == {(1, "a"), (2, "c")} and [r.v for r in out.collect()] == ["b"]
    assert K.apply_replacements(once, patch, ["id"])[1].count() == 0


def test_bootstrap_edges(spark):
    one = spark.createDataFrame([("c", 1.0), ("c", 3.0)], "cluster string, v double")
    r = R.bootstrap(one, [], "cluster", R.ratio(F.col("v")), 20, 1).first()
    assert (r.point, r.lo, r.hi) == (2.0, 2.0, 2.0)
    w = R.cluster_draws(spark.range(7).withColumnRenamed("id", "cluster"), [], "cluster", 30, 5)
    assert all(x.s == 7 for x in w.groupBy("rep").agg(F.sum("w").alias("s")).collect())
    some = spark.createDataFrame([("a", 1, 1), ("b", 0, 1), ("c", 0, 0)], "cluster string, keep int, v int")
    sub = R.bootstrap(some, [], "cluster", R.paired_difference(F.lit(0), F.col("v"), F.col("keep") == 1), 50, 1).first()
    assert sub.dropped > 0 and sub.lo == 1.0


def test_exact_tests(spark):
    d = spark.createDataFrame([(0, 0), (5, 0), (3, 7), (8, 2), (40, 60)], "b long, a long").withColumn("p", I.binomial_half_two_sided(F.col("b"), F.col("b") + F.col("a")))
    got = {(r.b, r.a): r.p for r in d.collect()}
    assert got[(0, 0)] == 1.0 and got[(5, 0)] == pytest.approx(0.0625) and got[(3, 7)] == pytest.approx(0.34375) and got[(8, 2)] == pytest.approx(0.109375)
    f = spark.createDataFrame([(3, 1, 1, 3), (8, 2, 1, 5)], "a long, b long, c long, d long").withColumn("p", I.fisher_two_sided(*[F.col(x) for x in "abcd"])).collect()
    assert f[0].p == pytest.approx(0.4857142857) and f[1].p == pytest.approx(0.0349650349)
    c = spark.createDataFrame([(3.841459, 1), (5.991465, 2), (7.814728, 3), (300.0, 3)], "x double, k int").withColumn("p", I.chi2_upper(F.col("x"), F.col("k"))).collect()
    assert [round(r.p, 5) for r in c] == [0.05, 0.05, 0.05, 0.0]


def test_holm_is_monotone(spark):
    d = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.2])], "i int, p double")
    assert [round(r.p_holm, 6) for r in I.holm(d, [], "p", ["i"]).orderBy("i").collect()] == [0.04, 0.09, 0.09, 0.2]


def test_t_quantiles():
    q = R.t_quantiles()
    for df, want in ((1, 12.706205), (2, 4.302653), (5, 2.570582), (16, 2.119905), (30, 2.042272), (120, 1.979930)):
        assert q[df - 1] == pytest.approx(want, abs=1e-5)


def test_stable_fold_and_seed(spark):
    import hashlib
    import zlib

    ids = [f"item-{i}" for i in range(50)]
    got = spark.createDataFrame([(i,) for i in ids], "id string").select("id", C.stable_fold("id").alias("f"), C.stable_seed(7, "id", F.lit("x")).alias("s")).collect()
    for r in got:
        assert r.f == int(hashlib.sha256(r.id.encode()).hexdigest(), 16) % 10
        assert r.s == (7 + zlib.crc32(f"{r.id}|x".encode())) % 2**32
