"""Intervals and permutation tests at the reference's 20,000 draws."""

import __spark_entry__ as entry
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"


def test_bootstrap_mean_at_full_draws(spark):
    sql = entry.oracle_sql()["bootstrap_mean_full"]
    assert "range(20000)" in sql and compare(entry.queries()["bootstrap_mean_full"](spark, SF), duck(SF), sql) is None


def test_permutation_at_full_draws(spark):
    got = {(r["model"], r["arm"]): r["perm_p"] for r in entry.queries()["chi2_permutation_full"](spark, SF).collect()}
    few = {(r["model"], r["arm"]): r["p"] for r in entry.queries()["chi2_permutation"](spark, SF).collect()}
    assert set(got) == set(few)
    on_grid = lambda p, draws: abs(p * (draws + 1) - round(p * (draws + 1))) < 0.03
    assert all(on_grid(p, 20_000) for p in got.values()) and not all(on_grid(p, 30) for p in got.values())
    assert all(abs(got[k] - few[k]) < 0.4 for k in got)  # 30 draws: a standard error of up to 0.09
