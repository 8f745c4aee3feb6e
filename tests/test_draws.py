"""Draws by counts, positions and ranks against full enumeration on small tables."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorefold.operators import draws as D
from scorefold.operators.ordered import percentiles

EDGES = [i * 0.1 for i in range(1, 10)]
DRAWS = 20_000
SLACK = 4 * 0.5 / math.sqrt(DRAWS)


def ece(q, y):
    bins = [sum(x > e for e in EDGES) for x in q]
    return sum(abs(sum(q[i] - y[i] for i in range(len(q)) if bins[i] == b)) for b in set(bins)) / len(q)


def shifted(q, mean):
    lo, hi = -40.0, 40.0
    at = lambda d: [x if x in (0, 1) else 1 / (1 + math.exp(-(math.log(x / (1 - x)) + d))) for x in q]
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(at(mid)) / len(q) < mean else (lo, mid)
    return at((lo + hi) / 2)


def enumerated(q):
    """(probability, plain error, refit error or None) of every labelling."""
    for y in itertools.product((0, 1), repeat=len(q)):
        w = math.prod(p if t else 1 - p for p, t in zip(q, y))
        if w:
            yield w, ece(q, y), (ece(shifted(q, sum(y) / len(y)), y) if 0 < sum(y) < len(y) else None)


@pytest.mark.parametrize("forecasts", [D.FORECASTS, 2])
def test_chance_band_equals_enumeration(spark, monkeypatch, forecasts):
    monkeypatch.setattr(D, "FORECASTS", forecasts)
    runs = {"a": [0.2, 0.2, 0.35, 0.5, 0.5, 0.62, 0.9, 0.97], "b": [0.0, 0.11, 0.11, 0.3, 0.3, 0.3, 0.81, 1.0]}
    df = spark.createDataFrame([(r, i, p) for r, q in runs.items() for i, p in enumerate(q)] + [("a", 99, None)], "run string, i int, p double")
    seen = {"a": 0.14, "b": 0.09}
    got = {r["run"]: r for r in D.chance_band(df, ["run"], "p", spark.createDataFrame(list(seen.items()), "run string, ece double"), DRAWS, 5).collect()}
    for r, q in runs.items():
        every = list(enumerated(q))
        plain = sum(w for w, e, _ in every if e >= seen[r] - 1e-9)
        both = [(w, f) for w, _, f in every if f is not None]
        refit = sum(w for w, f in both if f >= seen[r] - 1e-9) / sum(w for w, _ in both)
        assert abs(got[r]["plain_share"] - plain) < SLACK and abs(got[r]["refit_share"] - refit) < SLACK
        for name, values in (("plain", [(e, w) for w, e, _ in every]), ("refit", [(f, w) for w, f in both])):
            below = sum(w for e, w in values if e < got[r][f"{name}_p95"] - 1e-9) / sum(w for _, w in values)
            upto = sum(w for e, w in values if e <= got[r][f"{name}_p95"] + 1e-9) / sum(w for _, w in values)
            assert below - 0.01 <= 0.95 <= upto + 0.01
        assert got[r]["inside_plain"] == int(seen[r] <= got[r]["plain_p95"])


def rank(x):
    return [sum(b < a for b in x) + (sum(b == a for b in x) + 1) / 2 for a in x]


def test_row_ranks():
    x = np.random.default_rng(1).integers(0, 5, (40, 9)).astype(float)
    assert np.array_equal(D._row_ranks(x), np.array([rank(r) for r in x.tolist()]))


def test_shared_baseline_equals_all_permutations(spark):
    a, b = [0.1, 0.4, 0.4, 0.7, 0.8, 0.95], [0.3, 0.5, 0.45, 0.6, 0.9, 0.92]
    df = spark.createDataFrame([(f"m{i}", x, y) for i, (x, y) in enumerate(zip(a, b))] + [("none", None, 0.5)], "m string, a double, b double")
    got = D.shared_baseline_null(df, "m", "a", "b", DRAWS, 3).first()
    rho = lambda y: float(np.corrcoef(rank(a), rank([round(v - u, 12) for u, v in zip(a, y)]))[0, 1])
    every = sorted(rho(y) for y in itertools.permutations(b))
    share = lambda x: (np.mean([e < x - 1e-9 for e in every]), np.mean([e <= x + 1e-9 for e in every]))
    for name, p in (("lo", 0.025), ("median", 0.5), ("hi", 0.975)):
        below, upto = share(got[name])
        assert below - 0.012 <= p <= upto + 0.012
    assert abs(got["observed"] - rho(b)) < 1e-9 and got["draws"] == DRAWS


def test_too_many_members_are_refused(spark, monkeypatch):
    monkeypatch.setattr(D, "MEMBERS", 2)
    with pytest.raises(ValueError):
        D.shared_baseline_null(spark.range(3).select("id", F.col("id").alias("a"), F.col("id").alias("b")), "id", "a", "b", 10)


def test_median_difference_equals_all_resamples(spark):
    one, none = [1.0, 2.0, 4.0, 8.0, 16.0], [0.5, 0.5, 3.0, 7.0]
    rows = [("x", i, v, 1) for i, v in enumerate(one)] + [("x", 10 + i, v, 0) for i, v in enumerate(none)] + [("x", 99, None, 0), ("x", 98, 5.0, None)]
    df = spark.createDataFrame(rows, "k string, i int, v double, g int")
    got = D.median_difference(df, ["k"], "i", "v", F.col("g"), DRAWS, 2).first()
    medians = lambda v: [float(np.median(c)) for c in itertools.product(v, repeat=len(v))]
    every = np.subtract.outer(medians(one), medians(none)).ravel()
    for name, p in (("lo", 0.025), ("hi", 0.975)):
        assert np.mean(every < got[name] - 1e-9) - 0.01 <= p <= np.mean(every <= got[name] + 1e-9) + 0.01
    assert got["dropped"] == 0


def test_weighted_percentiles_equal_repeated_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(f"g{i % 3}", float(v), int(w)) for i, (v, w) in enumerate(zip(rng.integers(0, 12, 90), rng.integers(1, 6, 90)))]
    df = spark.createDataFrame(rows, "k string, v double, w bigint")
    for slices in (1, 5):
        got = {r["k"]: (r["q"], r["m"]) for r in percentiles(df, ["k"], "v", {"q": 0.3, "m": 0.5}, slices, F.col("w")).collect()}
        for k in got:
            flat = [v for key, v, w in rows if key == k for _ in range(w)]
            assert np.allclose(got[k], np.quantile(flat, [0.3, 0.5]))
