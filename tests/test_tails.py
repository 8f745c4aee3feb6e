"""Tail probabilities against exact integer sums and known values, from small tables to 10^6."""

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from scorefold.operators import calibration, inference, ordered


def exact_binomial(k, n):
    s = min(k, n - k)
    return 1.0 if n == 0 else min(1.0, float(2 * Fraction(sum(math.comb(n, i) for i in range(s + 1)), 2**n)))


def exact_fisher(a, b, c, d):
    r, q, n = a + b, a + c, a + b + c + d
    w = {k: math.comb(r, k) * math.comb(n - r, q - k) for k in range(max(0, r + q - n), min(r, q) + 1)}
    return float(Fraction(sum(x for x in w.values() if x <= w[a]), math.comb(n, q)))


def close(x, y, rel=1e-6):
    return x == y or abs(x - y) <= rel * abs(y)


def test_chi_square(spark):
    # one degree: erfc; two: exp; more: the closed forms for whole and half numbers
    cases = [(x, 1, math.erfc(math.sqrt(x / 2))) for x in (1e-6, 0.5, 1.0, 2.9, 3.1, 30.0, 100.0, 700.0, 1300.0)]
    cases += [(x, 2, math.exp(-x / 2)) for x in (0.1, 1.0, 5.0, 100.0, 1400.0)]
    cases += [(x, 6, math.exp(-x / 2) * (1 + x / 2 + (x / 2) ** 2 / 2)) for x in (0.5, 7.0, 40.0, 900.0)]
    cases += [(1600.0, 1, 0.0), (1e6, 1, 0.0), (1e6, 9, 0.0), (0.0, 3, 1.0), (1e4, 10_000, 0.4981), (9e3, 10_000, 1.0)]
    df = spark.createDataFrame([(float(x), d) for x, d, _ in cases], "x double, d int").coalesce(1)
    got = [r[0] for r in df.select(inference.chi2_upper(F.col("x"), F.col("d"))).collect()]
    for (x, d, want), p in zip(cases, got):
        assert p is not None and not math.isnan(p) and (close(p, want, 1e-9) if d < 100 and x < 1500 else abs(p - want) < 2e-4), (x, d, p, want)


def test_binomial(spark):
    cases = [(k, n) for n in (0, 1, 2, 3, 10, 51) for k in range(n + 1)] + [(2400, 5000), (2400, 5001), (100, 5001), (2500, 5001), (4900, 10_000), (9_800, 20_000)]
    df = spark.createDataFrame(cases, "k bigint, n bigint").coalesce(1)
    got = [r[0] for r in df.select(inference.binomial_half_two_sided(F.col("k"), F.col("n"))).collect()]
    for (k, n), p in zip(cases, got):
        assert close(p, exact_binomial(k, n)), (k, n, p, exact_binomial(k, n))
    big = spark.createDataFrame([(499_000, 1_000_000), (499_999, 1_000_000), (400_000, 1_000_000)], "k bigint, n bigint").coalesce(1)
    a, b, c = (r[0] for r in big.select(inference.binomial_half_two_sided(F.col("k"), F.col("n"))).collect())
    assert close(a, math.erfc((1000 - 0.5) / 500 / math.sqrt(2)), 1e-4) and 0.99 < b <= 1 and c == 0


def test_fisher(spark):
    cases = [(3, 1, 1, 3), (0, 5, 5, 0), (10, 0, 0, 10), (1, 9, 11, 3), (0, 0, 4, 5), (7, 3, 70, 30), (12, 5, 29, 2), (200, 300, 250, 251), (40, 2, 3, 900), (5, 5, 5, 5), (2, 7, 8, 2)]
    cases += [(a, b, c, d) for a in range(4) for b in range(3) for c in range(3) for d in range(4) if a + b + c + d]
    df = spark.createDataFrame(cases, "a bigint, b bigint, c bigint, d bigint").coalesce(1)
    got = [r[0] for r in df.select(inference.fisher_two_sided(*map(F.col, "abcd"))).collect()]
    for case, p in zip(cases, got):
        assert close(p, exact_fisher(*case)), (case, p, exact_fisher(*case))
    big = spark.createDataFrame([(50_000, 950_000, 51_000, 949_000)], "a bigint, b bigint, c bigint, d bigint")
    assert 0.001 < big.select(inference.fisher_two_sided(*map(F.col, "abcd"))).first()[0] < 0.0014


@pytest.mark.parametrize("a, b", [(0, 0), (1, 2**33), (3, 2**34 + 5), (0, 16**9 - 1), (7, 2**40 + 3), (15, 16), (16, 255)])
def test_range_blocks_cover_every_index(spark, a, b):
    got = spark.range(1).select(calibration._range_blocks(F.lit(a), F.lit(b), calibration._levels(b))).first()[0]
    spans = sorted((r["blk"] * 16 ** r["lv"], (r["blk"] + 1) * 16 ** r["lv"] - 1) for r in got)
    assert spans[0][0] == a and spans[-1][1] == b and all(x[1] + 1 == y[0] for x, y in zip(spans, spans[1:]))


def test_permutation_of_thin_tables(spark):
    import itertools

    table = {"a": (3, 1), "b": (0, 6), "c": (1, 4), "d": (2, 5)}
    log = spark.createDataFrame([("m", s, i < f) for s, (f, o) in table.items() for i in range(f + o)] + [("n", s, i % 2 == 0) for s in "abcd" for i in range(60)], "model string, stratum string, bad boolean")
    got = {r["model"]: r for r in inference.failures_by_stratum(log, ["model"], "stratum", F.col("bad")).collect()}
    rows, fails = [f + o for f, o in table.values()], sum(f for f, _ in table.values())

    def stat(fs):
        return sum((f - n * fails / sum(rows)) ** 2 * (1 / (n * fails / sum(rows)) + 1 / (n * (1 - fails / sum(rows)))) for f, n in zip(fs, rows))

    seen = stat([f for f, _ in table.values()])
    ways = {fs: math.prod(math.comb(n, f) for f, n in zip(fs, rows)) for fs in itertools.product(*(range(n + 1) for n in rows)) if sum(fs) == fails}
    want = sum(w for fs, w in ways.items() if stat(fs) >= seen - 1e-12) / sum(ways.values())
    assert abs(got["m"]["perm_p"] - want) < 0.012 and got["m"]["test"] == "chi-square" and got["n"]["perm_p"] is None


@pytest.mark.parametrize("by", [[], ["g"]])
def test_isotonic_rounds(spark, monkeypatch, by):
    import random

    monkeypatch.setattr(calibration, "SLICE_ROWS", 8)
    monkeypatch.setattr(ordered, "SMALL_GROUP", 8)
    rng = random.Random(2)
    rows = [(g, float(x), float(rng.random() < (0.9 if g == "falls" and x < 150 else x / 400))) for g in ("rises", "falls") for x in range(300) for _ in range(2)]
    rows = rows if by else [r for r in rows if r[0] == "falls"]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {(r["g"] if by else "falls", r["x_lo"]): (r["x_hi"], r["n"], round(r["value"], 9)) for r in calibration.isotonic_blocks(df, by, "x", "y").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        blocks = []
        for x in range(300):
            ys = [y for k, v, y in rows if k == g and v == x]
            blocks.append([x, x, len(ys), sum(ys)])
            while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
                _, hi, n, s = blocks.pop()
                blocks[-1][1:] = [hi, blocks[-1][2] + n, blocks[-1][3] + s]
        want |= {(g, float(a)): (float(b), float(n), round(s / n, 9)) for a, b, n, s in blocks}
    assert got == want
