"""What nearest rows shuffle and sort: pairs of two numbers, and measured rows within an item's bound only."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from scorefold.operators import nearest as N

BY = {"z_a": 2.0, "z_b": 1.0}


@pytest.fixture(scope="module")
def sides(spark):
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i % 40)
    pool = [(f"r{i:04d}", i % 97, day(i), float((i * 37) % 101), float((i * 53) % 89), 1.0) for i in range(1500)]
    items = [(f"i{i}", i % 97, day(i + 7), "all", float((i * 11) % 101), float((i * 29) % 89) if i % 3 else None) for i in range(60)]
    p = spark.createDataFrame(pool, "analogue_id string, incident_id bigint, report_date date, z_a double, z_b double, today double")
    it = spark.createDataFrame(items, "item_id string, incident_id bigint, __cut date, __scope string, z_a double, z_b double")
    want = {}
    for cap in (None, 1):
        for name, inc, cut, _, a, b in items:
            near = sorted((2.0 * (x - a) ** 2 + (0.0 if b is None else (y - b) ** 2), r, j) for r, j, d, x, y, _ in pool if j != inc and d < cut)
            seen, kept = {}, []
            for d, r, j in near:
                seen[j] = seen.get(j, 0) + 1
                if cap is None or seen[j] <= cap:
                    kept.append((r, d))
            want[name, cap] = kept[:4]
    return it, N.build(p, F.lit("all"), BY, ["today"]), want


def check(sides, cap):
    it, index, want = sides
    got = {}
    for r in N.nearest(it, index, BY, 4, cap).orderBy("item_id", "draw").collect():
        got.setdefault(r.item_id, []).append((r.analogue_id, r.distance))
    assert {k for k, c in want if c == cap and want[k, c]} == set(got)
    for k, rows in got.items():
        assert [r for r, _ in rows] == [r for r, _ in want[k, cap]]


@pytest.mark.parametrize("cap", [None, 1])
def test_nearest_rows_are_those_of_all_pairs(sides, cap):
    check(sides, cap)


@pytest.mark.parametrize("cap", [None, 1])
def test_many_items_and_full_leaves_and_large_levels_change_nothing(sides, cap, monkeypatch):
    for name in ("SMALL_ITEMS", "FULL_LEAF", "SMALL_LEVEL"):
        monkeypatch.setattr(N, name, 0)
    check(sides, cap)


def test_pairs_are_numbers_and_rows_beyond_the_bound_are_dropped_when_measured(sides):
    it, index, want = sides
    it = it.withColumns({"__item": F.monotonically_increasing_id(), "__tau": F.lit(30.0)})
    leaves = N.within(index, it, BY)
    assert leaves.columns == ["__item", "__scope", "__node"]
    assert N._measured(index, it, leaves, BY, ["analogue_id"], None).agg(F.max("distance")).first()[0] <= 30.0 + 1e-6


@pytest.fixture(scope="module")
def odd(spark):
    """Rows equal in all features, equal distances, incidents with many rows, items of every scope, one without a scope's rows, one before all rows."""
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    pool = [(f"r{i * 7919 % 3001:05d}", i % 13, day(i * 5 % 31), "ab"[i % 5 == 0], float(i % 3), float(i * i % 7), 1.0) for i in range(3000)]
    items = [(f"i{i}", i % 17, day(i % 33), "abc"[i % 40 // 19], float(i % 4) / 2, float(i % 5) if i % 4 else None) for i in range(200)]
    schema = "analogue_id string, incident_id bigint, report_date date, scope string, z_a double, z_b double, today double"
    return spark.createDataFrame(items, "item_id string, incident_id bigint, __cut date, __scope string, z_a double, z_b double"), spark.createDataFrame(pool, schema), items, pool


@pytest.mark.parametrize("cap", [None, 2])
@pytest.mark.parametrize("sizes", [(64, 40, 50), (500, 10_000, 1 << 18)])
def test_leaves_in_pieces_and_few_distances_at_once_change_nothing(odd, cap, sizes, monkeypatch):
    for name, n in zip(("LEAF", "FULL_LEAF", "CELLS"), sizes):
        monkeypatch.setattr(N, name, n)
    it, p, items, pool = odd
    got = {}
    for r in N.nearest(it, N.build(p, F.col("scope"), BY, ["today"]), BY, 4, cap).orderBy("item_id", "draw").collect():
        got.setdefault(r.item_id, []).append((r.analogue_id, r.analogue_date, r.analogue_incident, r.distance, r.draw))
    for name, inc, cut, scope, a, b in items:
        near, seen, want = sorted((2.0 * (x - a) ** 2 + (0.0 if b is None else (y - b) ** 2), r, d, j) for r, j, d, s, x, y, _ in pool if s == scope and j != inc and d < cut), {}, []
        for d, r, day, j in near:
            seen[j] = seen.get(j, 0) + 1
            if cap is None or seen[j] <= cap:
                want.append((r, day, j, d, len(want) + 1))
        assert got.get(name, []) == want[:4]


@pytest.mark.parametrize("cap", [None, 2])
def test_at_most_k_rows_of_an_item_leave_a_leaf(odd, cap):
    it, p, items, pool = odd
    index = N.build(p, F.col("scope"), BY, ["today"])
    it = it.withColumns({"__item": F.monotonically_increasing_id(), "__tau": F.lit(None).cast("double")})
    leaves = N.within(index, it, BY)
    out = N._measured(index, it, leaves, BY, [], cap, 4)
    assert out.count() <= 4 * leaves.count() < N._measured(index, it, leaves, BY, [], cap).count()


def test_draws_bring_the_bands_of_the_pool_along(spark):
    """The pool is not joined again to learn the band of a drawn row."""
    from scorefold.operators import retrieve as R
    from scorefold.plans.retrieve import sides

    it, p = sides(spark, "/root/testdata/sf0.001")
    d = R.retrieve_nearest(it, p, R.fit_scales(p, "2024-01-20"), None, k=2, payload=["band"])
    assert {"band", "analogue_incident", "analogue_date"} <= set(d.columns) and "today" not in d.columns
    got, known = d.select("analogue_id", "band").collect(), {r["analogue_id"]: r["band"] for r in p.select("analogue_id", "band").collect()}
    assert got and all(known[r["analogue_id"]] == r["band"] for r in got)
