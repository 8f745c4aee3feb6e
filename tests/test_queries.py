"""All registered queries against their SQL twins on the smallest scale factor; an empty or NaN result fails."""

from concurrent.futures import ThreadPoolExecutor

import pytest

import __spark_entry__ as entry
from scorefold.plans.registry import QUERIES
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
LARGER = {"peak_year_state", "top_state_for_cause"}  # no group of the smallest tables has a winner
ORACLES = entry.oracle_sql()
NAMES = sorted(ORACLES)
CHOSEN = [n for n in NAMES if n in QUERIES]  # the text operators have tests of their own


THREADS = 6  # small queries mostly wait for planning, so several run at once


@pytest.fixture(scope="module")
def diffs(spark, request):
    """name: a future of the difference between a query and its twin, for all tests selected from this module."""
    queries, cons = entry.queries(), {sf: duck(sf) for sf in (SF, "/root/testdata/sf0.01")}

    def run(name):
        sf = "/root/testdata/sf0.01" if name in LARGER else SF
        return compare(queries[name](spark, sf), cons[sf].cursor(), ORACLES[name])

    wanted = [i.callspec.params["name"] for i in request.session.items if i.name.startswith("test_matches_sql") and i.path == request.path]
    pool = ThreadPoolExecutor(THREADS)
    yield {n: pool.submit(run, n) for n in wanted}
    pool.shutdown(cancel_futures=True)


def test_registry():
    q = entry.queries()
    assert set(ORACLES) <= set(q) and len(q) > 250


@pytest.mark.parametrize("name", CHOSEN)
def test_matches_sql(diffs, name):
    diff = diffs[name].result()
    assert diff is None, diff


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
