"""Compare registered queries with their SQL twins: ``python -m tests.run_queries SF_DIR [name-substring ...]``."""

import os
import sys
import time

import __spark_entry__ as entry
from scorefold.session import local_session
from tests.compare import compare, duck


def main(argv):
    sf, wanted = argv[0], argv[1:]
    spark = local_session(os.environ.get("SCOREFOLD_CORES", "8"))
    con = duck(sf)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        t = time.time()
        try:
            if name in oracles:
                diff = compare(fn(spark, sf), con, oracles[name])
            else:
                diff = None if fn(spark, sf).count() > 0 else "EMPTY"
        except Exception as e:  # report and go on with the next query
            diff = f"{type(e).__name__}: {str(e)[:900]}"
        took = time.time() - t
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {name} {took:.2f}s {'' if name in oracles else '(no sql)'} {diff or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
