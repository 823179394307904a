"""Run registered queries against their SQL: python tests/check_queries.py [sf] [name ...]"""

import sys
import time
import traceback

sys.path.insert(0, __file__.rsplit("/", 2)[0])

from tests.conftest import make_spark  # noqa: E402
from tests.oracle import connect, difference  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    names = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = make_spark()
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name in names or queries:
        t0 = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                msg = difference(df, con, oracles[name])
            else:
                msg = None if df.count() >= 0 else "?"
        except Exception as e:  # noqa: BLE001
            msg = f"{type(e).__name__}: {str(e)[:700]}"
            if "-v" in names:
                traceback.print_exc()
        took = time.time() - t0
        if msg:
            bad.append(name)
        print(f"{'FAIL' if msg else 'ok  '} {name:32s} {took:6.1f}s {'' if name in oracles else '(no oracle)'} {msg or ''}", flush=True)
    print(f"{len(bad)} failed: {bad}")
    spark.stop()


if __name__ == "__main__":
    main()
