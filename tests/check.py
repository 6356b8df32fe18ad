"""Command-line check: python -m tests.check [sf] [name ...]."""

from __future__ import annotations

import sys
import time
import traceback

from tests.harness import compare, oracle_connection
from veritrace.plans.all_queries import ORACLES, QUERIES
from veritrace.session import local_session

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    names = sys.argv[2:] or list(QUERIES)
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    con = oracle_connection(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            if name in ORACLES:
                result = compare(spark, con, name, QUERIES, ORACLES, sf_dir)
            else:
                result = None
                print("  rows only:", QUERIES[name](spark, sf_dir).count())
        except Exception as exc:  # noqa: BLE001
            result = "".join(traceback.format_exception_only(exc))[:1500]
        failed += result is not None
        print(f"{'ok  ' if result is None else 'FAIL'} {name} {time.time() - start:.1f}s {result or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} ok")
