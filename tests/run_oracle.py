"""Run every registered query against its oracle SQL and print a summary.

Usage: python tests/run_oracle.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E  # noqa: E402
import compare as _cmp  # noqa: E402
from compare import compare, duck  # noqa: E402
from jobsift.session import build_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    _cmp.STRICT = bool(os.environ.get("STRICT"))
    spark = build_session()
    con = duck(sf)
    qs, orc = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and not any(o in name for o in only):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in orc:
                diff = compare(df, con, orc[name])
                status = "OK " if diff is None else "BAD"
            else:
                n = df.count()
                diff, status = f"rows={n} (no oracle)", "RUN"
        except Exception as e:  # noqa: BLE001
            status, diff = "ERR", f"{type(e).__name__}: {str(e)[:400]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        if status in ("BAD", "ERR"):
            bad += 1
        print(f"{status} {name:32s} {time.time() - t:6.2f}s {diff or ''}", flush=True)
    print(f"done: {len(qs)} queries, {len(orc)} with oracle, {bad} failing")


if __name__ == "__main__":
    main()
