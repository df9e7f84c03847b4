"""Command line check of registered queries: python tests/run_checks.py [sf] [name ...]."""

from __future__ import annotations

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from compare import compare, duck  # noqa: E402

import __spark_entry__ as entry_module  # noqa: E402
from wellspan.session import build_session  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8",
                          spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sqls = duck(sf_dir), entry_module.queries(), entry_module.oracle_sql()
    wanted = sys.argv[2:]
    failed = 0
    for name, run in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        began = time.time()
        try:
            df = run(spark, sf_dir)
            if name in sqls:
                problems = compare(df, con, sqls[name])
            else:
                problems = [] if df.count() > 0 else ["no rows"]
        except Exception as error:  # report and go on with the next query
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        failed += bool(problems)
        kind = "sql" if name in sqls else "rows"
        print(f"{'FAIL' if problems else 'ok  '} {name} [{kind}] {time.time() - began:.1f}s {' | '.join(problems)}", flush=True)
        spark.catalog.clearCache()
    print("failed:", failed)


if __name__ == "__main__":
    main()
