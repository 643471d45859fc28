"""Run queries against their SQL: ``python -m tests.check_queries [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time

from __spark_entry__ import oracle_sql, queries
from tests.oracle import connect, differences
from textloom.session import local_session


def main(sf_dir: str = "/root/testdata/sf0.01", *names: str) -> int:
    spark = local_session(8, **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    oracle = oracle_sql()
    failed = 0
    for name, query in queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            df = query(spark, sf_dir)
            found = differences(df, con, oracle[name]) if name in oracle else [f"{df.count()} rows, no SQL"]
        except Exception as problem:  # noqa: BLE001
            found = [f"{type(problem).__name__}: {str(problem)[:600]}"]
        failed += bool(found) and name in oracle
        print(f"{name:22} {time.time() - started:6.2f}s {'ok' if not found else found}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    raise SystemExit(main(*sys.argv[1:]))
