"""Run registered queries against their SQL: ``python tests/check.py [folder] [name ...]``."""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from savanto.session import local_session
from savanto.suite import load
from tests.oracle import connect, differences


def main(folder: str, names: list[str]) -> int:
    spark = local_session("check")
    con = connect(folder)
    cases = load()
    failed = 0
    for name in names or list(cases):
        c = cases[name]
        start = time.time()
        try:
            if c.sql:
                problem = differences(c.run(spark, folder), con, c.sql)
                note = "ok"
            else:
                problem, note = None, f"rows only: {c.run(spark, folder).count()}"
        except Exception as e:  # report and go on with the next query
            problem = "".join(traceback.format_exception_only(e))[:1500]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        failed += problem is not None
        print(f"{name:24s} {time.time() - start:6.2f}s {problem or note}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    args = sys.argv[1:]
    folder = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    sys.exit(1 if main(folder, args) else 0)
