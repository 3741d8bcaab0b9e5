"""Run queries against their SQL text: python tests/check.py [prefix ..] [--sf 0.01]."""

from __future__ import annotations

import importlib
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import connect, difference  # noqa: E402

from tidemark import registry  # noqa: E402
from tidemark.session import local_session  # noqa: E402


def main(args: list[str]) -> int:
    sf = "0.01"
    if "--sf" in args:
        at = args.index("--sf")
        sf = args[at + 1]
        del args[at:at + 2]
    modules = [a[2:] for a in args if a.startswith("m:")]
    prefixes = [a for a in args if not a.startswith("m:")]
    for m in modules or registry.MODULES:
        importlib.import_module(f"tidemark.plans.{m}")
    path = f"/root/testdata/sf{sf}"
    spark = local_session()
    con = connect(path)
    bad = 0
    ran = 0
    for name, q in registry.QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        began = time.perf_counter()
        ran += 1
        try:
            df = q(spark, path)
            if q.sql is None:
                rows = df.limit(3).collect()
                problem = None if rows else "no rows"
                note = f"rows-only {str([r.asDict() for r in rows[:1]])[:150]}"
            else:
                problem, note = difference(df, con, q.sql), "ok"
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:3000]}"
        seconds = time.perf_counter() - began
        if problem:
            bad += 1
            print(f"FAIL {name} {seconds:.1f}s {problem[:4000]}", flush=True)
        elif seconds > 4 or q.sql is None:
            print(f"ok   {name} {seconds:.1f}s {note}", flush=True)
    print(f"{ran} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    main(sys.argv[1:])
