"""Seconds per registered query, results computed in full but not collected.

    python tools/timing.py [data folder] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from check import entry_points, session  # noqa: E402


def main() -> None:
    args = sys.argv[1:]
    base = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.1"
    spark, queries = session(), entry_points.queries()
    names = args or list(queries)
    queries[names[0]](spark, base).write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        start = time.time()
        queries[name](spark, base).write.format("noop").mode("overwrite").save()
        took[name] = time.time() - start
    for name, sec in sorted(took.items(), key=lambda x: -x[1]):
        print(f"{name:28s} {sec:7.2f}")
    print(f"total {sum(took.values()):.1f}")


if __name__ == "__main__":
    main()
