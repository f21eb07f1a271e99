"""Compare registered queries with their SQL twins: ``python check.py [folder] [name ...]``."""

import sys
import time

from siftwell.plans import load_plans
from siftwell.session import local_session
from tests.compare import connect, differences


def main(folder: str, names: list[str]) -> int:
    spark, con, bad = local_session(), connect(folder), 0
    for name, p in load_plans().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = p.run(spark, folder)
            if p.sql is None:
                print(f"{name}: {len(df.collect())} rows, no SQL ({time.time() - start:.1f}s)")
                continue
            problems = differences(df, con, p.sql)
        except Exception as exc:  # report and go on with the next query
            problems = [f"{type(exc).__name__}: {str(exc)[:1500]}"]
        bad += bool(problems)
        print(f"{name}: {'ok' if not problems else 'DIFFERENT'} ({time.time() - start:.1f}s)")
        for line in problems:
            print("   ", line[:1800])
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    sys.exit(1 if main(folder, args) else 0)
