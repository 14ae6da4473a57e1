"""python tests/run_check.py <sf_dir> [name ...]: run queries against oracles."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from ringweave.session import build_session  # noqa: E402
from tests.compare import connect, run_pair  # noqa: E402

if __name__ == "__main__":
    sf, wanted = sys.argv[1], sys.argv[2:]
    spark, con = build_session("check"), connect(sf)
    oracles, bad = entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            rows, problem = run_pair(spark, con, sf, name, fn, oracles.get(name))
        except Exception as exc:  # report and go on
            rows, problem = -1, f"{type(exc).__name__}: {str(exc)[:600]}"
        print(f"{time.time() - start:6.1f}s {rows:7d} {name:34s} {'ok' if problem is None else 'BAD ' + problem}{'' if name in oracles else ' (rows only)'}", flush=True)
        if problem:
            bad.append(name)
    print("bad:", bad)
