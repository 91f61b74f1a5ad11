"""Run named queries against their stated results: ``run_queries.py SF [name ...]``."""

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from compare import connect, difference  # noqa: E402

from qaspark.plans import load_catalog  # noqa: E402
from qaspark.session import local_session  # noqa: E402


def main(sf, *wanted):
    sf_dir = f"/root/testdata/sf{sf}"
    queries, stated = load_catalog()
    names = [n for n in queries if not wanted or any(n == w or (w.endswith("*") and n.startswith(w[:-1])) or queries[n].__module__.endswith(w) for w in wanted)]
    spark, db = local_session(8), connect(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in stated:
                problem = difference(df, db, stated[name])
            else:
                problem = None if df.count() else "no rows"
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:700]}"
            if "-v" in sys.argv:
                traceback.print_exc()
        failed += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {time.time() - start:6.2f}s {name} {problem or ''}"[:900], flush=True)
    print(f"{len(names)} queries, {failed} failed")


if __name__ == "__main__":
    main(*[a for a in sys.argv[1:] if a != "-v"])
