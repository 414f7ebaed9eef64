"""Check registered queries by hand: ``python tests/run_oracles.py sf0.01 name ...``."""

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from compare import connect, difference

from longspark.catalog import load
from longspark.session import build_session


def main() -> int:
    scale, names = sys.argv[1], sys.argv[2:]
    queries, oracles = load()
    chosen = [n for n in queries if not names or any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in names)]
    spark = build_session(cores="8")
    sf = f"/root/testdata/{scale}"
    con = connect(sf)
    bad = 0
    for n in chosen:
        t = time.time()
        try:
            if n in oracles:
                d = difference(spark, con, queries[n], oracles[n], sf)
                rows = ""
            else:
                d, rows = None, f" rows only: {queries[n](spark, sf).count()}"
        except Exception as e:
            d, rows = "".join(traceback.format_exception_only(e))[:1500], ""
        bad += d is not None
        print(f"{'ok  ' if d is None else 'FAIL'} {n} {time.time() - t:.2f}s{rows}{'' if d is None else ' ' + d}", flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} agree")
    return bad > 0


if __name__ == "__main__":
    sys.exit(main())
