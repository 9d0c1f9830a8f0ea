"""Command line: python tests/check.py [sf] [name ...] compares queries with their SQL."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from choicemill.oracles import ORACLES
from choicemill.queries import QUERIES
from choicemill.session import build_session
from tests.oracle import compare, connect


def main() -> None:
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].replace(".", "").isdigit() else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    names = [q for q in QUERIES if not args or any(q.startswith(a) for a in args)]
    bad = 0
    for name in names:
        try:
            if name not in ORACLES:
                print(f"rows {name} {QUERIES[name](spark, sf_dir).count()}", flush=True)
                continue
            out = compare(spark, con, QUERIES[name], ORACLES[name], sf_dir)
        except Exception as error:  # noqa: BLE001
            out = {"equal": False, "note": str(error)[:1500]}
        bad += not out["equal"]
        print("ok  " if out["equal"] else "BAD ", name, out if not out["equal"] or out["types"] else
              (out["rows"], out["spark_sec"], out["oracle_sec"]), flush=True)
    print("missing query:", sorted(set(ORACLES) - set(QUERIES)), "bad:", bad)


if __name__ == "__main__":
    main()
