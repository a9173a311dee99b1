"""Run one registered query: ``python -m pulsegrid.plans.run a1_window_agg /path/to/tables``.

Prints the first rows, or writes the whole result as Parquet with ``--out``;
``--explain`` prints the formatted physical plan.
"""

from __future__ import annotations

import argparse

from ..session import build_session
from .catalog import queries


def main(argv: list[str] | None = None) -> None:
    qs = queries()
    ap = argparse.ArgumentParser(description=__doc__)
    ap.add_argument("name", choices=sorted(qs))
    ap.add_argument("tables", help="folder holding <table>.parquet")
    ap.add_argument("--show", type=int, default=20)
    ap.add_argument("--out", help="write the result here (Parquet) instead of showing it")
    ap.add_argument("--explain", action="store_true")
    args = ap.parse_args(argv)
    spark = build_session(app_name=f"pulsegrid-{args.name}")
    df = qs[args.name](spark, args.tables)
    if args.explain:
        df.explain("formatted")
    if args.out:
        df.write.mode("overwrite").parquet(args.out)
    else:
        df.show(args.show, truncate=False)


if __name__ == "__main__":
    main()
