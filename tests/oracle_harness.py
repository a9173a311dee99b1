"""Compare registered Spark queries with their DuckDB oracles.

Checks, per query: column names, row count, exact column types and the
order-insensitive multiset of row values (floats compared to 1e-9 relative).

    python tests/oracle_harness.py [--sf /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


STRICT = False


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v if STRICT else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


_SPARK_TO_DUCK = {"integer": "INTEGER", "long": "BIGINT", "short": "SMALLINT", "byte": "TINYINT",
                  "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN",
                  "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def _kind_spark(t) -> str:
    """Exact type, in DuckDB's names (the driver compares schemas too)."""
    return _SPARK_TO_DUCK.get(t.typeName(), t.typeName().upper())


def _kind_duck(t: str) -> str:
    return t.upper()


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_rows = [tuple(r) for r in sdf.collect()]
    t_spark = time.time() - t0
    s_cols = sdf.columns
    s_kinds = {f.name: _kind_spark(f.dataType) for f in sdf.schema.fields}
    rel = con.sql(sql)
    d_cols = rel.columns
    d_kinds = {c: _kind_duck(str(t)) for c, t in zip(rel.columns, rel.types)}
    d_rows = rel.fetchall()
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns spark={sorted(s_cols)} duck={sorted(d_cols)}")
    else:
        for c in s_cols:
            if s_kinds[c] != d_kinds[c]:
                problems.append(f"type {c}: spark={s_kinds[c]} duck={d_kinds[c]}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
    if not problems:
        order = sorted(s_cols)
        si = [s_cols.index(c) for c in order]
        di = [d_cols.index(c) for c in order]
        a = sorted((tuple(_norm(r[i]) for i in si) for r in s_rows), key=repr)
        b = sorted((tuple(_norm(r[i]) for i in di) for r in d_rows), key=repr)
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        if diff:
            problems.append(f"{len(diff)} differing rows, first: spark={diff[0][0]} duck={diff[0][1]}")
    return problems, len(s_rows), t_spark


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--plain", action="store_true", help="use a default session, as the driver may")
    ap.add_argument("--strict", action="store_true", help="compare floats bit for bit")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args(argv)
    global STRICT
    STRICT = args.strict
    import __spark_entry__ as E
    from pulsegrid.session import build_session

    if args.plain:
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[8]").config("spark.sql.session.timeZone", "America/New_York")
                 .getOrCreate())
    else:
        spark = build_session(master="local[8]", shuffle_partitions=8)
    qs, os_ = E.queries(), E.oracle_sql()
    con = duck(args.sf)
    names = args.names or sorted(qs)
    bad = 0
    for name in names:
        if name not in os_:
            try:
                n = qs[name](spark, args.sf).count()
                print(f"ROWS  {name}: {n} rows (no oracle)")
            except Exception as exc:  # noqa: BLE001
                bad += 1
                print(f"ERROR {name}: {type(exc).__name__}: {str(exc)[:400]}")
            continue
        try:
            problems, n, secs = compare(spark, con, name, qs[name], os_[name], args.sf)
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"ERROR {name}: {type(exc).__name__}: {str(exc)[:600]}")
            continue
        if problems:
            bad += 1
            print(f"FAIL  {name}: " + "; ".join(problems))
        else:
            print(f"OK    {name}: {n} rows ({secs:.1f}s)")
    print(f"{len(names) - bad}/{len(names)} passed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
