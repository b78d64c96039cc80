"""Run registered queries on Spark and DuckDB and compare all values.

Usage: python tests/compare.py [sf] [name ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time
from collections import Counter

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN",
         "date": "DATE", "float": "FLOAT"}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _cell(v) -> str:
    """Text of a value; unlike ==, it tells -0.0 from 0.0."""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return repr(v)


def differences(df, con, sql: str) -> list[str]:
    """What differs between a Spark result and the SQL result; empty when nothing does."""
    relation = con.execute(sql)
    names = [c[0] for c in relation.description]
    types = {c[0]: str(c[1]) for c in relation.description}
    found = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    for name, kind in df.dtypes:
        if TYPES.get(kind, kind) != types[name]:
            found.append(f"type of {name}: {kind} against {types[name]}")
    order = sorted(names)
    theirs = Counter(tuple(_cell(v) for v in row) for row in
                     (tuple(r[names.index(c)] for c in order) for r in relation.fetchall()))
    ours = Counter(tuple(_cell(v) for v in row) for row in df.select(*order).collect())
    if ours != theirs:
        extra, missing = ours - theirs, theirs - ours
        found.append(f"{sum(ours.values())} rows against {sum(theirs.values())}; "
                     f"{sum(extra.values())} only here, e.g. {sorted(extra)[:2]}; "
                     f"{sum(missing.values())} only in SQL, e.g. {sorted(missing)[:2]}")
    return found


def main(argv: list[str]) -> int:
    sys.path.insert(0, ROOT)
    import __spark_entry__ as entry
    from haulcast.session import local_session

    sf = argv[0] if argv else "0.01"
    d = f"/root/testdata/sf{sf}"
    names = argv[1:] or list(entry.queries())
    spark, con, bad = local_session(), duck(d), 0
    for name in names:
        start = time.time()
        try:
            df = entry.queries()[name](spark, d)
            if name in entry.oracle_sql():
                problems = differences(df, con, entry.oracle_sql()[name])
            else:
                problems = [] if df.count() else ["no rows"]
        except Exception as e:  # noqa: BLE001 - report and go on
            problems = [f"{type(e).__name__}: {str(e)[:900]}"]
        bad += bool(problems)
        kind = "sql " if name in entry.oracle_sql() else "rows"
        print(f"{'FAIL' if problems else 'ok  '} {kind} {time.time() - start:6.2f}s {name}", *problems, sep="\n       "
              if problems else " ", flush=True)
    print(f"{len(names) - bad} of {len(names)} good")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
