"""Compares registered queries with their check SQL in DuckDB, value by value.

`python -m tests.compare [sf_dir] [name ...]` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
SPARK_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return value


def difference(df, con, sql: str) -> tuple[str | None, int]:
    """None when columns, types and the multiset of rows agree; else what differs."""
    rel = con.sql(sql)
    theirs_types = dict(zip(rel.columns, map(str, rel.types)))
    ours_types = {n: SPARK_TYPES.get(t, t) for n, t in df.dtypes}
    if ours_types != theirs_types:
        return f"schema: {sorted(ours_types.items())} != {sorted(theirs_types.items())}", 0
    names = sorted(ours_types)
    ours = Counter(tuple(cell(r[n]) for n in names) for r in df.collect())
    order = [rel.columns.index(n) for n in names]
    theirs = Counter(tuple(cell(r[i]) for i in order) for r in rel.fetchall())
    rows = sum(ours.values())
    if ours == theirs:
        return None, rows
    a, b = ours - theirs, theirs - ours
    return (f"rows {rows} vs {sum(theirs.values())}; {names}; only ours {sum(a.values())}: "
            f"{list(a)[:3]}; only theirs {sum(b.values())}: {list(b)[:3]}"), rows


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from codequarry.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session("compare", cores="8")
    con = duck(sf_dir)
    checks, bad = oracle_sql(), 0
    for name, query in queries().items():
        if argv[1:] and not any(name.startswith(a) for a in argv[1:]):
            continue
        started = time.time()
        try:
            df = query(spark, sf_dir)
            if name in checks:
                diff, rows = difference(df, con, checks[name])
            else:
                diff, rows = None, df.count()
        except Exception as e:  # report and go on with the next query
            diff, rows = f"{type(e).__name__}: {str(e)[:1500]}", 0
        bad += diff is not None
        mark = "FAIL" if diff else ("ok  " if name in checks else "rows")
        print(f"{mark} {name} {rows} rows {time.time() - started:.2f}s {diff or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
