"""Compare registered queries with their SQL: python tests/compare.py FOLDER [NAME...]."""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, Decimal):
        return round(float(x), 6)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if hasattr(x, "tzinfo"):
        return str(x.replace(tzinfo=None))
    return x


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def difference(spark, con, folder: str, name: str, query, sql: str) -> str:
    """Empty if both give the same rows; else what differs."""
    df = query(spark, folder)
    cols = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = con.execute(sql)
    names = [x[0] for x in res.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    at = [names.index(c) for c in cols]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in res.fetchall()), key=repr)
    if ours == theirs:
        return ""
    a, b = set(map(repr, ours)), set(map(repr, theirs))
    return f"{len(ours)} and {len(theirs)} rows; only ours {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}"


if __name__ == "__main__":
    import __spark_entry__ as e
    from pricegrain.session import session

    folder, only = sys.argv[1], sys.argv[2:]
    spark = session(cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = duck(folder), e.oracle_sql()
    bad = 0
    for name, query in e.queries().items():
        if only and not any(name == o or (o.endswith("*") and name.startswith(o[:-1])) for o in only):
            continue
        t = time.time()
        try:
            said = difference(spark, con, folder, name, query, sql[name]) if name in sql else f"rows only: {query(spark, folder).count()}"
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:700]}"
        ok = not said or said.startswith("rows only")
        bad += not ok
        print(f"{'ok  ' if ok else 'DIFF'} {name} {time.time() - t:.1f}s {said}", flush=True)
    sys.exit(bad > 0)
