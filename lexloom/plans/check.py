"""Compare registered queries with their SQL on the checking engine: ``python -m lexloom.plans.check``."""

from __future__ import annotations

import math
import sys
import time

from lexloom.plans.queries import REGISTRY
from lexloom.plans.tables import GIVEN
from lexloom.session import local_session


def _normal(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_normal(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, con, sf_dir: str, name: str) -> str:
    q = REGISTRY[name]
    start = time.time()
    df = q.plan(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if q.check is None:
        return f"rows-only  {len(got):7d} rows {took:6.2f}s"
    start = time.time()
    rel = con.sql(q.check)
    want, names = rel.fetchall(), list(rel.columns)
    if sorted(df.columns) != sorted(names):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(names)}"
    sql_took = time.time() - start
    kinds = dict(zip(names, [str(t) for t in rel.types]))
    same = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    odd = [
        (c, t, kinds[c]) for c, t in df.dtypes if same.get(t) != kinds[c]
    ]
    a, b = _rows(got, df.columns), _rows(want, names)
    if a != b:
        sa, sb = set(a), set(b)
        left = [r for r in a if r not in sb][:3]
        right = [r for r in b if r not in sa][:3]
        return f"DIFF {len(a)} vs {len(b)} rows\n   spark {left}\n   check {right}"
    note = f" TYPES {odd}" if odd else ""
    return f"ok         {len(a):7d} rows {took:6.2f}s (check {sql_took:5.2f}s){note}"


def main() -> None:
    import duckdb

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(REGISTRY)
    spark = local_session(8)
    con = duckdb.connect()
    for t in GIVEN:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name in names:
        try:
            print(f"{name:36s} {compare(spark, con, sf_dir, name)}", flush=True)
        except Exception as exc:  # report and go on with the next query
            print(f"{name:36s} ERROR {type(exc).__name__}: {str(exc)[:900]}", flush=True)


if __name__ == "__main__":
    main()
