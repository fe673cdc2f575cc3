"""Runs registered queries in Spark and their SQL in DuckDB and compares schema and rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is None, "" if v is None else (f"{v:.6g}" if isinstance(v, float) else str(v))) for v in row)


def _same(a, b, exact):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b)) or (
            not exact and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))
    return a == b


def compare(df, con, sql: str, exact: bool = True) -> str | None:
    """None when equal, else what differs."""
    cols = sorted(df.columns)
    rel = con.sql(sql)
    theirs = dict(zip(rel.columns, map(str, rel.types)))
    if cols != sorted(theirs):
        return f"columns {cols} vs {sorted(theirs)}"
    bad = [(f.name, f.dataType.simpleString(), theirs[f.name]) for f in df.schema.fields
           if TYPES.get(f.dataType.simpleString()) != theirs[f.name]]
    if bad:
        return f"types {bad}"
    ours = sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=_key)
    order = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=_key)
    if len(ours) != len(want):
        extra = [r for r in ours if r not in set(want)][:2]
        lack = [r for r in want if r not in set(ours)][:2]
        return f"{len(ours)} rows vs {len(want)}; ours only {extra}; theirs only {lack}"
    for a, b in zip(ours, want):
        if not all(_same(x, y, exact) for x, y in zip(a, b)):
            n = sum(not all(_same(x, y, exact) for x, y in zip(p, q)) for p, q in zip(ours, want))
            return f"{n} of {len(ours)} rows differ, columns {cols}: {a} vs {b}"
    return None


def main(argv):
    import __spark_entry__ as entry
    from brigade.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(n.startswith(a) for a in argv)]
    bad = 0
    for n in names:
        t = time.time()
        try:
            df = queries[n](spark, sf_dir)
            if n in sql:
                why = compare(df, con, sql[n])
                size = "" if why else df.count()
            else:
                why, size = None, f"{df.count()} (rows only)"
        except Exception as e:  # report and go on with the next query
            why, size = f"{type(e).__name__}: {str(e)[:600]}", ""
        bad += why is not None
        print(("ok  " if why is None else "BAD ") + n, f"{time.time() - t:.1f}s", size, why or "", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    sys.exit(1 if main(sys.argv[1:]) else 0)
