"""Run registered queries against their SQL in DuckDB and compare whole results."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    return con


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(normal(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(picked, key=repr)


def compare(spark, con, query, sql, root: str) -> tuple[bool, str]:
    df = query(spark, root)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want_cols, want = rows_of(rel.columns, rel.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} vs {want_cols}"
    if len(got) != len(want):
        return False, f"rows {len(got)} vs {len(want)}"
    kinds = [{type(x) for x in col if x is not None} for col in zip(*got)]
    wants = [{type(x) for x in col if x is not None} for col in zip(*want)]
    if kinds != wants:
        return False, f"types {list(zip(got_cols, kinds, wants))}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return False, f"{len(bad)} of {len(got)} rows differ, e.g. {got_cols}: {bad[0]}"
    return True, f"{len(got)} rows"


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from marketloom.session import local_session

    root, names = sys.argv[1], sys.argv[2:]
    spark, con = local_session("8"), duck(root)
    queries, sql = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or queries:
        start = time.time()
        try:
            if name in sql:
                ok, note = compare(spark, con, queries[name], sql[name], root)
            else:
                rows = queries[name](spark, root).collect()
                ok, note = True, f"{len(rows)} rows (no SQL)"
        except Exception as error:  # noqa: BLE001 report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - start:6.2f}s {note}", flush=True)
    print("failed:", failed)
