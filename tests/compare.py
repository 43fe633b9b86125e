"""Runs registered queries against their SQL counterparts; also a command line tool: python tests/compare.py SF [name ...]."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, query, sql):
    """Empty text when equal, else a short account of the difference."""
    df = query(spark, folder)
    cols_s, rows_s = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    cols_d, rows_d = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    types = sorted((f.name, f.dataType.simpleString()) for f in df.schema.fields)
    kinds = sorted((c[0], str(c[1])) for c in cursor.description)
    odd = [(a, b) for a, b in zip(types, kinds) if a[0] == b[0] and not _same_type(a[1], b[1])]
    if cols_s != cols_d:
        return f"columns {sorted(set(cols_s) ^ set(cols_d))}"
    if len(rows_s) != len(rows_d):
        return f"rows {len(rows_s)} against {len(rows_d)}"
    if odd:
        return f"types {odd}"
    for a, b in zip(rows_s, rows_d):
        if a != b:
            return "values " + str([(c, x, y) for c, x, y in zip(cols_s, a, b) if x != y][:4])
    return "" if rows_s else "no rows"


def _same_type(spark_type: str, duck_type: str) -> bool:
    return {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}.get(spark_type) == duck_type


if __name__ == "__main__":
    import __spark_entry__ as entry
    from edgeloom.session import local_session

    folder = f"/root/testdata/sf{sys.argv[1]}"
    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    con = connection(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in oracle:
                result = compare(spark, con, folder, queries[name], oracle[name])
            else:
                result = "" if queries[name](spark, folder).count() else "no rows"
        except Exception as error:  # report and go on
            result = "ERROR " + str(error).split("JVM stacktrace")[0][:700]
        bad += bool(result)
        print(f"{'ok  ' if not result else 'FAIL'} {name} {time.time() - start:.1f}s {result}", flush=True)
    print(f"{len(names) - bad} of {len(names)} equal; without SQL: {sorted(set(queries) - set(oracle))}; only SQL: {sorted(set(oracle) - set(queries))}")
