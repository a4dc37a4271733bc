"""Run registered queries next to their reference SQL and compare values."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def normal(value):
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (float, decimal.Decimal)):
        f = float(value)
        if math.isnan(f):
            return "NULL"
        return f"{f + 0.0:.6g}" if abs(f) >= 1e6 else f"{round(f, 6) + 0.0:.6f}"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, dt.datetime) and value.time() == dt.time(0):
        return value.date().isoformat()
    return str(value)


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(normal(r[c]) for c in columns) for r in df.select(*[f"`{c}`" for c in columns]).collect())


def sql_rows(con, sql: str):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = sorted(tuple(normal(r[i]) for i in order) for r in result.fetchall())
    return [names[i] for i in order], rows


def numbers(rows):
    """Integers and floats of the same value count as equal."""
    def one(v):
        try:
            return f"{float(v):.6f}" if v not in ("True", "False") else v
        except ValueError:
            return v
    return sorted(tuple(one(v) for v in row) for row in rows)


def compare(spark, con, folder, query, sql):
    """None if equal, otherwise a short text with the first difference."""
    a_cols, a = spark_rows(query(spark, folder))
    b_cols, b = sql_rows(con, sql)
    if a_cols != b_cols:
        return f"columns {a_cols} != {b_cols}"
    if len(a) != len(b):
        extra = [x for x in a if x not in set(b)][:2] if len(a) < 50000 else ""
        return f"rows {len(a)} != {len(b)} e.g. {extra}"
    if a != b:
        a, b = numbers(a), numbers(b)
    if a != b:
        sa, sb = set(a), set(b)
        return f"{len(sa - sb)} rows differ: {str(sorted(sa - sb)[:2])[:600]} vs {str(sorted(sb - sa)[:2])[:600]}"
    return None


def main() -> None:
    import __spark_entry__ as entry

    from reviewlake.session import build_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
    spark = build_session(master="local[8]", partitions=8, memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[1:] or list(queries)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            if name in oracle:
                problem = compare(spark, con, folder, queries[name], oracle[name])
            else:
                n = len(queries[name](spark, folder).collect())
                problem = None if n else "no rows"
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        bad += problem is not None
        kind = "sql " if name in oracle else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} good")


if __name__ == "__main__":
    main()
