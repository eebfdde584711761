"""Compare registered queries with their SQL: ``python tests/compare.py [sf] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')"
        )
    return con


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value + 0.0)
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, int):
        return int(value)
    return repr(float(value)) if hasattr(value, "as_tuple") else str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(normal(row[i]) for i in order) for row in rows), key=lambda r: str(r)
    )


def differences(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short description."""
    ours = [tuple(r) for r in spark_df.collect()]
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = result.fetchall()
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)} rows"
    a, b = rows_of(spark_df.columns, ours), rows_of(names, theirs)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)} of {len(a)} rows differ, first {str(wrong[0])[:600]}"
    return None


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from civilspark.session import local_session

    sf = argv[1] if len(argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark, con = local_session(8), connect(folder)
    sql = oracle_sql()
    for name, query in queries().items():
        if len(argv) > 2 and name not in argv[2:]:
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            if name in sql:
                verdict = differences(df, con, sql[name])
            else:
                verdict = f"rows only: {len(df.collect())}"
        except Exception as error:  # report and go on with the next query
            verdict = f"ERROR {type(error).__name__} {str(error)[:700]}"
        print(f"{name:24} {time.time() - start:6.1f}s  {verdict or 'equal'}", flush=True)


if __name__ == "__main__":
    main(sys.argv)
