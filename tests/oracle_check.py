"""Compare every query with its SQL on the supplied tables: python tests/oracle_check.py [names]."""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(str(r[i]).lower() if isinstance(r[i], bool) else str(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """None when both sides agree, else what differs."""
    df = entry.queries()[name](spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    cur = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    theirs = rows_of(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {df.columns} vs {columns}"
    if ours != theirs:
        only = list((ours - theirs).items())[:2], list((theirs - ours).items())[:2]
        return f"{sum(ours.values())} vs {sum(theirs.values())} rows; {sum((ours - theirs).values())} differ: {only}"
    return None


if __name__ == "__main__":
    from pagemill.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = local_session(), database(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    for name in sys.argv[1:] or entry.oracle_sql():
        start = time.time()
        try:
            diff = compare(spark, con, name, sf_dir)
        except Exception as e:  # report and go on
            diff = f"{type(e).__name__}: {str(e)[:700]}"
        print("ok  " if diff is None else "DIFF", name, round(time.time() - start, 1), (diff or "")[:900], flush=True)
