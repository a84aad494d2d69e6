"""Compare registered queries with their oracle SQL."""

from __future__ import annotations

import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(spark, con, query, sql: str, folder: str) -> str | None:
    """None when equal, else what differs."""
    df = query(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    kinds = [tuple(type(v).__name__ for v in r) for r in (got[1][:1] + want[1][:1])]
    if got[1] != want[1]:
        bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
        return f"{len(bad)} rows differ, e.g. spark {bad[0][0]} oracle {bad[0][1]}"
    if len(kinds) == 2 and kinds[0] != kinds[1]:
        return f"types {kinds[0]} != {kinds[1]}"
    return None


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tarmaq.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8",
                                                   "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    for name in names:
        started = time.time()
        try:
            if name in entry.oracle_sql():
                verdict = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name],
                                  folder) or "ok"
            else:
                verdict = f"rows only: {entry.queries()[name](spark, folder).count()}"
        except Exception as error:  # report and go on
            verdict = f"ERROR {type(error).__name__} {str(error)[:600]}"
        print(f"{name:28s} {time.time() - started:6.2f}s {verdict}", flush=True)


if __name__ == "__main__":
    main()
