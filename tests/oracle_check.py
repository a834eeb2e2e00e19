"""Run registered queries and their SQL side by side: ``python tests/oracle_check.py [sf_dir] [names]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def compare(spark, con, query, sql: str, sf_dir: str) -> tuple[bool, str]:
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    theirs = rows_of(columns, result.fetchall())
    if sorted(df.columns) != sorted(columns):
        return False, f"columns {sorted(df.columns)} / {sorted(columns)}"
    if ours == theirs:
        types = [str(d[1]) for d in result.description]
        return True, f"{len(ours)} rows {df.dtypes} {types}"
    differing = [(a, b) for a, b in zip(ours, theirs) if a != b][:2]
    return False, f"{len(ours)} / {len(theirs)} rows; " + " || ".join(
        f"{str(a)[:400]}  <>  {str(b)[:400]}" for a, b in differing
    )


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from paperloom.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark = build_session(
        "oracle-check", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), []
    for name in names:
        start = time.perf_counter()
        try:
            ok, note = compare(spark, con, queries()[name], oracle_sql()[name], sf_dir)
        except Exception as failure:
            ok, note = False, str(failure)[:1200]
        seconds = time.perf_counter() - start
        print(f"{'ok ' if ok else 'BAD'} {name} {seconds:.1f}s {note if not ok or '-v' in os.environ.get('CHECK', '') else note[:60]}", flush=True)
        if not ok:
            bad.append(name)
    print("bad:", bad)


if __name__ == "__main__":
    main()
