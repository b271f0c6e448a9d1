"""Runs registered queries and their SQL side by side.

``python tests/oracle.py SF_DIR [name ...]`` prints one line per query.
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def rows_of(table) -> list[tuple]:
    """Rows with columns in name order, sorted; floats without a negative zero."""
    names = sorted(table.column_names)
    cols = [table.column(n).to_pylist() for n in names]
    rows = [tuple(v + 0.0 if isinstance(v, float) else v for v in r) for r in zip(*cols)]
    return sorted(rows, key=repr)


def compare(spark_table, sql_table) -> str | None:
    """None when both agree, otherwise what differs."""
    if sorted(spark_table.column_names) != sorted(sql_table.column_names):
        return f"columns {sorted(spark_table.column_names)} != {sorted(sql_table.column_names)}"
    for name in spark_table.column_names:
        a, b = str(spark_table.schema.field(name).type), str(sql_table.schema.field(name).type)
        if a.replace("large_", "") != b.replace("large_", ""):
            return f"type of {name}: {a} != {b}"
    if spark_table.num_rows != sql_table.num_rows:
        return f"rows {spark_table.num_rows} != {sql_table.num_rows}"
    a, b = rows_of(spark_table), rows_of(sql_table)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from tidelearn.session import get_session

    QUERIES, SQL = queries(), oracle_sql()
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, con = get_session("8"), connect(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            got = QUERIES[name](spark, sf_dir).toArrow()
            took = time.time() - start
            if name in SQL:
                start = time.time()
                wrong = compare(got, con.sql(SQL[name]).to_arrow_table())
                note = f"sql {time.time() - start:.2f}s"
            else:
                wrong, note = None, "no sql"
        except Exception as e:  # noqa: BLE001
            wrong, took, note, got = f"{type(e).__name__}: {str(e)[:600]}", time.time() - start, "", None
        failed += wrong is not None
        print(f"{'ok  ' if wrong is None else 'FAIL'} {name:24s} {took:7.2f}s {note} rows={getattr(got, 'num_rows', None)} {wrong or ''}", flush=True)
    print(f"{len(names)} queries, {failed} failed")


if __name__ == "__main__":
    main()
