"""Run a registered query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as spark_entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def _plain(value):
    return list(map(_plain, value)) if isinstance(value, (list, tuple)) else value


def _sorted(rows, columns, names):
    order = [columns.index(n) for n in names]
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def differences(spark, db, name: str, folder: str) -> str | None:
    """None where both sides agree, else what differs."""
    df = spark_entry.queries()[name](spark, folder)
    names = sorted(df.columns)
    got = _sorted([tuple(r) for r in df.collect()], df.columns, names)
    sql = spark_entry.oracle_sql().get(name)
    if sql is None:
        return None if got else "no rows"
    result = db.execute(sql)
    columns = [d[0] for d in result.description]
    types = {d[0]: str(d[1]).upper() for d in result.description}
    if sorted(columns) != names:
        return f"columns {names} != {sorted(columns)}"
    want = _sorted(result.fetchall(), columns, names)
    spark_types = dict(df.dtypes)
    loose = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date"}
    wrong = [n for n in names if loose.get(types[n], spark_types[n]) != spark_types[n]]
    if wrong:
        return f"types {[(n, spark_types[n], types[n]) for n in wrong]}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(bad)} of {len(got)} rows, first {str(bad[0])[:600]}" if bad else None


def main(folder: str, wanted: list[str]) -> None:
    from millrace.session import build_session

    spark = build_session(master="local[8]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__sql__shuffle__partitions="8")
    spark.sparkContext.setLogLevel("OFF")
    db = connect(folder)
    for name in wanted or spark_entry.queries():
        began = time.time()
        try:
            found = differences(spark, db, name, folder)
        except Exception as error:  # noqa: BLE001
            found = f"{type(error).__name__}: {str(error)[:700]}"
        print(f"{'ok  ' if found is None else 'FAIL'} {name} {time.time() - began:.1f}s {found or ''}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
