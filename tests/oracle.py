"""Runs registered queries and their SQL on the same tables and compares all rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark"
    " labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shaped = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(shaped, key=lambda row: tuple((v is None, str(type(v)), v if v is not None else 0) for v in row))


def compare(spark, connection, name: str, query, sql: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = query(spark, sf_dir)
    relation = connection.sql(sql)
    if sorted(df.columns) != sorted(relation.columns):
        return f"columns {sorted(df.columns)} <> {sorted(relation.columns)}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    theirs_kind = dict(zip(relation.columns, map(str, relation.types)))
    for column, kind in df.dtypes:
        if kinds.get(kind, kind) != theirs_kind[column]:
            return f"type of {column}: {kind} <> {theirs_kind[column]}"
    ours = _rows(df.columns, [tuple(r) for r in df.collect()])
    theirs = _rows(relation.columns, relation.fetchall())
    if len(ours) != len(theirs):
        return f"rows {len(ours)} <> {len(theirs)}"
    if not ours:
        return "no rows on either side"
    different = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    if different:
        return f"{len(different)} of {len(ours)} rows differ, first {different[0]}"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from cadastrum.session import build_session

    sf_dir = "/root/testdata/" + (sys.argv[1] if len(sys.argv) > 1 else "sf0.01")
    only = sys.argv[2:]
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    oracles = entry.oracle_sql()
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            if name in oracles:
                verdict = compare(spark, connection, name, query, oracles[name], sf_dir) or "ok"
            else:
                verdict = f"rows only: {len(query(spark, sf_dir).collect())}"
        except Exception as error:  # report and go on with the next query
            verdict = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        print(f"{name:28s} {time.time() - start:6.2f}s  {verdict}", flush=True)


if __name__ == "__main__":
    main()
