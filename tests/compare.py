"""Run registered queries next to their SQL and compare the rows."""

from __future__ import annotations

import argparse
import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract  # noqa: E402
from curbflow.session import build_session  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def canonical(columns, rows):
    """Rows with columns in name order, floats as they are, sorted."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float) and math.isnan(v):
            return "NaN"
        return v

    return [columns[i] for i in order], sorted(
        (tuple(value(r[i]) for i in order) for r in rows), key=_key
    )


def compare(spark, con, name, query, sql, sf_dir) -> str:
    """Empty when schema, row count and every value agree, else what differs."""
    df = query(spark, sf_dir)
    columns, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    expected_columns, expected = canonical(names, result.fetchall())
    if columns != expected_columns:
        return f"columns {columns} != {expected_columns}"
    if len(got) != len(expected):
        return f"rows {len(got)} != {len(expected)}"
    bad = [(a, b) for a, b in zip(got, expected) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, e.g. {columns}: {bad[0][0]} != {bad[0][1]}"
    types = dict(df.dtypes)
    kinds = dict(zip(names, [str(c[1]) for c in result.description]))
    known = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP"}
    off = {c: (t, kinds[c]) for c, t in types.items() if known.get(t, t) != kinds[c]}
    return f"types {off}" if off else ""


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf_dir)
    queries, oracles = contract.queries(), contract.oracle_sql()
    print("oracles without a query:", sorted(set(oracles) - set(queries)))
    failed = 0
    for name in args.names or queries:
        start = time.time()
        try:
            if name in oracles:
                message = compare(spark, con, name, queries[name], oracles[name], args.sf_dir)
            else:
                message = f"rows only: {queries[name](spark, args.sf_dir).count()}"
        except Exception as error:  # noqa: BLE001
            traceback.print_exc(limit=3)
            message = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(message) and not message.startswith("rows only")
        print(f"{name:32s} {time.time() - start:6.1f}s {message or 'ok'}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    raise SystemExit(main())
