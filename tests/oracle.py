"""Compare registered queries with their SQL on the same parquet tables.

``python tests/oracle.py [sf] [name part ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


SAME_TYPE = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return float(f"{value:.9g}")
    if hasattr(value, "item"):
        return _cell(value.item())
    if isinstance(value, (bool, int, str)):
        return value
    if hasattr(value, "asDict"):
        return str({k: _cell(v) for k, v in value.asDict().items()})
    if type(value).__name__ == "Decimal":
        return float(f"{float(value):.9g}")
    if isinstance(value, dict):
        return str({k: _cell(v) for k, v in value.items()})
    if isinstance(value, (list, tuple)):
        return str([_cell(v) for v in value])
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return ([columns[i] for i in order],
            sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr))


def compare(spark, con, fn, sql, sf_dir) -> str:
    """Empty when equal, else what differs."""
    df = fn(spark, sf_dir)
    left_columns, left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "" if left else "no rows"
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    right_columns, right = rows_of(names, result.fetchall())
    if left_columns != right_columns:
        return f"columns {left_columns} != {right_columns}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}: {left[:2]} {right[:2]}"
    for a, b in zip(left, right):
        if a != b:
            return f"values {dict(zip(left_columns, a))} != {dict(zip(left_columns, b))}"
    theirs = {c[0]: str(c[1]) for c in result.description}
    ours = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    bad = {n: f"{t} / {theirs[n]}" for n, t in ours.items()
           if t in SAME_TYPE and theirs[n] != SAME_TYPE[t] or "decimal" in t}
    return f"types {bad}" if bad else ("" if left else "no rows")


def main() -> int:
    import __spark_entry__ as entry
    from edgetide import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(master="local[8]", shuffle_partitions=8,
                          **{"spark.ui.enabled": "false", "spark.driver.memory": "8g",
                             "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    failed = []
    for name, fn in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, fn, sqls.get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
            if len(parts):
                traceback.print_exc()
        took = time.time() - start
        kind = "sql " if name in sqls else "rows"
        print(f"{'ok  ' if not problem else 'FAIL'} {kind} {took:6.2f}s {name} {problem}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    spark.stop()
    return len(failed)


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
