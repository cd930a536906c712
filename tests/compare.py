"""Runs registered queries in Spark and their SQL in DuckDB, and compares whole results."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


SAME_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)  # tells 0.0 from -0.0
    return value


def table(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql: str) -> list[str]:
    """Empty when names, row count and all values agree."""
    ours = df.collect()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} vs {sorted(names)}"]
    if len(ours) != len(theirs):
        return [f"rows {len(ours)} vs {len(theirs)}"]
    kinds = dict(zip(names, (str(d[1]) for d in cursor.description)))
    wide = [f"type {c}: {t} vs {kinds[c]}" for c, t in df.dtypes if SAME_TYPE.get(t) != kinds[c]]
    a, b = table(df.columns, ours), table(names, theirs)
    return [f"{x} vs {y}" for x, y in zip(a, b) if x != y] or wide


def main() -> None:
    import __spark_entry__ as entry
    from tallywatch.session import build_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    chosen = sys.argv[1:] or list(entry.queries())
    spark = build_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, bad = connect(folder), entry.oracle_sql(), 0
    for name in chosen:
        start = time.time()
        try:
            df = entry.queries()[name](spark, folder)
            if name in oracle:
                found = differences(df, con, oracle[name])
                verdict = "ok" if not found else f"DIFF {len(found)}: {found[0]}"
            else:
                verdict = f"rows {df.count()}"
        except Exception as error:  # report and go on with the next query
            verdict = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        bad += not (verdict == "ok" or verdict.startswith("rows"))
        print(f"{name:24s} {time.time() - start:6.1f}s  {verdict}", flush=True)
    print(f"{bad} bad of {len(chosen)}; without SQL: {sorted(set(chosen) - set(oracle))}; unused SQL: {sorted(set(oracle) - set(entry.queries()))}")


if __name__ == "__main__":
    main()
