"""Compare registered queries with their SQL: ``python tests/check_oracle.py [sf] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry_module  # noqa: E402
from affinity.session import build_session  # noqa: E402

DATA = Path("/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    order = frame.map(repr).apply("|".join, axis=1) if len(frame) else None
    return frame if order is None else frame.loc[order.sort_values().index].reset_index(drop=True)


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    """None when both hold the same rows in any order."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} vs {sorted(sql_frame.columns)}"
    if len(spark_frame) != len(sql_frame):
        return f"rows {len(spark_frame)} vs {len(sql_frame)}"
    a, b = canonical(spark_frame), canonical(sql_frame)
    for column in a.columns:
        unequal = [(x, y) for x, y in zip(a[column], b[column]) if x != y]
        if unequal:
            return f"{column}: {len(unequal)} differ, first {unequal[0]}"
    return None


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = str(DATA / f"sf{sf}")
    wanted = sys.argv[2:]
    spark = build_session("check", "local[8]", 8, **{"spark.driver.memory": "8g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = entry_module.oracle_sql()
    failed = 0
    for name, query in entry_module.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            got = query(spark, sf_dir).toPandas()
            spent = time.time() - start
            if name not in oracles:
                verdict = f"rows only ({len(got)})"
            else:
                verdict = difference(got, con.execute(oracles[name]).df())
                failed += verdict is not None
                verdict = f"DIFFERS {verdict}" if verdict else f"ok ({len(got)})"
        except Exception as error:  # report and go on with the next query
            spent = time.time() - start
            failed += 1
            verdict = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        print(f"{name:32s} {spent:7.2f}s  {verdict}", flush=True)
    print(f"{failed} failed")
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(main())
