"""Compare registered queries with their SQL on one set of tables.

Run as ``python tests/oracle_check.py [folder] [query ...]``.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _canon(value) -> str:
    if value is None or (not isinstance(value, (list, tuple)) and not hasattr(value, "__len__")
                         and pd.isna(value)):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value + 0.0)
    if hasattr(value, "tolist"):
        return repr(value.tolist())
    return str(value)


def rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    frame = frame[sorted(frame.columns)]
    columns = []
    for name in frame.columns:
        series = frame[name]
        if pd.api.types.is_datetime64_any_dtype(series):
            series = series.astype("datetime64[us]")
        columns.append([_canon(v) for v in series.astype(object)])
    return sorted(zip(*columns))


def differences(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} against {sorted(sql_frame.columns)}"
    mine, theirs = rows(spark_frame), rows(sql_frame)
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}"
    unequal = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(unequal)} rows differ, first {unequal[0]}" if unequal else None


def main() -> None:
    import __spark_entry__ as entry
    from cohort_spark.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("oracle_check", "local[8]", spark__sql__shuffle__partitions=8,
                          spark__ui__enabled="false", spark__driver__memory="8g",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf_dir), entry.oracle_sql()
    wanted = sys.argv[2:] or list(entry.queries())
    failed = []
    for name in wanted:
        began = time.time()
        try:
            frame = entry.queries()[name](spark, sf_dir).toPandas()
            took = time.time() - began
            problem = (differences(frame, con.sql(sql[name]).df()) if name in sql else None)
            print(f"{'ok  ' if problem is None else 'DIFF'} {name} {len(frame)} rows "
                  f"{took:.2f}s sql {time.time() - began - took:.2f}s"
                  f"{'' if name in sql else ' (rows only)'}", flush=True)
        except Exception as error:  # report and go on to the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
            print("FAIL", name, flush=True)
        if problem:
            failed.append(name)
            print("     ", problem, flush=True)
    print(f"{len(wanted) - len(failed)} of {len(wanted)} agree", failed)


if __name__ == "__main__":
    main()
