"""Compare registered queries with their SQL twins: python tools/check_oracle.py [folder] [name ...]"""

from __future__ import annotations

import importlib
import pathlib
import sys
import tempfile
import time
from collections import Counter

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from corpuslens.plans.registry import ORACLES, QUERIES, TABLE_NAMES, Tables  # noqa: E402
from corpuslens.session import build_session  # noqa: E402


SQL_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP",
}


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLE_NAMES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def differences(spark_df, connection, sql: str) -> str | None:
    """How a result differs from its SQL twin: columns, types, rows. None if it does not."""
    names = sorted(spark_df.columns)
    there = {row[0]: row[1] for row in connection.execute(f"DESCRIBE {sql}").fetchall()}
    if sorted(there) != names:
        return f"columns {names} against {sorted(there)}"
    types = {name: SQL_TYPES.get(kind, kind) for name, kind in spark_df.dtypes}
    if types != there:
        return f"types {[(n, types[n], there[n]) for n in names if types[n] != there[n]]}"
    quoted = ", ".join('"' + n + '"' for n in names)
    want = connection.execute(f"SELECT {quoted} FROM ({sql}) q").fetchall()
    got = [tuple(row) for row in spark_df.select(*[f"`{n}`" for n in names]).collect()]
    if Counter(got) != Counter(want):
        extra = list((Counter(got) - Counter(want)).elements())[:3]
        lacking = list((Counter(want) - Counter(got)).elements())[:3]
        return f"{len(got)} rows against {len(want)}; only here {extra}; only there {lacking}"
    return None


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    if wanted and all(w.startswith("@") for w in wanted):
        for w in wanted:
            importlib.import_module(f"corpuslens.plans.{w[1:]}")
        wanted = list(QUERIES)
    else:
        importlib.import_module("corpuslens.plans").load_queries()
    spark = build_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g",
                                "spark.ui.showConsoleProgress": "false",
                                "spark.checkpoint.dir": tempfile.mkdtemp(prefix="oracle-")}
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(folder)
    failed = 0
    for name in wanted or QUERIES:
        started = time.time()
        try:
            df = QUERIES[name](Tables(spark, folder))
            if name in ORACLES:
                problem = differences(df, connection, ORACLES[name])
                rows = connection.execute(f"SELECT count(*) FROM ({ORACLES[name]}) q").fetchone()[0]
            else:
                rows, problem = df.count(), None
        except Exception as error:
            problem, rows = f"{type(error).__name__}: {str(error)[:900]}", -1
        failed += problem is not None
        state = "FAIL" if problem else ("ok" if name in ORACLES else "rows")
        print(f"{state:5s} {name:32s} {rows:8d} {time.time() - started:6.2f}s {problem or ''}", flush=True)
    print(f"{failed} failed of {len(wanted or QUERIES)}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
