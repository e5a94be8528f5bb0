"""Order-insensitive comparison of a Spark result with its DuckDB oracle.

Row count, column names, column types and a canonical form of every row
(columns sorted by name, rows sorted) must all agree.  Used by the tests and
by ``tools/compare_oracle.py``.
"""

from __future__ import annotations

import datetime as dt
import os

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return str(v)


def canonical(columns: list[str], rows: list[tuple]) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


SPARK_TO_DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN",
}


def compare(df, con, sql: str) -> tuple[bool, str]:
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(sql)
    ocols = [d[0] for d in res.description]
    otypes = {d[0]: str(d[1]) for d in res.description}
    orows = res.fetchall()
    if sorted(df.columns) != sorted(ocols):
        return False, f"columns {sorted(df.columns)} != {sorted(ocols)}"
    for name, dtype in df.dtypes:
        if SPARK_TO_DUCK.get(dtype) != otypes[name]:
            return False, f"type of {name}: spark {dtype} vs oracle {otypes[name]}"
    a, b = canonical(df.columns, rows), canonical(ocols, orows)
    if a != b:
        only_a = [x for x in a if x not in set(b)][:3]
        only_b = [x for x in b if x not in set(a)][:3]
        return False, f"rows {len(a)} vs {len(b)}; spark-only {only_a}; oracle-only {only_b}"
    return True, ""
