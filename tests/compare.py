"""Row-for-row comparison of a registered query with its DuckDB check."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter

import duckdb
import pyarrow as pa

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _kind(t: pa.DataType) -> str:
    return str(t).replace("large_", "").replace("timestamp[us, tz=UTC]", "timestamp[us]")


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def _rows(table: pa.Table) -> Counter:
    table = table.select(sorted(table.column_names))
    return Counter(zip(*[[_norm(v) for v in c.to_pylist()] for c in table.columns]))


def differences(spark_table: pa.Table, duck_table: pa.Table) -> list[str]:
    out = []
    if sorted(spark_table.column_names) != sorted(duck_table.column_names):
        return [f"columns {sorted(spark_table.column_names)} vs {sorted(duck_table.column_names)}"]
    for name in spark_table.column_names:
        a, b = _kind(spark_table.schema.field(name).type), _kind(duck_table.schema.field(name).type)
        if a != b:
            out.append(f"type of {name}: {a} vs {b}")
    left, right = _rows(spark_table), _rows(duck_table)
    if left != right:
        out.append(
            f"rows {spark_table.num_rows} vs {duck_table.num_rows}; only spark "
            f"{list((left - right).elements())[:3]}; only duckdb {list((right - left).elements())[:3]}"
        )
    return out


def check(spark, con, name, query, sql, sf_dir) -> tuple[int, list[str]]:
    got = query(spark, sf_dir).toArrow()
    want = con.sql(sql).to_arrow_table()
    return got.num_rows, differences(got, want)
