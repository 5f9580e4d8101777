"""Compare a Spark result with a DuckDB result: names, types, and rows, in their order where one is given."""

from __future__ import annotations

import math
from collections import Counter

_KIND = {
    "bigint": "int64", "int": "int32", "double": "float", "string": "text", "boolean": "bool", "date": "date",
    "BIGINT": "int64", "HUGEINT": "int128", "INTEGER": "int32", "DOUBLE": "float", "VARCHAR": "text",
    "BOOLEAN": "bool", "DATE": "date",
}


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}") + 0.0
    return value


def connect(path: str):
    import duckdb

    con = duckdb.connect()
    for table in ("region", "nation", "customer", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/{table}.parquet')")
    return con


def differences(frame, con, sql: str, order: str | None = None) -> list[str]:
    """What differs, empty when the two agree. ``order``: rows must come in this order of the SQL result's columns."""
    relation = con.sql(sql if order is None else f"SELECT * FROM (\n{sql}\n) ORDER BY {order}")
    spark_names, duck_names = sorted(frame.columns), sorted(relation.columns)
    if spark_names != duck_names:
        return [f"columns {spark_names} != {duck_names}"]
    spark_kinds = {name: _KIND.get(kind, kind) for name, kind in frame.dtypes}
    duck_kinds = {n: _KIND.get(str(t), str(t)) for n, t in zip(relation.columns, relation.types, strict=True)}
    out = [f"type of {n}: {spark_kinds[n]} != {duck_kinds[n]}" for n in spark_names if spark_kinds[n] != duck_kinds[n]]
    have = [tuple(_cell(row[n]) for n in spark_names) for row in frame.collect()]
    at = [relation.columns.index(n) for n in spark_names]
    want = [tuple(_cell(row[i]) for i in at) for row in relation.fetchall()]
    left, right = Counter(have), Counter(want)
    if left != right:
        out.append(
            f"rows {sum(left.values())} / {sum(right.values())}; only Spark {list((left - right).items())[:3]}; "
            f"only DuckDB {list((right - left).items())[:3]}"
        )
    elif order is not None and have != want:
        first = next(i for i, (a, b) in enumerate(zip(have, want, strict=True)) if a != b)
        out.append(f"order: row {first} is {have[first]}, by {order} it is {want[first]}")
    return out
