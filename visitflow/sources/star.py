"""The visit table as a view over an order star: one visit per order.

The facts are the orders; patient name and department come from the customer, race from the customer's region. All
three lookups are left joins on a unique key, so they never add or drop visits, and a lookup is joined only when one
of the requested columns needs it. No join carries a broadcast hint: nation and region files are far below Spark's
broadcast threshold, while a customer table beyond it falls back to a sort-merge join that adaptive execution can
split on a hot customer.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import DataFrame, SparkSession

from visitflow.operators.derive import derive, fill_scores
from visitflow.sources import schema as S

# Declared, so that opening a table reads no file footers.
TABLES = {
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_mktsegment STRING",
    "nation": "n_nationkey INT, n_regionkey INT",
    "region": "r_regionkey INT, r_name STRING",
}

_SECOND = "((o_orderkey * 7919) % 86400)"  # second of the day at which the visit starts



def _clock(hour: str) -> str:
    minute, second = f"({_SECOND} % 3600) div 60", f"{_SECOND} % 60"
    return "concat_ws(':', " + ", ".join(f"lpad(cast({x} AS STRING), 2, '0')" for x in (hour, minute, second)) + ")"


STORED = ("o_orderdate", "o_totalprice")  # may be named besides visit columns, for filters that the scan can use

_FACTS = {
    "patient_id": "CASE WHEN o_orderkey IS NOT NULL THEN format_string('P%09d', o_orderkey) END",
    "admission_date": "CASE WHEN o_orderkey % 997 <> 0 THEN cast(o_orderdate AS DATE) END",
    "admission_time": f"CASE WHEN o_orderkey % 89 <> 0 THEN {_clock(f'{_SECOND} div 3600')} END",
    "gender": "CASE o_orderstatus WHEN 'F' THEN 'Female' WHEN 'O' THEN 'Male' ELSE 'Other' END",
    "age": "cast(o_custkey % 101 AS INT)",
    "admission_flag": """CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH')
        OR (o_orderpriority = '3-MEDIUM' AND o_orderkey % 2 = 0) THEN 'Admission' ELSE 'Not Admission' END""",
    "satisfaction_score": """CASE WHEN o_orderkey % 10 < 3
        THEN cast(floor(o_orderkey / 10) % 7 + floor((500000 - o_totalprice) / 100000) AS DOUBLE) END""",
    "wait_time": """CASE WHEN o_orderkey % 211 <> 0
        THEN cast(floor(o_totalprice / 8000) AS INT) + CASE WHEN o_orderkey % 97 = 0 THEN 120 ELSE 0 END END""",
}

_LOOKUPS = {
    "patient_name": "c_name",
    "race": "r_name",
    "department_referral": "CASE WHEN c_mktsegment = 'MACHINERY' THEN 'None' ELSE c_mktsegment END",
}

# What an unparsed file would hold: dates and times as text, some of it bad.
_RAW_TEXT = {
    **_FACTS,
    "admission_date": "CASE WHEN o_orderkey % 997 = 0 THEN 'not-a-date' "
                      "ELSE date_format(o_orderdate, 'MM/dd/yyyy') END",
    "admission_time": f"""CASE WHEN o_orderkey % 89 = 0 THEN ''
        ELSE concat({_clock(f"({_SECOND} div 3600 + 11) % 12 + 1")},
                    CASE WHEN {_SECOND} < 43200 THEN ' AM' ELSE ' PM' END) END""",
}


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{path}/{name}.parquet")


def _base(
    spark: SparkSession, path: str, expressions: Mapping[str, str], columns: Collection[str]
) -> DataFrame:
    rows = _table(spark, path, "orders")
    if not _LOOKUPS.keys().isdisjoint(columns):
        customer = _table(spark, path, "customer")
        rows = rows.join(customer, rows.o_custkey == customer.c_custkey, "left")
    if "race" in columns:
        # After the customer, so that every side to broadcast is a plain scan, whose size Spark knows.
        nation, region = _table(spark, path, "nation"), _table(spark, path, "region")
        rows = rows.join(nation, rows.c_nationkey == nation.n_nationkey, "left")
        rows = rows.join(region, rows.n_regionkey == region.r_regionkey, "left")
    stored = [c for c in STORED if c in columns]
    return rows.selectExpr(*stored, *[f"{expressions[c]} AS {c}" for c in S.RAW_COLUMNS if c in columns])


def visits(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The named columns of the visit table over the Parquet tables in ``path``; all columns when none is named.

    Columns of ``STORED`` may be named too.
    """
    wanted = columns or S.ALL_COLUMNS
    sources = {S.DERIVED_FROM.get(c, c) for c in wanted}
    table = derive(_base(spark, path, {**_FACTS, **_LOOKUPS}, sources), only=wanted)
    if "satisfaction_score_filled" in wanted:
        table = fill_scores(table)
    return table.select(*wanted)


def raw_text(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The named raw columns (all eleven when none is named) as a file would hold them, before parsing."""
    return _base(spark, path, {**_RAW_TEXT, **_LOOKUPS}, columns or S.RAW_COLUMNS)
