"""Files and tables: CSV and Parquet in, Parquet, tables and CSV out."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitflow.operators.derive import derive, fill_scores, parse, sql_view
from visitflow.sources import schema as S


CSV = {"quote": '"', "escape": '"'}  # a quote inside a quoted field is doubled


def _number(text: Column, kind: T.DataType) -> Column:
    """The number a field holds; null when it holds something else (for whole numbers, also a fraction)."""
    value = text.try_cast("double")
    if isinstance(kind, T.IntegerType):
        return F.when(value == F.floor(value), value.try_cast("int"))
    return value


def _header_widths(spark: SparkSession, path: str) -> list[tuple[int, list[str]]]:
    """Numbers of columns in the header lines, each with up to three of the files that have it.

    The header of a file is the first line of its first block; only one line of each file leaves a task.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    ).where("block = 0")
    heads = lines.groupBy("file").agg(F.min_by("value", "at").alias("head"))
    # A quoted comma does not divide, whatever else the quoted text holds.
    plain = F.regexp_replace("head", '"([^"]|"")*"', "x")
    found = heads.groupBy(F.size(F.split(plain, ",")).alias("width")).agg(
        F.slice(F.sort_array(F.collect_set("file")), 1, 3).alias("files"))
    return [(row["width"], row["files"]) for row in found.collect()]


def read_raw_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Raw rows with a header line; the header text is ignored, columns bind by position.

    Fields may be quoted, with ``""`` for a quote. A line break inside quotes needs ``multi_line``: each file is then
    read by one task, since only reading from the start tells which line breaks are quoted.

    A file of another width is refused. Single rows that are short, long or hold text in a number field are kept, with
    the row's text in ``malformed_record``. The parser reads text only and does not prune columns: otherwise which rows
    count as malformed would depend on the columns a query happens to select.
    """
    for width, files in _header_widths(spark, path):
        if width != len(S.RAW_COLUMNS):
            raise ValueError(f"expected {len(S.RAW_COLUMNS)} columns, the header has {width}: {', '.join(files)}")
    text = (
        spark.read.schema(S.RAW_TEXT)
        .options(**CSV)
        .option("multiLine", multi_line)
        .option("header", True)
        .option("enforceSchema", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", S.MALFORMED)
        .option("columnPruning", False)
        .csv(path)
    )
    kinds = {f.name: f.dataType for f in S.RAW if not isinstance(f.dataType, T.StringType)}
    numbers = {name: _number(F.col(name), kind) for name, kind in kinds.items()}
    unread = reduce(or_, [F.col(name).isNotNull() & number.isNull() for name, number in numbers.items()])
    fields = F.concat_ws(",", *[F.coalesce(F.col(c), F.lit("")) for c in S.RAW_COLUMNS])
    return text.withColumns({**numbers, S.MALFORMED: F.coalesce(F.col(S.MALFORMED), F.when(unread, fields))})


def read_visits(
    spark: SparkSession, path: str, source: str = "csv", referral_null_mode: str = "literal", multi_line: bool = False
) -> DataFrame:
    """The full visit table from raw CSV, or from Parquet written by this library."""
    if source == "parquet":
        visits = spark.read.parquet(path)
        if "is_admitted" not in visits.columns:
            visits = derive(visits, referral_null_mode)
        return visits if "satisfaction_score_filled" in visits.columns else fill_scores(visits)
    if source != "csv":
        raise ValueError(f"source must be 'csv' or 'parquet', not {source!r}")
    parsed = parse(read_raw_csv(spark, path, multi_line), referral_null_mode)
    return fill_scores(derive(parsed, referral_null_mode))


def _by_month(visits: DataFrame, *leading: str) -> DataFrame:
    # Rebalancing brings the rows of a month together, so that each writes few files; adaptive execution splits a
    # month that is far larger than the others.
    return visits.hint("rebalance", *leading, "year", "month")


def write_parquet(visits: DataFrame, path: str, *leading: str) -> None:
    """Parquet partitioned by year and month: the layout that date filters prune."""
    _by_month(visits, *leading).write.mode("overwrite").partitionBy(*leading, "year", "month").parquet(path)


def save_table(visits: DataFrame, name: str) -> None:
    """Replace a catalog table, partitioned by year and month."""
    _by_month(visits).write.mode("overwrite").partitionBy("year", "month").format("parquet").saveAsTable(name)


def save_bucketed(visits: DataFrame, name: str, buckets: int) -> None:
    """Replace a catalog table, dealt to buckets by patient id and sorted by it in each.

    The layout for work by id: joins and groups by ``patient_id`` read a bucket in a task, without an exchange. Rows are
    dealt by the same hash first, so that every bucket is one file. Ids should be of even weight: the rows of one id, and
    those without an id, lie in one bucket.
    """
    dealt = visits.repartition(buckets, "patient_id")
    dealt.write.mode("overwrite").bucketBy(buckets, "patient_id").sortBy("patient_id").format("parquet").saveAsTable(name)


def export_csv(df: DataFrame, path: str) -> None:
    """All columns as CSV part files with a header each."""
    df.write.mode("overwrite").options(**CSV).option("header", True).csv(path)


def register(visits: DataFrame, name: str = "patients") -> None:
    """Make the table visible to SQL text."""
    sql_view(visits).createOrReplaceTempView(name)


def keep(df: DataFrame) -> DataFrame:
    """Keep a table for repeated interactive use; the caller ends it with ``unpersist()``."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
