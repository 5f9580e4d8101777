"""What the operators share: input tables, tables written between steps, and batches of bounded size for Python."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator, Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a Python worker turns into arrays at once; a single longer text makes a batch of its own.
BATCH_CHARS = 1_000_000
#: Rows and bytes that are sent to a Python worker at once, where a job asks for small batches.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def travels(module: str) -> None:
    """Send a module's functions to the workers by value, so that they need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


travels(__name__)


def small_batches(spark: SparkSession) -> None:
    """From now on, rows of this session reach Python in batches of bounded size, long texts or not."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="visitflow-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows read from a table in the shared folder: lineage ends here, and no lost executor takes it along.

    The file schema is passed on, so opening it runs no job.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(*columns: str) -> Column:
    """16 bytes that stand for a row in joins: equal for equal values of the columns, nulls told apart from texts."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]
    return F.unhex(F.md5(F.concat_ws("\x1f", *parts)))


def text_slices(texts: Sequence[str | None], most: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of at most ``most`` characters together."""
    low = total = 0
    for i, text in enumerate(texts):
        size = len(text) if text else 0
        if total + size > most and i > low:
            yield low, i
            low, total = i, 0
        total += size
    if low < len(texts):
        yield low, len(texts)


class Cache(dict):
    """Values computed once per key; emptied when it holds ``most`` keys, so a worker's memory stays bounded."""

    def __init__(self, compute, most: int = 150_000, longest: int = 64) -> None:
        super().__init__()
        self.compute, self.most, self.longest = compute, most, longest

    def __reduce__(self):
        return Cache, (self.compute, self.most, self.longest)

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value
