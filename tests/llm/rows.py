"""Small tables that every operator must take: nulls, empty texts, repeated rows and extra columns."""

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EXTRA = ("row", "key", "score", "clean", "verdict", "node", "n_words", "id", "shard")


def documents(spark, texts):
    """Rows from ``(doc_id, text)`` pairs."""
    rows = [(d, t, None if i % 5 == 0 else "en", "src0", None) for i, (d, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd(spark):
    long = " ".join(f"word{i % 977}" for i in range(20_000))
    some = "one two three four five six seven eight nine ten eleven twelve"
    return documents(spark, [
        (1, some), (1, some), (2, None), (3, ""), (4, " \n\t "), (5, long), (None, some), (None, None), (6, "x"),
        (7, some.upper()), (8, "ü" * 50 + "\n" + some),
    ])


def widened(docs):
    """The same rows with columns whose names operators use inside."""
    return docs.withColumns({name: F.lit(name) for name in EXTRA})
