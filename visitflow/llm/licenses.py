"""Licences of files: TF-IDF cosine of their statements to templates, then inheritance from ancestor directories.

* Every line of a text is a unit - short licence headers are lines of their own - and so are, for headers over several
  lines: every paragraph, that is the lines between empty ones, the first of which is the head of a file; every run of
  comment lines; every stretch of as many lines as a template of several lines has; and the whole text of a file that is
  named like a licence file. Units and templates are sparse vectors of words, weighted by count times
  ``ln((files + 1) / (files with the word + 1)) + 1``. File counts are taken over all files for the words of templates;
  another word counts as one that no file has, the heaviest weight there is: it can only lower a cosine, so that a unit
  needs a template's words, and few others, to be like it.
* The cosine of a unit with each template needs their common words only. It is at most the length of the template's vector
  over these words, as a share of the whole; so a line counts only when it has a word outside the lightest words of some
  template, which together stay below ``SIMILAR`` of its length. Other lines cannot reach it.
* A unit of ``SIMILAR`` or more states the licence of the most similar template (ties: the lowest name). A file has the
  licence of its most similar unit. A file whose statement is ``SHARE`` or more of its words, or that is named like a
  licence file, is a *licence file* of its directory.
* A file without a statement inherits from the licence files of the nearest directory above it that has one: by joins of
  directories with their ancestors.

Null and empty texts state nothing and inherit. A null path is a file in no directory: it inherits nothing. Files of equal
path and text are alike. Of several licence files in one directory the most similar counts, then the lowest name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitflow.llm.shared import row_key, written

SIMILAR = 0.6
SHARE = 0.25
NAMED = r"(?i)(^|/)(licen[cs]e|copying|notice|copyright)[^/]*$"


COMMENT = r"^\s*(#|//|/?\*|--|;|%|<!--)"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def directory(path: Column) -> Column:
    """The path up to its last slash, empty for a file at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors(folder: Column) -> Column:
    """The directory and all above it, the empty top last."""
    parts = F.array_remove(F.split(folder, "/"), "")
    return F.transform(
        F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )


def units_of(text: Column, heights: Column) -> Column:
    """What is compared with templates: lines, paragraphs, runs of comment lines, stretches of ``heights`` lines."""
    lines = F.split(text, "\n")

    def blocks(whole: Column) -> Column:
        return F.filter(F.split(whole, "\n[ \t\r]*\n"), lambda b: F.contains(b, F.lit("\n")))

    comments = F.array_join(F.transform(lines, lambda x: F.when(x.rlike(COMMENT), x).otherwise(F.lit(""))), "\n")
    stretches = F.flatten(F.transform(F.filter(heights, lambda k: k <= F.size(lines)), lambda k: F.transform(
        F.sequence(F.lit(1), F.size(lines) - k + 1), lambda i: F.array_join(F.slice(lines, i, k), "\n"))))
    return F.concat(lines, blocks(text), blocks(comments), stretches)


def _term_weights(files: DataFrame, templates: DataFrame) -> tuple[DataFrame, Column]:
    """``word, idf, share`` for the words of templates, and the weight of any other word."""
    vocabulary = templates.select(F.explode(words_of(F.col("text"))).alias("word")).distinct()
    listed = vocabulary.agg(F.collect_set("word").alias("words")).scalar()
    held = files.select(F.explode(F.array_intersect(words_of(F.col("text")), F.coalesce(
        listed, F.array().cast("array<string>")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = files.agg(F.count(F.lit(1)).alias("n")).scalar()
    n = F.coalesce(F.col("n"), F.lit(0))
    weights = vocabulary.join(held, "word", "left").select("word", (F.log((total + 1) / (n + 1)) + 1).alias("idf"))
    return weights, F.log(total + F.lit(1.0)) + 1


def statements(files: DataFrame, templates: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``key, license, similarity, words`` of the most similar unit of each file that states a licence.

    ``files``: ``key, path, text``; ``templates``: ``license, text``, a list that is small against any file table.
    """
    weights, other = _term_weights(files, templates)
    weights = written(weights, "term-weights")
    vectors = templates.select("license", F.explode(words_of(F.col("text"))).alias("word")).groupBy(
        "license", "word").agg(F.count(F.lit(1)).alias("n")).join(weights, "word").select(
        "license", "word", (F.col("n") * F.col("idf")).alias("w"))
    lengths = vectors.groupBy("license").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("template_length"))
    # A window over the words of one template, lightest first.
    lightest = Window.partitionBy("license").orderBy("w", "word").rowsBetween(Window.unboundedPreceding, 0)
    heavy = vectors.join(lengths, "license").withColumn("upto", F.sqrt(F.sum(F.col("w") * F.col("w")).over(lightest))).where(
        F.col("upto") >= (similar - 1e-6) * F.col("template_length"))
    needed = F.coalesce(heavy.agg(F.collect_set("word").alias("words")).scalar(), F.array().cast("array<string>"))
    height = F.size(F.split("text", "\n"))
    found = [r["n"] for r in templates.select(height.alias("n")).where("n > 1").distinct().collect()]  # of a short list
    heights = F.array(*map(F.lit, found)).cast("array<int>")
    lines = files.select("key", F.posexplode(units_of(F.col("text"), heights)).alias("unit", "line"))
    whole = files.where(F.col("path").rlike(NAMED)).select("key", F.lit(-1).alias("unit"), F.col("text").alias("line"))
    units = lines.union(whole).select("key", "unit", words_of(F.col("line")).alias("words")).where(
        F.arrays_overlap("words", needed))
    # One row for each different word of the few units that are left, weighed by their count.
    counted = units.select("key", "unit", F.size("words").alias("size"), F.explode("words").alias("word")).groupBy(
        "key", "unit", "size", "word").agg(F.count(F.lit(1)).alias("n")).join(weights, "word", "left").select(
        "key", "unit", "size", "word", (F.col("n") * F.coalesce("idf", other)).alias("u"))
    unit_lengths = counted.groupBy("key", "unit", "size").agg(F.sqrt(F.sum(F.col("u") * F.col("u"))).alias("length"))
    products = counted.join(vectors, "word").groupBy("key", "unit", "license").agg(
        F.sum(F.col("u") * F.col("w")).alias("product"))
    cosine = products.join(unit_lengths, ["key", "unit"]).join(lengths, "license").select(
        "key", "license", "size", F.least(F.lit(1.0), F.round(
            F.col("product") / (F.col("length") * F.col("template_length")), 6)).alias("similarity"),
    ).where(F.col("similarity") >= similar)
    best = cosine.groupBy("key").agg(F.min(F.struct(
        (-F.col("similarity")).alias("rank"), "license", (-F.col("size")).alias("size"))).alias("best"))
    return best.select("key", "best.license", (-F.col("best.rank")).alias("similarity"),
                       (-F.col("best.size")).alias("words"))


def scanned(files: DataFrame, templates: DataFrame, similar: float = SIMILAR, share: float = SHARE) -> DataFrame:
    """``row`` (the given row without its text), ``license``, ``similarity``, ``how`` (stated, inherited, none) and
    ``from_directory``.

    Texts are read for the statements only; what is joined and inherited are keys, directories and names.
    """
    rows = files.select(F.struct("*").alias("row"), row_key("path", "text").alias("key"), "path", "text")
    stated = written(statements(rows.select("key", "path", "text"), templates, similar).distinct(), "statements")
    places = written(rows.select(
        "row", "key", "path", directory(F.col("path")).alias("folder"),
        F.size(words_of(F.coalesce("text", F.lit("")))).alias("size"),
    ).select(F.col("row").dropFields("text").alias("row") if len(files.columns) > 1 else "row", "key", "path", "folder",
             "size"), "places")
    found = written(places.join(stated, "key", "left"), "found")
    files_of = found.where(F.col("license").isNotNull() & F.col("folder").isNotNull() & (
        F.col("path").rlike(NAMED) | (F.col("words") >= share * F.col("size"))))
    named = files_of.groupBy("folder").agg(F.min(F.struct(
        (-F.col("similarity")).alias("rank"), "license")).alias("best")).select(
        F.col("folder").alias("above"), "best.license", (-F.col("best.rank")).alias("similarity"))
    # Each directory once, however many files it holds.
    folders = found.where(F.col("license").isNull() & F.col("folder").isNotNull()).select("folder").distinct()
    nearest = folders.select("folder", F.explode(ancestors(F.col("folder"))).alias("above")).join(named, "above").groupBy(
        "folder").agg(F.max(F.struct(
            F.length("above").alias("depth"), "above", "license", "similarity")).alias("up"))
    own = F.col("license").isNotNull()
    return found.join(nearest, "folder", "left").select(
        "row",
        F.coalesce("license", "up.license").alias("license"),
        F.coalesce("similarity", "up.similarity").alias("similarity"),
        F.when(own, "stated").when(F.col("up").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.when(~own, F.col("up.above")).alias("from_directory"),
    )
