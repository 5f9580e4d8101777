"""Model inputs, models and their metrics, on MLlib.

Features are computed once per training and kept as a table; every fit, fold and metric reads them from there. Splits and
folds come from hash ranks (see ``sampling``), so no training step sorts or collects the visits. Forests are grown in
groves (see ``forests``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import sqrt
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitflow.functions.numeric import half_even, share
from visitflow.operators import lloyd, trees as whole_trees
from visitflow.operators.forests import GROVE, ROW, Forest, Task, grown, majority
from visitflow.operators.quantiles import medians
from visitflow.operators.sampling import cutoffs, first_rank, hash_key, with_fold, with_test_flag
from visitflow.sources.scratch import written

# --- fixed values: features and training settings -----------------------------------------------------------------
CATEGORIES = ("gender", "race", "department_referral", "time_of_day", "day_of_week")
NUMBERS = ("age", "hour", "wait_time")
FEATURES = CATEGORIES + NUMBERS
SEGMENT_FEATURES = ("age", "wait_time", "satisfaction_score_filled", "hour", "is_admitted", "has_referral")
PROFILE_FEATURES = ("age", "wait_time", "satisfaction_score_filled", "is_admitted", "has_referral")

MISSING_LABEL = "nan"  # a missing category is a category of its own, sorted by this text
SEED = 42
TREES = 100
FOLDS = 5
STARTS = 10
SHIFT = 1e-4
# --- end of fixed values ------------------------------------------------------------------------------------------

DEPTH = 30  # the most that MLlib grows: in practice unbounded
LABELLED = 5_000  # visits, those of lowest hash, that the score forest learns from; time and driver memory grow with it


# --- inputs -------------------------------------------------------------------------------------------------------

def fit_medians(visits: DataFrame, columns: Sequence[str], accuracy: float | None = None) -> dict[str, float]:
    """Medians, found in one pass and fetched as one small row, like the fit of any MLlib estimator.

    Exact, or with an error in rank of at most ``accuracy``, for columns of very many values.
    """
    return dict(visits.sparkSession.range(1).select(medians(visits, columns, accuracy).alias("m")).first()["m"])


def impute(visits: DataFrame, columns: Sequence[str], accuracy: float | None = None) -> DataFrame:
    """Columns as doubles, missing values replaced by the median of the column (see :func:`fit_medians`)."""
    middle = fit_medians(visits, columns, accuracy)
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(middle.get(c)).cast("double")) for c in columns}
    return visits.withColumns(filled)


def _labels(visits: DataFrame) -> DataFrame:
    return visits.withColumns({c: F.coalesce(F.col(c), F.lit(MISSING_LABEL)) for c in CATEGORIES})


def label_codes(visits: DataFrame) -> DataFrame:
    """The code of every label: rows of ``(feature, label, code)``, codes from 0 in label order."""
    combinations = _labels(visits).select(*CATEGORIES).distinct()
    labels = combinations.unpivot([], list(CATEGORIES), "feature", "label").distinct()
    # One window row per distinct label, not per visit.
    order = Window.partitionBy("feature").orderBy("label")
    return labels.withColumn("code", F.dense_rank().over(order) - 1)


def fit_features(visits: DataFrame) -> tuple[StringIndexerModel, dict[str, float]]:
    """Encoder of the categories and medians of the numbers, from the value counts of one pass.

    The driver receives one row for each feature.
    """
    texts = _labels(visits).select(*CATEGORIES, *[F.col(c).cast("string").alias(c) for c in NUMBERS])
    counts = texts.unpivot([], [*CATEGORIES, *NUMBERS], "feature", "value").where(
        F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    number = F.col("feature").isin(*NUMBERS)
    rows = counts.groupBy("feature").agg(
        F.sort_array(F.collect_set(F.when(~number, F.col("value")))).alias("labels"),
        F.percentile(F.when(number, F.col("value").try_cast("double")), F.lit(0.5), F.col("n")).alias("m"),
    ).collect()
    found = {r["feature"]: r for r in rows}
    labels = [found[c]["labels"] if c in found else [MISSING_LABEL] for c in CATEGORIES]
    # Every label at least once: the encoder is fitted on this frame, whose rows are bounded by the labels.
    examples = [tuple(own[min(i, len(own) - 1)] for own in labels) for i in range(max(map(len, labels)))]
    frame = visits.sparkSession.createDataFrame(examples, ", ".join(f"{c} string" for c in CATEGORIES))
    encoder = StringIndexer(
        inputCols=list(CATEGORIES), outputCols=[f"{c}_code" for c in CATEGORIES],
        stringOrderType="alphabetAsc", handleInvalid="keep",
    ).fit(frame)
    return encoder, {c: found[c]["m"] if c in found else None for c in NUMBERS}


def feature_matrix(visits: DataFrame, *keep: str) -> tuple[DataFrame, StringIndexerModel]:
    """The eight numeric features (and the columns to keep), with the fitted encoder."""
    encoder, middle = fit_features(visits)
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(middle[c]).cast("double")) for c in NUMBERS}
    coded = encoder.transform(_labels(visits).withColumns(filled))
    codes = [F.col(f"{c}_code").alias(c, metadata=coded.schema[f"{c}_code"].metadata) for c in CATEGORIES]
    return coded.select(*keep, *codes, *NUMBERS), encoder


def nearest(points: DataFrame, centroids: Sequence[Sequence[float]], columns: Sequence[str]) -> DataFrame:
    """Add ``cluster``, the nearest of fixed centroids (ties: the first), and ``distance``, squared, to it."""
    features = [F.col(c).cast("double") for c in columns]
    ranked = [
        F.struct(
            sum(((f - F.lit(float(x))) ** 2 for f, x in zip(features[1:], centre[1:], strict=True)),
                (features[0] - F.lit(float(centre[0]))) ** 2).alias("distance"),
            F.lit(i).alias("cluster"),
        )
        for i, centre in enumerate(centroids)
    ]
    best = F.array_min(F.array(*ranked))
    return points.withColumn("_best", best).withColumns(
        {"cluster": F.col("_best.cluster"), "distance": F.col("_best.distance")}).drop("_best")


def inertia(assigned: DataFrame) -> DataFrame:
    """Within-cluster sum of squares and number of points: one row."""
    return assigned.agg(F.sum("distance").alias("inertia"), F.count(F.lit(1)).alias("visits"))


def _value_counts(visits: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows ``feature, value, n`` of all values of the columns, missing ones too: one pass over the visits."""
    long = visits.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "feature", "value")
    return long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def fit_scale(visits: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float | None, float | None, float | None]]:
    """Median of each column, and mean and population deviation once its missing values are that median.

    All of them come from the value counts of one pass, fetched as one row for each column.
    """
    counts = _value_counts(visits, columns)
    middle = counts.where(F.col("value").isNotNull()).groupBy("feature").agg(
        F.percentile("value", F.lit(0.5), F.col("n")).alias("m"))
    filled = counts.join(F.broadcast(middle), "feature").select(  # one row for each column
        "feature", "m", "n", F.coalesce("value", "m").alias("v"))
    n, v = F.col("n"), F.col("v")
    middle = filled.groupBy("feature").agg((F.sum(n * v) / F.sum(n)).alias("mean"))
    centred = filled.join(F.broadcast(middle), "feature")  # one row for each column, again
    square = F.sum(n * (v - F.col("mean")) ** 2) / F.sum(n)
    rows = centred.groupBy("feature", "m", "mean").agg(F.sqrt(square).alias("std")).collect()
    found = {r["feature"]: (r["m"], r["mean"], r["std"]) for r in rows}
    return {c: found.get(c, (None, None, None)) for c in columns}


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Centre each column and divide by its population deviation; a constant column becomes 0."""
    fitted = df.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns], *[F.stddev_pop(c).alias(f"std_{c}") for c in columns]
    ).first()

    def scaled(c: str) -> Column:
        mean, std = fitted[f"mean_{c}"], fitted[f"std_{c}"]
        return (F.col(c) - F.lit(mean)) / F.lit(std) if std else F.when(F.col(c).isNotNull(), F.lit(0.0))

    return df.withColumns({c: scaled(c) for c in columns})


def segment_features(visits: DataFrame, *keep: str) -> DataFrame:
    """Imputed and standardized segmentation features; a constant column becomes 0."""
    fitted = fit_scale(visits, SEGMENT_FEATURES)

    def scaled(c: str) -> Column:
        middle, mean, std = fitted[c]
        value = F.coalesce(F.col(c).cast("double"), F.lit(middle).cast("double"))
        return (value - F.lit(mean)) / F.lit(std) if std else F.when(value.isNotNull(), F.lit(0.0))

    return visits.withColumns({c: scaled(c) for c in SEGMENT_FEATURES}).select(*keep, *SEGMENT_FEATURES)


# --- metrics on predictions ---------------------------------------------------------------------------------------

def accuracy(predictions: DataFrame) -> DataFrame:
    return predictions.agg(share(F.col("label") == F.col("prediction")).alias("accuracy"))


def _cells(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy(
        F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction")
    ).agg(F.count(F.lit(1)).alias("n"))


def confusion(predictions: DataFrame) -> DataFrame:
    """Rows: true class; columns: predicted class."""
    return (
        _cells(predictions).groupBy("label").pivot("prediction", [0, 1]).agg(F.sum("n"))
        .select(
            "label",
            F.coalesce("0", F.lit(0).cast("bigint")).alias("predicted_0"),
            F.coalesce("1", F.lit(0).cast("bigint")).alias("predicted_1"),
        )
        .orderBy("label")
    )


def classification_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy and the plain and weighted means.

    An undefined ratio is 0. Computed from the at most four cells of the confusion matrix.
    """
    label, prediction, n, cls = F.col("label"), F.col("prediction"), F.col("n"), F.col("class")
    cells = _cells(predictions)

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0))

    hit, guessed, actual = F.col("hit"), F.col("guessed"), F.col("support")
    per_class = (
        cells.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("class"))
        .groupBy("class")
        .agg(
            total((label == cls) & (prediction == cls)).alias("hit"),
            total(prediction == cls).alias("guessed"),
            total(label == cls).cast("bigint").alias("support"),
        )
        .select(
            cls.cast("string").alias("class"),
            F.coalesce(F.try_divide(hit, guessed), F.lit(0.0)).alias("precision"),
            F.coalesce(F.try_divide(hit, actual), F.lit(0.0)).alias("recall"),
            F.coalesce(F.try_divide(2 * hit, guessed + actual), F.lit(0.0)).alias("f1"),
            "support",
            "hit",
        )
    )
    names = ("precision", "recall", "f1")
    size = F.sum("support")
    right = F.try_divide(F.sum("hit"), size)
    overall = per_class.agg(
        F.array(
            F.struct(F.lit("accuracy").alias("class"), *[right.alias(c) for c in names], size.alias("support")),
            F.struct(F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in names], size.alias("support")),
            F.struct(
                F.lit("weighted avg").alias("class"),
                *[F.try_divide(F.sum(F.col(c) * actual), size).alias(c) for c in names],
                size.alias("support"),
            ),
        ).alias("rows")
    ).select(F.inline("rows"))
    return per_class.drop("hit").unionByName(overall)


def class_table(report: DataFrame) -> DataFrame:
    """The report's two classes under their display names, four digits."""
    name = F.when(F.col("class") == "0", "Not Admitted").otherwise("Admitted")
    return report.where(F.col("class").isin("0", "1")).select(
        name.alias("class"), *[half_even(F.col(c), 4).alias(c) for c in ("precision", "recall", "f1")]
    )


def regression_metrics(predictions: DataFrame) -> DataFrame:
    """Mean absolute error and coefficient of determination."""
    error = F.col("label") - F.col("prediction")
    spread = F.var_pop("label") * F.count("label")
    return predictions.agg(
        F.avg(F.abs(error)).alias("mae"), (1 - F.try_divide(F.sum(error * error), spread)).alias("r2")
    )


def importances(model: Forest, df: DataFrame) -> DataFrame:
    """Feature importances, largest first: one row per feature."""
    rows = [(name, float(value)) for name, value in zip(FEATURES, model.featureImportances, strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


# --- models -------------------------------------------------------------------------------------------------------

@dataclass
class Trained:
    """A grown forest with its results as frames; ``data`` are the features, flags and folds of all visits."""

    model: Forest
    encoder: StringIndexerModel
    predictions: DataFrame
    metrics: DataFrame
    importances: DataFrame
    data: DataFrame
    out_of_fold: DataFrame | None = None

    def release(self) -> None:
        """Nothing is held: data and predictions are tables in the shared folder."""


def _assembled(matrix: DataFrame, *keep: str) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(matrix).select(*keep, "features")


def _kept(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Persist training data in one layout, whatever the layout of the input.

    MLlib's bagging and starting points follow partitions and the order in them; the rows are dealt by id to a fixed
    number of partitions (by default that of shuffles) and sorted, so equal rows give equal models.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["patient_id", *(F.col(c).cast("string") for c in df.columns if c != "patient_id")]
    return df.repartition(n, "patient_id").sortWithinPartitions(*order).persist(StorageLevel.MEMORY_AND_DISK)


def _bins(encoder: StringIndexerModel) -> int:
    # Every category value needs a bin of its own, and one is set aside for unseen labels.
    return max(32, max(len(labels) for labels in encoder.labelsArray) + 1)


def _forest_options(encoder: StringIndexerModel, depth: int) -> dict:
    # With the node of every row kept beside it, a level need not send all trees to the tasks.
    return {"maxDepth": depth, "maxBins": _bins(encoder), "maxMemoryInMB": 256, "cacheNodeIds": True}


def fold_scores(predictions: DataFrame) -> DataFrame:
    """``fold`` and the F1 of class 1 in it, from one confusion count of all folds; an undefined F1 is 0."""
    n = {name: F.count_if(F.expr(test)).cast("double") for name, test in (
        ("hit", "label = 1 AND prediction = 1"), ("either", "label = 1"), ("guessed", "prediction = 1"))}
    score = F.coalesce(F.try_divide(2 * n["hit"], n["either"] + n["guessed"]), F.lit(0.0))
    return predictions.groupBy("fold").agg(score.alias("f1"))


def _flagged(features: DataFrame, seed: int, labelled: int | None, folds: int, label: str | None) -> DataFrame:
    """Features with ``row``, ``is_test``, ``is_fit`` (at most ``labelled`` visits; None: all) and ``fold``, as a table.

    All cut-offs are found on features that are persisted first, so the source is not read again.
    """
    kept = features.persist(StorageLevel.MEMORY_AND_DISK)
    data = with_test_flag(kept, seed, label=label)
    if folds:
        data = with_fold(data, label, folds, seed)
    if labelled is None:
        data = data.withColumn("is_fit", F.lit(True))
    else:
        key = hash_key(seed + 1)
        least = cutoffs(data, key, [first_rank(labelled)])[F.lit("all")][0]
        data = data.withColumn("is_fit", F.coalesce(key <= least, F.lit(False)))
    data = written(data.withColumn(ROW, F.monotonically_increasing_id()), "features")
    kept.unpersist()
    return data


def _learned(data: DataFrame, condition: str) -> DataFrame:
    return data.where(f"is_fit AND {condition}").select(ROW, "patient_id", "label", "features")


def train_admission(
    visits: DataFrame, trees: int = TREES, depth: int = DEPTH, folds: int = FOLDS, seed: int = SEED,
    parallelism: int = 2, labelled: int | None = None, grove: int = GROVE, sampled_from: int = whole_trees.SAMPLED_FROM,
) -> Trained:
    """Random forest for ``is_admitted``: stratified 80/20 test, and F1 over stratified folds (``folds=0``: none).

    It learns from all visits of its part (with ``labelled``, from at most so many); predictions and metrics cover all visits
    of the test part, and folds all visits held out. Every fold's held-out visits are predicted by the forest of the others,
    and all F1 come from one count. The groves of the forest and of all folds grow side by side: up to ``sampled_from`` visits
    in MLlib, ``parallelism`` at a time; of more, MLlib would take thresholds from a sample, and each grove grows in a task of
    its own (see ``trees``).
    """
    known = visits.withColumn("label", F.col("is_admitted").cast("int"))
    matrix, encoder = feature_matrix(known, "patient_id", "label")
    data = _flagged(_assembled(matrix, "patient_id", "label"), seed, labelled, folds, "label")
    if data.select("label").distinct().count() < 2:
        raise ValueError("the admission model needs both admitted and not admitted visits")
    columns = (ROW, "patient_id", "label", "features")
    estimator = RandomForestClassifier(**_forest_options(encoder, depth))
    parts = [("NOT is_test", "is_test", folds, True), *[(f"fold <> {f}", f"fold = {f}", f, False) for f in range(folds)]]
    if data.where("is_fit").count() <= sampled_from:
        tasks = [Task(_learned(data, learn), data.where(predict).select(*columns), name, keep)
                 for learn, predict, name, keep in parts]
        forests, votes = grown(estimator, tasks, trees, seed, grove, parallelism)
    else:
        plots = [whole_trees.Plot(f"is_fit AND {learn}", predict, name, keep) for learn, predict, name, keep in parts]
        arity = [len(labels) + 1 for labels in encoder.labelsArray] + [0] * len(NUMBERS)
        forests, votes = whole_trees.grown(estimator, data, plots, ("patient_id", "label"), arity, trees, seed, grove)
    said = written(
        votes.select("patient_id", "label", "forest", majority(F.col("votes")).alias("prediction")), "predictions")
    predictions = said.where(F.col("forest") == folds).select("patient_id", "label", "prediction")
    metrics, out_of_fold = accuracy(predictions), None
    if folds:
        out_of_fold = said.where(F.col("forest") < folds).select(
            "patient_id", "label", "prediction", F.col("forest").alias("fold"))
        # Folds are added in their order, so that equal scores give equal sums.
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("fold", "f1"))), lambda x: x["f1"])
        scores = fold_scores(out_of_fold).agg(ordered.alias("f1"))
        mean = F.aggregate("f1", F.lit(0.0), lambda s, x: s + x) / F.size("f1")
        spread = F.aggregate("f1", F.lit(0.0), lambda s, x: s + (x - F.col("cv_f1_mean")) ** 2) / F.size("f1")
        spread = scores.select("f1", mean.alias("cv_f1_mean")).select("cv_f1_mean", F.sqrt(spread).alias("cv_f1_std"))
        both = F.struct("cv_f1_mean", "cv_f1_std")
        metrics = metrics.withColumn("cv", spread.select(both.alias("cv")).scalar()).select("accuracy", "cv.*")
    return Trained(forests[0], encoder, predictions, metrics, importances(forests[0], data), data, out_of_fold)


def train_score(
    visits: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED, labelled: int = LABELLED,
    parallelism: int = 1, grove: int = GROVE,
) -> Trained:
    """Random forest for the satisfaction score, on scored visits only; plain 80/20 test.

    It learns from at most ``labelled`` visits (``n_fit_samples``, of all ``n_training_samples`` scored ones); predictions
    and metrics cover all visits of the test part.
    """
    rated = visits.where(F.col("satisfaction_score").isNotNull()).withColumn("label", F.col("satisfaction_score"))
    matrix, encoder = feature_matrix(rated, "patient_id", "label")
    data = _flagged(_assembled(matrix, "patient_id", "label"), seed, labelled, 0, None)
    estimator = RandomForestRegressor(featureSubsetStrategy="all", **_forest_options(encoder, depth))
    task = Task(_learned(data, "NOT is_test"), data.where("is_test").select(ROW, "patient_id", "label", "features"))
    forests, votes = grown(estimator, [task], trees, seed, grove, parallelism)
    predictions = written(
        votes.select("patient_id", "label", (F.col("votes")[0] / trees).alias("prediction")), "predictions")
    metrics = regression_metrics(predictions).withColumns({
        "n_training_samples": data.agg(F.count(F.lit(1)).alias("n")).scalar(),
        "n_fit_samples": data.agg(F.count_if(F.expr("is_fit AND NOT is_test")).alias("n")).scalar(),
    })
    return Trained(forests[0], encoder, predictions, metrics, importances(forests[0], data), data)


@dataclass
class Segments:
    """Clustered visits, their profile, and the within-cluster sum of squares."""

    model: KMeansModel
    clustered: DataFrame
    profiles: DataFrame
    inertia: float
    n_clusters: int


def cluster_profiles(clustered: DataFrame) -> DataFrame:
    """Mean of the profile features (two digits) and size per cluster."""
    means = [half_even(F.avg(F.col(c).cast("double"))).alias(c) for c in PROFILE_FEATURES]
    return clustered.groupBy("cluster").agg(*means, F.count(F.lit(1)).alias("size")).orderBy("cluster")


def cluster_table(profiles: DataFrame) -> DataFrame:
    """Cluster profiles under their display names."""
    names = ("cluster", "avg_age", "avg_wait", "avg_satisfaction", "admitted_rate", "referral_rate", "size")
    return profiles.toDF(*names)


def segment(
    visits: DataFrame, n_clusters: int = 4, starts: int = STARTS, seed: int = SEED, parallelism: int = 2
) -> Segments:
    """K-Means on the standardized features: the best of several starts by within-cluster sum of squares.

    A start ends when the centres together move by less than ``SHIFT`` squared; MLlib's tolerance is the distance a
    single centre may move. Iterations run over blocks of points (``solver="block"``): row by row, each of them would
    decode every point again.
    """
    raw = [F.col(c).alias(f"_{c}") for c in SEGMENT_FEATURES]
    scaled = segment_features(visits.select("*", *raw), *visits.drop(*SEGMENT_FEATURES).columns,
                              *[f"_{c}" for c in SEGMENT_FEATURES])
    vectors = VectorAssembler(inputCols=list(SEGMENT_FEATURES), outputCol="features").transform(scaled)
    points = _kept(vectors.select("patient_id", "features"))

    kmeans = KMeans(k=n_clusters, maxIter=300, tol=sqrt(SHIFT / n_clusters), predictionCol="cluster", solver="block")

    def run(start: int) -> KMeansModel:
        return kmeans.copy({kmeans.seed: seed + start}).fit(points)

    with ThreadPool(parallelism) as pool:
        best = min(pool.map(run, range(starts)), key=lambda m: m.summary.trainingCost)
    inertia = best.summary.trainingCost
    points.unpersist()
    original = {c: F.col(f"_{c}") for c in SEGMENT_FEATURES}
    clustered = best.transform(vectors).withColumns(original).select(*visits.columns, "cluster")
    return Segments(best, clustered, cluster_profiles(clustered), inertia, n_clusters)


@dataclass
class FixedSegments:
    """Clustered visits and their profile, from a fit that the rows alone decide."""

    fit: lloyd.Fit
    clustered: DataFrame
    profiles: DataFrame


def segment_from_fixed_starts(
    visits: DataFrame, n_clusters: int = 4, starts: int = STARTS, seed: int = SEED
) -> FixedSegments:
    """K-Means on the standardized features by exact Lloyd steps from visits of lowest hash (see ``lloyd``)."""
    raw = [F.col(c).alias(f"_{c}") for c in SEGMENT_FEATURES]
    rest = visits.drop(*SEGMENT_FEATURES).columns
    points = lloyd.whole(
        segment_features(visits.select("*", *raw), *rest, *[f"_{c}" for c in SEGMENT_FEATURES]), SEGMENT_FEATURES)
    best = lloyd.fit(points.select("patient_id", *SEGMENT_FEATURES), SEGMENT_FEATURES, n_clusters, starts, seed, SHIFT)
    assigned = lloyd.assign(points, SEGMENT_FEATURES, best.centres)
    clustered = assigned.withColumns({c: F.col(f"_{c}") for c in SEGMENT_FEATURES}).select(*visits.columns, "cluster")
    return FixedSegments(best, clustered, cluster_profiles(clustered))


def save_model(trained: Trained, path: str) -> None:
    """Encoder and forest as loadable pipelines, ``path/<grove>``, one for each grove: only one is held at a time."""
    for i, grove in enumerate(trained.model.models()):
        PipelineModel([trained.encoder, grove]).write().overwrite().save(f"{path}/{i}")
