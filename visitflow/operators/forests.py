"""Forests grown grove by grove.

A forest of deep trees is too large to be grown at once: the driver holds every node of the trees in training, and MLlib
sends them to the tasks at each level. Here a forest is a number of *groves*, forests of ``GROVE`` trees with a seed of
their own. A grove is grown on node ids kept with the rows (``cacheNodeIds``), so that a level sends only the new splits;
then it is saved (a fold's is not) and held until ``TOGETHER`` groves of its forest are grown, whose votes for the rows to
be predicted are added in one pass, which leaves one row for each of them in a table. Up to ``TOGETHER`` groves a forest
needs no shuffle for its votes; of larger forests, the sums of the passes are added by row. The driver holds the groves that
vote (one pass at a time), those that wait and those that grow (``parallelism``), whatever the number of trees, forests and
rows.

A forest learns here from a bounded number of rows (the caller sees to it; ``trees`` grows forests from any number), which lie
in one partition in the order of their values: equal rows give equal groves on every cluster. What is predicted is not bounded
and stays where it is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool
from threading import Lock

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from visitflow.sources.scratch import new_folder

GROVE = 10  # trees that are grown together
TOGETHER = 10  # groves whose votes are taken in one pass
ROW = "row"  # the column that tells the rows of a table apart


@dataclass
class Task:
    """A forest to grow: rows to learn from, and those whose votes are wanted (with the column ``ROW``).

    What else stands beside ``features`` in the rows to predict is kept beside the votes. Without ``keep``, only the votes are left of it.
    """

    learn: DataFrame
    predict: DataFrame
    name: int = 0
    keep: bool = True


@dataclass
class Forest:
    """Groves saved below a folder, with the votes they left."""

    spark: SparkSession
    folder: str
    groves: list[str] = field(default_factory=list)
    trees: list[int] = field(default_factory=list)
    nodes: int = 0
    importances: np.ndarray | None = None

    def models(self) -> Iterator[Model]:
        """The groves, loaded one after another."""
        kinds = {"classifier": RandomForestClassificationModel, "regressor": RandomForestRegressionModel}
        return (kinds[path.rsplit("-", 1)[1]].load(path) for path in self.groves)

    @property
    def featureImportances(self) -> np.ndarray:  # noqa: N802 (as in MLlib)
        total = self.importances.sum()
        return self.importances / total if total else self.importances


def _added(votes: Column) -> Column:
    """The sum, class by class, of an array of votes, in its order."""
    none = F.transform(votes[0], lambda _: F.lit(0.0))
    return F.aggregate(votes, none, lambda s, v: F.zip_with(s, v, lambda a, b: a + b))


def _voted(rows: DataFrame, models: Sequence[Model], sizes: Sequence[int]) -> DataFrame:
    """Rows with ``votes`` instead of features: the sums of all trees' class shares, or of their values, grove by grove."""
    kept, said = [c for c in rows.columns if c != "features"], []
    for g, (model, n) in enumerate(zip(models, sizes, strict=True)):
        if isinstance(model, RandomForestClassificationModel):
            model = model.copy().setRawPredictionCol(f"_{g}").setProbabilityCol("").setPredictionCol("")
            said.append(vector_to_array(F.col(f"_{g}")))
        else:
            model = model.copy().setPredictionCol(f"_{g}")
            said.append(F.array(F.col(f"_{g}") * n))
        rows = model.transform(rows)
    return rows.select(*kept, _added(F.array(*said)).alias("votes"))


def fitted_rows(rows: DataFrame) -> DataFrame:
    """Rows to learn from, in one partition and in an order that their values alone decide. Bounded by the caller."""
    order = [F.col(c).cast("string") for c in rows.columns if c != ROW]
    return rows.repartition(1).sortWithinPartitions(*order).drop(ROW)


def grown(
    estimator: Estimator, tasks: Sequence[Task], trees: int, seed: int, grove: int = GROVE, parallelism: int = 2
) -> tuple[list[Forest], DataFrame]:
    """One forest for each task, and the votes: the kept columns of the rows, ``forest, votes`` (summed over all trees)."""
    spark = tasks[0].learn.sparkSession
    folder = new_folder(spark, "forest")
    sizes = [min(grove, trees - low) for low in range(0, trees, grove)]
    parts = [range(len(sizes))[low:low + TOGETHER] for low in range(0, len(sizes), TOGETHER)]
    forests = [Forest(spark, f"{folder}/{t.name}") for t in tasks]
    learn = [fitted_rows(t.learn).persist() for t in tasks]
    votes = f"{folder}/votes"

    held: dict[tuple[int, int], dict[int, Model]] = {(i, p): {} for i in range(len(tasks)) for p in range(len(parts))}
    holding, voting = Lock(), Lock()

    def vote(i: int, p: int) -> None:
        with voting:
            models = held.pop((i, p))
            said = _voted(tasks[i].predict, [models[g] for g in parts[p]], [sizes[g] for g in parts[p]])
            said.write.mode("overwrite").parquet(f"{votes}/forest={tasks[i].name}/part={p}")

    def grow(job: tuple[int, int, int]) -> tuple[str | None, int, np.ndarray]:
        i, p, g = job
        model = estimator.copy({estimator.numTrees: sizes[g], estimator.seed: seed + g}).fit(learn[i])
        kind = "classifier" if isinstance(model, RandomForestClassificationModel) else "regressor"
        path = f"{forests[i].folder}/grove-{g}-{kind}" if tasks[i].keep else None
        if path:
            model.write().overwrite().save(path)
        with holding:
            held[i, p][g] = model
            last = len(held[i, p]) == len(parts[p])
        if last:
            vote(i, p)
        return path, model.totalNumNodes, model.featureImportances.toArray() * sizes[g]

    jobs = [(i, p, g) for p, own in enumerate(parts) for i in range(len(tasks)) for g in own]
    try:
        with ThreadPool(max(1, min(parallelism, len(jobs)))) as pool:
            results = pool.map(grow, jobs, chunksize=1)
    finally:
        for rows in learn:
            rows.unpersist()
    for (i, _, g), (path, nodes, importance) in zip(jobs, results, strict=True):
        own = forests[i]
        if path:
            own.groves.append(path)
        own.trees.append(sizes[g])
        own.nodes += nodes
        own.importances = importance if own.importances is None else own.importances + importance
    kept = StructType([f for f in tasks[0].predict.schema if f.name != "features"])
    names, schema = kept.names, StructType(kept.fields).add("votes", ArrayType(DoubleType()))
    said = spark.read.schema(schema.add("forest", IntegerType()).add("part", IntegerType())).parquet(votes)
    if len(parts) == 1:
        return forests, said.drop("part")
    # At most one entry for each pass of a row's forest; added in their order, so that sums do not depend on the run.
    each = F.transform(F.array_sort(F.collect_list(F.struct("part", "votes"))), lambda x: x["votes"])
    return forests, said.groupBy(*names, "forest").agg(_added(each).alias("votes"))


def majority(votes: Column) -> Column:
    """The class of most votes, the first of equals."""
    return (F.array_position(votes, F.array_max(votes)) - 1).cast("double")
