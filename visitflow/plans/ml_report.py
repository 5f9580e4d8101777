"""The model report: trains the three models, flags wait anomalies, and writes the results."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from visitflow.operators import charts, learning, stats
from visitflow.plans.report import write_sections
from visitflow.sources.files import keep, read_visits

TOP = 3


def ml_report(visits: DataFrame, **forest) -> tuple[dict[str, DataFrame], list[learning.Trained]]:
    """Section name to frame, and the trained models (whose features the caller releases)."""
    admission = learning.train_admission(visits, **forest)
    score = learning.train_score(visits, **{k: v for k, v in forest.items() if k in ("trees", "depth", "seed")})
    segments = learning.segment(visits)
    report = learning.classification_report(admission.predictions)
    sections = {
        "admission_metrics": admission.metrics,
        "admission_report": report,
        "admission_classes": learning.class_table(report),
        "admission_confusion": learning.confusion(admission.predictions),
        "admission_importances": admission.importances,
        "admission_top_features": admission.importances.limit(TOP),
        "score_metrics": score.metrics,
        "score_importances": score.importances,
        "segments": learning.cluster_table(segments.profiles),
        "segment_scatter": charts.segment_scatter(segments.clustered),
        "wait_anomalies": stats.anomaly_summary(visits),
    }
    return sections, [admission, score]


def main() -> None:
    parser = argparse.ArgumentParser(description="Train the models on a visit table and write their report.")
    parser.add_argument("source")
    parser.add_argument("target")
    parser.add_argument("--source-format", default="csv", choices=["csv", "parquet"])
    parser.add_argument("--format", default="parquet", choices=["csv", "parquet"])
    args = parser.parse_args()
    spark = SparkSession.builder.appName("visitflow-models").getOrCreate()
    # All three models and every section read the table; the source is parsed once.
    visits = keep(read_visits(spark, args.source, args.source_format))
    trained: list[learning.Trained] = []
    try:
        sections, trained = ml_report(visits)
        write_sections(sections, args.target, args.format)
    finally:
        for model in trained:
            model.release()
        visits.unpersist()


if __name__ == "__main__":
    main()
