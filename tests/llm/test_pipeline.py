import corpus_pipeline
import rows
from pyspark.sql import functions as F

from visitflow.llm import decontaminate
from visitflow.llm.shared import table


def test_stages_keep_the_columns_and_take_effect(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, counts = docs.columns, [docs.count()]
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, sf_dir).persist()
        assert docs.columns == columns
        counts.append(docs.count())
        if i == 1:
            assert docs.where("text IS NOT NULL AND n_chars <> length(text)").count() == 0
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    left = decontaminate.matched(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0").count()
    assert left == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_every_stage_takes_odd_rows_and_empty_tables(spark, sf_dir):
    strange = rows.widened(rows.odd(spark))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, strange, sf_dir)
        if name != "packing":
            assert out.columns == strange.columns
        assert out.count() > 0
        assert stage(spark, strange.limit(0), sf_dir).count() == 0
    short = strange.where(F.col("doc_id") == 6)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert [r["text"] for r in stage(spark, short, sf_dir).collect()] == ["x"], name
