"""The pipeline, stage by stage, on small documents."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import line_dedup, mixing

from .cases import documents, frame


def test_stages(spark, tmp_path):
    docs, kept = frame(spark, documents(5, 40)), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        kept.append(docs)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.dtypes == before.dtypes
    language, near, passages, mix, ids = kept
    assert language.filter("text IS NULL OR NOT text RLIKE '\\\\p{L}'").count() == 0
    assert near.count() < language.count()
    assert sorted(map(repr, passages.collect())) != sorted(map(repr, near.collect()))
    assert line_dedup.remove_repeats(passages).agg(F.sum("n_removed")).first()[0] == 0  # nothing is left to remove
    sizes = {r["source"]: r["n"] for r in passages.groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()}
    assert set(sizes) >= {r["source"] for r in mix.select("source").distinct().collect()}
    assert ids.count() == mix.count() and ids.filter("NOT round_trip").count() == 0


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (None, "", None, None, 0)]])
def test_nothing_goes_through(spark, rows):
    docs = frame(spark, rows)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_columns_called_like_made_ones(spark):
    """Stages give back the values that documents brought, whatever their columns are called."""
    names = ["score", "lang_pred", "n_removed", "removed_spans", "size", "target", "copies", "left_text", "_rank", "_same", "_spans", "_gone", "rank", "same", "spans", "a.b", "aside_0", "gone"]
    docs = frame(spark, documents(5, 30)).select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        rows = out.collect()
        assert len(rows) > 10
        for r in rows:
            assert [r[n] for n in names] == [None if r["doc_id"] is None else f"{n}:{r['doc_id']}" for n in names], name
