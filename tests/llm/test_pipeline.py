"""Every stage passes on the columns of documents, whatever the rows; the whole runs on the smallest tables."""

import os

import pytest

import corpus_pipeline
from readwindows.llm import stages

from .cases import labels, no_docs, odd_docs

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    odd_docs(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    labels(spark).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name,function", corpus_pipeline.STAGES[:-1])
def test_stage_on_odd_and_no_rows(spark, tables, name, function):
    for docs in (odd_docs(spark), no_docs(spark)):
        out = function(spark, docs, tables)
        assert out.columns == docs.columns
        assert out.count() <= docs.count()


def test_mixing_stage(spark, tables):
    assert stages.mixing(spark, no_docs(spark), tables).count() == 0
    docs = odd_docs(spark)
    out = stages.mixing(spark, docs, tables)
    assert set(out.columns) == {*docs.columns, "size", "source_size", "target", "taken"}
    texts = lambda df: sorted(map(repr, df.select("doc_id", "text", "lang", "n_chars").collect()))
    assert texts(out) == texts(docs)
    assert all(0 <= r.taken <= 2 * r.size and r.size == len((r.text or "").split()) for r in out.collect())


def test_all_stages_on_odd_rows(spark, tables):
    rows = corpus_pipeline.run(spark, tables).collect()
    known = {repr((r.doc_id, r.text)) for r in odd_docs(spark).collect()}
    assert 0 < len(rows) <= odd_docs(spark).count() and {repr((r.doc_id, r.text)) for r in rows} <= known


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_run(spark):
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    ids = [r.doc_id for r in rows]
    assert len(ids) == len(set(ids)) > 100 and all(r.taken <= 2 * r.size for r in rows)
