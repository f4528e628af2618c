"""The pipeline against its operators, applied one after the other to what each predecessor kept."""

import corpus_pipeline
from buildlens.llm import leaks, near_dup, pii, quality
from buildlens.llm.common import store, table

FOLDER = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    texts, before = {r.doc_id: r.text for r in docs.collect()}, docs
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = store(stage(spark, before, FOLDER))
        assert after.schema.names == docs.schema.names
        sizes.append(after.count())
        if name == "quality classifier":
            model = quality.fit_documents(docs, table(spark, FOLDER, "labels"))
            import numpy as np
            good = {i for i, t in texts.items() if model.score(np.array([quality.statistics(t)]))[0] >= quality.REJECT_BELOW}
            assert {r.doc_id for r in after.collect()} == good
        if name == "MinHash near-dedup":
            assert {r.doc_id for r in after.collect()} == {r.class_id for r in near_dup.near_duplicates(before).collect()}
        if name == "benchmark decontamination":
            leaked = {r.doc_id for r in leaks.leaks(before, table(spark, FOLDER, "benchmark")).collect()}
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - leaked
        if name == "PII":
            clean = {r.doc_id for r in pii.spans(before).filter("size(base_spans) + size(added_spans) = 0").collect()}
            rows = {r.doc_id: r.text for r in after.collect()}
            assert {i for i, t in rows.items() if t == texts[i]} == clean
        before = after
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2]
    packed = corpus_pipeline.STAGES[-1][1](spark, before, FOLDER)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in before.collect()}


def test_empty_documents(spark):
    docs = table(spark, FOLDER, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, FOLDER))
    assert docs.count() == 0


def test_small_batches(spark):
    session = spark.newSession()
    corpus_pipeline.STAGES[0][1](session, table(session, FOLDER, "documents").limit(0), FOLDER)
    assert int(session.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    assert int(session.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 250
