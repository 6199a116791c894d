"""The pipeline's stages one by one, on the test tables."""

import corpus_pipeline
from curbflow.llm import personal_data
from curbflow.llm.common import table, written


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "test")
        assert docs.columns == columns, name
        seen.append(docs.count())
    assert seen[0] > seen[1] > seen[2] >= seen[3] == seen[4] > seen[0] / 2
    assert personal_data.span_digest(docs).where("n_email + n_ip + n_phone > 0").count() == 0
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert encoded.count() == seen[-1]


def test_run_keeps_what_the_stages_keep(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert rows.where("n_tokens = 0").count() == 0
