"""The pipeline against a plain version of each stage, on a fixture of driver rows."""

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

import corpus_pipeline
from dittograph.llm import line_crf, piece_codec, quality_rules

from .test_decontaminate import brute as leaked
from .test_jaccard_join import brute as groups

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def done(spark):
    return corpus_pipeline.run(spark, DATA)


def test_run_equals_plain_stages(spark, done):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rejected = {r.doc_id for r in quality_rules.judged(spark.read.parquet(f"{DATA}/documents.parquet"), order=list(quality_rules.RULES)).filter("not keep").collect()}
    docs = [d for d in docs if d[0] not in rejected]
    model = line_crf.train(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))

    def quality(text):
        x, doc, n = line_crf.line_features(pa.array([text]))
        return np.average(line_crf.marginals(x @ model.weights, doc, model), weights=n)

    docs = [d for d in docs if quality(d[1]) >= line_crf.THRESHOLD]
    gone = {i for i, rep in groups(docs) if i != rep}
    docs = [d for d in docs if d[0] not in gone]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    near = [d for d in docs if any(set(" ".join(d[1].lower().split()).split()) & set(t.lower().split()) for _, t in items)]
    bad = {x[0] for x in leaked(near, items)}
    docs = [d for d in docs if d[0] not in bad]
    library = sentencepiece.SentencePieceProcessor(model_file=piece_codec.MODEL)
    assert {r.doc_id: r.ids for r in done.collect()} == {i: library.encode(t) for i, t in docs}
    assert all(r.exact for r in done.collect()) and len(docs) > 100


def test_stages_take_odd_rows_and_keep_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    clean = spark.read.parquet(f"{DATA}/documents.parquet").limit(20).collect()
    rows = [tuple(r) for r in clean] + [(None, "A text without an id.", "en", "s", 21), (9001, None, None, None, None), (9002, "", "en", "s", 0), tuple(clean[0])]
    for name, table in (("documents", spark.createDataFrame(rows, schema)), ("empty", spark.createDataFrame([], schema))):
        where = tmp_path / name
        table.write.parquet(str(where / "documents.parquet"))
        spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(str(where / "labels.parquet"))
        spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(str(where / "benchmark.parquet"))
        docs = table
        for stage, f in corpus_pipeline.STAGES[:-1]:
            docs = f(spark, docs, str(where))
            assert docs.columns == table.columns, stage
        out = corpus_pipeline.run(spark, str(where)).collect()
        ids = [r.doc_id for r in out]
        assert not {9001, 9002} & set(ids) and len(set(ids)) == len(ids)
        assert bool(ids) == (name == "documents")

