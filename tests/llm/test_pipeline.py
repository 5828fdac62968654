"""Every stage of the pipeline against a plain version of its decision, on the stage's own input."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

from tests.llm.test_operators import SCHEMA, corpus, plain_components, plain_contamination, plain_fingerprint  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows = corpus(3)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, rows[40][1]), (2, "green hill rain fell slowly home the cat")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)

    def step(name):
        out = spark.createDataFrame(stages[name](spark, docs, folder).collect(), docs.schema)
        assert out.columns == docs.columns
        return out

    before, docs = docs.collect(), step("language")
    after = docs.collect()
    assert {r.text for r in after} == {r.text for r in before if any(c.isalpha() for c in r.text or "")}
    docs = step("exact_copies")
    norm = lambda t: __import__("re").sub(r"[\x20\x09-\x0D]+", " ", t)
    assert len({norm(r.text) for r in docs.collect()}) == len({norm(r.text) for r in after})
    before, docs = docs.collect(), step("near_copies")
    fps = [(r.doc_id, plain_fingerprint(r.text)) for r in before]
    assert sorted({r.doc_id for r in docs.collect()}, key=str) == sorted({d for (d, _), c in zip(fps, plain_components(fps), strict=True) if d == c}, key=str)
    before, docs = docs.collect(), step("benchmark")
    assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before if not plain_contamination(r.text, items)[4]}
    out = stages["encode"](spark, docs, folder)
    assert out.count() == docs.count() and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 10 and corpus_pipeline.ORACLE_SQL is None and [k for k, _ in corpus_pipeline.STAGES]
