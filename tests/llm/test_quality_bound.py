"""The labelled texts that quality is learned from stay within a bound of bytes."""

from tracewell.llm import quality


def test_within():
    assert quality.within([5, 9, 4, 1, 0], 10) == [0, 2, 3, 4]
    assert quality.within([11], 10) == [] and quality.within([], 10) == []


def test_statistics_are_bounded_by_the_text():
    text = "a " * 80 * 50
    assert quality.passages(text).nbytes <= 2.4 * len(text)
    assert all(quality.passages("A b1 é.\x01\t?! Ab " * 40).any(axis=0)[:6])


def test_long_texts_past_the_bound_are_not_learned_from(spark, monkeypatch):
    docs = spark.createDataFrame([(n, ("good plain words. " if n % 2 else "@@@ ### !!! ") * 20) for n in range(40)] + [(90, "x " * 4000), (90, "short"), (91, None), (None, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(n, n % 2) for n in range(40)] + [(90, 1), (91, 0), (91, None), (None, 1)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 6000)
    model = quality.train(docs, labels, None)
    assert model is not None
    got = {r.doc_id: r.predicted for r in quality.score_documents(docs, model).where("doc_id < 40").collect()}
    assert sum(got[n] == n % 2 for n in range(40)) >= 38
    monkeypatch.setattr(quality, "SAMPLE_BYTES", -1)
    assert quality.train(docs, labels, None) is None
