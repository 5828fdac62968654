"""Models against plain versions of the same formulas, and rows that are easy to get wrong."""

import collections
import math

import numpy as np
import pytest

from tests.llm.test_operators import SCHEMA, corpus, plain_contamination
from tracewell.llm import decontaminate, language_id, quality, secret_scan


def plain_buckets(text):
    """n-gram buckets one by one, in Python integers."""
    out, letters = [], []
    for c in text or "":
        low = c.lower() if len(c.lower()) == 1 else c
        if c.isalpha():
            letters.append(ord(low))
        elif not letters or letters[-1] != 32:
            letters.append(32)
    for n in range(1, language_id.LONGEST + 1):
        for i in range(len(letters) - n + 1):
            h = 0
            for k in range(n):
                h = (h * 0x01000193 + letters[i + k] + k + 1) & 0xFFFFFFFF
            out.append(((h * 0x9E3779B1) & 0xFFFFFFFF) >> 17)
    return out, any(x != 32 for x in letters)


TEXTS = [None, "", "12 !?", "the water", "über die Straße", "the the THE. water", "\U00030001\U00030002 x", "a" * 9000 + " été", "İstanbul ΟΔΟΣ", "x"]


def test_language_is_plain_naive_bayes():
    rng = np.random.default_rng(3)
    p = rng.random((language_id.BUCKETS, 3)) + 0.01
    model = language_id.LanguageModel(["de", "en", "fr"], np.log([0.5, 0.3, 0.2]), np.log(p / p.sum(0)).astype(np.float32))
    got = model.predict(TEXTS)
    for text, lang, score in zip(TEXTS, *got, strict=True):
        buckets, any_letter = plain_buckets(text)
        if not any_letter:
            assert (lang, score) == ("und", 0.0)
            continue
        total = [model.log_prior[k] + sum(float(model.log_prob[b, k]) for b in buckets) for k in range(3)]
        top = max(total)
        assert lang == model.languages[total.index(top)]
        assert score == pytest.approx(1 / sum(math.exp(t - top) for t in total), rel=1e-6)


def test_language_counts_are_plain_counts(spark):
    rows = [(1, "ab ba", "en"), (1, "ab ba", "en"), (3, "abba", "x"), (4, None, "en"), (5, "", "x")]
    docs = spark.createDataFrame([(*r, "clash", 1.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    model = language_id.train(docs, None)
    for k, lang in enumerate(model.languages):
        n = collections.Counter(b for _, t, x in rows if x == lang for b in plain_buckets(t)[0])
        want = np.full(language_id.BUCKETS, language_id.SMOOTHING)
        for b, c in n.items():
            want[b] += c
        assert np.allclose(model.log_prob[:, k], np.log(want / want.sum()), atol=1e-5)
    out = language_id.language_report(docs).collect()
    assert len(out) == 5 and [tuple(r) for r in out if r.doc_id == 1][0] == [tuple(r) for r in out if r.doc_id == 1][1]


def test_many_languages(spark):
    rows = [(i, chr(0x4E00 + i) * 3, f"l{i:03}") for i in range(300)]
    assert len(language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), None).languages) == 300


def test_quality_forward_is_plain_attention():
    rng = np.random.default_rng(9)
    bags = [quality.passages(t) for t in ("One good sentence. " * 60, "x", None, "a b " * 300)]
    model = quality.MilModel.fresh(np.concatenate(bags))
    model.p = {k: v + rng.normal(0, 0.3, v.shape) for k, v in model.p.items()}
    p = model.p
    sig = lambda v: 1 / (1 + math.exp(-v))
    for bag, got in zip(bags, model.score(bags), strict=True):
        hidden, weight = [], []
        for row in bag:
            x = [min(8, max(-8, (v - m) / s)) for v, m, s in zip(row.tolist(), model.mean.tolist(), model.scale.tolist(), strict=True)]
            h = [math.tanh(sum(x[i] * p["W"][i, j] for i in range(len(x))) + p["b"][j]) for j in range(quality.ENCODED)]
            gate = [math.tanh(sum(h[i] * p["V"][i, j] for i in range(len(h)))) * sig(sum(h[i] * p["U"][i, j] for i in range(len(h)))) for j in range(quality.GATE)]
            hidden.append(h)
            weight.append(math.exp(sum(g * w for g, w in zip(gate, p["w"], strict=True))))
        z = [sum(w * h[j] for w, h in zip(weight, hidden, strict=True)) / sum(weight) for j in range(quality.ENCODED)]
        assert got == pytest.approx(sig(sum(a * b for a, b in zip(z, p["o"], strict=True)) + p["c"][0]), rel=1e-5)


def test_quality_rows_that_repeat_and_clash(spark):
    docs = spark.createDataFrame([(1, "Good text here.", 0.9, 1), (1, "Good text here.", 0.1, 0), (2, "*** !!", None, None), (None, "no id", None, 1), (4, "word " * 30_000, None, 0)], "doc_id long, text string, score double, predicted int")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 6)], "doc_id long, quality int, toxic int")
    out = quality.quality_report(docs, labels).collect()
    assert len(out) == 5 and len({r.score for r in out if r.doc_id == 1}) == 1 and all(0 <= r.score <= 1 for r in out)


def test_secrets_in_odd_rows(spark):
    key = "AKIA" + "Q" * 20
    long = "word " * 200_000 + key
    docs = spark.createDataFrame([(1, key, "x", 5), (1, key, "y", 6), (2, long, None, None), (None, "", None, None), (4, None, None, None)], "doc_id long, text string, spans string, n_hex long")
    out = sorted(map(tuple, secret_scan.secret_report(docs).select("doc_id", "n_access", "spans").collect()), key=str)
    assert [(r[0], r[1]) for r in out] == [(1, 1), (1, 1), (2, 1), (4, 0), (None, 0)]
    assert out[2][2] == f"access:1000000:{1000000 + len(key)}"
    assert secret_scan.secret_report(spark.createDataFrame([], docs.schema)).count() == 0


@pytest.mark.parametrize("table_bytes", [4 << 20, 12])
def test_rows_of_one_id_keep_their_own_hits(spark, monkeypatch, table_bytes):
    monkeypatch.setattr(decontaminate, "TABLE_BYTES", table_bytes)
    texts = ["red blue x", "a red b green c blue d blue green", "nothing here", None]
    items = [("1", "red"), ("2", "blue"), ("3", "green c")]
    docs = spark.createDataFrame([(7, t, [9], "i") for t in texts], "doc_id long, text string, hit_words array<int>, items string")
    bench = spark.createDataFrame([(int(k), t) for k, t in items], "item_id long, text string")
    got = sorted(tuple(r)[1:] for r in decontaminate.contamination_report(docs, bench).collect())
    assert got == sorted(plain_contamination(t, items) for t in texts)
    assert sorted(str(r.text) for r in decontaminate.clean_documents(docs, bench).collect()) == ["None", "nothing here"]


def test_empty_pipeline(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_posteriors_and_codes(spark, tmp_path):
    """The first stage keeps what the model tells with one half or more; the last gives the library's ids."""
    import hashlib

    import corpus_pipeline
    from tests.llm.test_operators import library
    from tracewell.llm.common import table

    spark.createDataFrame(corpus(4), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = table(spark, str(tmp_path), "documents")
    rows, model = docs.collect(), language_id.train(docs)
    langs, scores = model.predict([r.text for r in rows])
    want = collections.Counter((r.doc_id, r.text) for r, x, p in zip(rows, langs, scores, strict=True) if x != "und" and p >= 0.5)
    kept = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == want
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    digest = lambda t: hashlib.sha256(" ".join(map(str, library(t))).encode()).hexdigest()
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in out) == collections.Counter((r.doc_id, len(library(r.text)), digest(r.text)) for r in rows)


def test_hot_pair_of_words_and_null_items(spark):
    """Thousands of windows end in one pair of words: only those of the text's own words are compared; null ids hit too."""
    items = [(f"i{k}", f"w{k} " + " ".join(f"x{k}y{j}" for j in range(7)) + " hot pair") for k in range(20_000)]
    search = decontaminate.WindowSearch(items)
    text = " ".join(f"t{k} hot pair" for k in range(600)) + " " + items[77][1]
    table = search.tables[10]
    compared = []
    plain = decontaminate._Table._to_compare
    decontaminate._Table._to_compare = lambda self, *a: compared.append(r := plain(self, *a)) or r
    try:
        ws, hit, found = search.look(text)
    finally:
        decontaminate._Table._to_compare = plain
    assert found == {"i77"} and sum(hit) == 10 and hit[-10:] == b"\x01" * 10
    assert sum(map(len, compared)) < 20 and not table.buckets.get(b"hot pair")

    same = [(f"j{k}", "a b c d e f g h hot pair") for k in range(50)] + [(None, "a b c d e f g h hot pair"), (None, "red blue"), ("q", "red blue")]
    docs = spark.createDataFrame([(1, "red blue green now"), (2, "a b c d e f g h hot pair " * 300), (3, "red")], "doc_id long, text string")
    bench = spark.createDataFrame(same, "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.contamination_report(docs, bench).collect()}
    assert (got[1].n_hit, got[1].n_items) == (2, 2) and (got[2].n_hit, got[2].n_items) == (3000, 51) and not got[3].contaminated
