"""Results that hold every row: what earlier forms of the operators left out."""

import hashlib

from tracewell.operators import fit, ground, rubrics


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_echo_of_any_script(spark):
    said = [
        "Это предложение целиком написано кириллицей без единой латинской буквы.",
        "这是一个没有空格的很长的中文句子用来检查在文本里能不能被找到没有空格的句子",
        "Η πρόταση αυτή είναι γραμμένη",
        "Donaudampfschifffahrtsgesellschaft kapitän",
        "the glued sentence begins after a letter",
        "go to the continued word here is enou",
    ]
    texts = [f"Before it. {s} After it." for s in said] + ["x" + said[4] + " tail", said[5] + "gh said they", said[1] + said[1], "nothing of it here at all, not one of the sentences", None]
    sentences = spark.createDataFrame([(s,) for s in said], "sentence string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = rows(rubrics.verbatim_echo(sentences, docs).selectExpr("doc_id", "lower(sentence)"))
    fold = lambda t: (t or "").lower()
    assert got == sorted(((i, fold(s)) for i, t in enumerate(texts) for s in said if fold(s) in fold(t)), key=str)
    assert len(got) == 9


def test_every_entry_is_ranked(spark, tmp_path):
    from tracewell.plans import record_queries as q

    orders = [(c, k, f"1996-{1 + k % 3:02}-{1 + k % 20:02}", "OFP"[k % 3]) for c, n in ((1, 40), (2, 3)) for k in range(n)]
    spark.createDataFrame(orders, "o_custkey long, o_orderkey long, d string, o_orderstatus string").selectExpr("*", "cast(d as date) o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    want = []
    for c in (1, 2):
        mine = sorted(((s == "O", "" if s == "O" else d[:7], d, k) for o, k, d, s in orders if o == c), reverse=True)
        want += [(c, x[3], n + 1) for n, x in enumerate(mine)]
    assert rows(q.ordered_entries(spark, str(tmp_path))) == sorted(want, key=str)
    assert rows(q.newest_entries(spark, str(tmp_path))) == sorted(want, key=str)


def test_every_term_is_merged(spark, tmp_path):
    from tracewell.plans import record_queries as q

    said = [(0, " ".join(f"own{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(50)))]
    docs = [(7, " ".join(f"doc{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(50)) + " ownaa"), (9, "docaa later")]
    spark.createDataFrame(said, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    order = [*said[0][1].split(), *docs[0][1].split()[:50], "later"]
    assert rows(q.all_merged_terms(spark, str(tmp_path))) == sorted(((0, t, n + 1) for n, t in enumerate(order)), key=str)
    assert q.merged_terms(spark, str(tmp_path)).count() == len(order)


def test_support_stays_rows(spark):
    items = spark.createDataFrame([("a", 1, [1]), ("b", 5, [5])], "owner_id string, item_id long, cites array<long>")
    texts = [("a", 1, None, None), *[("a", k, f"é{k}", 1) for k in (3, 2, 100_000)], ("b", 5, "only", None), ("b", 6, "other", None)]
    sources = spark.createDataFrame(texts, "owner_id string, source_id long, text string, parent_id long")
    want = [("a", 1, "é2\né3\né100000"), ("b", 5, "only")]
    got = ground.support_digests(items, sources)
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    held = {"a": [(2, "é2"), (3, "é3"), (100_000, "é100000")], "b": [(5, "only")]}
    assert rows(got) == [(o, i, len(held[o]), len(t), sum(int(md5(f"{k}:{md5(x)}")[:8], 16) for k, x in held[o])) for o, i, t in want]
    none = spark.createDataFrame([("a", 1, [1]), ("a", 2, [7])], "owner_id string, item_id long, cites array<long>")
    assert rows(ground.support_digests(none, sources.where("source_id = 1"))) == [("a", 1, 0, 0, 0)]
    assert "collect" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert rows(ground.supporting_text(items, sources)) == want


def test_support_is_digested_whole(spark):
    items = spark.createDataFrame([("a", 1, [1]), ("b", 5, [5]), ("c", 9, [9])], "owner_id string, item_id long, cites array<long>")
    texts = [("a", 1, None, None), *[("a", k, f"é{k}", 1) for k in (3, 2, 100_000)], ("b", 5, "only", None), ("c", 9, None, None)]
    sources = spark.createDataFrame(texts, "owner_id string, source_id long, text string, parent_id long")
    want = [("a", 1, "é2\né3\né100000"), ("b", 5, "only"), ("c", 9, "")]
    got = ground.support_md5s(items, sources)
    assert rows(got) == [(o, i, len(t), hashlib.md5(t.encode()).hexdigest()) for o, i, t in want]
    assert "collect" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_the_query_digests_texts_in_order(spark, tmp_path):
    from tracewell.plans import record_queries as q

    docs = [(3, "b", "s"), (1, "a\nx", "s"), (2, None, "s"), (4, "", "s"), (7, "z", "t")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want = [("s", 1, "a\nx\nb\n"), ("t", 7, "z")]
    assert rows(q.supporting_text(spark, str(tmp_path)).select("owner_id", "item_id", "n_chars", "digest")) == [(o, i, len(t), hashlib.md5(t.encode()).hexdigest()) for o, i, t in want]


def test_terms_decide_where_named(spark):
    reqs = spark.createDataFrame([(1, 0, ["kafka", "spark", "flink", "aa", "bb", "cc", "dd", "ee"]), (1, 1, ["owns", "kafka"]), (1, 2, ["plain", "words"])], "item_id int, seq int, words array<string>")
    named = spark.createDataFrame([(1, 0, "kafka"), (1, 0, "spark"), (1, 0, "flink"), (1, 1, "kafka")], "item_id int, seq int, term string")
    terms = spark.createDataFrame([("a", "kafka"), ("a", "spark")], "source string, term string")
    words = spark.createDataFrame([("a", "kafka"), ("a", "spark"), ("b", "owns"), ("b", "plain")], "source string, word string")
    assert rows(fit.addressed_by_terms(reqs, named, terms, words)) == [(1, 0, "a", 2, 3, True), (1, 1, "a", 1, 1, True), (1, 2, "b", 1, 2, True)]


def test_merged_terms_keep_numbers_only(spark, tmp_path):
    from tracewell.operators import sets
    from tracewell.plans import record_queries as q

    spark.createDataFrame([(0, "zeta alpha zeta"), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(2, "alpha omega"), (3, "solo"), (4, "omega beta " + "x" * 60), (None, "lost")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = q.all_merged_terms(spark, str(tmp_path))
    assert rows(got) == sorted([(0, "zeta", 1), (0, "alpha", 2), (0, "omega", 3), (0, "beta", 4), (1, "solo", 1), (None, "lost", 1)], key=str)
    # where a term stands first is a number, so that no rows are sorted to find it
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    s = "item_id int, term string, seq int"
    first, extra = spark.createDataFrame([(1, "b", 5), (1, "a", 9), (1, "", 0)], s), spark.createDataFrame([(1, "a", 1), (1, "c", 2), (1, "y" * 60, 3)], s)
    plain = sets.merge_terms(first, extra)
    assert rows(plain) == rows(sets.merge_terms(first, extra, normal=True)) == [(1, "a", 2), (1, "b", 1), (1, "c", 3)]


def test_words_are_those_of_the_normal_form(spark):
    from pyspark.sql import functions as F
    from tracewell.functions import text as T

    said = ["Don’t ‘re-use’ co–op—x−y", "Straße GROẞ a•b‣c▪d·e", "“Quoted”\t\x0b\r\n  text ", "İstanbul Kelvin ΟΔΟΣ Σ'a -x '-y", "", None, "a1b2 3c--d''"]
    df = spark.createDataFrame([(t,) for t in said], "t string")
    norm = T.normalize("t")
    got = df.select(T.words("t"), F.regexp_extract_all(norm, F.lit(r"[a-z][a-z'\-]*"), F.lit(0)), T.runs("t"), F.regexp_extract_all(norm, F.lit("[a-z0-9]+"), F.lit(0)))
    assert all(r[0] == r[1] and r[2] == r[3] for r in got.collect())
    # white space is not collapsed first, which costs more than the words
    assert "regexp_replace" not in df.select(T.words("t"), T.runs("t"))._jdf.queryExecution().optimizedPlan().toString()
