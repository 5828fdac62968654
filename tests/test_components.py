"""Score components, figures and certificates of the gate, and the joins that leave texts where they are."""

from pyspark.sql import functions as F

from tracewell.operators import fit, ground, mentions, rubrics


def test_mentions_confirm_only_what_is_doubtful(spark):
    texts = spark.createDataFrame([(1, "We use C++ and node js daily."), (2, "Nodejs, c"), (3, None), (None, "SQLs in node.js"), (1, "sql")], "doc_id int, text string")
    terms = spark.createDataFrame([("C++",), ("Node.js",), ("SQL",), ("++",), (None,)], "term string")
    assert {tuple(r) for r in mentions.mentions(texts, terms).collect()} == {(1, "c++"), (1, "node.js"), (2, "node.js"), (None, "node.js"), (None, "sql"), (1, "sql")}
    plain = mentions.mentions(texts, terms.where("term = 'SQL'"))
    assert {tuple(r) for r in plain.collect()} == {(None, "sql"), (1, "sql")}
    assert mentions.mentions(texts.limit(0), terms).count() == 0


def test_round_trip_rows(spark):
    rows = [(1, "A long hyphen-\nated word.", ["hyphenated", "lost"]), (2, None, ["x", ""]), (3, "y", []), (4, "y", None), (5, "Has it", ["has it", None])]
    got = rubrics.round_trip_rows(spark.createDataFrame(rows, "doc_id int, text string, items array<string>"), F.col("items"))
    assert {tuple(r) for r in got.collect()} == {(1, 2, 1), (2, 2, 1), (5, 2, 0)}


def test_title_fit(spark):
    s = "id int, title string, seniority string, surface string, levels string"
    rows = [(1, "Senior Data Engineer", "senior", "data pipelines", "Staff role"), (2, "Data Engineer", "", "engineer", None), (3, None, "mid", None, None), (4, "Data", "Fellow", "data", "a fellow"), (5, "", None, "x", "x")]
    got = {r.id: (r.overlap, r.title_fit, r.missing_title) for r in fit.title_fit(spark.createDataFrame(rows, s)).collect()}
    assert got == {1: (0.333333, 0.666667, ["engineer", "senior"]), 2: (0.5, 0.5, ["data"]), 3: (1.0, 0.5, []), 4: (1.0, 1.0, []), 5: (1.0, 1.0, [])}


def test_in_context(spark):
    wanted = spark.createDataFrame([(1, "sql"), (1, "go")], "item_id int, term string")
    counts = spark.createDataFrame([(7, "sql", 4), (7, "rust", 9), (8, "sql", 1), (8, "go", 3)], "doc_id int, term string, n int")
    bullets = spark.createDataFrame([(7, 2), (8, 2), (9, 1)], "doc_id int, bullets int")
    dealt = spark.createDataFrame([(7, 1), (8, 1), (9, 1), (10, 2)], "doc_id int, item_id int")
    assert {tuple(r) for r in fit.in_context(wanted, counts, bullets, dealt).collect()} == {(7, 0.45), (8, 1.0), (9, 0.0), (10, 1.0)}


def test_format_share(spark):
    checks = spark.createDataFrame([(1, "a", True), (1, "b", False), (1, "c", True), (2, "a", True)], "doc_id int, name string, ok boolean")
    assert {tuple(r) for r in rubrics.format_share(checks).collect()} == {(1, 0.666667), (2, 1.0)}


def test_figures_and_certificates(spark):
    t = "owner_id string, item_id int, text string"
    items = spark.createDataFrame([("o", 1, "Cut cost by 40% for 3 teams and 12,000 users"), ("o", 2, None)], t)
    support = spark.createDataFrame([("o", 1, "three teams; 40.5 before"), ("o", 1, "8 users")], t)
    ids = ["owner_id", "item_id"]
    bad = ground.unsupported_figures(ground.figure_claims(items, ids), ground.figure_keys(support, ids))
    assert [tuple(r) for r in bad.collect()] == [("o", 1, "12000")]
    listed = spark.createDataFrame([("o", "a"), ("o", "a"), ("o", "b"), ("o", None)], "owner_id string, cited string")
    held = spark.createDataFrame([("o", "a", "certification"), ("o", "b", "job")], "owner_id string, source_id string, kind string")
    assert {tuple(r) for r in ground.unknown_certifications(listed, held).collect()} == {("o", "b"), ("o", None)}


def test_drafts_count_the_words_of_their_posting(spark, tmp_path, monkeypatch):
    from tracewell.plans import text_queries as q

    spark.createDataFrame([(0, "Alpha lead. zulu"), (1, "Bravo lead. yank")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [(0, "alpha alpha bravo yank"), (1, "alpha zulu bravo\nyank yank yank yank"), (2, None)]
    spark.createDataFrame([(d, t, "s") for d, t in texts], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    seen, told = {}, fit.in_context

    def in_context(wanted, counts, *rest):
        seen["counts"] = sorted(tuple(r) for r in counts.collect())
        return told(wanted, counts, *rest)

    monkeypatch.setattr(fit, "in_context", in_context)
    got = {r.doc_id: r.in_context for r in q.draft_components(spark, str(tmp_path)).collect()}
    assert seen["counts"] == [(0, "alpha", 2), (1, "bravo", 1), (1, "yank", 4)]
    assert got == {0: 0.5, 1: 0.9, 2: 0.0}
