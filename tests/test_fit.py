"""Fit operators on small fixtures."""

from tracewell.operators import fit, rubrics


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_coverage_and_gaps(spark):
    wanted = spark.createDataFrame([(1, "sql"), (1, "go"), (2, "rust")], "item_id int, term string")
    present = spark.createDataFrame([("a", "sql"), ("b", "go"), ("b", "sql")], "source string, term string")
    got = fit.coverage(wanted, present)
    assert rows(got) == [(1, "a", 1, 2, 0.5), (1, "b", 2, 2, 1.0)]
    assert rows(fit.top_owners(got, 1).select("item_id", "source")) == [(1, "b")]
    record = spark.createDataFrame([("a", 7, "sql"), ("a", 5, "sql"), ("a", 5, "go")], "source string, doc_id int, term string")
    draft = spark.createDataFrame([("a", "go")], "source string, term string")
    assert rows(fit.gaps(wanted, draft, record)) == [(1, "a", "sql", 5)]


def test_requirements(spark):
    postings = spark.createDataFrame([(1, "Owns a billing service. Writes tests!\nThe and of."), (2, None)], "item_id int, text string")
    reqs = fit.requirements(postings)
    assert rows(reqs) == [(1, 0, ["owns", "billing", "service"]), (1, 1, ["writes", "tests"]), (1, 2, [])]
    met = fit.addressed(reqs, spark.createDataFrame([("a", "billing"), ("a", "tests")], "source string, word string"))
    assert rows(met.select("seq", "hits", "addressed")) == [(0, 1, False), (1, 1, True)]
    assert rows(fit.qualification_score(reqs, met)) == [(1, "a", 2, 3, 0.666667)]


def test_stuffing(spark):
    counts = spark.createDataFrame([(1, "sql", 4), (1, "go", 3), (2, "sql", 4)], "doc_id int, term string, n int")
    bullets = spark.createDataFrame([(1, 2), (2, 10)], "doc_id int, bullets int")
    assert rows(fit.stuffing(counts, bullets)) == [(1, 1, 0.1), (2, 0, 0.0)]


def test_round_trip_and_echo(spark):
    texts = spark.createDataFrame([(1, "A long hyphen-\nated sentence that is quite plain to see."), (2, None)], "doc_id int, text string")
    items = spark.createDataFrame([(1, "hyphenated sentence"), (1, "not there"), (2, "x")], "doc_id int, item string")
    assert rows(rubrics.round_trip(items, texts)) == [(1, 2, 1), (2, 1, 1)]
    said = spark.createDataFrame([("sentence that is quite plain to see.",), ("short",)], "sentence string")
    assert rows(rubrics.verbatim_echo(said, texts)) == [(1, "sentence that is quite plain to see.")]
