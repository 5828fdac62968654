"""Gate, runs, pages, sets and streams on small fixtures."""

import json

from pyspark.sql import functions as F

from tracewell.operators import fit, ground, rubrics, runs, sets
from tracewell.sources import pages as P
from tracewell.streaming import stages


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


SOURCES = "owner_id string, source_id string, kind string, text string, parent_id string"


def sources(spark):
    return spark.createDataFrame([("a", "e1", "experience", "Engineer, X", None), ("a", "h1", "highlight", "cut cost 40%", "e1"), ("a", "e2", "experience", "Lead, Y", None), ("b", "e1", "experience", "Other", None)], SOURCES)


def test_citations(spark):
    items = spark.createDataFrame([("a", 1, "e1", ["h1"]), ("a", 2, "e1", ["e2", "zz"]), ("b", 1, "e1", ["h1"]), ("a", 3, "e1", [])], "owner_id string, item_id int, entry_id string, cites array<string>")
    assert rows(ground.unknown_citations(items, sources(spark)).select("owner_id", "item_id", "source_id")) == [("a", 2, "zz"), ("b", 1, "h1")]
    assert rows(ground.misattributed(items, sources(spark), ("experience", "highlight"))) == [("a", 2, "e2")]
    assert rows(ground.supporting_text(items.where("owner_id = 'a' and item_id = 2").withColumn("cites", F.array(F.lit("e1"))), sources(spark))) == [("a", 2, "Engineer, X\ncut cost 40%")]


def test_first_failure_and_cut(spark):
    bad = spark.createDataFrame([("a", 1, 2, "term"), ("a", 1, 1, "citation"), ("a", 2, 3, "figure")], "owner_id string, item_id int, level int, kind string")
    assert rows(ground.first_failures(bad).select("item_id", "kind")) == [(1, "citation"), (2, "figure")]
    items = spark.createDataFrame([("a", 1), ("a", 3)], "owner_id string, item_id int")
    assert rows(ground.cut(items, bad)) == [("a", 3)]


def test_scores(spark):
    """The weighted total of given components, to one decimal."""
    df = spark.createDataFrame([(2 / 3, 0.5, 0.6667, 2 / 3, 1.0)], "h double, q double, t double, k double, f double")
    total = df.select(fit.weighted(hard_skills=F.col("h"), qualifications=F.col("q"), title_fit=F.col("t"), keywords_in_context=F.col("k"), format=F.col("f")).alias("x")).first().x
    assert total == round(40 * 2 / 3 + 7.5 + 15 * 0.6667 + 20 * 2 / 3 + 10, 1)


def test_best_and_stop(spark):
    a = spark.createDataFrame([("r", 1, True, True, 60.0, False, 75.0), ("r", 2, True, True, 60.5, False, 75.0), ("r", 3, False, True, 90.0, False, 75.0), ("s", 1, True, False, 85.0, False, 90.0), ("s", 2, True, True, 85.0, True, 90.0)], "run_id string, attempt int, grounded boolean, parses boolean, total double, repaired boolean, ceiling double")
    assert rows(runs.best_attempt(a).select("run_id", "attempt")) == [("r", 2), ("s", 2)]
    assert rows(runs.stop_reasons(a).select("run_id", "attempt", "reason")) == [("r", 1, None), ("r", 2, "plateau"), ("r", 3, "threshold"), ("s", 1, None), ("s", 2, "threshold")]
    assert rows(runs.run_outcomes(runs.stop_reasons(a)).select("run_id", "used", "reason", "met")) == [("r", 2, "plateau", True), ("s", 2, "threshold", True)]


def test_usage_counts_missing_as_zero(spark):
    calls = spark.createDataFrame([("r", 5.0, None), ("r", None, 1.5), ("s", 1.0, 1.0)], "run_id string, tokens double, seconds double")
    assert rows(runs.usage(calls)) == sorted([("r", 2, 5.0, 1.5), ("s", 1, 1.0, 1.0), (None, 3, 6.0, 2.5)], key=str)


def test_months_and_ids(spark):
    df = spark.createDataFrame([("2024-03", ""), ("", "2023-12-05"), ("Summer", None)], "a string, b string")
    assert [r.x for r in df.select(sets.month_range(F.col("a"), F.col("b")).alias("x")).collect()] == ["March 2024 – Present", "December 2023", "Summer – Present"]
    e = spark.createDataFrame([("o", "Big Co.", 1), ("o", "big co", 2), ("o", "--", 3), ("p", "Big Co", 1)], "owner string, name string, n int")
    assert rows(sets.assign_ids(e, "owner", "name", "n").select("owner", "n", "assigned_id")) == [("o", 1, "big-co"), ("o", 2, "big-co-2"), ("o", 3, "item"), ("p", 1, "big-co")]


def test_drift_keeps_repeats(spark):
    a = spark.createDataFrame([("e", "x"), ("e", "x"), ("e", "y")], "entry string, line string")
    b = spark.createDataFrame([("e", "x"), ("e", "z")], "entry string, line string")
    assert rows(sets.drift(a, b, ["entry"])) == sorted([("e", "x", "removed"), ("e", "y", "removed"), ("e", "z", "added"), ("e", "x", "kept")], key=str)


def test_posts_and_chunks(spark):
    html = '<html><title>T</title><script>x="</p>"</script><article><h1>A &amp; B</h1><p>one two three four five six seven eight</p><p>few</p></article></html>'
    pages = spark.createDataFrame([(1, "https://h.org/2024/05/x", html), (2, "https://h.org/y", None)], "page_id int, url string, html string")
    got = {r.page_id: r for r in P.extract_posts(pages).collect()}
    assert (got[1].title, got[1].date) == ("A & B", "2024-05") and "script" not in got[1].text and got[2].text == ""
    long = "\n".join(" ".join(["word"] * 60) for _ in range(5))
    chunks = P.chunk_texts(spark.createDataFrame([(1, long), (2, None), (3, "too few words")], "doc_id int, text string")).collect()
    assert [c.doc_id for c in chunks] == [1] * len(chunks) and "\n".join(c.chunk for c in sorted(chunks, key=lambda c: c.n)) == long and all(len(c.chunk) <= 700 for c in chunks)


def test_links(spark):
    html = '<a href="/a">x</a><a href="/a#q">y</a><a href="https://h.org/b">z</a><a href="https://h.org.evil/b">w</a><a href="mailto:x@y">m</a>'
    got = rows(P.discover_links(spark.createDataFrame([(1, "https://h.org/p", html)], "page_id int, url string, html string")).select("link"))
    assert got == [("https://h.org/a",), ("https://h.org/b",)]


def test_profiles(spark, tmp_path):
    good = {"owner_id": "o", "experience": [{"id": "e1", "title": "Engineer", "company": "X", "start": "2020-01", "end": "", "highlights": [{"id": "h1", "text": "built", "skills": ["SQL"]}]}], "skills": {"data": ["SQL", "Spark"]}, "certifications": [{"id": "c1", "name": "Cert", "issuer": None, "date": None}]}
    (tmp_path / "p.json").write_text(json.dumps(good) + "\n{broken\n" + json.dumps({"skills": {}}) + "\n")
    profiles, rejects = P.read_profiles(spark, str(tmp_path / "p.json"))
    assert profiles.count() == 1 and rejects.count() == 2
    got = {r.source_id: r for r in P.build_sources(profiles).collect()}
    assert set(got) == {"e1", "h1", "c1", "skills"} and got["h1"].parent_id == "e1" and got["h1"].text == "Engineer, X\nbuilt" and got["skills"].skills == ["SQL", "Spark"]


def test_postings_survive_bad_bytes(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"caf\xe9 wanted\nline")
    assert "wanted\nline" in P.read_postings(spark, str(tmp_path)).first().raw


def test_letter_rubric(spark):
    bad = "I am writing to apply. I delve into synergy at your esteemed firm."
    good = "\n".join(" ".join(["solid"] * 70) + " 40 cases." for _ in range(3))
    got = {(r.id, r.name): r.ok for r in rubrics.letter_rubric(spark.createDataFrame([(1, bad), (2, good), (3, None)], "id int, text string"), ["id"]).collect()}
    assert not any(got[1, k] for k in ("opening", "length", "paragraphs", "specifics", "plain_words", "no_cliche", "no_flattery", "varied_openings"))
    assert all(v for (i, _), v in got.items() if i == 2)


def test_text_layer(spark):
    df = spark.createDataFrame([(1, "eﬃcient"), (2, "S K I L L S"), (3, "U S A"), (4, "")], "doc_id int, text string")
    got = {(r.doc_id, r.name) for r in rubrics.text_layer_rubric(df).where("not ok").collect()}
    assert got == {(1, "no_ligatures"), (2, "no_spaced_letters"), (4, "no_private_use")}


def test_gate_stream(spark, tmp_path):
    spark.createDataFrame([("a", 1, ["h1", "zz"])], "owner_id string, item_id int, cites array<string>").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("owner_id string, item_id int, cites array<string>").parquet(str(tmp_path / "in"))
    got = stages.run_to_table(stages.gate_stream(stream, sources(spark)), "gate_rows", str(tmp_path / "state"), "append")
    assert rows(got.select("source_id", "known")) == [("h1", True), ("zz", False)]
