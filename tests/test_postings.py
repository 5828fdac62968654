"""Postings, feeds, exports, drafts and runs on small fixtures."""

import json

from pyspark.sql import functions as F

from tracewell.operators import postings as X
from tracewell.sources import imports as I

POSTING = """Senior Data Engineer - Remote
About Northwind

- five years of SQL.
What you'll do
* build pipelines
Requirements:
• 3+ years of Python; 2 years of Go
1) own a service end to end
ok
"""


def test_sections_and_headers(spark):
    df = spark.createDataFrame([("p", POSTING), ("q", None), ("r", "Title: Analyst II\nCompany: Acme\n- do things")], "posting_id string, raw string")
    got = [(r.bucket, r.text) for r in X.sections(df).where("posting_id = 'p'").orderBy("seq").collect()]
    assert got == [("requirement", "five years of SQL"), ("responsibility", "build pipelines"), ("requirement", "3+ years of Python; 2 years of Go"), ("requirement", "own a service end to end")]
    heads = {r.posting_id: r for r in X.headers(df).collect()}
    assert (heads["p"].title, heads["p"].company, heads["p"].seniority, heads["p"].min_years) == ("Senior Data Engineer", "Northwind", "senior", 2)
    assert (heads["r"].title, heads["r"].company, heads["r"].seniority, heads["r"].min_years) == ("Analyst II", "Acme", "mid", None)
    assert (heads["q"].title, heads["q"].seniority) == ("", "")
    found = spark.createDataFrame([("p", "sql"), ("p", "python")], "posting_id string, term string")
    row = X.parse_postings(df, found).where("posting_id = 'p'").first()
    assert row.keywords == ["python", "sql"] and len(row.qualifications) == 3


def test_candidate_terms(spark):
    heads = spark.createDataFrame([("p", "Northwind", "Data Engineer")], "posting_id string, company string, title string")
    terms = spark.createDataFrame([("p", t) for t in ("SQL", "remote", "strong SQL", "Northwind Traders", "data engineer", "data platform", "one two three four", "")], "posting_id string, term string")
    assert sorted(r.term for r in X.candidate_terms(terms, heads).collect()) == ["SQL", "data platform"]


def test_enrich_and_phrases(spark):
    heads = spark.createDataFrame([("p", "", "Acme", "", None)], "posting_id string, title string, company string, seniority string, min_years int")
    fields = spark.createDataFrame([("p", 7, "Other", None)], "posting_id string, title int, company string, seniority string")
    assert tuple(X.enrich(heads, fields).first()) == ("p", "7", "Acme", "", None)
    a = spark.createDataFrame([("p", "One thing", 0)], "posting_id string, term string, seq int")
    b = spark.createDataFrame([("p", "one  thing.", 0), ("p", "two", 1), ("p", "x" * 400, 2)], "posting_id string, term string, seq int")
    assert [r.term for r in X.merge_phrases(a, b).orderBy("place").collect()] == ["One thing", "two"]


def test_feeds_and_sitemaps(spark):
    rss = '<rss xmlns:content="urn:c"><channel><title>Site</title><item><title>A &amp; B</title><link>https://h/1</link><description>short</description><content:encoded><![CDATA[<p>long text</p>]]></content:encoded><pubDate>2024-05-06T00:00</pubDate></item></channel></rss>'
    atom = '<feed><entry><title>C</title><link href="https://h/2"/><summary>teaser</summary><updated>2023-01-02</updated></entry></feed>'
    df = spark.createDataFrame([("a", rss), ("b", atom), ("c", "<rss><item><title>x</title>"), ("d", None)], "site string, body string")
    got = {(r.site, r.title, r.link, r.date, r.text) for r in I.parse_feeds(df).collect()}
    assert got == {("a", "A & B", "https://h/1", "2024-05-06", "short"), ("b", "C", "https://h/2", "2023-01-02", "teaser")}
    maps = spark.createDataFrame([("a", "<urlset><url><loc> https://h/1 </loc></url><url><loc>https://h/2</loc></url></urlset>"), ("b", "<urlset><url>")], "site string, body string")
    assert sorted(r.url for r in I.parse_sitemaps(maps).collect()) == ["https://h/1", "https://h/2"]
    routes = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "site string, priority int, url string")
    assert sorted(r.url for r in I.choose_route(routes).collect()) == ["y", "z"]


def test_exports(spark, tmp_path):
    (tmp_path / "Positions.csv").write_text('﻿Notes:\n"a, b"\n\nCompany Name,Title,Started On\n"Acme, Inc.","Line one\nline two",2020\nShort\n,,\n', encoding="utf-8")
    got = {(r.col, r.value) for r in I.read_exports(spark, str(tmp_path)).collect()}
    assert got == {("companyname", "Acme, Inc."), ("title", "Line one\nline two"), ("startedon", "2020"), ("companyname", "Short"), ("title", ""), ("startedon", "")}


def test_drafts(spark):
    good = 'Here it is:\n```json\n{"entries": [{"source_id": "e1", "bullets": [{"text": "did", "source_ids": ["h1"]}, {"text": "more"}]}]}\n```'
    df = spark.createDataFrame([("r", 1, good), ("r", 2, '{"entries": []}'), ("r", 3, "sorry"), ("r", 4, None)], "run_id string, attempt int, output string")
    items, rejects = I.parse_drafts(df)
    assert sorted((r.locator, r.text, r.source_ids) for r in I.locators(items).collect()) == [("e1.bullet1", "did", ["h1"]), ("e1.bullet2", "more", [])]
    assert sorted(r.attempt for r in rejects.collect()) == [2, 3, 4]


def test_runs(spark, tmp_path):
    for name, body in (("a", json.dumps({"run_id": "a", "created_at": "2024-01-02", "ok": True, "score": {"total": 71.2}, "documents": [{"files": ["b", "a"]}]})), ("b", "{broken"), ("c", json.dumps({"run_id": "c", "created_at": "2024-02-02"}))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "run.json").write_text(body)
    got = I.read_runs(spark, str(tmp_path)).collect()
    assert [(r.run_id, r.total, r.files, r.legacy) for r in got] == [("c", None, [], False), ("a", 71.2, ["a", "b"], False), (None, None, [], True)]
    I.write_runs(spark.createDataFrame([("x", "2024-03-04T05:06")], "run_id string, created_at string"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().run_id == "x"
    I.write_evidence(spark.createDataFrame([("e",)], "source_id string"), str(tmp_path / "ev"))
    assert spark.read.parquet(str(tmp_path / "ev")).where(F.col("generated_at").isNotNull()).count() == 1
