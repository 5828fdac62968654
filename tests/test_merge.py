"""Record texts and merging two records."""

from tracewell.operators import merge as M
from tracewell.sources import resumes as R

TEXT = """Ada Brown
ada@x.org | 555-123-4567 | Brooklyn, NY

EXPERIENCE
Acme, Inc. | Data Engineer
June 2020 – Present
• built pipelines that move a great many rows from one place to the next
and a wrapped end
Designer | Studio Nord | Oslo, Norway
- drew things
2018 - 2019
Skills
Languages: Python, Go; SQL
Docker
"""


def test_resume_blocks(spark):
    lines = R.clean_lines(spark.createDataFrame([(1, TEXT), (2, None), (3, "no headings here")], "doc_id int, text string")).cache()
    c = {r.doc_id: r for r in R.contacts(lines).collect()}
    assert (c[1].name, c[1].email, c[1].phone, c[1].location) == ("Ada Brown", "ada@x.org", "555-123-4567", "Brooklyn, NY")
    assert c[3].name == "no headings here" and 2 not in c
    blocks = R.resume_blocks(lines)
    got = [tuple(r) for r in R.experience_entries(blocks).orderBy("block").collect()]
    assert got[0] == (1, 0, "Acme, Inc.", "Data Engineer", "", "June 2020", "Present", ["built pipelines that move a great many rows from one place to the next and a wrapped end"])
    assert got[1] == (1, 1, "Studio Nord", "Designer", "Oslo, Norway", "2018", "2019", ["drew things"])
    assert sorted((r.category, r.skill) for r in R.skill_lines(blocks).collect()) == [("Languages", "Go"), ("Languages", "Python"), ("Languages", "SQL"), ("Skills", "Docker")]


def test_match_and_highlights(spark):
    s = "owner_id string, entry_id string, seq int, name string"
    a = spark.createDataFrame([("o", "s1", 1, "Acme, Inc."), ("o", "s2", 2, "Acme"), ("o", "s3", 3, None)], s)
    b = spark.createDataFrame([("o", "d1", 1, "Acme Corporation Europe"), ("o", "d2", 2, "Acme"), ("o", "d3", 3, "Zed"), ("p", "d9", 1, "Acme")], s)
    matches = M.match_entries(a, b)
    assert sorted(map(tuple, matches.collect()), key=str) == sorted([("o", "s1", "d1"), ("o", "s2", "d2"), ("o", "s3", None), ("o", None, "d3"), ("p", None, "d9")], key=str)
    h = spark.createDataFrame([("o", "skeleton", "s1", 1, "old"), ("o", "detail", "d1", 5, "b"), ("o", "detail", "d1", 2, "a"), ("o", "skeleton", "s2", 1, "kept")], "owner_id string, side string, entry_id string, n int, text string")
    assert sorted(map(tuple, M.merge_highlights(matches, h).collect())) == [("o", "s1", 1, "a"), ("o", "s1", 2, "b"), ("o", "s2", 1, "kept")]


def test_basics_links_skills(spark):
    f = "owner_id string, name string, headline string, summary string, email string, phone string, location string"
    a = spark.createDataFrame([("o", "TODO your name", "h", "", None, "1", "")], f)
    b = spark.createDataFrame([("o", "Ada", "x", "s", "e", "2", None), ("p", "Bob", "", "", "", "", "")], f)
    got = {r.owner_id: tuple(r) for r in M.merge_basics(a, b).collect()}
    assert got["o"] == ("o", "Ada", "h", "s", "e", "1", "") and got["p"][1] == "Bob"
    u = "owner_id string, label string, url string"
    links = M.merge_links(spark.createDataFrame([("o", "a", "https://X/"), ("o", "b", "https://y")], u), spark.createDataFrame([("o", "c", "https://x")], u))
    assert sorted(r.label for r in links.collect()) == ["b", "c"]
    k = "owner_id string, category string, skill string"
    skills = M.merge_skills(spark.createDataFrame([("o", "x", "sql"), ("o", "x", "Rust")], k), spark.createDataFrame([("o", "Data", "SQL")], k))
    assert sorted((r.category, r.skill) for r in skills.collect()) == [("Data", "SQL"), ("Skills", "Rust")]
    d = M.distinct_skills(spark.createDataFrame([("o", 2, "sql"), ("o", 1, " SQL "), ("o", 3, None)], "owner_id string, seq int, skill string"))
    assert [r.skill for r in d.collect()] == ["SQL"]


def test_audit_and_current_copy(spark, tmp_path):
    from tracewell.sources.pages import read_profiles

    (tmp_path / "p.json").write_text('{"owner_id": "o", "basics": {"name": "TODO x", "email": "e"}, "experience": [{"id": "e1", "company": "TODO", "start": ""}]}')
    profiles, _ = read_profiles(spark, str(tmp_path / "p.json"))
    got = {(r.subject, r.problem) for r in M.audit(profiles).collect()}
    assert got == {("basics.name", "not set"), ("basics.phone", "empty"), ("basics.location", "empty"), ("skills", "empty"), ("e1", "name needs checking"), ("e1", "no bullets"), ("e1", "no start date")}
    entries = spark.createDataFrame([("o", "e1", "ACME"), ("o", "e2", "Zed")], "owner_id string, entry_id string, company string")
    high = spark.createDataFrame([("o", "e1", 2, "b"), ("o", "e1", 1, "a")], "owner_id string, entry_id string, n int, text string")
    out = spark.createDataFrame([("o", "acme", "live text")], "owner_id string, company string, text string")
    assert {r.entry_id: r["copy"] for r in M.current_copy(entries, out, high).collect()} == {"e1": "live text", "e2": ""}
    assert {r.entry_id: r["copy"] for r in M.current_copy(entries, None, high).collect()} == {"e1": "a\nb", "e2": ""}
