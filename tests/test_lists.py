"""Runs listed by folder, posting lists that a model adds to, report views, and sentences searched in slices."""

import json

import pytest
from tracewell.functions import shared
from tracewell.operators import postings, rubrics, scores
from tracewell.sources import imports


def test_runs_listed_by_folder(spark, tmp_path):
    root = tmp_path / "out put"
    for name in ("good", "bad", "typed", "bare", "named"):
        (root / name / "deep").mkdir(parents=True)
    (root / "good" / "run.json").write_text(json.dumps({"run_id": "g", "created_at": "2030-01-02T00:00:00+00:00", "ok": True, "cancelled": True, "mode": "both", "score": {"total": 71.2}}))
    (root / "good" / "b.pdf").write_text("x")
    (root / "named" / "run.json").write_text(json.dumps({"run_id": "n", "created_at": "2031-01-02T00:00:00+00:00", "documents": [{"name": "d", "files": ["z.pdf", "a.pdf"]}, {"name": "e"}]}, indent=1))
    (root / "bad" / "run.json").write_text("{not json")
    (root / "bad" / "deep" / "inner.pdf").write_text("x")
    (root / "typed" / "run.json").write_text('{"run_id": "t", "ok": "perhaps"}')
    (root / "bare" / "B.PDF").write_text("x")
    (root / "bare" / "a.pdf").write_text("x")
    (root / "bare" / "deep" / "run.json").write_text('{"run_id": "inner"}')
    (root / "stray.pdf").write_text("x")
    got = imports.list_runs(spark, str(root)).collect()
    assert [r.run_id for r in got[:2]] == ["n", "g"] and {r.run_id for r in got[2:]} == {"bad", "typed", "bare"}
    by = {r.run_id: r for r in got}
    assert (by["g"].ok, by["g"].cancelled, by["g"].total, by["g"].files, by["g"].legacy) == (True, True, 71.2, ["b.pdf"], False)
    assert by["n"].files == ["a.pdf", "z.pdf"] and not by["n"].ok
    assert by["bare"].files == ["B.PDF", "a.pdf"] and all(by[x].legacy and by[x].total is None for x in ("bad", "typed", "bare"))
    assert by["bad"].files == [] and by["bad"].created_at.endswith("+00:00")


def test_posting_lists(spark):
    heads = spark.createDataFrame([(1, "Data Engineer", "Acme", "", None), (2, None, None, "", 4)], "posting_id int, title string, company string, seniority string, min_years int")
    lists = spark.createDataFrame(
        [(1, "hard_skills", 0, "Python"), (1, "keywords", 0, "python"), (1, "keywords", 1, "Spark"), (1, "qualifications", 0, "Two years of Python"), (2, "responsibilities", 0, "Own it")],
        "posting_id int, kind string, seq int, term string",
    )
    said = {"hard_skills": ["PYTHON", "Go", "", None, "Acme"], "keywords": ["remote", "SQL", "go"], "qualifications": ["3+ years of SQL.", "two years of python", 7], "responsibilities": "not a list"}
    outputs = spark.createDataFrame([(1, json.dumps(said)), (2, "no JSON"), (2, None), (3, '{"keywords": ["x1"]}')], "posting_id int, output string")
    merged = postings.enrich_lists(lists, outputs, heads)
    got = {}
    for r in merged.orderBy("posting_id", "kind", "place").collect():
        got.setdefault((r.posting_id, r.kind), []).append(r.term)
    assert got == {
        (1, "hard_skills"): ["Python", "Go"],
        (1, "keywords"): ["python", "Spark", "Go", "SQL"],
        (1, "qualifications"): ["Two years of Python", "3+ years of SQL", "7"],
        (2, "responsibilities"): ["Own it"],
        (3, "keywords"): ["x1"],
    }
    assert {r.posting_id: r.min_years for r in postings.fewest_years(heads, merged).collect()} == {1: 3, 2: 4}


def test_report_views(spark):
    cols = "doc_id int, item_id int, hard_skills double, qualifications double, title_fit double, keywords_in_context double, format double, total double"
    made = spark.createDataFrame([(1, 1, 1.0, 1.0, 1.0, 1.0, 0.5, 95.0), (2, 1, 0.5, 0.0, 0.0, 0.0, 1.0, 30.0), (3, 2, 0.0, 0.0, 0.0, 0.0, 1.0, 10.0), (4, 3, 0.0, 0.0, 0.0, 0.0, 1.0, 10.0)], cols)
    rows = {(r.doc_id, r.component): (r.weight, r.points) for r in scores.breakdown(made).collect()}
    assert len(rows) == 20 and rows[1, "format"] == (0.1, 5.0) and rows[2, "hard_skills"] == (0.4, 20.0)
    owners = spark.createDataFrame([(n, "s") for n in (1, 2, 3, 4)], "doc_id int, source string")
    best = spark.createDataFrame([(1, "s", 96.0), (2, "s", 40.0)], "item_id int, source string, ceiling double")
    assert {r.doc_id: r.note for r in scores.notes(made, owners, best).collect()} == {1: "reached", 2: "tailoring", 3: "out_of_reach", 4: None}
    drafts = spark.createDataFrame([(1, "Head", None, ["a b", " ", None], ["SQL"]), (2, None, "Sum up", None, None)], "doc_id int, headline string, summary string, bullets array<string>, skills array<string>")
    said = {r.doc_id: (r.searchable, r.running, r.n_words, r.n_bullets) for r in scores.document_texts(drafts).collect()}
    assert said == {1: ("Head\na b\n \nSQL", "a b\n ", 4, 1), 2: ("Sum up", "Sum up", 2, 0)}


@pytest.mark.parametrize("held", [1 << 20, 60])
def test_sentences_searched_in_slices(spark, monkeypatch, held):
    monkeypatch.setattr(rubrics, "SEARCHED_BYTES", held)
    lines = [f"this is sentence number {n} of the posting" for n in range(5)]
    said = spark.createDataFrame([(x,) for x in [*lines, lines[0].upper(), "short", None]], "sentence string")
    texts = spark.createDataFrame([(1, f"{lines[0]} and {lines[3]}"), (2, None), (3, f"{lines[3]}\n{lines[3]}"), (4, lines[4][:-1])], "doc_id int, text string")
    got = {tuple(r) for r in rubrics.verbatim_echo(said, texts).collect()}
    assert got == {(1, lines[0]), (1, lines[3]), (3, lines[3])}
    assert rubrics.verbatim_echo(said.limit(0), texts).count() == 0


def test_no_folder_of_our_own_on_a_cluster(spark):
    class Conf:
        get = staticmethod(lambda key, default: default)

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://somewhere:7077"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session(), "x")
    assert "x-" in shared.shared_folder(spark, "x")
