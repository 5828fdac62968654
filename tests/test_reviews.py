"""Whole rubrics: every check both ways, absent inputs, and verdicts by kind."""

from tracewell.operators import reviews

DRAFT = "doc_id int, history int, headings array<string>, dates array<string>, bullets array<string>, email string, phone string, location string, html string, pages int"
LETTER = "id int, item_id int, addressee string, paragraphs array<string>"


def results(checks, key="doc_id"):
    out = {}
    for r in checks.collect():
        out.setdefault(r[key], {})[r.name] = r.ok
    return out


def test_draft_review(spark):
    good = (1, 2, ["Experience", " Technical  Skills "], ["June 2025 – August 2025", "May 2024 - Present", "Present", ""], ["Cut cost by 40%.", "Wrote tests", "Served 3 teams"], "a@b.c", "1", "NY", "<p>one column</p>", 1)
    bad = (2, 0, ["Where I worked"], ["Summer 2024"], ["Responsible for 3 jobs", "My work", "x" * 241, "y"], " ", "1", None, '<div style="display: flex">', 2)
    month = (3, 1, ["Skills"], ["Aug 2025 – Present"], ["Done in 3 days"], "a@b.c", "1", "x", "", None)
    none = (4, *[None] * 9)
    drafts = spark.createDataFrame([good, bad, month, none], DRAFT)
    checks = reviews.draft_review(drafts, ["doc_id"])
    got = results(checks)
    assert len(got[1]) == 11 and all(got[1].values())
    assert len(got[2]) == 11 and not any(got[2].values())
    assert {k for k, ok in got[3].items() if not ok} == {"dates"} and not {"single_column", "page_budget"} & set(got[3])
    assert {k for k, ok in got[4].items() if not ok} == {"history", "email", "reachable"}
    told = {r.doc_id: (r.passed, r.failed, r.severe, r.ok, r.failures) for r in reviews.verdicts(checks, ["doc_id"]).collect()}
    assert told[1] == (11, 0, 0, True, "") and told[3] == (8, 1, 1, False, "dates") and told[2][1:4] == (11, 6, False)
    assert reviews.draft_review(drafts.limit(0), ["doc_id"]).count() == 0


def test_letter_review(spark):
    long = " ".join(["word"] * 70)
    echo = "Owns the ingestion service from end to end."
    letters = spark.createDataFrame(
        [
            (1, 1, "Hiring Manager", [f"At Northwind I rewrote the job in Python. {long}", f"It took 9 minutes. {long}", f"Then more. {long}"]),
            (2, 1, "To whom it may concern", ["I am writing to apply.", "I delve into synergy.", "I like your innovative team.", f"I wrote: {echo}", "I end."]),
            (3, 2, None, ["I use PostgreSQL and JavaScript.", None, "I mean it."]),
            (4, 9, None, None),
            (5, None, "", [" ", "In Pythons"]),
        ],
        LETTER,
    )
    postings = spark.createDataFrame([(1, "Northwind", [echo, "Python"]), (2, None, None)], "item_id int, company string, qualifications array<string>")
    terms = spark.createDataFrame([(1, 0, "Python"), (1, 1, "Go"), (1, 2, "python"), (1, 3, None)], "item_id int, place int, term string")
    lexicon = spark.createDataFrame([("Python",), ("SQL",)], "term string")
    checks = reviews.letter_review(letters, ["id"], postings, terms, lexicon)
    got = results(checks, "id")
    assert all(len(v) == 12 for v in got.values()) and len(got) == 5
    assert all(got[1].values())
    assert not any(got[2].values())
    assert {k for k, ok in got[3].items() if not ok} == {"length", "paragraphs"}
    assert {k for k, ok in got[4].items() if not ok} == {"opening", "length", "paragraphs", "specifics"}
    assert {k for k, ok in got[5].items() if not ok} == {"opening", "length", "paragraphs", "specifics"}
    told = {r.id: (r.ok, r.severe) for r in reviews.verdicts(checks, ["id"]).collect()}
    assert told == {1: (True, 0), 2: (False, 6), 3: (False, 2), 4: (False, 4), 5: (False, 4)}


def test_first_terms(spark):
    terms = spark.createDataFrame([(1, n, f"t{n:02d}") for n in range(40)] + [(2, 5, "B"), (2, 5, "a"), (2, 1, "b")], "item_id int, place int, term string")
    got = reviews.first_terms(terms)
    assert got.where("item_id = 1").count() == 30 and got.where("item_id = 1").agg({"term": "max"}).first()[0] == "t29"
    assert {r.term for r in reviews.first_terms(terms, 1).where("item_id = 2").collect()} == {"b"}
