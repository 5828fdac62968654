"""Scores on all components: known totals of an example record, ceilings, gaps, feedback, and odd inputs."""

import pytest

from tracewell.operators import scores
from tracewell.plans import score_queries

DRAFT = "doc_id string, item_id int, source string, headline string, summary string, bullets array<string>, skills array<string>, titles array<string>, format double"
HEAD = "Backend engineer — data pipelines"
TITLES = ["Backend Engineer Intern", "Backend engineer — data pipelines, Python, Postgres"]
PYTHON = "Rewrote the nightly ingestion job in Python as an asyncio worker pool, cutting the run from 51 minutes to 9."
NO_PYTHON = "Rewrote the nightly ingestion job as an asyncio worker pool, cutting the run from 51 minutes to 9."
FEEDS = "Added contract tests across the 14 upstream PostgreSQL feeds, catching 3 silent schema changes."
NO_FEEDS = "Added contract tests across the 14 upstream feeds, catching 3 silent schema changes."
TIDES = "Packed 40 years of NOAA harmonic constants into a 6 MB SQLite file."
COURSES = "Coursework: Databases, Operating Systems."
SKILLS = ["Python", "SQL", "PostgreSQL", "SQLite"]


@pytest.fixture(scope="module")
def posted(spark):
    terms = ["python", "postgresql", "kubernetes"]
    postings = spark.createDataFrame([(1, "Backend Engineer, Data Platform", "")], "item_id int, title string, seniority string")
    wanted = spark.createDataFrame([(1, kind, t) for kind in ("hard", "keyword") for t in terms], "item_id int, kind string, term string")
    quals = spark.createDataFrame([(1, 0, "Production Python"), (1, 1, "Strong PostgreSQL"), (1, 2, "Kubernetes in production")], "item_id int, seq int, text string")
    lexicon = spark.createDataFrame([(t,) for t in [*terms, "SQL", "SQLite", "asyncio"]], "term string")
    record = spark.createDataFrame(
        [("me", "h1", f"{NO_PYTHON} Python asyncio PostgreSQL"), ("me", "h2", f"{NO_FEEDS} pytest CI"), ("me", "p1", f"{TIDES} Python SQLite"), ("me", "e1", None), ("me", "basics", f"{TITLES[1]} {' '.join(SKILLS)}")],
        "source string, doc_id string, text string",
    )
    held = spark.createDataFrame([("me", t) for t in TITLES], "source string, title string")
    drafts = spark.createDataFrame(
        [
            ("honest", 1, "me", HEAD, "", [PYTHON, FEEDS, TIDES, COURSES], SKILLS, TITLES, 1.0),
            ("titled", 1, "me", "Backend engineer, data platform — Python, PostgreSQL", "", [PYTHON, FEEDS, TIDES, COURSES], SKILLS, TITLES, 1.0),
            ("middling", 1, "me", HEAD, "", [PYTHON, NO_FEEDS, COURSES], ["Python"], TITLES, 1.0),
            ("weaker", 1, "me", HEAD, "", [NO_PYTHON, COURSES], [], TITLES, 1.0),
        ],
        DRAFT,
    )
    return drafts, postings, scores.asked(wanted, quals, lexicon), record, held, quals


def test_totals_of_the_example_record(posted):
    drafts, postings, want, record, held, _ = posted
    got = {r.doc_id: r.total for r in scores.score_drafts(drafts, postings, want).scores.collect()}
    assert (got["honest"], got["titled"], got["middling"]) == (71.2, 75.0, 46.2)
    best = scores.ceilings(drafts.select("item_id", "source"), postings, record, held, want).collect()
    assert [(r.ceiling, r.unreachable, r.title_fit) for r in best] == [(75.0, 1, 1.0)]
    assert all(total <= best[0].ceiling for total in got.values())


def test_gaps_and_feedback(posted):
    drafts, postings, want, record, _, quals = posted
    scored = scores.score_drafts(drafts, postings, want)
    gaps = scores.draft_gaps(drafts, scored, record)
    assert {tuple(r)[0:1] + tuple(r)[2:] for r in gaps.where("doc_id in ('honest', 'middling')").collect()} == {
        ("honest", "kubernetes", False, None), ("middling", "kubernetes", False, None), ("middling", "postgresql", True, "basics"),
    }
    told = scores.feedback(drafts, scored, gaps, postings, quals).where("doc_id = 'middling'")
    assert {tuple(r)[1:] for r in told.collect()} == {
        ("unsurfaced", 1, "postgresql"), ("title_words", 1, "platform"), ("unaddressed", 1, "Strong PostgreSQL"),
        ("unaddressed", 2, "Kubernetes in production"), ("absent", 1, "kubernetes"),
    }


def test_lists_are_cut(spark, posted):
    _, postings, _, record, _, quals = posted
    many = [f"tool{n:02d}" for n in range(20)]
    wanted = spark.createDataFrame([(1, "hard", t) for t in many], "item_id int, kind string, term string")
    drafts = spark.createDataFrame([("d", 1, "me", None, None, None, None, None, None)], DRAFT)
    want = scores.asked(wanted, quals, wanted.select("term"))
    scored = scores.score_drafts(drafts, postings, want)
    told = scores.feedback(drafts, scored, scores.draft_gaps(drafts, scored, record), postings, quals)
    assert [r.entry for r in told.where("list = 'absent'").orderBy("rank").collect()] == many[:15]
    assert [tuple(r)[2:] for r in scored.scores.collect()] == [(0.0, 0.0, 0.0, 1.0, 0.0, 20.0)]


def test_spellings_repeats_and_plural_forms_in_context(spark, posted):
    _, postings, _, _, _, quals = posted
    wanted = spark.createDataFrame([(1, "keyword", "Node.js"), (1, "keyword", "api"), (1, "keyword", "c++"), (1, "keyword", None), (None, "keyword", "x")], "item_id int, kind string, term string")
    want = scores.asked(wanted, quals.limit(0), wanted.select("term").limit(0))
    rows = [
        ("a", 1, "s", None, "node js and APIs", ["C++"], None, None, 1.0),
        ("b", 1, "s", None, "c++ c++", ["c++, c++", None], [], [], 1.0),
        ("skills", 1, "s", "api", None, [], ["C++", "Node.js", None], [], 1.0),
        (None, 1, "s", "api", None, [], [], [], 1.0),
        ("none", None, "s", "api", None, [], [], [], 1.0),
        ("other", 9, None, "", "", [], [], [], 0.5),
    ]
    drafts = spark.createDataFrame(rows, DRAFT)
    scored = scores.score_drafts(drafts, postings, want)
    got = {r.doc_id: (r.hard_skills, r.qualifications, r.keywords_in_context, r.format) for r in scored.scores.collect()}
    assert got == {"a": (1.0, 1.0, 1.0, 1.0), "b": (1.0, 1.0, 0.3, 1.0), "skills": (1.0, 1.0, 0.0, 1.0), "other": (1.0, 1.0, 1.0, 0.5)}
    assert [tuple(r) for r in scored.stuffed.collect()] == [("b", ["c++"])]
    assert scores.score_drafts(drafts.limit(0), postings, want).scores.count() == 0


def test_levels(spark):
    held = spark.createDataFrame([("a", "Staff Engineer"), ("a", None), ("b", "Fellow"), (None, "Lead"), ("c", "")], "source string, title string")
    postings = spark.createDataFrame([(1, "t", "senior"), (2, "t", "Fellow"), (3, None, None)], "item_id int, title string, seniority string")
    assert {tuple(r) for r in scores.levels_shown(held, postings).collect()} == {("a", "mid"), ("a", "senior"), ("a", "staff"), ("b", "fellow")}
    empty = spark.createDataFrame([], "item_id int, kind string, term string")
    want = scores.asked(empty, spark.createDataFrame([], "item_id int, seq int, text string"), empty.select("term"))
    pairs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (3, "c"), (3, "c"), (3, None)], "item_id int, source string")
    record = spark.createDataFrame([("a", 1, None)], "source string, doc_id int, text string")
    got = {(r.item_id, r.source): r.ceiling for r in scores.ceilings(pairs, postings, record, held, want).collect()}
    assert got == {(1, "a"): 100.0, (1, "b"): 92.5, (2, "b"): 100.0, (3, "c"): 100.0}


def test_no_draft_passes_its_ceiling(spark):
    d = "/root/testdata/sf0.001"
    best = score_queries.draft_ceilings(spark, d).select("item_id", "source", "ceiling")
    drafts = score_queries.Drafts(spark, d).drafts.select("doc_id", "source")
    both = score_queries.draft_scores(spark, d).join(drafts, "doc_id").join(best, ["item_id", "source"])
    assert both.count() > 0 and both.where("total > ceiling").count() == 0


def _tables(spark, folder):
    docs = [(1, "Kafkas and kafka run. Planners plan kafkas.", "s"), (2, None, "s"), (3, "nothing named", None)]
    items = [(0, "Kafka engineer. Builds planner tools."), (1, "Cook wanted. Peels onion sacks."), (2, "Nurse here.")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_drafts_are_put_together_once(spark, tmp_path):
    from tracewell.plans.score_queries import Drafts

    drafts = Drafts(spark, _tables(spark, tmp_path)).drafts
    assert "Join" not in drafts._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.doc_id for r in drafts.collect()) == [1, 2, 3]


def test_a_term_counts_once_whatever_its_spellings(spark, tmp_path):
    from tracewell.plans import report_queries as q

    got = q.answers_posting(spark, _tables(spark, tmp_path))
    assert sorted(map(tuple, got.select("item_id", "doc_id", "named").collect())) == [(0, 1, 2)]
    assert "Aggregate [doc_id" not in got._jdf.queryExecution().optimizedPlan().toString()
