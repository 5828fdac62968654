"""Names that mean the same, and the gate over whole documents with its repair."""

import random

import pytest

from tracewell.functions.shared import written
from tracewell.operators import documents as D
from tracewell.operators import ground, names
from tracewell.operators import mentions as M


@pytest.fixture(autouse=True, scope="module")
def interpreted(spark):
    """Plans here are large and tables tiny: compiling would take most of the time."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.codegen.wholeStage", "spark.sql.codegen.factoryMode")}
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    spark.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_components_are_reachability(spark):
    rng = random.Random(2)
    pairs = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(300)] + [(1000 + k, 1001 + k) for k in range(60)] + [(7, None), (None, 9), (2000, 2000)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in names.components(frame(spark, pairs, "a int, b int"), "a", "b").collect()}
    assert got == {x: find(x) for x in root}
    assert names.components(frame(spark, [], "a int, b int"), "a", "b").count() == 0


SYNONYMS = [("k8s", "Kubernetes"), ("Postgres", "PostgreSQL"), ("continuous integration", "CI/CD"), ("ci cd", "CI/CD"), ("js", "JavaScript"), ("ECMAScript", "js"), ("a1", "a2"), ("a2", "a1"), ("", "x"), (None, "y")]


def synonyms(spark):
    return frame(spark, SYNONYMS, "alias string, name string")


def test_canonical_names(spark):
    got = {r.spelling: r.canonical for r in names.synonym_classes(synonyms(spark)).collect()}
    assert got["k8s"] == got["kubernetes"] == "kubernetes"
    assert got["ecmascript"] == got["js"] == "javascript"  # chains mean the same; an alias of an alias is no name
    assert got["a1"] == got["a2"] == "a1" and "x" not in got


def test_canonical_mentions(spark):
    texts = frame(spark, [(1, "Deployed K8S and Postgres."), (2, "Continuous integration, CI/CD, CICD"), (3, None), (4, "ECMAScript here"), (5, "Go and Kubernetes, kubernetes")], "doc_id int, text string")
    lexicon = frame(spark, [("Kubernetes",), ("CI/CD",), ("js",), ("Go",), ("PostgreSQL",)], "term string")
    got = {(r.doc_id, r.term) for r in names.canonical_mentions(texts, lexicon, synonyms(spark)).collect()}
    assert got == {(1, "kubernetes"), (1, "postgresql"), (2, "ci/cd"), (4, "javascript"), (5, "go"), (5, "kubernetes")}


def test_stripped(spark):
    cases = {"Dockerized": "docker", "containerisation": "container", "testing": "test", "sing": None, "ed": None, "sparkify": "spark", "reds": None}
    got = {(r.term, r.name) for r in names.names_of(frame(spark, [(t,) for t in cases], "term string")).where("not grown").collect()}
    assert got == {(t.lower(), t.lower()) for t in cases} | {(t.lower(), n) for t, n in cases.items() if n}


SOURCES = [
    (1, "job1", "experience", None, "Engineer at Acme. Dockerised the worker, three releases"),
    (1, "job1.a", "highlight", "job1", "Cut latency by 40%"),
    (1, "job2", "experience", None, "Analyst at Beta, PostgreSQL"),
    (1, "deg", "education", None, "BSc"),
    (1, "cert1", "certification", None, "CKA"),
    (1, "blog#1", "evidence", None, "Kubernetes in anger"),
    (2, "job1", "experience", None, "Cook"),
]
LEXICON = ["Docker", "Kubernetes", "PostgreSQL", "Terraform", "Spark"]
ALLOWED = {"experience": ("experience",), "education": ("education",)}
KINDS = ("experience", "education", "project", "certification")


def case(spark, entries, bullets, skills=(), certificates=(), prose=(), cites=()):
    sources = frame(spark, SOURCES, "owner_id int, source_id string, kind string, parent_id string, text string")
    bullets = frame(spark, bullets, "owner_id int, where string, under string, text string, cites array<string>")
    prose = frame(spark, list(prose), "owner_id int, where string, text string")
    skills = frame(spark, list(skills), "owner_id int, category string, skill string")
    known = written(names.names_of(written(frame(spark, [(t,) for t in [*LEXICON, *(r.skill for r in skills.collect() if r.skill)]], "term string"), "terms"), synonyms(spark)), "names")
    lexicon = known.select("term").distinct()

    def named(texts, of, words):
        keyed = texts.selectExpr(f"struct(owner_id, {of}) as id", "text")
        return written(M.mentions(keyed, words, "id").selectExpr("id.owner_id", f"id.{of} as {of}", "term"), "named")

    said = bullets.select("owner_id", "where", "text").unionByName(prose)
    record = D.Record(
        sources.drop("text"),
        named(sources, "source_id", known.selectExpr("name as term")).withColumnRenamed("term", "name"),
        written(ground.figure_keys(sources, ["owner_id", "source_id"]), "keys"),
        frame(spark, [(1, "terraform")], "owner_id int, name string"),
        frame(spark, [(1, "terraform"), (1, "docker"), (1, "postgresql")], "owner_id int, name string"),
    )
    docs = D.Documents(frame(spark, entries, "owner_id int, where string, section string, entry_id string"), bullets, skills, frame(spark, list(certificates), "owner_id int, cited string"), prose, frame(spark, list(cites), "owner_id int, source_id string"))
    return docs, record, D.Said(named(said, "where", lexicon), written(ground.figure_claims(said, ["owner_id", "where"]), "figures"), known)


JOB = (1, "experience[job1]", "experience", "job1")


def bullet(n, text, cites, under="experience[job1]", owner=1):
    return (owner, f"{under}.bullet{n}", under, text, cites)


def found(spark, *args, **more):
    return sorted((r.where, r.kind, r.subject) for r in D.violations(*case(spark, *args, **more), ALLOWED, KINDS).collect())


def test_each_bullet_has_its_earliest_failure(spark):
    bullets = [
        bullet(1, "Built it with Docker, 3 releases", ["job1"]),
        bullet(2, "  ", []),
        bullet(3, "No source", []),
        bullet(4, "Spark here", ["nope", "job2"]),
        bullet(5, "Ran Postgres", ["job2"]),
        bullet(6, "Cut it by 40 percent on k8s", ["job1", "blog#1"]),
        bullet(7, "Cut it by 41 with Spark", ["job1"]),
        bullet(8, "Wrote Terraform", ["job1"]),
        bullet(9, None, None),
    ]
    want = [(2, "empty_bullet", ""), (3, "uncited_bullet", ""), (4, "unknown_source", "nope"), (5, "misattributed_bullet", "job2"), (7, "unsupported_figure", "41"), (7, "unsupported_term", "spark"), (9, "empty_bullet", "")]
    assert found(spark, [JOB], bullets) == [(f"experience[job1].bullet{n}", k, s) for n, k, s in want]


def test_rejected_entries_suppress_their_bullets(spark):
    entries = [JOB, (1, "experience[ghost]", "experience", "ghost"), (1, "experience[deg]", "experience", "deg"), (1, "education[deg]", "education", "deg"), (2, "experience[job2]", "experience", "job2")]
    bullets = [bullet(1, "Docker", ["job1"]), bullet(1, "Spark", [], "experience[ghost]"), bullet(1, "", [], "experience[deg]")]
    assert found(spark, entries, bullets) == [("education[deg]", "empty_entry", ""), ("experience[deg]", "wrong_section", ""), ("experience[ghost]", "unknown_entry", ""), ("experience[job2]", "unknown_entry", "")]


def test_skills_certificates_and_prose(spark):
    entries = [JOB, (1, "experience[ghost]", "experience", "ghost")]
    got = found(
        spark,
        entries,
        [bullet(1, "Docker", ["job1"])],
        skills=[(1, "tools", "Postgres"), (1, "tools", "Dockerized"), (1, "tools", "Spark"), (1, "tools", " "), (1, "tools", None)],
        certificates=[(1, "cert1"), (1, "job1"), (1, None)],
        prose=[(1, "summary", "Kubernetes and PostgreSQL, 40% faster"), (1, "headline", "Docker engineer, 12 years"), (2, "summary", None)],
        cites=[(1, "blog#1"), (1, "gone")],
    )
    assert got == sorted([("experience[ghost]", "unknown_entry", ""), ("skills[tools]", "undeclared_skill", "Spark"), ("certifications[job1]", "unknown_certification", "job1"), ("summary", "unsupported_term", "postgresql"), ("summary", "unknown_source", "gone"), ("headline", "unsupported_figure", "12"), ("certifications[]", "unknown_certification", "")])


def outcome(spark, owners, args, least=1, **more):
    docs, record, said = case(spark, *args, **more)
    done = D.repair(docs, record, said, ALLOWED, KINDS)
    rows = D.outcomes(frame(spark, [(o,) for o in owners], "owner_id int"), docs, done, least).collect()
    return done, {r.owner_id: r for r in rows}


def test_repair_cuts_at_every_level(spark):
    entries = [JOB, (1, "experience[job2]", "experience", "job2"), (1, "experience[ghost]", "experience", "ghost")]
    bullets = [bullet(1, "Docker", ["job1"]), bullet(2, "Spark", ["job1"]), bullet(1, "Kubernetes", ["job2"], "experience[job2]"), bullet(1, "fine", ["job1"], "experience[ghost]")]
    done, by = outcome(
        spark, [1, 3], (entries, bullets),
        skills=[(1, "tools", "SPARK"), (1, "tools", "Docker")], certificates=[(1, "cert1"), (1, "x")],
        prose=[(1, "summary", "Spark"), (1, "headline", "Docker")],
    )
    assert [r.where for r in done.kept.bullets.collect()] == ["experience[job1].bullet1"]
    assert [r.where for r in done.kept.entries.collect()] == ["experience[job1]"]  # job2 lost its only bullet
    assert [r.skill for r in done.kept.skills.collect()] == ["Docker"] and [r.cited for r in done.kept.certificates.collect()] == ["cert1"]
    assert [r.where for r in done.kept.prose.collect()] == ["headline"]
    assert (by[1].kept, by[1].entries_kept, by[1].remaining, by[1].usable) == (1, 1, 0, True)
    assert by[1].dropped == 6 and by[1].summary == "undeclared_skill×1, unknown_certification×1, unknown_entry×1, unsupported_term×3"
    assert (by[3].bullets, by[3].dropped, by[3].summary, by[3].usable) == (0, 0, "", False)


def test_what_remains_is_found_by_the_second_run(spark):
    """The headline is backed by an entry that goes with its bullets; only the second run can see that."""
    entries = [JOB, (1, "experience[job2]", "experience", "job2")]
    bullets = [bullet(1, "Docker", ["job1"]), bullet(1, "Spark", ["job2"], "experience[job2]")]
    done, by = outcome(spark, [1], (entries, bullets), prose=[(1, "headline", "PostgreSQL")])
    assert [(r.where, r.kind, r.subject) for r in done.remaining.collect()] == [("headline", "unsupported_term", "postgresql")]
    assert (by[1].kept, by[1].remaining, by[1].usable) == (1, 1, False)


def test_letters(spark):
    paragraphs = [(1, "paragraph1", None, "Docker for 40 of you", ["job1"]), (1, "paragraph2", None, "I ran Postgres", ["job2"]), (1, "paragraph3", None, "Spark", ["job1"]), (2, "paragraph1", None, "Spark", ["job1"])]
    docs, record, said = case(spark, [], paragraphs)
    owners = frame(spark, [(1,), (2,), (3,)], "owner_id int")
    done = D.repaired_letters(owners, docs, record, said)
    by = {r.owner_id: r for r in D.outcomes(owners, docs, done, 2).collect()}
    assert (by[1].kept, by[1].dropped, by[1].remaining, by[1].usable) == (2, 1, 0, True)
    assert (by[2].kept, by[2].remaining, by[2].usable) == (0, 1, False)  # nothing is left of it
    assert (by[3].dropped, by[3].summary) == (1, "empty_letter×1")


def test_streamed_items_get_the_batch_gate_s_verdicts(spark, tmp_path):
    from tracewell.streaming import stages

    bullets = [bullet(1, "Docker, 3 releases", ["job1"]), bullet(2, " ", []), bullet(3, "x", []), bullet(4, "y", ["nope"]), bullet(5, "Ran Postgres", ["job2"]), bullet(6, "41 with Spark", ["job1"])]
    docs, record, _ = case(spark, [JOB], bullets)
    known = written(names.names_of(frame(spark, [(t,) for t in LEXICON], "term string"), synonyms(spark)), "names")

    def said(texts):
        keyed = texts.selectExpr("struct(owner_id, where) as id", "text")
        return D.Said(M.mentions(keyed, known.select("term").distinct(), "id").selectExpr("id.owner_id", "id.where", "term"), ground.figure_claims(texts, ["owner_id", "where"]), known)

    docs.bullets.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.bullets.schema).parquet(str(tmp_path / "in"))
    rows = lambda df: sorted((r.where, r.kind, r.subject) for r in df.collect())
    want = rows(D.item_violations(docs, record, said(docs.bullets.select("owner_id", "where", "text")), KINDS))
    for _ in range(2):  # the second run finds nothing new and repeats nothing
        got = rows(stages.gate_items(stream, record, said, docs.entries, KINDS, str(tmp_path / "out"), str(tmp_path / "state")))
        assert got == want and len(want) == 6


def test_names_of_a_class_are_one_group(spark):
    """Twenty names for each of twenty terms: a claim meets its few groups, not all names of its class."""
    from tracewell.operators import names

    pairs = [(f"t{a}", f"t{b}") for a in range(20) for b in range(20)] + [(f"t{a}", f"t{a}ing") for a in range(20)] + [("t0", "x"), ("t1", "x")]
    of_name, of_term = names.grouped(spark.createDataFrame(pairs, "term string, name string"), "name")
    assert sorted(map(tuple, of_name.join(of_term, "group").select("term", "name").collect())) == sorted(pairs)
    assert of_term.count() == 20 + 20 + 2 and of_name.count() == 41
