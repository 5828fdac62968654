"""The gate's rules: one case for each, the earliest failing rule alone, and the best letter."""

from tracewell.operators import ground, runs
from tracewell.sources.imports import split_descriptions


def test_gate_keeps_the_earliest_rule(spark):
    s = "owner_id string, item_id int, entry_id long, text string, cites array<bigint>"
    items = spark.createDataFrame([("o", 1, 1, " ", []), ("o", 2, 1, "a b", []), ("o", 3, 1, "x", [9, 1]), ("o", 4, 1, "x", [2]), ("o", 5, 1, "rust", [1]), ("o", 6, 1, "fine", [1]), ("o", 7, 1, None, None)], s)
    sources = spark.createDataFrame([("o", 1, "user", None), ("o", 2, "user", None)], "owner_id string, source_id long, kind string, parent_id long")
    t = "owner_id string, item_id int, term string"
    claimed = spark.createDataFrame([("o", 3, "go"), ("o", 5, "rust"), ("o", 6, "fine")], t)
    found = ground.gate(items, sources, claimed, spark.createDataFrame([("o", 6, "fine")], t), ("user",))
    assert {(r.item_id, r.kind, r.subject) for r in found.collect()} == {(1, "empty", ""), (2, "uncited", ""), (3, "unknown_citation", "9"), (4, "misattributed", "2"), (5, "unsupported_term", "rust"), (7, "empty", "")}
    assert [tuple(r) for r in ground.kind_counts(found).collect()] == [("o", 6, "empty×2, misattributed×1, uncited×1, unknown_citation×1, unsupported_term×1")]


def test_entries_and_skills(spark):
    e = spark.createDataFrame([("o", "a", "work"), ("o", "b", "work"), ("o", "c", "work"), ("o", "z", "work")], "owner_id string, entry_id string, section string")
    s = spark.createDataFrame([("o", "a", "job"), ("o", "b", "degree"), ("o", "c", "job")], "owner_id string, source_id string, kind string")
    b = spark.createDataFrame([("o", "a")], "owner_id string, entry_id string")
    assert {tuple(r)[1:] for r in ground.entry_checks(e, s, b, {"work": ("job",)}).collect()} == {("b", "wrong_section"), ("c", "empty_entry"), ("z", "unknown_entry")}
    k = "owner_id string, skill string"
    skills = spark.createDataFrame([("o", "APIs"), ("o", "Rust"), ("o", ""), ("o", None), ("p", "go")], k)
    assert {tuple(r) for r in ground.undeclared_skills(skills, spark.createDataFrame([("o", "api"), ("o", "go")], k)).collect()} == {("o", "Rust"), ("p", "go")}


def test_best_letter_and_descriptions(spark):
    s = "run_id int, attempt int, grounded boolean, parses boolean, reads_well boolean, failures int, repaired boolean"
    rows = [(1, 1, True, True, False, 3, False), (1, 2, True, True, False, 1, True), (1, 3, True, True, False, 1, False), (2, 1, False, True, True, 0, False), (2, 2, True, False, False, None, False)]
    assert {(r.run_id, r.attempt) for r in runs.best_letter(spark.createDataFrame(rows, s)).collect()} == {(1, 3), (2, 2)}
    d = spark.createDataFrame([(1, "• one thing\r\n- two\nno\n\n  three  "), (2, None), (3, "")], "doc_id int, text string")
    assert [tuple(r) for r in split_descriptions(d).orderBy("doc_id", "n").collect()] == [(1, 1, "one thing"), (1, 2, "two"), (1, 3, "three")]


def test_letter_and_profile_gates(spark):
    s = "owner_id string, item_id int, text string, cites array<bigint>"
    items = spark.createDataFrame([("o", 1, "rust go", [1]), ("o", 2, "fine", [1]), ("o", 3, "x", [9]), ("o", 4, "kept", [1]), ("p", 1, None, None)], s)
    sources = spark.createDataFrame([("o", 1, "user")], "owner_id string, source_id long, kind string")
    t = "owner_id string, item_id int, term string"
    claimed = spark.createDataFrame([("o", 1, "rust"), ("o", 1, "go")], t)
    letters = spark.createDataFrame([("o",), ("o",), ("p",), ("q",)], "owner_id string")
    allowed = spark.createDataFrame([("o", "go"), ("p", "rust")], "owner_id string, term string")
    found = ground.letter_gate(letters, items, sources, claimed, claimed.limit(0), allowed)
    assert {(r.owner_id, r.item_id, r.kind, r.subject) for r in found.collect()} == {("o", 1, "unsupported_term", "rust"), ("o", 3, "unknown_citation", "9"), ("p", 1, "empty", ""), ("q", None, "empty_letter", "")}
    kept = ground.cut(items, found)
    assert {(r.owner_id, r.item_id, r.number) for r in ground.renumbered(kept).collect()} == {("o", 2, 1), ("o", 4, 2)}
    again = ground.letter_gate(letters.where("owner_id = 'o'"), kept, sources, ground.cut(claimed, found), claimed.limit(0), allowed)
    assert {tuple(r) for r in ground.repair_outcome(items, kept, again, 2).collect()} == {("o", 4, 2, 0, True), ("p", 1, 0, 0, False)}
    sections = spark.createDataFrame([("o", 1), ("o", 7), ("o", 7)], "owner_id string, entry_id long")
    copy = ground.profile_gate(sections, sources, items, sources, claimed, claimed)
    assert {(r.owner_id, r.item_id, r.kind, r.subject) for r in copy.collect()} == {("o", 3, "unknown_citation", "9"), ("p", 1, "empty", ""), ("o", None, "unknown_role", "7")}


def test_prose_is_held_to_all_that_is_selected(spark):
    claimed = spark.createDataFrame([("o", "summary", "go"), ("o", "headline", "rust"), ("p", "summary", "go")], "owner_id string, part string, term string")
    supported = spark.createDataFrame([("o", "go"), ("o", "go")], "owner_id string, term string")
    prose = spark.createDataFrame([("o", "summary", "3 teams and 40% less"), ("p", "summary", None)], "owner_id string, part string, text string")
    scope = spark.createDataFrame([("o", "three teams"), ("o", None)], "owner_id string, text string")
    found = ground.prose_scope(claimed, supported, ground.figure_claims(prose, ["owner_id", "part"]), ground.figure_keys(scope, ["owner_id"]))
    assert {tuple(r) for r in found.collect()} == {("o", "headline", "unsupported_term", "rust"), ("p", "summary", "unsupported_term", "go"), ("o", "summary", "unsupported_figure", "40")}
