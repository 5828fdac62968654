"""Line dedup: where classes stand first, found by numbers where they fit and by structs where not."""

import pytest
from tracewell.llm import line_dedup


@pytest.mark.parametrize("ids", [[3, -2, 3, 7, 0], [3, None, 3, 7, 0], [2**62, -(2**63), 5, 2**63 - 1, 0], []])
def test_first_places_of_classes(spark, ids):
    rows = [(d, n, c, c) for k, d in enumerate(ids) for n, c in ((4, 1), (9, 1), (70_000 + k, 2 + k % 2), (1, None))]
    df = spark.createDataFrame(rows, "doc_id long, line_no int, c1 long, c2 int")
    got = line_dedup.class_places(df)
    want = {}
    for d, n, c, _ in rows:
        if c is not None:
            want.setdefault(c, []).append((d is not None, d or 0, n, d))
    assert {r.c1: (r.first.doc_id, r.first.line_no, r.copies) for r in got.collect()} == {c: (min(x)[3], min(x)[2], len(x)) for c, x in want.items()}
    small = not ids or (None not in ids and max(map(abs, ids)) < 2**40)
    assert ("SortAggregate" in got._jdf.queryExecution().executedPlan().toString()) != small


def test_white_space_of_every_kind(spark):
    texts = [(1, "One two\tthree\rfour\x0bfive\x0csix SEVEN\n\t\nno other"), (2, "one  two three four five six seven"), (3, None), (4, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.line_report(docs).collect()}
    assert got == {1: (3, 0), 2: (1, 1), 3: (0, 0), 4: (1, 0)}


def test_only_lines_read_again_are_put_in_lower_case(spark):
    texts = [(1, "\u03a3\u039f\u03a3\n\u0130x\ty\r\nZ\x0bw\x0c \tv", [2, 1, 0, 7]), (2, None, [0]), (3, "A  B", [0, 1])]
    docs = spark.createDataFrame(texts, "doc_id long, text string, numbers array<int>")
    got = line_dedup._numbered_lines(docs)
    whole = {(r.doc_id, r.line_no): r.words for r in line_dedup._lines(docs).collect()}
    assert {(r.doc_id, r.line_no): r.words for r in got.collect()} == {k: v for k, v in whole.items() if v is not None}
    assert whole[1, 2] == ["z", "w", "v"] and whole[1, 1] == ["\u0130x".lower(), "y"] and whole[3, 0] == ["a", "b"] and whole[2, None] is None
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "lower(line" in plan and "lower(text" not in plan and "Contains(low" in plan


def test_tokens_of_lines_by_brute_force(spark):
    """Least tokens against all tokens: of the kth least first word, or before, and every run where too few differ."""
    words = [f"w{k * k % 23}" for k in range(60)]
    texts = [(k, " ".join(words[k : k + n])) for k, n in enumerate((1, 4, 5, 6, 9, 30, 44))] + [(90, "a b " * 40), (91, ""), (92, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.least for r in line_dedup.line_rows(docs).collect()}
    sets = {r.doc_id: r for r in line_dedup._hashed(line_dedup._lines(docs)).select("doc_id", "hashes", line_dedup._tokens().alias("tokens")).collect()}
    for d, text in texts:
        w = (text or "").split()
        runs = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        if w:
            assert len(sets[d].tokens) == len(set(sets[d].tokens)) == len(runs)
            m = max(1, len(w) - 4)
            assert len(got[d]) == min(len(runs), m - -(-m * 8 // 10) + 3) and got[d] == sorted(set(got[d]))
            if len(w) >= 5:
                firsts = sorted({h >> 32 for h in sets[d].hashes[: len(w) - 4]})
                assert {t >> 32 for t in got[d]} == set(firsts[: len({t >> 32 for t in got[d]})])
    assert got[91] is None and got[92] is None
