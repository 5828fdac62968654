"""Matching rules on cases of the same shapes as the survey's fixtures."""

import random
import re
import unicodedata

import pytest

from tracewell.functions import text as T
from tracewell.functions import vocab
from tracewell.operators import ground, mentions

MENTION_CASES = [
    ("We used R and Python", "R", True),
    ("Rewrote the parser", "R", False),
    ("Ongoing work in Go", "Go", True),
    ("Ongoing work", "Go", False),
    ("he goes home", "Go", False),
    ("C++ services", "C++", True),
    ("C++ services", "C", True),
    ("runs on Kubernetes", ".NET", False),
    ("runs on .NET", ".NET", True),
    ("built with nodejs", "Node.js", True),
    ("built with Node JS", "Node.js", True),
    ("CICD pipelines", "CI/CD", True),
    ("many LLMs", "LLM", True),
    ("an LLM", "LLMs", True),
    ("two classes", "class", True),
    ("", "class", False),
]


def test_mention_cases(spark):
    rows = [(i, h, t) for i, (h, t, _) in enumerate(MENTION_CASES)]
    texts = spark.createDataFrame([(i, h) for i, h, _ in rows], "doc_id int, text string")
    lexicon = spark.createDataFrame([(t,) for t in sorted({t for _, _, t in rows})], "term string")
    got = {(r.doc_id, r.term) for r in mentions.mentions(texts, lexicon).collect()}
    for (i, _, term), (_, _, want) in zip(rows, MENTION_CASES, strict=True):
        assert ((i, term.lower()) in got) == want, (i, term)


def plain_contains(hay, term):
    """The rule, term by term, as a plain scan."""
    norm = lambda s: " ".join(unicodedata.normalize("NFKC", s).split()).casefold()
    hay, term = norm(hay), norm(term)
    edge = lambda s: ("(?<![a-z0-9])" if s[0].isalnum() else "") + re.escape(s) + ("(?![a-z0-9])" if s[-1].isalnum() else "")
    forms = [term]
    if len(term) >= 2 and term[-1].isalnum():
        forms += [term + "s"]
        forms += [term[:-1]] if term.endswith("s") and len(term) > 2 else []
        forms += [term[:-2]] if re.search("(ses|xes|zes|ches|shes)$", term) else []
        forms += [term + "es"] if re.search("(s|x|z|ch|sh)$", term) else []
        forms += [term[:-3] + "y"] if term.endswith("ies") and len(term) > 4 else []
    if any(re.search(edge(f), hay) for f in forms):
        return True
    parts = re.findall("[a-z0-9]+", term)
    return len(parts) > 1 and bool(re.search("(?<![a-z0-9])" + "[^a-z0-9]{0,2}".join(parts) + "(?![a-z0-9])", hay))


def test_mentions_equal_a_plain_scan(spark):
    rng = random.Random(5)
    terms = ["R", "Go", "C++", "C#", ".NET", "Node.js", "CI/CD", "LLM", "class", "box", "Spring Boot", "a b", "x.y.z", "policies", "H100"]
    bits = ["r", "go", "goes", "c", "++", "#", ".", "net", "node", "js", "ci", "/", "cd", "llms", "classes", "boxes", "spring", "boot", " ", " ", "-", "a", "b", "x", "y", "z", "policy", "h100", "é", "'s"]
    texts = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 12)))) for i in range(1500)]
    got = {(r.doc_id, r.term) for r in mentions.mentions(spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    want = {(i, t.lower()) for i, x in texts for t in terms if plain_contains(x, t)}
    assert got == want and len(want) > 300


NUMBER_CASES = [
    ("about 40 percent", "40", True),
    ("grew to 12,000 users", "12000", True),
    ("a 3.0 rating", "3", True),
    ("from three hours", "3", True),
    ("all threes", "3", False),
    ("rated 40.5", "40", True),
    ("rated 5.05", "05", False),
    ("none at all", "7", False),
    ("twenty minutes", "20", True),
]


def test_figure_support(spark):
    for source, claim, want in NUMBER_CASES:
        keys = ground.figure_keys(spark.createDataFrame([(1, source)], "id int, text string"), ["id"])
        claims = ground.figure_claims(spark.createDataFrame([(1, claim)], "id int, text string"), ["id"])
        assert (claims.join(keys, ["id", "kind", "key"]).count() > 0) == want, (source, claim)


def test_figures_skip_names(spark):
    row = spark.createDataFrame([("S3 and EC2 on Python3: $1,200 or 2.5x, 40%",)], "t string").select(T.figures("t").alias("f")).first()
    assert row.f == ["1200", "2.5", "40"]


@pytest.mark.parametrize(("text", "limit"), [("one two three four five six", 12), ("abcdefghijklmnop", 8), ("short", 10), ("", 5), (None, 5), ("a b, c d e f g h", 9)])
def test_truncate(spark, text, limit):
    got = spark.createDataFrame([(text,)], "t string").select(T.truncate("t", limit).alias("x")).first().x
    t = (text or "").strip()
    want = t
    if len(t) > limit:
        cut = t[: limit - 1].rstrip()
        at = cut.rfind(" ")
        want = (cut[:at] if at > limit * 0.6 else cut).rstrip(" ,;:-") + "…"
    assert got == want


def test_normalize_and_nulls(spark):
    df = spark.createDataFrame([("  Straße —  “X” ",), (None,)], "t string").select(T.normalize("t").alias("n"), T.squash("t").alias("s"), T.words("t").alias("w"), T.sentences("t").alias("x"))
    a, b = df.collect()
    assert (a.n, a.s, a.w) == ('strasse - "x"', "strassex", ["strasse", "x"])
    assert (b.n, b.s, b.w, b.x) == ("", "", [], [])


def test_technical_tokens(spark):
    df = spark.createDataFrame([(1, "DeepMind's GPU on H100, node.js and C++; the CV of Q1. CICD")], "doc_id int, text string")
    known = spark.createDataFrame([(1, "CI/CD")], "doc_id int, term string")
    got = {r.token for r in mentions.technical_tokens(df, known).collect()}
    assert got == {"DeepMind", "GPU", "H100", "node.js", "C++", "CI/CD"}


def test_derived_spellings(spark):
    got = {r.spelling for r in mentions.derived_spellings(spark.createDataFrame([("Docker",), ("Go",), ("Spring Boot",)], "term string")).collect()}
    assert "dockerized" in got and not any(x.startswith(("go", "spring")) for x in got)


def test_compose(spark):
    df = T.compose(spark.createDataFrame([("ﬁne",), (None,)], "t string"), "t")
    assert [r.t for r in df.collect()] == ["fine", None]


def test_vocabulary():
    assert abs(sum(vocab.WEIGHTS.values()) - 1) < 1e-9 and len(vocab.STOPWORDS) == len(set(vocab.STOPWORDS))
