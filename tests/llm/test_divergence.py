"""Divergence of sources against plain counting in whole numbers; blocks, runs and their merge."""

import collections
import random
import re

import pyarrow as pa

from tests.llm.test_operators import SCHEMA, corpus
from tracewell.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain(rows, least=3, top=200):
    """rows: (text, lang, source). Every kept term with every group, zeros included."""
    rows = [(TERM.findall(lower(t)), lang or "", source or "") for t, lang, source in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == lang]
        docs = collections.Counter(w for ws, _, _ in mine for w in set(ws))
        kept = sorted(w for w, n in docs.items() if n >= least)
        counts = {s: collections.Counter(w for ws, _, x in mine if x == s for w in ws) for s in {r[2] for r in mine}}

        def shares(c):
            total = sum(c[w] for w in kept) + len(kept)
            return {w: 1 + 1_000_000_000 * (c[w] + 1) // total for w in kept}

        q = shares(sum(counts.values(), collections.Counter()))
        p = {s: shares(c) for s, c in counts.items()}
        for s, c in counts.items():
            pairs = [(sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o) for o in counts if o != s]
            terms = [((p[s][w] - q[w]) ** 2 // q[w], w) for w in kept if c[w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])}
    return out


def made(n=400, seed=4):
    rng = random.Random(seed)
    words = ["rain", "Rain", "über", "straße", "the", "THE", "of", "x1y", "日本", "don't", *["w" + "abcdefgh"[k % 8] * (k // 8 + 1) for k in range(60)]]
    return [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))), rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "b", "c", None, "ü"])) for _ in range(n)] + [(None, "en", "only null"), ("", "xx", "p"), ("12 !", "xx", "q"), ("once", "yy", "r")]


def result(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "text string, lang string, source string, item string, value int")
    return [tuple(r) for r in divergence.divergence_report(docs, **options).collect()]


def test_report_is_plain_counting(spark):
    got = result(spark, made())
    assert len(got) == len(set(got)) and set(got) == plain(made())


def test_few_ranks_and_ties(spark):
    got = result(spark, made(120), top=3)
    assert set(got) == plain(made(120), top=3) and max(r[5] for r in got if r[2] == "term") == 3


def test_languages_without_terms(spark):
    rows = [("one", "x", "a"), (None, "x", "b"), ("", None, None)]
    assert sorted(result(spark, rows)) == [("x", "a", "pair", "b", 0, 1), ("x", "b", "pair", "a", 0, 1)]
    assert result(spark, []) == []


def test_spilled_blocks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_BYTES", 1)
    monkeypatch.setattr(divergence, "CHUNK_TERMS", 3)
    monkeypatch.setattr(divergence, "PAIRS_HELD", 4)
    assert set(result(spark, made())) == plain(made())


def test_awkward_rows(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    want = plain([(r.text, r.lang, r.source) for r in docs.collect()])
    assert {tuple(r) for r in divergence.divergence_report(docs).collect()} == want


def test_runs_merge_to_counts_of_long_texts(monkeypatch):
    """One text of many windows, a word longer than a window, and runs that share terms."""
    monkeypatch.setattr("tracewell.llm.windows.WINDOW", 64)
    rng = random.Random(2)
    long = " ".join(rng.choice(["aa", "bb", "Cc", "x" * 300, "é"]) for _ in range(3000))
    texts = [(long, "en", "a"), ("aa é", "en", "b"), (long, "de", "a")]
    chunks = []
    for t in texts:
        block = divergence.Block()
        block.add(pa.array([t[0]]), [t[1]], [t[2]])
        chunks += list(block.run(1))
    found = dict(divergence.merge_runs(sorted(chunks, key=lambda c: c["first"])))
    assert list(found) == sorted(found)
    for term, got in found.items():
        want = [(lang, s, TERM.findall(lower(t)).count(term.decode()), 1) for t, lang, s in texts if term.decode() in TERM.findall(lower(t))]
        assert sorted(got) == sorted(want)


def test_shares_beyond_64_bits(spark):
    """A count of 2**40 needs a product over 2**63."""
    n, size, terms = 1 << 40, (1 << 43) + 7, 12345
    row = spark.range(1).selectExpr(f"{divergence._share(f'{n}L', f'{size}L', f'{terms}L')} as p").first()
    assert row.p == 1 + 1_000_000_000 * (n + 1) // (size + terms)


def test_a_document_counts_once_per_term(spark):
    rows = [("rain rain rain", "en", "a"), ("rain", "en", "b"), ("sun", "en", "a"), ("sun", "en", "b"), ("sun", "en", "b")]
    terms = {r[3] for r in result(spark, rows) if r[2] == "term"}
    assert terms <= {"sun"}


