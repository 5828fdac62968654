"""Packing against the library's ids, and plans against the pieces that they must hold."""

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.llm.test_operators import corpus
from tracewell.llm import packing
from tracewell.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def random_texts(n=3000, seed=6):
    rng = random.Random(seed)
    signs = ["a", "B", "é", "Ü", "ß", "×", "÷", "1", "23", " ", " ", "  ", "\n", "\t", "\r\n", " ", " ", "　", "\x85", "\x1f", "\x00", "'", "'s", "'LL", "’", "<", "<|endoftext|>", "<|ENDOFTEXT|>", ",", "!!", "_", "日本", "́", "🙂", "word", "ª", "٣", "﻿"]
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("window", [1 << 20, 16])
def test_ids_are_the_library_s(library, window, monkeypatch):
    monkeypatch.setattr("tracewell.llm.windows.WINDOW", window)
    texts = [*random_texts(), None, *(r[1] for r in corpus())]
    ids, ends = packing.byte_memo(PATH).encode(pa.array(texts, pa.string()))
    for k, e in enumerate(library.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert ids[ends[k] : ends[k + 1]].tolist() == e.ids, repr(texts[k])


def plain_pieces(library, doc_id, text, size):
    ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
    n = -(-len(ids) // size)
    cuts = [0, *(len(ids) - size * k for k in range(n - 1, -1, -1))]
    return [(doc_id, k, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())) for k, (a, z) in enumerate(zip(cuts, cuts[1:]))]


def well_packed(rows, size):
    """Sequences are filled from 0 without gaps and hold at most size tokens; returns how many there are."""
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


@pytest.mark.parametrize("size", [1024, 16])
def test_pieces_and_places(spark, library, size):
    rows = [(r[0], r[1]) for r in corpus()] + [(1000 + k, "long words here " * n) for k, n in enumerate((5, 341, 700, 2000))]
    docs = spark.createDataFrame([(*r, 5, "clash") for r in rows], "doc_id long, text string, length int, piece string").repartition(5)
    got = packing.pack_documents(docs, PATH, size).collect()
    want = [p for k, t in rows for p in plain_pieces(library, k, t, size)]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    n = well_packed(got, size)
    assert n <= -(-sum(r.length for r in got) // size) * 1.2 + 1
    assert packing.pack_documents(docs.where("false"), PATH, size).count() == 0


@pytest.mark.parametrize("kind", ["even", "short", "long", "one length", "prose", "few"])
def test_plan_holds_every_piece_once(kind):
    rng = random.Random(kind)
    lengths = {
        "even": lambda: rng.randint(1, 1024),
        "short": lambda: rng.randint(1, 60),
        "long": lambda: rng.randint(500, 1024),
        "one length": lambda: 300,
        "prose": lambda: min(1024, 1 + int(rng.lognormvariate(5, 1))),
        "few": lambda: rng.choice([1, 2, 1023, 341, 342, 700]),
    }[kind]
    counts = collections.Counter(lengths() for _ in range(20_000))
    plan = packing.plan_fillings(counts)
    held = collections.Counter()
    for filling, n in plan:
        assert sum(filling) <= 1024 and n > 0
        for length in filling:
            held[length] += n
    assert held == counts
    total, sequences = sum(k * n for k, n in counts.items()), sum(n for _, n in plan)
    least = max(-(-total // 1024), sum(n for k, n in counts.items() if k > 512))
    if kind == "one length":
        least = -(-counts[300] // 3)
    if kind != "few":
        assert sequences <= least * 1.01 + 1, (sequences, least)
    plain = sum(n for _, n in packing.best_fit(counts))
    assert sequences <= plain * 1.005 + 1, (sequences, plain)


def test_exact_complements_come_first():
    plan = dict(packing.plan_fillings({1024: 2, 1000: 5, 24: 3, 600: 1, 400: 1, 20: 4, 4: 9, 500: 2, 12: 2}))
    assert plan[(1024,)] == 2 and plan[(1000, 24)] == 3 and plan[(1000, 20, 4)] == 2


def test_places_are_those_of_the_plan():
    counts = collections.Counter(random.Random(1).randint(1, 100) for _ in range(5000))
    places = packing.Places(packing.plan_fillings(counts, 128), 128)
    seen = collections.defaultdict(list)
    for length, n in counts.items():
        s, o = places.of(np.full(n, length), np.arange(n))
        for a, b in zip(s.tolist(), o.tolist(), strict=True):
            seen[a].append((b, length))
    assert len(seen) == places.sequences
    for parts in seen.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128


def test_work_depends_on_lengths_only():
    counts = {k: 10**9 + k for k in range(1, 1025)}
    plan = packing.plan_fillings(counts)
    assert len(plan) < 5000 and sum(k * n for f, n in plan for k in f) == sum(k * n for k, n in counts.items())
