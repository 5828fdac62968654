"""Chunks whose folding and composing do not commute."""

import random

import pyarrow as pa
import pytest

from tracewell.llm import bpe, token_files
from tracewell.llm.queries import tokenizer_path

TEXTS = ["H\u0331", "J\u030c", "T\u0308", "W\u030a", "Y\u030a", "aJ\u0323\u030cb xH\u0331y", "h\u0331 H\u0331 \u00c9lan DON\u2019T", "Caf\u00c9-H\u0331 1e\u0301", "<|ENDOFTEXT|> a", "x<|EndOfText|>\u0331"]


MEMOS = pytest.mark.parametrize("memo", [lambda p: token_files.library_memo(p), lambda p: bpe.Bpe(p).memo()], ids=["op3", "op9"])


def check(memo, texts):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    ids, ends = memo(path).encode(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == want[k], text


@MEMOS
def test_marks_after_capitals(memo):
    check(memo, TEXTS)


@MEMOS
def test_special_tokens_in_any_case(memo):
    """Case variants of special tokens next to each sign, letters, marks and each other."""
    rng = random.Random(5)
    vary = lambda t: "".join(rng.choice((c.lower(), c.upper())) for c in t)
    specials = ["<|startoftext|>", "<|endoftext|>"]
    around = [*map(chr, range(33, 127)), "", "é", "É", "\u0331", "\u00a0", "\u2028", "'s", "'LL", "İ", "Σ", "日"]
    texts = []
    for a in around:
        for t in (*specials, vary(specials[0]), specials[1].upper()):
            texts += [a + t, t + a, f"{a}{t}{rng.choice(around)}{vary(rng.choice(specials))} {rng.choice(around)}"]
    check(memo, texts)


def test_query_runs_transducer_and_decoder(monkeypatch):
    """What op9 and the pipeline run on a batch: each new piece goes through the transducer, each id through the decoder."""
    b = bpe.Bpe(tokenizer_path())
    fed, decoded = [], []
    finish, feed = bpe.PieceTransducer.finish, bpe.Decoder.feed
    monkeypatch.setattr(bpe.PieceTransducer, "finish", lambda self: fed.append(bytes(self.held)) or finish(self))
    monkeypatch.setattr(bpe.Decoder, "feed", lambda self, ids: decoded.extend(ids) or feed(self, ids))
    ids, ends = b.memo().encode(pa.array(["one two, one", None, "two 3"]))
    n, _, _ = bpe.digests(b, ids, ends)
    assert set(fed) == {b"one", b"two", b",", b"3"} and decoded == ids.tolist() and n == [4, 0, 2]
