"""BPE encoding by a bounded-lookahead streaming transducer, and incremental decoding.

Merging is local: a boundary in the encoding of a prefix can only be undone by later symbols if a
chain of merges carries the difference back to it. The merge list bounds such chains, so a
boundary more than that bound before the last symbol read is final, and its tokens are emitted
while the rest of the piece has not been read. A piece of any length is encoded with a buffer of
fixed size.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.chunks import ChunkMemo
from tracewell.llm.common import limit_batches

#: Symbols that a piece may add to the lookahead before stable tokens are emitted.
STRIDE = 256
_ID, _NONE = (1 << 24) - 1, 1 << 60
_SPACE = regex.compile(r"\s+")


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in for each byte: itself if printable, else the next code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Merges:
    """A merge list over token ids, with its sufficient lookahead."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.suffix = suffix
        #: For each pair of ids, its rank and, in the low bits, the id that it becomes.
        self.pair: dict[tuple[int, int], int] = {}
        alphabet = byte_alphabet()
        self.inner = [vocab.get(alphabet[b], -1) for b in range(256)]
        self.final = [vocab.get(alphabet[b] + suffix, -1) for b in range(256)]
        rules = []
        for rank, (a, b) in enumerate(merges):
            key, new = (vocab[a], vocab[b]), vocab[a + b]
            if key not in self.pair:
                self.pair[key] = rank << 24 | new
                rules.append((*key, new))
        self.lookahead = self._sufficient_lookahead(rules)

    def _sufficient_lookahead(self, rules: list[tuple[int, int, int]]) -> int:
        """How many symbols before the end of a prefix its token boundaries may still change.

        Compare the encodings of a prefix and of a longer text, merge by merge. Left of a frontier
        they agree. The frontier moves left only when a rule (u, v) joins, in one of the two, the
        agreed token u with the token v that starts at the frontier; it moves by |u|. After such a
        move, the tokens that start at the new frontier are u in the one and uv in the other, and
        what later merges make of them by adding to the right; so the next rule that moves it,
        which ranks later, has as its right part a token with u on its left spine. Hence the
        greatest sum of |u| over such chains bounds all movement. Rules are visited by rank:
        reach[u] is the greatest sum of a chain that ended in a rule with left part u.
        """
        length = {x: 1 for x in {*self.inner, *self.final}}
        left: dict[int, int] = {}
        reach: dict[int, int] = {}
        most = 0
        for u, v, new in rules:
            if u not in length or v not in length:
                raise ValueError("a merge uses a token that no earlier merge makes")
            came, spine = 0, v
            while True:
                came = max(came, reach.get(spine, 0))
                if spine not in left:
                    break
                spine = left[spine]
            total = came + length[u]
            reach[u] = max(reach.get(u, 0), total)
            most = max(most, total)
            if new not in length:
                length[new] = length[u] + length[v]
                left[new] = u
        return most + 1

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merges by rank, each from left to right, until none applies."""
        get, none = self.pair.get, _NONE
        found = [get(two, none) for two in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best == none:
                break
            i = found.index(best)
            ids[i : i + 2] = [best & _ID]
            del found[i]
            if i < len(found):
                found[i] = get((ids[i], ids[i + 1]), none)
            if i:
                found[i - 1] = get((ids[i - 1], ids[i]), none)
        return ids


class PieceTransducer:
    """Encodes one piece given byte by byte; tokens come out once no later byte can change them."""

    def __init__(self, merges: Merges, sizes: list[int]):
        """sizes: the bytes that each token covers."""
        self.merges, self.sizes = merges, sizes
        self.window = merges.lookahead + STRIDE
        self.held: list[int] = []  # bytes from the last final boundary on

    def feed(self, data: bytes) -> Iterator[int]:
        """The last byte stays back: it may turn out to end the piece."""
        for at in range(0, len(data), STRIDE):
            self.held += data[at : at + STRIDE]
            if len(self.held) > self.window:
                inner = self.merges.inner
                tokens = self.merges.merge([x for x in (inner[b] for b in self.held[:-1]) if x >= 0])
                stable, done = len(self.held) - 1 - self.merges.lookahead, 0
                for t in tokens:
                    if done + self.sizes[t] > stable:
                        break
                    done += self.sizes[t]
                    yield t
                del self.held[:done]

    def finish(self) -> list[int]:
        if not self.held:
            return []
        ids = [self.merges.inner[b] for b in self.held[:-1]] + [self.merges.final[self.held[-1]]]
        self.held = []
        return self.merges.merge([x for x in ids if x >= 0])


class Bpe:
    """A byte-level BPE vocabulary with a word-end suffix, read from a tokenizers file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.merges = Merges(model["vocab"], merges, self.suffix)
        self.tokens = [""] * (1 + max([*model["vocab"].values(), *self.special.values()]))
        for token, k in [*model["vocab"].items(), *self.special.items()]:
            self.tokens[k] = token
        #: Bytes that each token covers (one stand-in character for each byte).
        self.sizes = [len(t.removesuffix(self.suffix)) if self.suffix else len(t) for t in self.tokens]
        for k in self.special.values():
            self.sizes[k] = 0
        self.decimal = [b"%d" % k for k in range(len(self.tokens))]
        self._standing: dict[bool, _Standing] = {}
        self._pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self._special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def _normalise(self, text: str) -> str:
        text = _SPACE.sub(" ", unicodedata.normalize("NFC", text))
        if "Σ" in text:  # lower case character by character: no final form
            return "".join(c.lower() for c in text)
        return text.lower()

    def _piece(self, piece: bytes) -> list[int]:
        one = PieceTransducer(self.merges, self.sizes)
        return [*one.feed(piece), *one.finish()]

    def standing(self, spaced: bool) -> _Standing:
        """Where decoding begins: the first token has no space before it."""
        if spaced not in self._standing:
            tokens, clean = token_bytes(self, spaced), Utf8Machine().state
            rest = _Standing(tokens, b" " if spaced else b"", clean)
            self._standing[spaced] = _Standing(tokens, b"", clean, rest) if spaced else rest
        return self._standing[spaced]

    def encode_piece(self, part: bytes) -> list[int]:
        """A chunk's part. One of lower-case ASCII letters, or of ASCII signs only, is one piece."""
        if part.isascii() and b"'" not in part and (part.isalpha() and part.islower() or not any(c < 128 and chr(c).isalnum() for c in part)):
            return self._piece(part)
        return self.encode(part.decode("utf-8"))

    def _plain(self, text: str) -> Iterator[int]:
        for m in self._pieces.finditer(self._normalise(text)):
            yield from self._piece(m[0].encode("utf-8", "replace"))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        at = 0
        for m in self._special.finditer(text) if self._special else ():
            out += [*self._plain(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        out += self._plain(text[at:])
        return out

    def encode_chunks(self, chunks: list[bytes]) -> list[bytes]:
        """For the memo: chunks without white space, as packed ids."""
        return [array("I", self.encode_piece(c)).tobytes() for c in chunks]

    def memo(self) -> ChunkMemo:
        return ChunkMemo(self.encode_chunks, keep=tuple(x.encode() for x in self.special))


class Utf8Machine:
    """Byte-to-text state machine: bytes in, text out as soon as a character is complete.

    Its state is the number of continuation bytes awaited, the range allowed for the next one and
    the character's bytes so far. A byte that cannot continue gives U+FFFD and is read afresh.
    """

    #: First byte's range, continuation bytes, and the second byte's range.
    LEADS = (
        (0xC2, 0xDF, 1, 0x80, 0xBF),
        (0xE0, 0xE0, 2, 0xA0, 0xBF),
        (0xE1, 0xEC, 2, 0x80, 0xBF),
        (0xED, 0xED, 2, 0x80, 0x9F),
        (0xEE, 0xEF, 2, 0x80, 0xBF),
        (0xF0, 0xF0, 3, 0x90, 0xBF),
        (0xF1, 0xF3, 3, 0x80, 0xBF),
        (0xF4, 0xF4, 3, 0x80, 0x8F),
    )

    def __init__(self, state: tuple[int, int, int, bytes] = (0, 0x80, 0xBF, b"")) -> None:
        self.wait, self.low, self.high, part = state
        self.part = bytearray(part)

    @property
    def state(self) -> tuple[int, int, int, bytes]:
        return self.wait, self.low, self.high, bytes(self.part)

    def feed(self, data: Iterable[int]) -> str:
        out: list[str] = []
        for b in data:
            if self.wait:
                if self.low <= b <= self.high:
                    self.part.append(b)
                    self.wait, self.low, self.high = self.wait - 1, 0x80, 0xBF
                    if not self.wait:
                        out.append(self.part.decode())
                        self.part.clear()
                    continue
                out.append("�")
                self.wait = 0
                self.part.clear()
            if b < 0x80:
                out.append(chr(b))
                continue
            for a, z, n, low, high in self.LEADS:
                if a <= b <= z:
                    self.wait, self.low, self.high = n, low, high
                    self.part.append(b)
                    break
            else:
                out.append("�")
        return "".join(out)

    def finish(self) -> str:
        left, self.wait = self.wait, 0
        self.part.clear()
        return "�" if left else ""


class _Standing(dict):
    """Where the byte machine stands between two tokens.

    Maps an id to the text that its bytes complete from here and to where the machine then stands.
    The machine runs over a token's bytes when the token is first met in a place; what it does from
    the places between characters is kept, at most one entry for each token.
    """

    def __init__(self, tokens: list[bytes], lead: bytes, state: tuple, rest: _Standing | None = None):
        super().__init__()
        self.tokens, self.lead, self.state, self.rest = tokens, lead, state, self if rest is None else rest

    def __missing__(self, k: int) -> tuple[str, _Standing]:
        data = self.tokens[k] if 0 <= k < len(self.tokens) else b""
        if not data:
            return "", self
        machine = Utf8Machine(self.state)
        text = machine.feed(self.lead + data)
        clean = not machine.wait
        out = text, self.rest if clean else _Standing(self.tokens, self.rest.lead, machine.state, self.rest)
        if not self.state[0]:
            self[k] = out
        return out


class Decoder:
    """Ids to text, id by id, in constant memory.

    spaced: what the tokenizers library gives for a file without a decoder, the tokens' own
    strings with a space between. Otherwise the text itself: bytes for stand-ins, and a space for
    each word end. Unknown ids give nothing.
    """

    def __init__(self, bpe: Bpe, spaced: bool = False):
        self.at = bpe.standing(spaced)

    def feed(self, ids: Iterable[int]) -> str:
        out, at = [], self.at
        for k in ids:
            text, at = at[k]
            out.append(text)
        self.at = at
        return "".join(out)

    def finish(self) -> str:
        return Utf8Machine(self.at.state).finish()


def token_bytes(bpe: Bpe, spaced: bool) -> list[bytes]:
    """What each id adds to a decoded text."""
    if spaced:
        return [t.encode() for t in bpe.tokens]
    back = {c: b for b, c in byte_alphabet().items()}
    special = set(bpe.special.values())
    out = []
    for k, t in enumerate(bpe.tokens):
        end = bool(bpe.suffix) and t.endswith(bpe.suffix)
        body = t.removesuffix(bpe.suffix) if end else t
        out.append(t.encode() if k in special else bytes(back[c] for c in body) + b" " * end)
    return out


_loaded: dict[str, tuple[Bpe, ChunkMemo]] = {}


def _load(path: str) -> tuple[Bpe, ChunkMemo]:
    if path not in _loaded:
        bpe = Bpe(path)
        _loaded[path] = bpe, bpe.memo()
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids of every whole text (null: empty, no ids); one row per input row. No shuffle."""
    limit_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, memo = _load(path)
        for batch in batches:
            ids, ends = memo.encode(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "ids"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, spaced: bool = False) -> DataFrame:
    """doc_id and the text that the ids give (see Decoder); null ids give the empty text."""
    limit_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = _load(path)
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                d = Decoder(bpe, spaced)
                texts.append(d.feed(ids or ()) + d.finish())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Ids that are decoded and digested at a time.
SEGMENT = 4096


class _Digest:
    """Digests of one text's ids and of what they decode to, fed SEGMENT ids at a time."""

    def __init__(self, bpe: Bpe):
        self.decimal, self.decoder = bpe.decimal.__getitem__, Decoder(bpe, spaced=True)
        self.numbers, self.text, self.n = hashlib.sha256(), hashlib.sha256(), 0

    def feed(self, ids: np.ndarray) -> None:
        for at in range(0, len(ids), SEGMENT):
            some = ids[at : at + SEGMENT].tolist()
            said = b" ".join(map(self.decimal, some))
            self.numbers.update(b" " + said if self.n else said)
            self.text.update(self.decoder.feed(some).encode())
            self.n += len(some)

    def finish(self) -> tuple[int, str, str]:
        self.text.update(self.decoder.finish().encode())
        return self.n, self.numbers.hexdigest(), self.text.hexdigest()


def digests(bpe: Bpe, ids: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[str], list[str]]:
    """For each run of ids: how many, and digests of the decimal ids and of the text that they decode to."""
    out = []
    for a, z in zip(ends.tolist(), ends[1:].tolist(), strict=False):
        d = _Digest(bpe)
        d.feed(ids[a:z])
        out.append(d.finish())
    n, ids_sha, text_sha = zip(*out, strict=True) if out else ((), (), ())
    return list(n), list(ids_sha), list(text_sha)


def digest_texts(bpe: Bpe, memo: ChunkMemo, texts: pa.Array) -> tuple[list[int], list[str], list[str]]:
    """digests of the texts' ids, which are let go window by window: a text of any length is never held as ids."""
    open_text, d, out = 0, _Digest(bpe), []
    for ids, counts in memo.windows(texts):
        at = 0
        for k in np.flatnonzero(counts).tolist():
            while open_text < k:
                out.append(d.finish())
                open_text, d = open_text + 1, _Digest(bpe)
            d.feed(ids[at : at + counts[k]])
            at += int(counts[k])
    while open_text < len(texts):
        out.append(d.finish())
        open_text, d = open_text + 1, _Digest(bpe)
    n, ids_sha, text_sha = zip(*out, strict=True) if out else ((), (), ())
    return list(n), list(ids_sha), list(text_sha)


def _digest_batch(doc_ids: pa.Array, found: tuple[list[int], list[str], list[str]]) -> pa.RecordBatch:
    n, ids_sha, text_sha = found
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def token_digests(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of encoded documents (doc_id, ids); null ids are no ids."""
    limit_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = _load(path)
        for batch in batches:
            lists = batch.column(1)
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
            yield _digest_batch(batch.column(0), digests(bpe, lists.flatten().to_numpy(zero_copy_only=False), ends))

    return encoded.mapInArrow(run, _DIGESTS)


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """token_digests of encode_documents in one step, so that ids need not leave the task.

    One row per input row: a null or empty text has no ids and decodes to the empty text; an empty
    table gives no rows. New pieces go through the transducer, all ids through the decoder.
    """
    limit_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, memo = _load(path)
        for batch in batches:
            yield _digest_batch(batch.column(0), digest_texts(bpe, memo, batch.column(1)))

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, _DIGESTS)
