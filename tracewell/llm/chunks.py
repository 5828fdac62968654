"""A bounded memo of encoded chunks, for tokenizers whose tokens never cross white space."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex

from tracewell.llm.windows import LOWER, binary_spans, distinct_bytes, flat_bytes, window_ends

#: Chunks kept before the older generation goes (twice as many pieces), and the longest that are kept.
MOST, LONGEST = 120_000, 48
_ASCII_PIECES = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+")
_PIECES = regex.compile(r"\p{L}+|\p{N}|[^\p{L}\p{N}]+")


def _pieces(chunk: bytes, keep: tuple[bytes, ...] = ()) -> list[bytes]:
    """A chunk's parts between which no token lies: runs of letters, single digits, runs of signs.

    Chunks that hold one of the strings in keep (special tokens, which begin with < and are matched before folding), or
    would when folded, stay as they are. Chunks with an apostrophe (contractions), or that composing or
    lower-casing would change in kind, stay whole. Of the others, only parts that are ASCII are folded:
    folded as a whole, a letter could compose with the mark after it.
    """
    if chunk.isalpha():  # ASCII letters
        return [chunk.lower()]
    low = chunk.lower()
    if any([x in low for x in keep]):
        return [chunk]
    if chunk.isascii():
        return [low] if b"'" in low else _ASCII_PIECES.findall(low)
    text = chunk.decode("utf-8")
    if text.isalpha() or "'" in text or "İ" in text or not unicodedata.is_normalized("NFC", text):
        return [chunk]
    return [p.encode().lower() if p.isascii() else p.encode() for p in _PIECES.findall(text)]


#: Kinds of bytes: white space, letters, digits, signs, and those that need a look at their whole chunk.
_SPACE, _LETTER, _DIGIT, _SIGN, _ODD = range(5)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[33:127] = _SIGN
_KIND[[32, *range(9, 14)]] = _SPACE
_KIND[48:58] = _DIGIT
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[[ord("'"), ord("<")]] = _ODD


#: What a window's cut gives: its parts as binary, and the number of each part's text.
Parts = tuple[pa.Array, np.ndarray]


def cut_parts(texts: pa.Array) -> Iterator[Parts]:
    """Texts' parts as binary and the number of each part's text, in windows of bounded size.

    Parts are lower-case runs of ASCII letters, single digits, runs of ASCII signs, and whole chunks
    that hold any other byte, an apostrophe or a "<" (with which special tokens begin). Windows are cut at white space.
    """
    raw_all, bounds_all = flat_bytes(texts)
    for lo, hi in window_ends(raw_all, bounds_all, lambda here, _: _KIND[here] == _SPACE):
        raw = raw_all[lo:hi]
        begin = np.zeros(len(raw), bool)
        begin[bounds_all[np.searchsorted(bounds_all, lo) : np.searchsorted(bounds_all, hi)] - lo] = True
        kind = _KIND[raw]
        inside = kind != _SPACE
        low = LOWER[raw]
        odd = kind == _ODD
        if odd.any():
            first = inside.copy()
            first[1:] &= ~inside[:-1] | begin[1:]
            odd = _whole_chunks(first, odd) & inside
            kind[odd] = _ODD
            low[odd] = raw[odd]
        new = np.ones(len(raw), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT) | begin[1:]
        starts = np.flatnonzero(new & inside)
        at = (np.cumsum(inside, dtype=np.int64) - 1)[starts]
        yield binary_spans(low[inside], at), np.searchsorted(bounds_all, starts + lo, side="right") - 1


def _whole_chunks(first: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """Which bytes lie in a chunk that has a marked byte; chunks begin where first is true."""
    chunk = np.cumsum(first, dtype=np.int32)
    has = np.zeros(int(chunk[-1]) + 1, bool)
    has[chunk[marked]] = True
    return has[chunk]


#: Bytes before which a cut is safe, after white space: no sign of a Unicode space begins with them, nor a special token.
_SAFE = np.zeros(256, bool)
_SAFE[33:127] = _SAFE[0xC3:0xE0] = True
_SAFE[ord("<")] = False


def cut_byte_parts(texts: pa.Array) -> Iterator[Parts]:
    """The same for byte-level vocabularies, whose pieces take a space before them along; parts cover all bytes.

    A chunk begins at the last white space before other signs, if the byte after it is a safe one. Chunks of ASCII and
    Latin letters, digits and signs are cut where the vocabulary's pieces end: between runs of a kind,
    of which the first takes a space before it along. Chunks with any other byte, an apostrophe or
    a "<" stay whole.
    """
    raw_all, bounds_all = flat_bytes(texts)
    for lo, hi in window_ends(raw_all, bounds_all, lambda here, after: (_KIND[here] == _SPACE) & _SAFE[after]):
        raw = raw_all[lo:hi]
        n = len(raw)
        begin = np.zeros(n, bool)
        begin[bounds_all[np.searchsorted(bounds_all, lo) : np.searchsorted(bounds_all, hi)] - lo] = True
        kind = _KIND[raw]
        latin = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7))
        kind[latin] = kind[latin + 1] = _LETTER
        space = kind == _SPACE
        chunk = begin.copy()
        chunk[0] = True
        chunk[:-1] |= space[:-1] & _SAFE[raw[1:]] & ~begin[1:]
        whole = _whole_chunks(chunk, kind == _ODD)
        change = begin.copy()
        change[0] = True
        change[1:] |= kind[1:] != kind[:-1]
        joined = np.flatnonzero(chunk[:-1] & (raw[:-1] == 32) & ~space[1:] & ~begin[1:]) + 1
        change[joined] = False
        starts = np.flatnonzero(chunk | change & ~whole)
        yield binary_spans(raw, starts), np.searchsorted(bounds_all, starts + lo, side="right") - 1


class _Generations:
    """A dict of bounded size: when the younger half is full, the older half is dropped."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def missing(self, keys: list[bytes]) -> list[bytes]:
        """The keys that neither half holds; those of the older half move to the younger."""
        young, old = self.young, self.old
        out = []
        for k in keys:
            if k not in young:
                if k in old:
                    young[k] = old[k]
                else:
                    out.append(k)
        return out

    def trim(self, new: list[bytes]) -> None:
        for k in new:
            if len(k) > LONGEST:
                self.young.pop(k, None)
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}


class ChunkMemo:
    """Encodes texts chunk by chunk; a chunk lies between ASCII white space.

    Sound for a vocabulary whose pieces hold no white space and are runs of letters, digits or runs
    of signs, after composing and lower-casing. A batch's texts are cut and its parts told apart in
    numpy and Arrow, so Python sees each distinct part of a batch once; encode_new gets pieces that
    are new.
    """

    def __init__(self, encode_new: Callable[[list[bytes]], list[bytes]], keep: tuple[bytes, ...] = (), most: int = MOST, cut: Callable[[pa.Array], Iterator[Parts]] = cut_parts, pieces: Callable[[bytes], list[bytes]] | None = None):
        self.encode_new, self.cut = encode_new, cut
        self.pieces = pieces or (lambda chunk: _pieces(chunk, keep))
        self.chunks, self.parts = _Generations(most), _Generations(2 * most)

    def windows(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, how many of them each text has) window by window; a text's ids may come in several windows. Null: empty."""
        for parts, text_no in self.cut(texts):
            told, index = distinct_bytes(parts)
            packed = self._packed(told)
            sizes = np.array([len(x) >> 2 for x in packed], np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            lists = pa.LargeListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(b"".join(packed), np.uint32)))
            ids = lists.take(pa.array(index)).flatten().to_numpy() if len(index) else np.zeros(0, np.uint32)
            n = np.zeros(len(texts), np.int64)
            np.add.at(n, text_no, sizes[index])
            yield ids, n

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): all texts' ids one after the other, and where each text begins and the last ends. Null: empty."""
        found, n = [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64)
        for ids, some in self.windows(texts):
            found.append(ids)
            n += some
        return (found[-1] if len(found) == 2 else np.concatenate(found)), np.concatenate([[0], np.cumsum(n)])

    def _packed(self, chunks: list[bytes]) -> list[bytes]:
        known, parts = self.chunks, self.parts
        missing = known.missing(chunks)
        new: list[bytes] = []
        if missing:
            cut = list(map(self.pieces, missing))
            new = parts.missing(list({p: None for s in cut for p in s}))
            got = parts.young
            got.update(zip(new, self.encode_new(new), strict=True))
            known.young.update((c, got[s[0]] if len(s) == 1 else b"".join([got[p] for p in s])) for c, s in zip(missing, cut, strict=True))
        out = list(map(known.young.__getitem__, chunks))
        known.trim(missing)
        parts.trim(new)
        return out
