"""Texts of an Arrow batch as one run of bytes, worked through in windows of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a window, about: it ends at the next place where a cut is allowed.
WINDOW = 1 << 20
_LOOK = 1 << 16
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each begins and the last ends). Null: empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def window_ends(raw: np.ndarray, bounds: np.ndarray, may_cut: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int | None = None) -> Iterator[tuple[int, int]]:
    """(begin, end) of windows that cover raw, about size bytes each.

    A cut is allowed where a text begins and before bytes for which may_cut(byte, next byte) holds;
    a window without such a place grows until there is one.
    """
    size, n, begin = size or WINDOW, len(raw), 0
    while begin < n:
        end = min(begin + size, n)
        text_end = int(bounds[np.searchsorted(bounds, end)])
        while end < text_end:
            stop = min(end + _LOOK, text_end - 1)  # the next byte must be of the same text
            hits = np.flatnonzero(may_cut(raw[end:stop], raw[end + 1 : stop + 1]))
            if len(hits):
                end += int(hits[0])
                break
            end = stop if stop < text_end - 1 else text_end
        yield begin, end
        begin = end


def binary_spans(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """data cut at starts (the first is 0), as binary."""
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)])


def word_windows(texts: pa.Array, of_words: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(words, number of each word's text) window by window, in order.

    Words are longest runs of bytes for which of_words (256 truth values) holds, with A-Z lower-cased;
    no word lies in two texts or two windows.
    """
    raw, bounds = flat_bytes(texts)
    for begin, end in window_ends(raw, bounds, lambda here, _: ~of_words[here]):
        part = raw[begin:end]
        inside = of_words[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        begins = bounds[np.searchsorted(bounds, begin) : np.searchsorted(bounds, end)] - begin
        first[begins] = inside[begins]
        starts = np.flatnonzero(first)
        at = (np.cumsum(inside) - 1)[starts]
        yield binary_spans(LOWER[part[inside]], at), np.searchsorted(bounds, starts + begin, side="right") - 1


def letters_and_beyond(digits: bool) -> np.ndarray:
    """The bytes of words: ASCII letters, all of non-ASCII characters and, if digits, 0-9."""
    out = np.zeros(256, bool)
    out[65:91] = out[97:123] = out[128:] = True
    out[48:58] = digits
    return out


def distinct_bytes(words: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """(distinct words, each word's place among them)."""
    told = pc.dictionary_encode(words)
    _, offsets, data = told.dictionary.buffers()
    at = np.frombuffer(offsets, np.int64)[: len(told.dictionary) + 1].tolist() if len(told.dictionary) else [0]
    raw = data.to_pybytes() if data is not None else b""
    return [raw[a:z] for a, z in zip(at, at[1:])], told.indices.to_numpy(zero_copy_only=False)
