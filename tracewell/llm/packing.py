"""Best-fit packing of token sequences by exact complements.

1. Texts are encoded where they are read; a document of more than SIZE tokens is cut into pieces. A
   piece is a row of its length and checksum; its ids do not leave the task.
2. What is packed are lengths, of which there are at most SIZE: a histogram, whatever the number
   of pieces. Sums of one, two and three lengths are indexed by the gap that they fill exactly; such
   fillings are used up as often as pieces of their lengths are left. What remains is put by best fit,
   longest first, equal bins at a time. The plan says how often each filling of a sequence occurs.
3. Each piece has a number among those of its length: its place in its task, plus the pieces of that
   length in tasks before. By that number the plan gives its sequence and its place there.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.chunks import ChunkMemo, cut_byte_parts
from tracewell.llm.common import limit_batches, written

#: Tokens of a sequence, and the id that ends each document.
SIZE, END_ID = 1024, 2
#: What part of the longest piece that fits a gap the longest part of a pair or triple has at least.
NEAR = 0.9
#: Chunks that a worker's memo keeps of each generation.
MEMO = 180_000

Filling = tuple[int, ...]


class Supply:
    """How many pieces of each length are left, and which lengths fill a gap exactly."""

    def __init__(self, counts: dict[int, int]):
        self.left = {k: n for k, n in sorted(counts.items()) if n > 0}

    def take(self, filling: Filling, times: int) -> None:
        for k, n in Counter(filling).items():
            self.left[k] -= n * times
            if not self.left[k]:
                del self.left[k]

    def times(self, filling: Filling) -> int:
        """How often the filling can be had from what is left."""
        return min(self.left.get(k, 0) // n for k, n in Counter(filling).items())


def exact_fillings(left: dict[int, int], first: int, parts: int, size: int) -> Iterator[Filling]:
    """Fillings of a sequence by a piece of length first and so many parts, none longer than the one before it.

    The longest part of a pair or triple is nearly as long as any piece that fits, as long pieces are
    the hard ones to place. Complements are looked up among the lengths that are left, also while they are used up: a single
    by the gap, pairs and triples by what their first one or two lengths leave of it.
    """
    gap = size - first
    if parts == 1:
        if 0 < gap <= first and gap in left:
            yield first, gap
        return
    lengths = sorted((k for k in left if k <= min(first, gap)), reverse=True)
    longest = max((k for k in left if k <= gap), default=0)
    for i, second in enumerate(lengths):
        if second < NEAR * longest or second * parts < gap:
            break
        if second not in left:
            continue
        rest = gap - second
        if parts == 2:
            if 0 < rest <= second and rest in left:
                yield first, second, rest
            continue
        for third in lengths[i:]:
            if 2 * third < rest:
                break
            if 0 < rest - third <= third and rest - third in left and third in left:
                yield first, second, third, rest - third


def plan_fillings(counts: dict[int, int], size: int = SIZE) -> list[tuple[Filling, int]]:
    """(filling, how many sequences have it) for pieces of 1 to size tokens, so many of each length.

    First full sequences: whole pieces, then pieces with their exact complements of one, two
    and three lengths, longest first, each as often as can be. Then best fit: the longest piece left goes to the fullest
    open sequence that takes it. Complements of two and three lengths can use up short pieces that best
    fit would put better, so the plan with complements of one length only is made too, and the one of fewer
    sequences is kept. Work depends on the number of different lengths only.
    """
    plans = [_plan(counts, size, parts) for parts in ((1, 2, 3), (1,))]
    return min(plans, key=lambda plan: sum(n for _, n in plan))


def _plan(counts: dict[int, int], size: int, parts: tuple[int, ...]) -> list[tuple[Filling, int]]:
    supply, plan = Supply(counts), []

    def use(filling: Filling) -> None:
        if n := supply.times(filling):
            supply.take(filling, n)
            plan.append((filling, n))

    if size in supply.left:
        use((size,))
    for k in parts:
        for first in sorted(supply.left, reverse=True):
            for filling in exact_fillings(supply.left, first, k, size):
                if first not in supply.left:
                    break
                use(filling)
    return plan + best_fit(supply.left, size)


def best_fit(counts: dict[int, int], size: int = SIZE) -> list[tuple[Filling, int]]:
    """Best fit, longest first. Open sequences with the same filling are one entry with a count."""
    gaps: list[int] = []
    open_bins: dict[int, dict[Filling, int]] = defaultdict(dict)

    def put(filling: Filling, gap: int, n: int) -> None:
        if gap not in open_bins:
            insort(gaps, gap)
        open_bins[gap][filling] = open_bins[gap].get(filling, 0) + n

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(gaps, length)
            if at == len(gaps):  # new sequences, each as full of this length as best fit makes it
                each = min(size // length, n)
                put((length,) * each, size - each * length, n // each)
                n %= each
                continue
            gap = gaps[at]
            filling, bins = next(iter(open_bins[gap].items()))
            each = min(gap // length, n)
            used = min(bins, n // each)
            del open_bins[gap][filling]
            if bins > used:
                open_bins[gap][filling] = bins - used
            if not open_bins[gap]:
                del open_bins[gap]
                gaps.pop(at)
            put(filling + (length,) * each, gap - each * length, used)
            n -= used * each
    return [(f, n) for bins in open_bins.values() for f, n in bins.items()]


class Places:
    """Where the plan puts the pieces of each length, by their number among them."""

    def __init__(self, plan: list[tuple[Filling, int]], size: int = SIZE):
        taken: Counter[int] = Counter()
        rows, sequence = [], 0
        for filling, n in plan:
            offset = 0
            for length in filling:
                rows.append((length, taken[length], sequence, offset))
                taken[length] += n
                offset += length
            sequence += n
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 4)
        self.sequences = sequence
        self.key, self.first = table[:, 0] << 48 | table[:, 1], table[:, 1]
        self.sequence, self.offset = table[:, 2], table[:, 3]

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces of these lengths and numbers."""
        at = np.searchsorted(self.key, length << 48 | number, side="right") - 1
        return self.sequence[at] + number - self.first[at], self.offset[at]


_memos: dict[str, ChunkMemo] = {}


def byte_memo(path: str) -> ChunkMemo:
    """The tokenizers library's encoding of whole texts for a byte-level vocabulary, chunk by chunk."""
    if path not in _memos:
        import json

        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        pre = spec["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or spec.get("normalizer") or any(not t["content"].startswith("<") or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("the vocabulary's pieces may cross the places where chunks are cut")
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        def encode(chunks: list[bytes]) -> list[bytes]:
            return [np.array(e.ids, np.uint32).tobytes() for e in tokenizer.encode_batch_fast([c.decode("utf-8") for c in chunks], add_special_tokens=False)]

        _memos[path] = ChunkMemo(encode, most=MEMO, cut=cut_byte_parts, pieces=lambda chunk: [chunk])
    return _memos[path]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long"


def cut_pieces(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Each document's pieces, one row for each: doc_id, piece, start, length, ids_crc32, task, number.

    A document is its text's ids and end_id. One of more than size tokens is cut so that all pieces
    but the first have size tokens. number counts a task's pieces of the same length from 0.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    limit_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            ids, ends = byte_memo(path).encode(batch.column(1))
            raw, end = memoryview(ids.astype("<u4", copy=False).tobytes()), end_id.to_bytes(4, "little")
            n = np.diff(ends) + 1
            pieces = -(-n // size)
            doc = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            head = (n - (pieces - 1) * size)[doc]
            start = np.where(piece == 0, 0, head + (piece - 1) * size)
            length = np.where(piece == 0, head, size)
            last = piece == pieces[doc] - 1
            begin = ends[doc] + start
            crc = [zlib.crc32(end, c) if z else c for c, z in zip((zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(begin.tolist(), (length - last).tolist(), strict=True)), last.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            by = length[order]
            number = np.empty(len(by), np.int64)
            number[order] = np.arange(len(by)) - np.searchsorted(by, by) + seen[by]
            seen += np.bincount(by, minlength=size + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), batch.column(2).take(pa.array(doc)), pa.array(number)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"],
            )

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("task", F.spark_partition_id())
    return picked.mapInArrow(run, _PIECES)


def pack_documents(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Every piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is a document of end_id alone; null ids and rows that repeat an id are
    documents of their own; an empty table gives no rows. Sequences are numbered from 0 and filled
    from offset 0 without gaps. Columns other than doc_id and text are not read.
    """
    result = ["doc_id", "piece", "start", "length", "ids_crc32"]
    pieces = written(cut_pieces(docs, path, size, end_id), "pieces")
    tasks = written(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-lengths")
    counts = {r.length: r.n for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # size rows at most
    places = Places(plan_fillings(counts, size), size)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tasks.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = pieces.join(offsets, ["task", "length"]).select(*result, (F.col("number") + F.col("before")).alias("number"))
    table = docs.sparkSession.sparkContext.broadcast(places)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            sequence, offset = table.value.of(length, number)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*result, "sequence_id", "offset"])

    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
