"""Benchmark decontamination by multi-pattern search over words, after Wu and Manber.

Each benchmark item gives windows of consecutive words. Windows of one length form a search
table: a shift for each block of two words that occurs in a window (how far the search may jump),
and buckets keyed by a window's last block that list the windows to compare. A block that is in no
window lets the search jump almost a whole window ahead, so most of a text is never looked at.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import limit_batches, written

#: Words are runs of these bytes after lower-casing A-Z; all others separate words.
_FOLD = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
#: Benchmark text (bytes) of one search table, about 60 times as much in a worker's memory; more is searched in several passes.
TABLE_BYTES = 4 << 20
#: Windows of a bucket that are compared one by one; more are told apart by a checksum first.
MOST = 8


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


class _Table:
    """Search table for the windows of one length; windows are places in one list of words."""

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.words: list[bytes] = []
        self.begins: list[int] = []  # where each item's words begin
        self.items: list[str | None] = []
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, array] = {}
        self.deep: dict[bytes, dict[int, array]] = {}

    def add(self, ws: list[bytes], item: str | None) -> None:
        """All windows of an item; ws holds at least one."""
        base, size, m = len(self.words), self.block, self.length
        self.begins.append(base)
        self.items.append(item)
        self.words += ws
        for end in range(size, len(ws) + 1):
            key = b" ".join(ws[end - size : end])
            step = max(0, m - end)  # from the m-th word on, every block ends a window
            old = self.shift.get(key)
            if old is None or step < old:
                self.shift[key] = step
            if step == 0:
                self.buckets.setdefault(key, array("q")).append(base + end - m)

    def split_hot_buckets(self) -> None:
        """Buckets of more than MOST windows are told apart by the checksum of the whole window; of equal windows of an item one stays."""
        for key in [k for k, ps in self.buckets.items() if len(ps) > MOST]:
            parts = self.deep[key] = {}
            seen = set()
            for p in self.buckets.pop(key):
                window = b" ".join(self.words[p : p + self.length])
                item = bisect_right(self.begins, p)
                if (window, item) not in seen:
                    seen.add((window, item))
                    parts.setdefault(zlib.crc32(window), array("q")).append(p)

    def _to_compare(self, key: bytes, here: list[bytes], met: set[bytes]) -> tuple[int, ...] | array:
        """Places of the windows that may equal these words; one that does, if the text has had these words before."""
        parts = self.deep.get(key)
        if parts is None:
            return self.buckets[key]
        window = b" ".join(here)
        found = parts.get(zlib.crc32(window), ())
        if len(found) > MOST:
            if window in met:
                return next(((p,) for p in found if self.words[p : p + self.length] == here), ())
            met.add(window)
        return found

    def search(self, ws: list[bytes], hit: bytearray, items: set[str | None]) -> None:
        """Mark the words inside every occurrence and collect the items that occur."""
        m, shift, n, known = self.length, self.shift, len(ws), self.words
        met: set[bytes] = set()
        i, far, single = m - 1, m - self.block + 1, self.block == 1
        while i < n:
            key = ws[i] if single else ws[i - 1] + b" " + ws[i]
            step = shift.get(key, far)
            if step:
                i += step
                continue
            here = ws[i - m + 1 : i + 1]
            for p in self._to_compare(key, here, met):
                if known[p : p + m] == here:
                    hit[i - m + 1 : i + 1] = b"\x01" * m
                    items.add(self.items[bisect_right(self.begins, p) - 1])
            i += 1


class WindowSearch:
    """Every window of every item, in one table for each window length."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = 10):
        self.tables: dict[int, _Table] = {}
        same: dict[bytes, bytes] = {}  # one object for each word
        for item, text in items:
            ws = [same.setdefault(w, w) for w in words(text)]
            m = min(window, len(ws))
            if m:
                self.tables.setdefault(m, _Table(m)).add(ws, item)
        for t in self.tables.values():
            t.split_hot_buckets()

    def look(self, text: str | None) -> tuple[list[bytes], bytearray, set[str]]:
        ws = words(text)
        hit, items = bytearray(len(ws)), set()
        for t in self.tables.values():
            t.search(ws, hit, items)
        return ws, hit, items


def _slices(benchmark: DataFrame) -> Iterator[tuple[list[tuple[str | None, str | None]], bool]]:
    """The benchmark's items in slices of bounded size, and whether the slice is the last.

    The size is measured first. Items are dealt by a hash, so each slice is a separate, small read.
    """
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.length("item"), F.lit(0)))).first()[0] or 0
    n = max(1, -(-total // TABLE_BYTES))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r.item, r.text) for r in part.collect()], k == n - 1


def _search_in_turn(rows: DataFrame, benchmark: DataFrame, window: int, step, purpose: str) -> DataFrame:
    """step(rows, search table) for each slice; between slices rows are written, so one table is held at a time."""
    for items, last in _slices(benchmark):
        shared = rows.sparkSession.sparkContext.broadcast(WindowSearch(items, window))
        rows = step(rows, shared)
        if not last:
            rows = written(rows, purpose)
            shared.unpersist()
    return rows


_FOUND = "doc_id long, text string, n_words long, hit_words array<int>, items array<string>"


def _add_hits(rows: DataFrame, shared) -> DataFrame:
    """rows (of _FOUND) with this table's hits added to those that each row has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, hits, found = [], [], []
            for text, before, items_before in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                ws, hit, items = shared.value.look(text)
                n.append(len(ws))
                mine = [i for i, x in enumerate(hit) if x] if items else []
                hits.append(sorted({*mine, *before}) if before else mine)
                found.append(sorted({*items, *items_before}, key=lambda x: (x is None, x)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "text", "n_words", "hit_words", "items"])

    return rows.mapInArrow(run, _FOUND)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, hit_words array<int> (positions), items array<string>.

    One row per input row, also where rows repeat an id; no documents, no rows. Null and empty texts
    have no words; an item without words matches nothing; items without an id hit words as others do, and
    are listed as one null (counted, not digested); an empty benchmark hits nothing. Documents are not shuffled: the search table goes to the tasks. A benchmark of more than
    TABLE_BYTES is searched slice by slice; each slice adds to what a row has.
    """
    limit_batches(docs.sparkSession)
    none = [F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("hit_words"), F.array().cast("array<string>").alias("items")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *none)
    return _search_in_turn(rows, benchmark, window, _add_hits, "window-hits").drop("text")


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Counts and a digest of the items found, per document."""
    return find_contamination(docs, benchmark, window).select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of docs, all columns, whose text holds no window of a benchmark item.

    One pass without a shuffle when the benchmark fits one search table; otherwise one filter for
    each slice, so the document must be clean of them all. Rows with a null or empty text stay.
    """
    limit_batches(docs.sparkSession)
    schema, at = docs.schema, docs.columns.index("text")

    def keep(rows: DataFrame, shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not shared.value.look(t)[2] for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return rows.mapInArrow(run, schema)

    return _search_in_turn(docs, benchmark, window, keep, "window-clean")
