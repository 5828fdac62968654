"""How the sources of a language differ in the terms they use: an audit of a corpus.

1. Single-pass in-memory indexing. A task reads its documents once and keeps a block of postings in
   memory: for each (language, source, term), how often it occurs and in how many documents. When the
   block fills its memory it is spilled as a run sorted by term, cut into chunks by hash shard.
2. A shard's task gets its chunks in the order of their first terms and merges the runs by a heap, so
   that it holds one chunk of each run at a time. What comes out are the frequencies of the terms
   that enough documents of the language hold.
3. Scores of terms against their language are expressions over the frequencies. A pair of sources
   differs by a sum over all terms, most of which neither has: that sum is taken as if no term
   occurred, and corrections are streamed: for terms that one of the two has, by a histogram of
   counts, and for those that both have, added up in the tasks that hold the terms' rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import limit_batches, written
from tracewell.llm.windows import distinct_bytes, letters_and_beyond, word_windows

#: Documents of a language in which a term must occur, and the scale of the shares.
LEAST_DOCUMENTS, SCALE = 3, 1_000_000_000
#: Terms listed for each source (the report's length; pairs are all listed).
TOP_TERMS = 200
#: Bytes of postings that a block may take before it is spilled, and about so many terms of a chunk.
BLOCK_BYTES, CHUNK_TERMS = 96 << 20, 4096
#: Sums of pairs that a task holds before it hands them on.
PAIRS_HELD = 1 << 20
_TERMS = letters_and_beyond(digits=False)
_CHUNK = "shard int, first binary, langs array<string>, sources array<string>, terms array<binary>, sizes array<int>, groups array<int>, counts array<bigint>, docs array<bigint>"
_FREQUENCY = "lang string, term string, sources array<string>, counts array<bigint>"


def sums_by_key(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order and the sums of each of the values, in whole numbers."""
    if not len(key):
        return (key, *values)
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return (key[at], *[np.add.reduceat(v[order], at) for v in values])


class Block:
    """Postings in memory: for each (group, term), occurrences and documents. A group is a (language, source)."""

    def __init__(self) -> None:
        self.terms: dict[bytes, int] = {}
        self.groups: dict[tuple[str, str], int] = {}
        self.term_bytes = 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, texts: pa.Array, langs: list[str], sources: list[str]) -> None:
        found = []
        for words, text_no in word_windows(texts, _TERMS):
            told, place = distinct_bytes(words)
            ids = np.fromiter(map(self._id, told), np.int64, len(told))
            key, times = np.unique((text_no << 32) | ids[place], return_counts=True)
            found.append((key, times))
        if not found:
            return
        key, times = found[0] if len(found) == 1 else sums_by_key(np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found]))
        of_text = np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(langs, sources, strict=True)], np.int64)
        self.parts.append(sums_by_key((of_text[key >> 32] << 32) | (key & 0xFFFFFFFF), times.astype(np.int64), np.ones(len(key), np.int64)))
        if len(self.parts) > 1 and len(self.parts[-1][0]) * 2 > len(self.parts[0][0]) or len(self.parts) > 8:
            self._compact()

    def _id(self, term: bytes) -> int:
        k = self.terms.get(term)
        if k is None:
            k = self.terms[term] = len(self.terms)
            self.term_bytes += len(term)
        return k

    def _compact(self) -> None:
        self.parts = [sums_by_key(*[np.concatenate(x) for x in zip(*self.parts, strict=True)])]

    def size(self) -> int:
        """Bytes that the block takes, about: entries, terms and their table."""
        return 24 * sum(len(p[0]) for p in self.parts) + self.term_bytes + 130 * len(self.terms)

    def run(self, shards: int) -> Iterator[dict]:
        """The block as chunks of a run: by shard, then by term in the order of its bytes."""
        if not self.parts:
            return
        self._compact()
        key, counts, docs = self.parts[0]
        names = list(self.terms)
        shard = np.array([zlib.crc32(t) % shards for t in names], np.int64)
        order = sorted(range(len(names)), key=names.__getitem__)
        order = np.array(order, np.int64)
        order = order[np.argsort(shard[order], kind="stable")]
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        by = np.argsort(rank[key & 0xFFFFFFFF], kind="stable")
        group, counts, docs = (key >> 32)[by], counts[by], docs[by]
        ends = np.searchsorted(rank[key & 0xFFFFFFFF][by], np.arange(len(names) + 1))
        cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
        all_groups = list(self.groups)
        for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(names)]):
            for at in range(a, z, CHUNK_TERMS):
                to = min(at + CHUNK_TERMS, z)
                mine = slice(ends[at], ends[to])
                here, local = np.unique(group[mine], return_inverse=True)
                terms = [names[k] for k in order[at:to].tolist()]
                yield {
                    "shard": int(shard[order[at]]),
                    "first": terms[0],
                    "langs": [all_groups[g][0] for g in here.tolist()],
                    "sources": [all_groups[g][1] for g in here.tolist()],
                    "terms": terms,
                    "sizes": np.diff(ends[at : to + 1]).astype(np.int32),
                    "groups": local.astype(np.int32),
                    "counts": counts[mine],
                    "docs": docs[mine],
                }


_ARROW = pa.schema([("shard", pa.int32()), ("first", pa.binary()), ("langs", pa.list_(pa.string())), ("sources", pa.list_(pa.string())), ("terms", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())), ("groups", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))])


def merge_runs(chunks: Iterable[dict]) -> Iterator[tuple[bytes, list[tuple[str, str, int, int]]]]:
    """Terms in order with their postings (language, source, occurrences, documents), from chunks in the order of first terms.

    The heap holds, for each chunk that is open, its next term. A term is complete once a chunk
    comes that begins later, since chunks to come begin later still.
    """
    heap: list[tuple[bytes, int, int, dict]] = []
    serial = 0

    def below(limit: bytes | None) -> Iterator[tuple[bytes, list[tuple[str, str, int, int]]]]:
        while heap and (limit is None or heap[0][0] < limit):
            term, found = heap[0][0], []
            while heap and heap[0][0] == term:
                _, k, i, c = heap[0]
                for j in range(c["at"][i], c["at"][i + 1]):
                    g = c["groups"][j]
                    found.append((c["langs"][g], c["sources"][g], c["counts"][j], c["docs"][j]))
                if i + 1 < len(c["terms"]):
                    heapq.heapreplace(heap, (c["terms"][i + 1], k, i + 1, c))
                else:
                    heapq.heappop(heap)
            yield term, found

    for c in chunks:
        yield from below(c["first"])
        c["at"] = [0, *np.cumsum(c["sizes"]).tolist()]
        serial += 1
        heapq.heappush(heap, (c["first"], serial, 0, c))
    yield from below(None)


def kept_frequencies(chunks: Iterable[dict], least: int) -> Iterator[tuple[str, str, list[str], list[int]]]:
    """(language, term, sources, counts) of terms in at least so many of the language's documents."""
    for term, found in merge_runs(chunks):
        by_lang: dict[str, dict[str, int]] = {}
        docs: dict[str, int] = {}
        for lang, source, n, d in found:
            counts = by_lang.setdefault(lang, {})
            counts[source] = counts.get(source, 0) + n
            docs[lang] = docs.get(lang, 0) + d
        for lang, counts in by_lang.items():
            if docs[lang] >= least:
                yield lang, term.decode(), list(counts), list(counts.values())


def term_frequencies(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, term, sources, counts: how often each source has each term that its language keeps.

    docs: text, lang, source, of which null counts as ''. One row for each language and kept term. A
    text's terms are its longest runs of ASCII letters and non-ASCII characters, A-Z lower-cased;
    repeated rows are documents of their own; an empty table and texts without terms give no rows.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spill(block: Block) -> Iterator[pa.RecordBatch]:
            chunks = block.run(shards)
            while some := list(islice(chunks, 64)):
                yield pa.RecordBatch.from_pylist(some, _ARROW)

        block = Block()
        for batch in batches:
            block.add(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist())
            if block.size() > BLOCK_BYTES:
                yield from spill(block)
                block = Block()
        yield from spill(block)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard_of(rows: Iterator[dict]) -> Iterator[tuple[str, str, list[str], list[int]]]:
            """Shards follow each other in a task; each has its own heap."""
            row = next(rows, None)
            while row:
                shard, mine = row["shard"], [row]

                def same() -> Iterator[dict]:
                    yield mine.pop()
                    for r in rows:
                        if r["shard"] != shard:  # noqa: B023
                            mine.append(r)  # noqa: B023
                            return
                        yield r

                yield from kept_frequencies(same(), least)
                row = mine.pop() if mine else None

        found = shard_of(r for b in batches for r in _chunk_rows(b))
        while some := list(islice(found, 5000)):
            lang, term, sources, counts = zip(*some, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(term, pa.string()), pa.array(sources, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))], names=["lang", "term", "sources", "counts"])

    or_empty = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")]
    runs = docs.select(*or_empty).mapInArrow(index, _CHUNK)
    dealt = runs.repartition(shards, F.col("shard")).sortWithinPartitions("shard", "first")
    return dealt.mapInArrow(merge, _FREQUENCY)


def _chunk_rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}


def _share(count: str, of: str, terms: str) -> str:
    """1 + floor(SCALE * (count + 1) / (of + terms)); the product is a decimal, since it may pass 64 bits."""
    return f"(1 + (cast({SCALE} as decimal(10, 0)) * cast({count} + 1 as decimal(20, 0))) div cast({of} + {terms} as decimal(20, 0)))"


def _excess(p: str, q: str) -> str:
    """floor((p - q)^2 / q); a sum of it over terms stays under 2^63 as long as the shares sum to under 3 * SCALE."""
    return f"((({p} - {q}) * ({p} - {q})) div {q})"


def _both_corrections(shared: DataFrame) -> DataFrame:
    """lang, source, item, value: for each pair of sources, what terms that both have add.

    shared: lang and, for each term, its sources with their shares of it and of a term that they lack.
    Sums are kept in the tasks and handed on when many; the pairs of a term are never rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple[str, str], int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def hand_on() -> Iterator[pa.RecordBatch]:
            if held:
                key, value = sums_by_key(*[np.concatenate(x) for x in zip(*held, strict=True)])
                held.clear()
                known = list(names)
                left, right = [known[k] for k in (key >> 32).tolist()], [known[k] for k in (key & 0xFFFFFFFF).tolist()]
                for at in range(0, len(key), 50_000):
                    some = slice(at, at + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in left[some]], pa.string()), pa.array([g[1] for g in left[some]], pa.string()), pa.array([g[1] for g in right[some]], pa.string()), pa.array(value[some])], names=["lang", "source", "item", "value"])

        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            p, p0 = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (2, 3))
            langs = np.repeat(np.arange(len(sizes)), sizes)
            told = batch.column(0).to_pylist()
            ids = np.array([names.setdefault((told[r], s), len(names)) for r, s in zip(langs.tolist(), batch.column(1).flatten().to_pylist(), strict=True)], np.int64)
            row_start = np.concatenate([[0], np.cumsum(sizes)])[langs]
            partners = np.cumsum(sizes[langs])
            at = 0
            while at < len(ids):  # entries whose partners are about PAIRS_HELD together
                to = max(at + 1, int(np.searchsorted(partners, (partners[at - 1] if at else 0) + PAIRS_HELD)))
                n = sizes[langs[at:to]]
                left = np.repeat(np.arange(at, to), n)
                right = np.repeat(row_start[at:to] - (np.cumsum(n) - n), n) + np.arange(len(left))
                f = lambda x, y: (x - y) * (x - y) // y
                value = f(p[left], p[right]) - f(p[left], p0[right]) - f(p0[left], p[right]) + f(p0[left], p0[right])
                differ = ids[left] != ids[right]
                held.append(sums_by_key((ids[left] << 32 | ids[right])[differ], value[differ]))
                at = to
            if sum(len(k) for k, _ in held) > PAIRS_HELD:
                held[:] = [sums_by_key(*[np.concatenate(x) for x in zip(*held, strict=True)])]
                if len(held[0][0]) > PAIRS_HELD // 2:
                    yield from hand_on()
        yield from hand_on()

    return shared.select("lang", "sources", "p", "p0").mapInArrow(run, "lang string, source string, item string, value long")


def divergence_report(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: by how much each source differs from others of its language, and in which terms.

    Part 'pair': item is each other source of the language, value the excess summed over all kept
    terms (0 if there are none). Part 'term': the kept terms that the source uses more than its
    language does, the first top of them. Ranks go by value, then by the bytes of the item. A source
    that is its language's only one and has no kept term has no row; an empty table gives none.
    Nulls in text, lang and source count as ''. Other columns are not read.
    """
    frequencies = written(term_frequencies(docs, least), "term-frequencies")
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    entries = frequencies.selectExpr("lang", "term", "aggregate(counts, 0L, (a, x) -> a + x) as total", "size(sources) as owners", "inline(arrays_zip(sources, counts))").withColumnsRenamed({"sources": "source", "counts": "n"})
    of_lang = frequencies.groupBy("lang").agg(F.count("*").alias("terms"), F.sum(F.expr("aggregate(counts, 0L, (a, x) -> a + x)")).alias("lang_size"))
    sizes = entries.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    stats = groups.join(sizes, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["size", "terms", "lang_size"])
    stats = written(stats.withColumn("p0", F.expr(f"if(terms > 0, {_share('0L', 'size', 'terms')}, 1L)")), "source-sizes")

    known = entries.join(stats, ["lang", "source"]).withColumn("p", F.expr(_share("n", "size", "terms")))
    over = known.withColumn("q", F.expr(_share("total", "lang_size", "terms"))).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_excess("p", "q")).alias("value"))

    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = over.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    histogram = written(known.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("n")), "term-histogram")
    other = stats.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    base = stats.join(other, "lang").where("source <> item").selectExpr("lang", "source", "item", f"terms * {_excess('p0', 'q0')} as value")
    met = histogram.join(other, "lang").where("source <> item")
    mine = met.selectExpr("lang", "source", "item", f"n * ({_excess('p', 'q0')} - {_excess('p0', 'q0')}) as value")
    theirs = met.selectExpr("lang", "item as source", "source as item", f"n * ({_excess('q0', 'p')} - {_excess('q0', 'p0')}) as value")
    shared = known.where("owners > 1").groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("s")).selectExpr("lang", "s.source as sources", "s.p as p", "s.p0 as p0")
    sums = base.unionByName(mine).unionByName(theirs).unionByName(_both_corrections(shared)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(by_value))
    return pairs.unionByName(terms)
