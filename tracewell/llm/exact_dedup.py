"""Exact dedup over an extendible-hash index kept in shared files.

1. Every text is normalised and hashed; the keys (id, hash, digest) are written to a shared table.
2. A directory is grown from counts of distinct hashes: an overfull bucket splits on its next hash
   bit, and the directory doubles when the bucket's depth has reached the directory's.
3. Texts are combined where they lie (equal texts of a task become one entry), then dealt to owner
   tasks, each of which owns a contiguous range of buckets, so a key that a third of all rows
   share arrives as one entry from each task. An owner walks its buckets in hash order, chains
   entries of one hash, compares bytes, and writes the index file of its range.
4. Keys are looked up in the index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import limit_batches, written

#: Distinct hashes that a bucket takes before it splits, and the deepest directory (entries: 2 to this).
BUCKET_ENTRIES, DEEPEST = 4096, 18
#: Bytes of text that a task combines before it passes its entries on.
COMBINE_BYTES = 24 << 20


def normalised(col: Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty text.

    Only runs other than a lone space are matched, since those stay as they are.
    """
    return F.regexp_replace(F.coalesce(col, F.lit("")), "[\\t-\\r][ \\t-\\r]*| [ \\t-\\r]+", " ")


def _hash(col: Column, bits: int) -> Column:
    h = F.xxhash64(col)
    return h if bits == 64 else F.shiftleft(F.shiftrightunsigned(h, 64 - bits), 64 - bits)


@dataclass
class Directory:
    """Maps the leading bits of a hash to a bucket; buckets are numbered in key order."""

    depth: int
    bucket: np.ndarray  # 2**depth entries
    entries: np.ndarray  # for each bucket

    @classmethod
    def grow(cls, counts: np.ndarray, capacity: int = BUCKET_ENTRIES) -> Directory:
        """From the number of distinct hashes for each prefix of log2(len(counts)) bits."""
        deepest = int(len(counts)).bit_length() - 1
        below = np.concatenate([[0], np.cumsum(counts)])
        filled = lambda prefix, depth: int(below[(prefix + 1) << (deepest - depth)] - below[prefix << (deepest - depth)])
        depth, slots = 0, [(0, 0)]  # a slot holds its bucket's (local depth, prefix)
        todo = [(0, 0)]
        while todo:
            local, prefix = todo.pop()
            if filled(prefix, local) <= capacity or local == deepest:
                continue  # at the deepest level an overfull bucket keeps its surplus as a chain
            if local == depth:  # double
                slots = [s for s in slots for _ in (0, 1)]
                depth += 1
            width = depth - local - 1
            for half in (0, 1):
                child = (local + 1, prefix * 2 + half)
                at = (prefix * 2 + half) << width
                slots[at : at + (1 << width)] = [child] * (1 << width)
                todo.append(child)
        numbers = {s: k for k, s in enumerate(dict.fromkeys(slots))}
        return cls(depth, np.array([numbers[s] for s in slots], np.int32), np.array([filled(p, d) for d, p in numbers], np.int64))

    def owners(self, tasks: int) -> np.ndarray:
        """For each bucket, the task that owns it: contiguous ranges of about equal size."""
        before = np.cumsum(self.entries) - self.entries
        return (before * tasks // max(1, int(self.entries.sum()))).astype(np.int32)

    def locate(self, h: np.ndarray) -> np.ndarray:
        if not self.depth:
            return np.zeros(len(h), np.int32)
        return self.bucket[(h.view(np.uint64) >> np.uint64(64 - self.depth)).astype(np.int64)]


def _directory(keys: DataFrame) -> Directory:
    distinct = keys.groupBy("h").agg(F.lit(1).alias("one"))
    total = distinct.count()
    depth = min(DEEPEST, max(1, int(4 * total // BUCKET_ENTRIES).bit_length()))
    rows = distinct.groupBy(F.shiftrightunsigned("h", 64 - depth).alias("prefix")).count().collect()
    counts = np.zeros(1 << depth, np.int64)
    for r in rows:
        counts[r.prefix] = r["count"]
    return Directory.grow(counts)


_ENTRY = "owner int, bucket int, h long, sha string, norm string, keep_id long, n long"
_INDEX = "bucket int, h long, slot int, sha string, keep_id long, group_size long"


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def _batch(columns: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*columns, strict=True), schema.types, strict=True)], schema=schema)


def _combine(directory: Directory, tasks: int):
    """Equal texts of a task become one entry, with the smallest id and the number of rows."""
    schema = pa.schema([("owner", pa.int32()), ("bucket", pa.int32()), ("h", pa.int64()), ("sha", pa.string()), ("norm", pa.string()), ("keep_id", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners = directory.owners(tasks)
        held: dict[str, list] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                h = np.array([e[0] for e in held.values()], np.int64)
                buckets = directory.locate(h).tolist()
                rows = [(int(owners[b]), b, e[0], e[1], text, e[2], e[3]) for b, (text, e) in zip(buckets, held.items(), strict=True)]
                for at in range(0, len(rows), 400):
                    yield _batch(rows[at : at + 400], schema)
                held.clear()

        for batch in batches:
            for doc_id, h, sha, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text in held:
                    e = held[text]
                    e[2], e[3] = _least(e[2], doc_id), e[3] + 1
                else:
                    held[text] = [h, sha, doc_id, 1]
                    size += len(text) + 200
            if size > COMBINE_BYTES:
                yield from out()
                size = 0
        yield from out()

    return run


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner's buckets in hash order: one chain for each hash, its texts told apart by their bytes."""
    schema = pa.schema([("bucket", pa.int32()), ("h", pa.int64()), ("slot", pa.int32()), ("sha", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
    at, chain, rows = None, [], []

    def close() -> None:
        for slot, (sha, _, keep, n) in enumerate(chain):
            rows.append((*at, slot, sha, keep, n))

    for batch in batches:
        for _, bucket, h, sha, text, keep, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (bucket, h) != at:
                close()
                at, chain = (bucket, h), []
            for link in chain:
                if link[1] == text:
                    link[2], link[3] = _least(link[2], keep), link[3] + n
                    break
            else:
                chain.append([sha, text, keep, n])
        if len(rows) > 2000:
            yield _batch(rows, schema)
            rows.clear()
    close()
    if rows:
        yield _batch(rows, schema)


def build_index(docs: DataFrame, hash_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """The written keys (doc_id, h, sha) of all rows, and the written index of all distinct texts."""
    spark = docs.sparkSession
    limit_batches(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    norm = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text").cast("string")).alias("norm"))
    hashed = norm.select("doc_id", _hash(F.col("norm"), hash_bits).alias("h"), F.sha2("norm", 256).alias("sha"), "norm")
    keys = written(hashed.drop("norm"), "exact-keys")
    directory = _directory(keys)
    entries = hashed.mapInArrow(_combine(directory, tasks), _ENTRY)
    dealt = entries.repartitionById(tasks, F.col("owner")).sortWithinPartitions("bucket", "h")
    return keys, written(dealt.mapInArrow(_own, _INDEX), "exact-index")


def exact_groups(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256 of the normalised text.

    Null texts count as empty and form one group with the empty ones. Null ids never become the
    kept id unless a group has no other. Rows that repeat both an id and a text count as the same
    row: all carry kept = true if the id is the group's smallest. An empty table gives no rows.
    """
    keys, index = build_index(docs, hash_bits)
    index = index.select(F.col("h").alias("ih"), F.col("sha").alias("isha"), "keep_id", "group_size")
    found = keys.join(index, (F.col("h") == F.col("ih")) & (F.col("sha") == F.col("isha")))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that stay: of each group of equal texts the smallest doc_id.

    Rows that repeat an id and a text all stay or go together.
    """
    gone = exact_groups(docs).where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha"))
    sha = F.sha2(normalised(F.col("text").cast("string")), 256)
    return docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("gone_id")) & (sha == F.col("gone_sha")), "left_anti")
