"""Token ids in binary files, packed by Simple-8b.

File: the magic; then blocks; then a footer; then the footer's length (8 bytes) and the magic.
A block is a run of whole documents: a row for each (id, whether the id is null, first word, first
escape, number of ids; 64 bits each), then its 64-bit words, then its escaped values. A word's top
four bits select how many ids of how many bits it packs; each document starts on a word of its own.
The footer gives, for each block, the byte offset and how many documents, words and escapes it has,
so that any block or document is found and decoded alone, without a loop over words. Writer and
reader hold one block and the footer.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.chunks import ChunkMemo
from tracewell.llm.common import limit_batches, shared_folder, written

MAGIC = b"TOKENS8B"
#: Chunks that a worker's memo keeps of each generation (about 0.3 GB with their pieces).
MEMO = 180_000
#: Documents of a file, about; there are as many files as shuffle partitions at least.
FILE_ROWS = 100_000
#: Words after which a block is closed (at the end of a document).
BLOCK_WORDS = 1 << 16
#: Ids that are packed at a time.
SEGMENT = 1 << 18
#: Ids and bits for each selector. Selector 0 is a run of zeros, selector 1 an escape:
#: one id of more than 60 bits, kept whole in the block's escapes.
SELECTORS = ((240, 0), (1, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 1


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs. Floating point has the exponent exactly below 2**53."""
    big = ids >= np.uint64(1 << 53)
    out = np.frexp(np.where(big, ids >> np.uint64(32), ids).astype(np.float64))[1].astype(np.uint8)
    out[big] += 32
    return out


def pack(ids: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, escapes, first word of each run, first escape of each run) for runs of ids.

    sizes: the runs' lengths. A word takes the most ids that fit from where it starts and never
    reaches into the next run, so a run's words hold its ids exactly.
    """
    sizes = np.asarray(sizes, np.int64)
    ends = np.cumsum(sizes)
    n = len(ids) + len(sizes)  # one barrier after each run
    place = np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)
    padded = np.zeros(n + 240, np.uint64)
    padded[place] = ids
    width = np.full(n + 256, 255, np.uint8)
    width[place] = _widths(np.ascontiguousarray(ids, np.uint64))
    top = {1: width}  # the widest of the next so many
    for p in (2, 4, 8, 16, 32, 64, 128):
        h = top[p // 2]
        top[p] = np.maximum(h[: len(h) - p // 2], h[p // 2 :])
    step, chosen = np.ones(n, np.uint8), np.full(n, 15, np.uint8)
    chosen[(width[:n] > 60) & (width[:n] < 255)] = ESCAPE
    for s in (14, 13, 12, 11, 10, 9, 8, 7, 6, 5, 4, 3, 2, 0):
        count, bits = SELECTORS[s]
        p = 1 << (count.bit_length() - 1)
        fits = top[p][:n] <= bits
        if p != count:
            fits &= top[p][count - p : count - p + n] <= bits
        step[fits], chosen[fits] = count, s
    barriers = ends + np.arange(len(sizes))
    chosen[barriers] = 255
    starts, i, steps = [], 0, step.tobytes()
    while i < n:
        starts.append(i)
        i += steps[i]
    at = np.array(starts, np.int64)
    at = at[chosen[at] != 255]
    picks = chosen[at]
    words = picks.astype(np.uint64) << np.uint64(60)
    for s in np.unique(picks):
        count, bits = SELECTORS[s]
        if bits:
            mine = picks == s
            first = at[mine]
            value = words[mine]
            for j in range(count):
                value |= padded[first + j] << np.uint64(j * bits)
            words[mine] = value
    run_starts = barriers - sizes
    escaped = at[picks == ESCAPE]
    return words, padded[escaped], np.searchsorted(at, run_starts), np.searchsorted(escaped, run_starts)


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ids of whole runs' words."""
    picks = (words >> np.uint64(60)).astype(np.intp)
    counts = np.array([c for c, _ in SELECTORS])[picks]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    first = ends - counts
    for s in np.unique(picks):
        count, bits = SELECTORS[s]
        mine = picks == s
        if s == ESCAPE:
            out[first[mine]] = escapes
        elif bits:
            mask = (np.uint64(1) << np.uint64(bits)) - np.uint64(1)
            value, to = words[mine], first[mine]
            for j in range(count):
                out[to + j] = (value >> np.uint64(j * bits)) & mask
    return out


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if urlparse(uri).scheme else (pafs.LocalFileSystem(), uri)


class TokenFileWriter:
    """Writes one file, block by block; documents come in the order in which they are added."""

    def __init__(self, uri: str):
        self.fs, self.path = _filesystem(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.path)
        self.out.write(MAGIC)
        self.at = len(MAGIC)
        self.docs: list[tuple[int, int, int, int, int]] = []
        self.words: list[bytes] = []
        self.escapes: list[bytes] = []
        self.n_words = self.n_escapes = self.n_docs = self.n_ids = 0
        self.blocks: list[tuple[int, int, int, int]] = []

    def add(self, doc_id: int | None, words: bytes, escapes: bytes, n_ids: int) -> None:
        """One document, packed."""
        self.docs.append((doc_id or 0, doc_id is None, self.n_words, self.n_escapes, n_ids))
        self.words.append(words)
        self.escapes.append(escapes)
        self.n_words += len(words) >> 3
        self.n_escapes += len(escapes) >> 3
        self.n_docs += 1
        self.n_ids += n_ids
        if self.n_words >= BLOCK_WORDS:
            self._close_block()

    def _close_block(self) -> None:
        data = b"".join([np.array(self.docs, "<i8").tobytes(), *self.words, *self.escapes])
        self.blocks.append((self.at, len(self.docs), self.n_words, self.n_escapes))
        self.out.write(data)
        self.at += len(data)
        self.docs, self.words, self.escapes, self.n_words, self.n_escapes = [], [], [], 0, 0

    def close(self) -> None:
        if self.docs:
            self._close_block()
        foot = np.array(self.blocks, "<i8").tobytes()
        self.out.write(foot + len(foot).to_bytes(8, "little") + MAGIC)
        self.out.close()


def read_blocks(uri: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(documents' rows, ids) of a file's blocks in order, one in memory at a time; see the file's layout."""
    fs, path = _filesystem(uri)
    with fs.open_input_file(path) as f:
        end = f.size() - len(MAGIC) - 8
        foot = int.from_bytes(f.read_at(8, end), "little")
        for at, n, words, escapes in np.frombuffer(f.read_at(foot, end - foot), "<i8").reshape(-1, 4).tolist():
            data = f.read_at(8 * (5 * n + words + escapes), at)
            packed = np.frombuffer(data, "<u8")[5 * n :]
            yield np.frombuffer(data, "<i8")[: 5 * n].reshape(n, 5), unpack(packed[:words], packed[words:])


def read_file(uri: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of a file's documents in order."""
    for docs, ids in read_blocks(uri):
        at = 0
        for doc_id, null, _, _, n in docs.tolist():
            yield (None if null else doc_id), ids[at : at + n]
            at += n


_memos: dict[str, ChunkMemo] = {}


def _one_piece(part: bytes) -> bool:
    """Letters only: one piece of the vocabulary's pre-tokenizer, with one word end."""
    return part.isalpha() if part.isascii() else part.decode("utf-8").isalpha()


def library_memo(path: str) -> ChunkMemo:
    """The tokenizers library's encoding of whole texts, chunk by chunk where that is the same.

    For a vocabulary with word ends, whose pre-tokenizer drops white space, the pieces of a text
    are those of its chunks; each new chunk is encoded by the library once.
    """
    if path not in _memos:
        import json

        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        if not spec["model"].get("end_of_word_suffix") or spec["pre_tokenizer"]["pretokenizers"][0]["behavior"] != "Removed":
            raise ValueError("the vocabulary's tokens may cross white space")
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        suffix = spec["model"]["end_of_word_suffix"]
        vocabulary = tokenizer.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[k for t, k in vocabulary.items() if t.endswith(suffix)]] = True

        def encode(parts: list[bytes]) -> list[bytes]:
            """All parts as one text, which is cut again at the word ends; each alone where that differs."""
            if not parts:
                return []
            texts = [p.decode("utf-8") for p in parts]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(ends[ids]) + 1
            if len(cuts) == len(parts) and all(map(_one_piece, parts)):
                raw, at = ids.tobytes(), [0, *(cuts * 4).tolist()]
                return [raw[a:z] for a, z in zip(at, at[1:])]
            return [np.array(e.ids, np.uint32).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

        def by_kind(parts: list[bytes]) -> list[bytes]:
            """Plain words together, all else one by one."""
            plain = [p for p in parts if _one_piece(p)]
            out = dict(zip(plain, encode(plain), strict=True))
            rest = [p for p in parts if p not in out]
            if rest:
                out.update(zip(rest, (np.array(e.ids, np.uint32).tobytes() for e in tokenizer.encode_batch_fast([p.decode("utf-8") for p in rest], add_special_tokens=False)), strict=True))
            return [out[p] for p in parts]

        _memos[path] = ChunkMemo(by_kind, keep=tuple(t["content"].encode() for t in spec["added_tokens"]), most=MEMO)
    return _memos[path]


def ranges_of(doc_ids: pa.Array, cuts: np.ndarray, null_parts: int, seen: int) -> np.ndarray:
    """The file that each row goes to: null ids to the first null_parts, then ids by the sorted cuts.

    An id that many rows share is a cut several times: its rows may go to any of the files between,
    and go to them in turn, as null ids do; so no file's size depends on how often an id occurs.
    """
    turn = seen + np.arange(len(doc_ids))
    ids = doc_ids.fill_null(0).to_numpy(zero_copy_only=False)
    low, high = np.searchsorted(cuts, ids, "left"), np.searchsorted(cuts, ids, "right")
    part = null_parts + low + np.where(high - low > 1, turn % (high - low + 1), 0)
    return np.where(doc_ids.is_null().to_numpy(zero_copy_only=False), turn % max(1, null_parts), part).astype(np.int32)


def _packed(path: str, end_id: int, batch: pa.RecordBatch, part: np.ndarray) -> pa.RecordBatch:
    """A batch (doc_id, text) as (doc_id, part, words, escapes, n_ids), with end_id after each text's ids.

    Ids are packed SEGMENT at a time, a long text's in several runs whose words follow each other.
    """
    ids, ends = library_memo(path).encode(batch.column(1))
    n = np.diff(ends) + 1
    pieces = [[b""] * len(n), [b""] * len(n)]
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SEGMENT, "right")) - 1)
        runs = _runs_of(ids[ends[at] : ends[to]], n[at:to], end_id)
        for some, sizes in runs:
            words, escapes, first, first_escape = pack(some, sizes)
            for out, data, begins in ((pieces[0], words, first), (pieces[1], escapes, first_escape)):
                raw, stops = data.astype("<u8").tobytes(), [*begins.tolist()[1:], len(data)]
                for k, (a, z) in enumerate(zip(begins.tolist(), stops, strict=True)):
                    if z > a:
                        out[at + k] += raw[8 * a : 8 * z]
        at = to
    columns = [batch.column(0), pa.array(part), pa.array(pieces[0], pa.binary()), pa.array(pieces[1], pa.binary()), pa.array(n)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "words", "escapes", "n_ids"])


def _runs_of(ids: np.ndarray, n: np.ndarray, end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids with the end ids, sizes of the texts' runs); a single text comes in runs of SEGMENT ids."""
    if len(n) == 1:
        for a in range(0, int(n[0]), SEGMENT):
            some = ids[a : a + SEGMENT].astype(np.uint64)
            yield (np.append(some, np.uint64(end_id)) if a + SEGMENT >= n[0] else some), np.array([min(SEGMENT, int(n[0]) - a)])
        return
    out = np.full(len(ids) + len(n), end_id, np.uint64)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(n) - 1] = False
    out[inner] = ids
    yield out, n


def write_token_files(docs: DataFrame, path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Encode every whole text (null: empty), append end_id, and write files in ascending doc_id order.

    Returns the written files in order: (part, uri, n_docs, n_ids); an empty table gives none. Texts
    are encoded and packed where they are read; what is dealt out are packed ids. Documents are cut
    into ranges of ids by quantiles; a range's task sorts it and writes it as a stream. Null ids
    come first, in files of their own; an id that fills more than a range is dealt to several. Every attempt of a task writes a file of its own and only the successful one's name
    is returned, so lost executors leave no double. Rows that repeat an id stay, next to each other.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    spark = docs.sparkSession
    limit_batches(spark)
    folder = folder or shared_folder(spark, "token-files")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sizes = slim.agg(F.count("*").alias("rows"), F.count("doc_id").alias("ids")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sizes.rows // FILE_ROWS))
    cuts = np.array(sorted(slim.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.1 / parts)), np.int64)
    null_parts = -(-(sizes.rows - sizes.ids) // FILE_ROWS)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        seen = 0
        for batch in batches:
            yield _packed(path, end_id, batch, ranges_of(batch.column(0), cuts, null_parts, seen))
            seen += batch.num_rows

    packed = slim.mapInArrow(encode, "doc_id long, part int, words binary, escapes binary, n_ids long")
    dealt = packed.repartitionById(parts + null_parts, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = uri = at = None
        made = []
        for batch in batches:
            for doc_id, k, words, escapes, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if k != at:
                    if writer:
                        writer.close()
                        made.append((at, uri, writer.n_docs, writer.n_ids))
                    uri = f"{folder}/part-{k:06d}-{uuid.uuid4().hex}.tok"
                    writer, at = TokenFileWriter(uri), k
                writer.add(doc_id, words, escapes, n)
        if writer:
            writer.close()
            made.append((at, uri, writer.n_docs, writer.n_ids))
            columns = list(zip(*made, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["part", "uri", "n_docs", "n_ids"])

    files = dealt.mapInArrow(write, "part int, uri string, n_docs long, n_ids long")
    return written(files, "token-manifest")


def read_token_files(files: DataFrame) -> DataFrame:
    """From the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32.

    The manifest holds one row for each file, as many as there were ranges; each file is read by
    one task, block by block. Without files there are no rows.
    """
    spark = files.sparkSession
    rows = files.orderBy("part").collect()
    if not rows:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    before, total = [], 0
    for r in rows:
        before.append((r.uri, total, len(before)))
        total += r.n_ids
    listed = spark.createDataFrame(before, "uri string, start long, k int").repartitionById(len(before), F.col("k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for docs, ids in read_blocks(uri):
                    ends = np.cumsum(docs[:, 4])
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip((ends - docs[:, 4]).tolist(), ends.tolist(), strict=True)]
                    doc_ids = pa.array(docs[:, 0], mask=docs[:, 1] == 1)
                    yield pa.RecordBatch.from_arrays([doc_ids, pa.array(start + ends - docs[:, 4]), pa.array(docs[:, 4]), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    start += int(ends[-1])

    return listed.select("uri", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_report(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    return read_token_files(write_token_files(docs, path, end_id))
