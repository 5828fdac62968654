"""SimHash near-dedup with pigeonring filtering.

Texts get 64-bit fingerprints; equal fingerprints form one class. Two fingerprints link when at most
TAU bits differ. The 64 bits lie on a ring of SEGMENTS segments. If the differences over the ring sum
to at most TAU, some start has every chain of l consecutive segments from it within the
proportional budget l * TAU / SEGMENTS (the pigeonring principle), so a pair is compared in full only
if such a start exists. With fewer differences than segments, two segments at least are equal, so
candidates meet under keys of two segments each.

Links are reduced to spanning forests where they are found: within a bucket, a fingerprint that has
been reached is not compared with other reached ones, so a dense group costs about its size and
gives one link for each member. Buckets over a bound are cut into blocks, and pairs of blocks
become tasks of their own. Components come from repeated large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import limit_batches, shared_folder, written

WORDS, TAU, SEGMENTS, SEED = 4, 4, 6, 42
#: Fingerprints of one bucket that one task compares; larger buckets are cut into blocks.
BLOCK = 2048
#: Buckets of up to so many are compared pair by pair, many buckets at once.
FEW = 6

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_COLUMN = (np.arange(8) * 256).astype(np.intp)
_SPACES = bytes(range(9, 14)) + b" "


def shingle_hashes(text: str | None, words: int = WORDS) -> list[int]:
    """XXH64 of each run of consecutive words, repeats included; fewer words: the whole sequence."""
    ws = (text or "").encode("utf-8", "replace").lower().split()
    if not ws:
        return []
    line = b" ".join(ws)
    h = xxhash.xxh64_intdigest
    if len(ws) <= words:
        return [h(line, SEED)]
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps[words - 1 :].tolist(), len(line)]
    return [h(line[a:z], SEED) for a, z in zip(starts, ends)]


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """A bit is 1 if it is set in over half the shingles' hashes; no words: zero."""
    hashes = shingle_hashes(text, words)
    if not hashes:
        return 0
    columns = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8).astype(np.intp) + _COLUMN
    counts = np.bincount(columns.reshape(-1), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    bits = (counts.reshape(-1) * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fp (64 bits as a signed long) of every whole text; one row per input row. No shuffle."""
    limit_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def segment_bounds(segments: int = SEGMENTS) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment: as equal as can be."""
    cuts = [64 * k // segments for k in range(segments + 1)]
    return [(a, z - a) for a, z in zip(cuts, cuts[1:], strict=False)]


def pigeonring(diff: np.ndarray, tau: int, segments: int = SEGMENTS) -> np.ndarray:
    """Which differences (xor of two fingerprints) have a start whose chains all keep their budgets.

    For l segments from the start: their differing bits are at most l * tau / segments.
    """
    per = [np.bitwise_count((diff >> np.uint64(a)) & np.uint64((1 << w) - 1)).astype(np.int16) for a, w in segment_bounds(segments)]
    viable = np.zeros(len(diff), bool)
    for start in range(segments):
        good = per[start] * segments <= tau
        total = per[start].copy()
        for n in range(2, segments + 1):
            if not good.any():
                break
            total += per[(start + n - 1) % segments]
            good &= total * segments <= n * tau
        viable |= good
    return viable


def _links(fps: np.ndarray, others: np.ndarray | None, tau: int) -> Iterator[tuple[int, int]]:
    """A forest that joins all linked fingerprints of a block (or of two blocks).

    Breadth first: a reached fingerprint is compared only with those not yet reached. Within a
    block that finds its components; between two blocks, the components of their links.
    """
    left = fps if others is None else np.concatenate([fps, others])
    side = np.zeros(len(left), bool)
    if others is not None:
        side[len(fps) :] = True
    todo = np.arange(len(left))  # not yet reached
    while len(todo):
        queue, todo = [int(todo[0])], todo[1:]
        while queue and len(todo):
            i = queue.pop()
            diff = left[todo] ^ left[i]
            near = np.zeros(len(todo), bool)
            maybe = np.flatnonzero(pigeonring(diff, tau) & ((side[todo] != side[i]) if others is not None else True))
            if len(maybe):
                near[maybe] = np.bitwise_count(diff[maybe]) <= tau
            if near.any():
                hit = todo[near]
                for j in hit.tolist():
                    yield int(left[i]), int(left[j])
                queue += hit.tolist()
                todo = todo[~near]


def _keys(fp: str, segments: int) -> list:
    """For each pair of segments, a struct of the pair's number and their bits."""
    bounds = segment_bounds(segments)
    part = lambda k: F.shiftrightunsigned(F.col(fp), bounds[k][0]).bitwiseAND(F.lit((1 << bounds[k][1]) - 1))
    return [F.struct(F.lit(n).cast("long").alias("n"), (F.shiftleft(part(a), 24).bitwiseOR(part(b))).alias("bits")) for n, (a, b) in enumerate(combinations(range(segments), 2))]


def fingerprint_links(distinct: DataFrame, tau: int = TAU, segments: int = SEGMENTS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that span all components."""
    if tau > segments - 2:
        raise ValueError("candidates need two equal segments: tau is at most segments - 2")
    spark = distinct.sparkSession
    limit_batches(spark)
    keyed = distinct.select("fp", F.explode(F.array(*_keys("fp", segments))).alias("key")).select("fp", (F.col("key.n") * (1 << 48) + F.col("key.bits")).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    placed = keyed.join(sizes, "key")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    placed = placed.withColumn("blocks", blocks).withColumn("mine", mine)
    # a pair of blocks (p, q) with p <= q is one task's work: each fingerprint goes to the pairs of its block
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("mine")).alias("p"), F.greatest(k, F.col("mine")).alias("q")))
    spread = placed.select("key", "fp", "mine", F.explode(pairs).alias("pq")).select("key", F.col("pq.p").alias("p"), F.col("pq.q").alias("q"), "mine", "fp")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = spread.repartition(tasks, "key", "p", "q").sortWithinPartitions("key", "p", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[tuple[int, int]] = []
        pairs_a: list[int] = []
        pairs_b: list[int] = []

        def take(key: tuple, parts: list[tuple[int, int]]) -> None:
            _, p, q = key
            if p == q and len(parts) <= FEW:
                for i, (_, a) in enumerate(parts):
                    for _, b in parts[:i]:
                        pairs_a.append(a)
                        pairs_b.append(b)
                return
            side = [np.array([fp for m, fp in parts if m == k], np.int64).view(np.uint64) for k in (p, q)]
            links.extend(_links(side[0], None if p == q else side[1], tau))

        def flush() -> pa.RecordBatch:
            a, b = (np.array(x, np.int64) for x in (pairs_a, pairs_b))
            diff = (a ^ b).view(np.uint64)
            maybe = np.flatnonzero(pigeonring(diff, tau))
            near = maybe[np.bitwise_count(diff[maybe]) <= tau]
            more = np.array(links, np.uint64).reshape(-1, 2)
            ends = [np.concatenate([x[near], np.ascontiguousarray(more[:, k]).view(np.int64)]) for k, x in enumerate((a, b))]
            for x in (links, pairs_a, pairs_b):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in ends], names=["a", "b"])

        at, parts = None, []
        for batch in batches:
            for key, p, q, m, fp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, p, q) != at:
                    if len(parts) > 1:
                        take(at, parts)
                    at, parts = (key, p, q), []
                    if len(links) + len(pairs_a) > 20_000:
                        yield flush()
                parts.append((m, fp))
        if len(parts) > 1:
            take(at, parts)
        yield flush()

    return dealt.mapInArrow(run, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the component's smallest node.

    Alternates large-star (a node's larger neighbours move to its smallest neighbour) and
    small-star (its smaller ones do) until nothing changes; each round is written to the shared
    folder. A node that holds a third of all links is aggregated in parts before it is shuffled.
    """
    edges = written(links.where("a <> b").select("a", "b"), "links")

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = both.where("b < a")
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        moved = both.join(least, "a")
        if large:
            out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    digest = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = None
    while True:
        edges = written(star(star(edges, True), False), "links")
        now = digest(edges)
        if now == before:
            break
        before = now
    # every edge now leads from a node to its root
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_groups(docs: DataFrame, words: int = WORDS, tau: int = TAU, keep_fold: str = "near") -> DataFrame:
    """Per row: doc_id, fp, component_id: the smallest doc_id reachable over links, itself included.

    Texts without words (null, empty, white space) have fingerprint zero and link like any other.
    Rows with a null id belong to a component but never name it, unless it has no other. An
    empty table gives no rows.
    """
    marked = written(fingerprints(docs, words), "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = written(components(fingerprint_links(classes.select("fp"), tau)), "roots")
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select(F.col("fp").alias("cfp"), "component_id")
    return marked.join(named, F.col("fp") == F.col("cfp")).select("doc_id", "fp", "component_id")


def near_report(docs: DataFrame) -> DataFrame:
    return near_groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, words: int = WORDS, tau: int = TAU) -> DataFrame:
    """The rows of docs, all columns, that are the smallest doc_id of their component."""
    kept = near_groups(docs, words, tau).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("kept_id")), "left_semi")
