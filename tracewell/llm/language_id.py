"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams of labelled texts per language; the log-probability matrix goes to
the tasks, which score a text by its sparse n-gram counts in numpy. A text's score is the posterior
probability of the predicted language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import crc_fold, limit_batches

#: Buckets of the n-gram hash, longest n-gram, and smoothing.
BUCKETS, LONGEST, SMOOTHING = 1 << 15, 3, 0.1
#: Bound on the training sample: labelled texts for each language. Every language is learned.
SAMPLE_PER_LANGUAGE = 3000
#: Products of counts and log-probabilities (8 bytes each) formed at once when a batch is scored.
PRODUCTS = 1 << 20

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """For each code point, its lower-case form if it is a letter, else a space."""
    global _letters
    if _letters is None:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if chr(c).isalpha():
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 else c
        _letters = table
    return _letters


def code_points(text: str | None) -> np.ndarray:
    """Lower-case letters as code points; whatever is no letter becomes a space, runs of it one."""
    a = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
    a = _letter_table()[a]
    if len(a):
        space = a == 32
        keep = np.ones(len(a), bool)
        keep[1:] = ~(space[1:] & space[:-1])
        a = a[keep]
    return a


def gram_buckets(a: np.ndarray) -> np.ndarray:
    """The hash buckets of all n-grams of 1 to LONGEST characters."""
    out, h = [], np.zeros(len(a), np.uint32)
    for n in range(1, LONGEST + 1):
        if len(a) < n:
            break
        h = h[: len(a) - n + 1] * np.uint32(0x01000193) + a[n - 1 :] + np.uint32(n)
        out.append((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


@dataclass
class LanguageModel:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # BUCKETS x languages

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and posteriors of a batch: sparse n-gram counts of its texts times the log-probabilities."""
        languages, scores = ["und"] * len(texts), np.zeros(len(texts))
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> None:
            rows, buckets, counts = zip(*held, strict=True)
            starts = np.cumsum([0, *[len(b) for b in buckets[:-1]]])
            products = np.concatenate(counts)[:, None] * self.log_prob[np.concatenate(buckets)].astype(np.float64)
            found = np.add.reduceat(products, starts, axis=0) + self.log_prior
            p = np.exp(found - found.max(1, keepdims=True))
            best = found.argmax(1)
            scores[list(rows)] = p[np.arange(len(rows)), best] / p.sum(1)
            for r, k in zip(rows, best.tolist(), strict=True):
                languages[r] = self.languages[k]

        for r, text in enumerate(texts):
            a = code_points(text)
            if not self.languages or not (a != 32).any():
                continue
            counts = np.bincount(gram_buckets(a), minlength=BUCKETS)
            some = np.flatnonzero(counts)
            held.append((r, some, counts[some]))
            size += len(some) * len(self.languages)
            if size >= PRODUCTS:
                flush()
                held, size = [], 0
        if held:
            flush()
        return languages, scores


def _labelled(docs: DataFrame, held_out: int | None) -> DataFrame:
    rows = docs.where("lang is not null and text is not null")
    return rows if held_out is None else rows.where(crc_fold("doc_id", 4) != held_out)


def train(docs: DataFrame, held_out: int | None = 2) -> LanguageModel:
    """Learn from the labelled texts outside the held-out fold.

    A hash of the id picks about SAMPLE_PER_LANGUAGE whole texts of each language (all of them
    where there are fewer). What reaches the driver is the sum of counts: at most BUCKETS rows for
    each language.
    """
    limit_batches(docs.sparkSession)
    rows = _labelled(docs, held_out)
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros(0), np.zeros((BUCKETS, 0), np.float32))
    index = {x: k for k, x in enumerate(languages)}
    share = F.create_map(*[F.lit(v) for x in languages for v in (x, min(1.0, SAMPLE_PER_LANGUAGE / sizes[x]))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(draw < F.coalesce(share[F.col("lang")], F.lit(0.0))).select(F.col("lang").cast("string"), "text").repartition(8)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = np.bincount(gram_buckets(code_points(text)), minlength=BUCKETS)
                total[lang] = total[lang] + c if lang in total else c
        for lang, c in total.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some.astype(np.int32)), pa.array(c[some])], names=["lang", "bucket", "n"])

    counts = np.zeros((BUCKETS, len(languages)))
    found = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    np.add.at(counts, (found["bucket"].to_numpy(), np.array([index[x] for x in found["lang"].to_pylist()], int)), found["n"].to_numpy())
    smooth = counts + SMOOTHING
    prior = np.array([sizes[x] for x in languages], float)
    return LanguageModel(languages, np.log(prior / prior.sum()), np.log(smooth / smooth.sum(0)).astype(np.float32))


def identify(docs: DataFrame, model: LanguageModel, extra: str | None = None) -> DataFrame:
    """doc_id, lang_pred and score for every whole text, one row per input row.

    Null texts and texts without a letter are 'und' with score 0; so is everything where the model
    learned no language. The input's lang and source are not read.
    """
    limit_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, score = shared.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose language could be told with at least this score."""
    limit_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, score = shared.value.predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array([x != "und" and p >= least for x, p in zip(found, score.tolist(), strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def language_report(docs: DataFrame) -> DataFrame:
    """Held-out fold, predicted language and score per document; learned outside the fold."""
    model = train(docs)
    held = crc_fold("doc_id", 4) == 2
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
