"""Rubrics: predicates over documents, computed in one pass and stacked to (doc, name, ok)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.functions import vocab
from tracewell.functions.shared import shared_folder, written


def stacked(df: DataFrame, id_cols: list[str], checks: dict[str, Column]) -> DataFrame:
    """One row for each check of each document."""
    cases = F.array(*[F.struct(F.lit(k).alias("name"), F.coalesce(v, F.lit(False)).alias("ok")) for k, v in checks.items()])
    return df.select(*id_cols, F.inline(cases))


def bullet_rubric(bullets: DataFrame, doc: str = "doc_id", text: str = "line") -> DataFrame:
    """Per document over its bullets: length, quantified share, empty openers, first person."""
    low = F.lower(text)
    per = bullets.groupBy(doc).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.length(text) > vocab.MAX_BULLET_CHARS).alias("long"),
        F.count_if(F.size(T.figures(text)) > 0).alias("quantified"),
        F.count_if(low.rlike(vocab.WEAK_OPENERS)).alias("weak"),
        F.count_if(low.rlike(vocab.FIRST_PERSON)).alias("personal"),
    )
    return stacked(per, [doc], {
        "short": F.col("long") == 0,
        "quantified": F.col("quantified") >= F.col("n") * vocab.MIN_QUANTIFIED,
        "openers": F.col("weak") == 0,
        "impersonal": F.col("personal") == 0,
    })


def _any(c: Column, phrases) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(c, F.lit(p))
    return out


def letter_rubric(letters: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    """Per letter, its lines as paragraphs: opening, length, paragraphs, specifics, worn phrases, "I" openings."""
    norm = T.normalize(text)
    paragraphs = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda p: F.trim(p) != "")
    df = letters.select(*ids, norm.alias("norm"), paragraphs.alias("paragraphs"), F.size(T.words(text)).alias("n_words"), F.size(T.figures(text)).alias("n_figures"))
    n = F.size("paragraphs")
    opens_i = F.size(F.filter("paragraphs", lambda p: F.lower(F.trim(p)).rlike("^i\\b")))
    return stacked(df, ids, {
        "opening": ~F.col("norm").rlike(vocab.DEAD_OPENINGS),
        "length": F.col("n_words").between(*vocab.LETTER_WORDS),
        "paragraphs": n.between(*vocab.LETTER_PARAGRAPHS),
        "specifics": F.col("n_figures") >= 1,
        "plain_words": ~_any(F.col("norm"), vocab.EXCESS_WORDS),
        "no_cliche": ~_any(F.col("norm"), vocab.CLICHES),
        "no_flattery": ~_any(F.col("norm"), vocab.FLATTERY),
        "varied_openings": (n == 0) | (opens_i < n * vocab.MAX_I_SHARE),
    })


def text_layer_rubric(texts: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Faults that leave a text unreadable to machines: ligatures, private-use signs, spaced-out letters."""
    return stacked(texts, [doc], {
        "no_ligatures": ~F.coalesce(F.col(text), F.lit("")).rlike(vocab.LIGATURES),
        "no_private_use": ~F.coalesce(F.col(text), F.lit("")).rlike(vocab.PRIVATE_USE),
        "no_spaced_letters": ~F.coalesce(F.col(text), F.lit("")).rlike(vocab.SPACED_OUT),
    })


def page_layout_rubric(pages: DataFrame, doc: str = "page_id", html: str = "html") -> DataFrame:
    low = F.lower(F.coalesce(F.col(html), F.lit("")))
    return stacked(pages, [doc], {f"no_{k}": ~low.rlike(p) for k, p in vocab.LAYOUT.items()})


def summary(checks: DataFrame, doc: str) -> DataFrame:
    """Checks passed and failed per document, and the failed names."""
    return checks.groupBy(doc).agg(
        F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("name")))), ",").alias("failures"),
    )


def _flat(c: Column) -> Column:
    return T.normalize(F.regexp_replace(F.coalesce(c, F.lit("")), "[-­][\\x09-\\x0D\\x20]*\n[\\x09-\\x0D\\x20]*", ""))


def format_share(checks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, format): the share of a document's checks (doc, name, ok) that passed."""
    return checks.groupBy(doc).agg(F.round(F.avg(F.col("ok").cast("double")), 6).alias("format"))


def round_trip_rows(docs: DataFrame, items: Column, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """round_trip() where each row holds its own items (an array): no text leaves its row. Without items, no row."""
    rows = docs.select(doc, _flat(F.col(text)).alias("flat"), F.transform(items, _flat).alias("said")).where(F.size("said") > 0)
    # an empty text holds empty items only; naming flat twice keeps it a column of the plan
    absent = F.when(F.col("flat") == "", F.size(F.filter("said", lambda s: s != ""))).otherwise(F.size(F.filter("said", lambda s: ~F.contains("flat", s))))
    return rows.select(doc, F.size("said").alias("items"), absent.alias("missing")).groupBy(doc).agg(F.sum("items").alias("items"), F.sum("missing").alias("missing"))


def round_trip(items: DataFrame, extracted: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Items (doc, item) that the extracted text of their document does not hold, white space aside."""
    both = items.select(doc, "item").join(extracted.select(doc, _flat(F.col("text")).alias("flat")), doc, "left")
    found = F.coalesce(F.contains("flat", _flat(F.col("item"))), F.lit(False))
    return both.groupBy(doc).agg(F.count(F.lit(1)).alias("items"), F.count_if(~found).alias("missing"))


#: The rolling hash's odd base, and bytes of sentences that one search of the texts holds in memory; more take another pass.
_BASE, SEARCHED_BYTES = 0x9E3779B97F4A7C15, 32 << 20


def verbatim_echo(sentences: DataFrame, texts: DataFrame, least: int = 25, doc: str = "doc_id") -> DataFrame:
    """(doc, sentence): sentences of over least characters that a text repeats.

    Each place of a text is held against the sentences' first least + 1 characters by a rolling
    hash, and the whole sentence where that agrees, so no text is held against every sentence.
    Sentences of more than SEARCHED_BYTES are searched slice by slice: one slice is in memory at a
    time, and what it found is written before the next. No sentences, no rows.
    """
    spark = texts.sparkSession
    long = written(sentences.select(T.normalize("sentence").alias("sentence")).where(F.length("sentence") > least).distinct(), "sentences")
    norm = texts.select(doc, T.normalize("text").alias("norm"))
    slices, n_bytes = _in_slices(long), long.agg(F.sum(F.octet_length("sentence"))).first()[0] or 0
    if n_bytes < SEARCHED_BYTES:
        return _search(norm, spark.sparkContext.broadcast(next(slices, [])), least + 1, doc).distinct()
    norm = written(norm, "normal")
    paths = []
    for some in slices:
        shared = spark.sparkContext.broadcast(some)
        paths.append(shared_folder(spark, "echo"))
        _search(norm, shared, least + 1, doc).distinct().write.parquet(paths[-1])
        shared.destroy()
    return spark.read.parquet(*paths)


def _in_slices(sentences: DataFrame) -> Iterator[list[str]]:
    some, size = [], 0
    for (sentence,) in sentences.toLocalIterator():
        some.append(sentence)
        size += len(sentence.encode())
        if size >= SEARCHED_BYTES:
            yield some
            some, size = [], 0
    if some:
        yield some


def _rolling(text: str, width: int) -> np.ndarray:
    """A hash of each window of width characters, built from those of halves."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    part, size, out, done = codes + np.uint64(1), 1, None, 0
    while True:
        if width & size:
            out = part if out is None else out[: max(0, len(part) - done)] * np.uint64(pow(_BASE, size, 1 << 64)) + part[done : done + len(out)]
            done += size
        size *= 2
        if size > width:
            return out
        part = part[: max(0, len(part) - size // 2)] * np.uint64(pow(_BASE, size // 2, 1 << 64)) + part[size // 2 :]


def _search(norm: DataFrame, shared: Broadcast, width: int, doc: str) -> DataFrame:
    """(doc, sentence): the shared sentences of width characters or more that norm holds, by a rolling hash (Rabin-Karp)."""
    schema = norm.select(doc, F.col("norm").alias("sentence")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_hash: dict[int, list[str]] = {}
        for s in shared.value:
            by_hash.setdefault(int(_rolling(s[:width], width)[0]), []).append(s)
        wanted = np.array(sorted(by_hash), np.uint64)
        marked = np.zeros(1 << 20, bool)
        marked[(wanted >> np.uint64(44)).astype(np.intp)] = True
        for batch in batches:
            rows, said = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                if len(text) < width:
                    continue
                hashes = _rolling(text, width)
                at = np.flatnonzero(marked[(hashes >> np.uint64(44)).astype(np.intp)])
                at = at[np.isin(hashes[at], wanted)]
                held = set()
                for i, h in zip(at.tolist(), hashes[at].tolist(), strict=True):
                    held.update(s for s in by_hash[h] if s not in held and text.startswith(s, i))
                rows += [k] * len(held)
                said += held
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(said, pa.string())], names=[doc, "sentence"])

    return norm.mapInArrow(run, schema)
