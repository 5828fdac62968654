"""Structured Streaming forms of the run accounts, and stream gates against static sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewell.functions.shared import written
from tracewell.operators import documents as D
from tracewell.operators import runs
from tracewell.sources import pages as P


def file_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 4) -> DataFrame:
    """A table's Parquet files as a stream; the schema is the static table's."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    # a file source reads folders: a single file is named by a pattern in its folder
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if _is_file(spark, path) else reader.parquet(path)


def _is_file(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jpath).isFile()


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def _drop(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def timeline_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The attempt timeline as a stream: state of a run's attempt goes once the watermark has passed it."""
    return runs.attempt_timeline(events.withWatermark("at", late))


#: What closed_attempts emits, and the state of an open attempt: for each field its value and the seq that it came with.
_CLOSED = "run_id long, document string, attempt int, attempts int, first_seq long, events long, last_us long, stage string, score double, parses boolean, pages int, words int, repaired boolean, dropped int, reason string, outcome string"
_FIELDS = {"stage": "string", "score": "double", "parses": "boolean", "pages": "int", "words": "int", "dropped": "int", "reason": "string", "settled": "string"}
_STATE = "events long, last_us long, first_seq long, attempts int, " + ", ".join(f"{f} {t}, {f}_seq long" for f, t in _FIELDS.items())


def _latest(events: pd.DataFrame) -> dict[str, pd.DataFrame]:
    """For each field, the events that say something of it."""
    repaired, settling = events["stage"] == "repaired", events["stage"].isin(list(runs.OUTCOMES))
    reasons = events[repaired | (events["stage"] == "rejected")]
    return {
        "stage": events,
        **{f: events[events[f].notna()] for f in ("score", "parses", "pages", "words")},
        "dropped": events[repaired].assign(dropped=lambda d: d["dropped"].fillna(0)),
        "reason": reasons.assign(reason=lambda d: d["reason"].fillna("")),
        "settled": events[settling].assign(settled=lambda d: d["stage"]),
    }


def closed_attempts(events: DataFrame, late: str = "1 hour", idle_ms: int = 3_600_000) -> DataFrame:
    """Attempts as runs.attempt_folds gives them, each once, when the watermark has passed its last event by idle_ms.

    events: a stream of the columns of attempt_folds (run_id long, attempt int). State is kept for open
    attempts only, one row of fixed size for each: events fold into it in any order, by seq, and an event-time
    timer closes it. Events up to late behind the newest count; later ones are dropped before they get
    here. An event that comes after its attempt was closed, and is not late, opens the attempt again
    and so gives a second row. Append mode.
    """
    names, timed = list(_FIELDS), events.where("attempt is not null").withColumn("document", F.coalesce("document", F.lit("resume"))).withWatermark("at", late)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, last_us, first_seq, attempts, *rest = state.get
            value = dict(zip(names, rest[::2], strict=True))
            state.remove()
            yield pd.DataFrame(
                {
                    "run_id": [key[0]], "document": [key[1]], "attempt": [key[2]], "attempts": [key[2] if attempts is None else attempts], "first_seq": [first_seq], "events": [n],
                    "last_us": [last_us], "stage": [value["stage"]], "score": [value["score"]], "parses": pd.array([value["parses"]], "boolean"), "pages": pd.array([value["pages"]], "Int32"),
                    "words": pd.array([value["words"]], "Int32"), "repaired": [value["dropped"] is not None], "dropped": [value["dropped"] or 0], "reason": [value["reason"] or ""], "outcome": [runs.OUTCOMES.get(value["settled"], "open")],
                }
            )
            return
        n, last_us, first_seq, attempts, *rest = state.get if state.exists else (0, 0, None, None, *[None] * (2 * len(names)))
        held = dict(zip(names, zip(rest[::2], rest[1::2], strict=True), strict=True))
        for batch in batches:
            n += len(batch)
            last_us = max(last_us, int(batch["us"].max()))
            earliest = batch.loc[batch["seq"].idxmin()]
            if first_seq is None or earliest["seq"] < first_seq:
                first_seq, attempts = int(earliest["seq"]), None if pd.isna(earliest["attempts"]) else int(earliest["attempts"])
            for f, said in _latest(batch).items():
                if len(said):
                    last = said.loc[said["seq"].idxmax()]
                    if held[f][1] is None or last["seq"] > held[f][1]:
                        v = last[f]
                        held[f] = (None if pd.isna(v) else v.item() if hasattr(v, "item") else v, int(last["seq"]))
        for f, kind in _FIELDS.items():
            if kind == "int" and held[f][0] is not None:
                held[f] = (int(held[f][0]), held[f][1])
        state.update((n, last_us, first_seq, attempts, *[x for f in names for x in held[f]]))
        state.setTimeoutTimestamp(max(last_us // 1000 + idle_ms, state.getCurrentWatermarkMs() + 1))

    keyed = timed.withColumn("us", F.unix_micros("at")).select("run_id", "document", "attempt", "attempts", "seq", "at", "us", "stage", "score", "parses", "pages", "words", "dropped", "reason")
    closed = keyed.groupBy("run_id", "document", "attempt").applyInPandasWithState(fold, _CLOSED, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return closed.select("run_id", "document", "attempt", "attempts", "first_seq", "events", F.timestamp_micros("last_us").alias("last_at"), *["stage", "score", "parses", "pages", "words", "repaired", "dropped", "reason", "outcome"])


#: For each field of an attempt the stages of the events that say something of it (null: all that have it), and what a null one says.
_SAYS = {"stage": (None, None), "score": (None, None), "parses": (None, None), "pages": (None, None), "words": (None, None), "dropped": (["repaired"], 0), "reason": (["repaired", "rejected"], "")}


def _one_event(events: DataFrame) -> DataFrame:
    """Each event as an attempt of its own, every value with its seq before it, so that attempts add up by min, max and sum."""
    said = [
        F.when(F.col(f).isNotNull() if of is None else F.col("stage").isin(of), F.struct("seq", (F.col(f) if none is None else F.coalesce(f, F.lit(none))).alias("value"))).alias(f)
        for f, (of, none) in _SAYS.items()
    ]
    settled = F.when(F.col("stage").isin(list(runs.OUTCOMES)), F.struct("seq", F.col("stage").alias("value"))).alias("settled")
    return events.select("run_id", "document", "attempt", F.struct("seq", "attempts").alias("first"), F.lit(1).cast("long").alias("events"), F.col("at").alias("last_at"), *said, settled)


def _as_fold(attempts: DataFrame) -> DataFrame:
    """Attempts of _one_event's form as runs.attempt_folds gives them."""
    value = lambda f: F.col(f"{f}.value")
    outcome = F.coalesce(*[F.when(value("settled") == stage, F.lit(what)) for stage, what in runs.OUTCOMES.items()], F.lit("open"))
    return attempts.select(
        "run_id", "document", "attempt", F.coalesce("first.attempts", "attempt").alias("attempts"), F.col("first.seq").alias("first_seq"), "events", "last_at",
        *[value(f).alias(f) for f in ("stage", "score", "parses", "pages", "words")],
        F.col("dropped").isNotNull().alias("repaired"), F.coalesce(value("dropped"), F.lit(0)).alias("dropped"), F.coalesce(value("reason"), F.lit("")).alias("reason"), outcome.alias("outcome"),
    )


def close_attempts(events: DataFrame, path: str, checkpoint: str, late: str = "1 hour", idle_ms: int = 3_600_000) -> DataFrame:
    """Run a stream of events over all that is there now, and return all attempts closed so far, each once, as runs.attempt_folds gives them.

    The rules are those of closed_attempts, with the watermark as it is after each batch, but a batch is
    one aggregate over its events and the attempts that the batch before left open: no
    attempt meets Python. Its attempts, open and closed ones apart, and its watermark are folders of
    its own, so one that is run again after a failure replaces itself. path: a folder of this stream alone.
    """
    spark = events.sparkSession
    named = events.where("attempt is not null").withColumn("document", F.coalesce("document", F.lit("resume")))
    schema = _one_event(spark.createDataFrame([], named.schema)).withColumn("closed", F.lit(False)).schema

    def fold(batch: DataFrame, number: int) -> None:
        rows, marks = batch, [batch.agg(F.unix_millis(F.expr(f"max(at) - interval {late}")).alias("mark")).first().mark]
        if number:
            marks.append(spark.read.schema("mark long").parquet(f"{path}/marks/batch={number - 1}").first().mark)
            rows = batch.where(F.coalesce(F.col("at") > F.timestamp_millis(F.lit(marks[-1]).cast("long")), F.lit(marks[-1] is None)))
        mark = max((m for m in marks if m is not None), default=None)
        rows = _one_event(rows)
        if number:
            left = spark.read.schema(schema).parquet(f"{path}/attempts/batch={number - 1}").where("not closed").drop("closed")
            rows = rows.unionByName(left)
        latest = [F.max(f).alias(f) for f in ("last_at", *_SAYS, "settled")]
        folded = rows.groupBy("run_id", "document", "attempt").agg(F.min("first").alias("first"), F.sum("events").alias("events"), *latest)
        closed = F.coalesce(F.unix_millis("last_at") + idle_ms < F.lit(mark).cast("long"), F.lit(False))
        folded.withColumn("closed", closed).write.mode("overwrite").partitionBy("closed").parquet(f"{path}/attempts/batch={number}")
        spark.range(1).select(F.lit(mark).cast("long").alias("mark")).write.mode("overwrite").parquet(f"{path}/marks/batch={number}")
        if number > 1:  # those that it left open are in the batch after it
            _drop(spark, f"{path}/attempts/batch={number - 2}/closed=false")

    named.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    if not _exists(spark, f"{path}/attempts"):
        return _as_fold(spark.createDataFrame([], schema))
    return _as_fold(spark.read.schema(schema).parquet(f"{path}/attempts").where("closed"))


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run an append stream over all that is there now into Parquet files, each row once also after a restart, and return all rows so far."""
    stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def usage_stream(calls: DataFrame) -> DataFrame:
    """Running calls, tokens and seconds of each run."""
    return calls.groupBy("run_id").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.coalesce("tokens", F.lit(0.0))).alias("tokens"), F.round(F.sum(F.coalesce("seconds", F.lit(0.0))), 2).alias("seconds"))


def gate_stream(items: DataFrame, sources: DataFrame) -> DataFrame:
    """A stream of cited items against static sources: each citation, and whether it names a source.

    items: (owner_id, item_id, cites); one row for each citation, so no state is kept.
    """
    cited = items.select("owner_id", "item_id", F.explode(F.array_distinct("cites")).alias("source_id"))
    known = sources.select("owner_id", "source_id", F.lit(True).alias("known")).dropDuplicates(["owner_id", "source_id"])
    return cited.join(known, ["owner_id", "source_id"], "left").select("owner_id", "item_id", "source_id", F.coalesce("known", F.lit(False)).alias("known"))


def gate_items(items: DataFrame, record: D.Record, said_of: Callable[[DataFrame], D.Said], entries: DataFrame, entry_kinds: tuple[str, ...], path: str, checkpoint: str) -> DataFrame:
    """A stream of bullets through all rules of an item: its citations, their owners, and the terms and figures it claims.

    items: a stream of (owner_id, where, under, text, cites); entries as in Documents; said_of finds what a batch's bullets
    (owner_id, where, text) claim. Every bullet is judged against static tables alone, so a batch is a plan
    of stream-static joins and no state is kept; a batch's violations are its own folder, so one that is
    run again after a failure replaces itself. Returns all violations so far: (owner_id, where, kind, subject).
    """
    spark = items.sparkSession
    none = lambda schema: spark.createDataFrame([], schema)

    def judge(batch: DataFrame, number: int) -> None:
        bullets = written(batch, "items")
        docs = D.Documents(entries, bullets, *[none("owner_id long")] * 4)  # only the items' rules run
        found = D.item_violations(docs, record, said_of(bullets.select("owner_id", "where", "text")), entry_kinds)
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    items.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    kind = items.schema["owner_id"].dataType.simpleString()
    return spark.read.schema(f"owner_id {kind}, `where` string, kind string, subject string, batch int").parquet(path).drop("batch")


def chunk_stream(pages: DataFrame, late: str = "1 day") -> DataFrame:
    """Arriving pages (page_id, url, html, at) to evidence chunks, each page's first arrival only."""
    once = pages.withWatermark("at", late).dropDuplicatesWithinWatermark(["page_id"])
    return P.chunk_texts(P.extract_posts(once), doc="page_id")


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there now, into a memory table, and return the table."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there now: each batch's full result replaces the one before.

    The result of a batch is written to a folder of its own, named by the batch number, so a
    repeated batch writes the same folder again; the last one is read.
    """
    batches: list[int] = []

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        batches.append(batch)

    query = stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    return spark.read.parquet(f"{path}/batch={max(batches)}") if batches else spark.createDataFrame([], stream.schema)
