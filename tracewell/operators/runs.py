"""Accounts of runs: best attempt, stop reason, timelines, usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import vocab
from tracewell.operators import sets


def best_attempt(attempts: DataFrame) -> DataFrame:
    """Per run: grounded before not, parsed before not, higher total, untouched before repaired, earlier."""
    rank = F.struct("grounded", "parses", "total", ~F.col("repaired"), -F.col("attempt"))
    return attempts.groupBy("run_id").agg(F.max_by(F.struct("attempt", "total", "grounded"), rank).alias("best"), F.count(F.lit(1)).alias("attempts")).select("run_id", "best.attempt", "best.total", "best.grounded", "attempts")


def best_letter(attempts: DataFrame) -> DataFrame:
    """Per run: grounded before not, parsed before not, one that reads well, fewer failures, untouched, earlier.

    attempts: (run_id, attempt, grounded, parses, reads_well, failures, repaired); null failures count as none.
    """
    rank = F.struct("grounded", "parses", "reads_well", -F.coalesce("failures", F.lit(0)), ~F.col("repaired"), -F.col("attempt"))
    return attempts.groupBy("run_id").agg(F.max_by(F.struct("attempt", "reads_well", "failures"), rank).alias("best")).select("run_id", "best.*")


def stop_reasons(attempts: DataFrame, target: float = vocab.TARGET, slack: float = vocab.SLACK, gain: float = vocab.MIN_GAIN) -> DataFrame:
    """Per attempt: why a run may stop there; null goes on. An unparsed attempt never stops.

    attempts: (run_id, attempt, total, parses, ceiling).
    """
    before = Window.partitionBy("run_id").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    best = F.max("total").over(before)
    reason = F.when(F.col("total") >= target, "threshold").when(F.col("total") >= F.col("ceiling") - slack, "ceiling").when(F.col("total") - best < gain, "plateau")
    return attempts.withColumn("reason", F.when(F.col("parses"), reason))


def run_outcomes(reasons: DataFrame) -> DataFrame:
    """Per run: attempts used up to the first stop, its reason (else exhausted, or ungrounded) and flags."""
    per = reasons.groupBy("run_id").agg(
        F.min(F.when(F.col("reason").isNotNull(), F.col("attempt"))).alias("stop_at"),
        F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("attempt"))).alias("why"),
        F.max("attempt").alias("last"),
        F.max("grounded").alias("any_grounded"),
        F.max("total").alias("best"),
        F.max("ceiling").alias("ceiling"),
    )
    reason = F.coalesce("why", F.when(F.col("any_grounded"), F.lit("exhausted")).otherwise(F.lit("ungrounded")))
    return per.select("run_id", F.coalesce("stop_at", "last").alias("used"), reason.alias("reason"), (F.col("best") >= vocab.TARGET).alias("met"), (F.col("ceiling") >= vocab.TARGET).alias("reachable"), (F.col("best") >= F.col("ceiling") - vocab.SLACK).alias("at_ceiling"))


def attempt_timeline(events: DataFrame) -> DataFrame:
    """Per run and attempt: events, first and last time, last stage, last score, and flags of what happened.

    events: (run_id, attempt, seq, stage, at, score). A fold by aggregates, so it also runs on a stream.
    """
    return events.groupBy("run_id", "attempt").agg(
        F.count(F.lit(1)).alias("events"),
        F.min("at").alias("first_at"),
        F.max("at").alias("last_at"),
        F.max_by("stage", "seq").alias("last_stage"),
        F.max_by("score", "seq").alias("last_score"),
        F.bool_or(F.col("stage") == "error").alias("failed"),
    )


def event_tail(events: DataFrame, keep: int = vocab.EVENTS_KEPT, after: int = -1) -> DataFrame:
    """The last keep events of each run, of those the ones past a cursor."""
    w = Window.partitionBy("run_id").orderBy(F.desc("seq"))
    return events.withColumn("from_end", F.row_number().over(w)).where((F.col("from_end") <= keep) & (F.col("seq") > after))


def usage(calls: DataFrame) -> DataFrame:
    """Per run and in total (null run): calls, tokens, seconds; missing figures count as zero."""
    return calls.rollup("run_id").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.coalesce("tokens", F.lit(0.0))).alias("tokens"), F.round(F.sum(F.coalesce("seconds", F.lit(0.0))), 2).alias("seconds"))


def newest_first(entries: DataFrame, owner: str, start: str, end: str) -> DataFrame:
    """Rank of each entry within its owner: current ones (empty end) first, then by end and start, latest first."""
    ranges = [(F.coalesce(F.col(end), F.lit("")) == "", True), (F.col(end), True), (F.left(F.col(start), F.lit(10)), True)]
    return sets.ranked_in_ranges(entries, [owner], ranges, [F.desc(start)], "rank")


def ranked_lists(rows: DataFrame, owner: list[str], order: list, most: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*owner).orderBy(*order))).where(F.col("rank") <= most)


#: Stages that settle an attempt, and what becomes of it.
OUTCOMES = {"rejected": "rejected", "scored": "finished"}


def milestones(events: DataFrame) -> DataFrame:
    """The events that belong to no attempt (null attempt), as they are."""
    return events.where("attempt is null")


def attempt_folds(events: DataFrame) -> DataFrame:
    """A row for each attempt at a document, with every event of it folded in by seq.

    events: (run_id, document, attempt, attempts, seq, at, stage, score, parses, pages, words, dropped,
    reason); a null document is 'resume', events without an attempt are milestones and left out. Last
    stage; last score, parses, pages and words that an event has; attempts as the first event says, else the attempt's
    number; repaired, with what its last repair dropped; the reason of the last repair or rejection; outcome
    'rejected' or 'finished' by the last event that settles it, else 'open'. first_seq orders the attempts
    of a run among its milestones.
    """
    of = lambda *stages: F.when(F.col("stage").isin(*stages), F.col("seq"))
    had = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    settled = F.max_by("stage", of(*OUTCOMES))
    outcome = F.coalesce(*[F.when(settled == stage, F.lit(what)) for stage, what in OUTCOMES.items()], F.lit("open"))
    mine = events.where("attempt is not null").withColumn("document", F.coalesce("document", F.lit("resume")))
    return mine.groupBy("run_id", "document", "attempt").agg(
        F.coalesce(F.min_by("attempts", "seq"), F.min("attempt")).alias("attempts"),
        F.min("seq").alias("first_seq"),
        F.count(F.lit(1)).alias("events"),
        F.max("at").alias("last_at"),
        F.max_by("stage", "seq").alias("stage"),
        had("score"),
        had("parses"),
        had("pages"),
        had("words"),
        F.bool_or(F.col("stage") == "repaired").alias("repaired"),
        F.coalesce(F.max_by(F.coalesce("dropped", F.lit(0)), of("repaired")), F.lit(0)).alias("dropped"),
        F.coalesce(F.max_by(F.coalesce("reason", F.lit("")), of("repaired", "rejected")), F.lit("")).alias("reason"),
        outcome.alias("outcome"),
    )
