"""Scores of drafts on the driver's tables: documents as drafts for benchmark items, their sources as records.

A document's first sentence is its headline and held title, its lines are bullets and its source's
name is its skill. An item's first sentence is its title, its other sentences are requirements, its
terms of up to eight letters are skills asked for, and those of six or more are keywords.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.functions import vocab
from tracewell.functions.shared import written
from tracewell.operators import rubrics, scores
from tracewell.plans.text_queries import Tables


class Drafts:
    """The tables of operators/scores.py, made of the driver's."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        t = Tables(spark, sf_dir)
        item = F.pmod(F.col("doc_id"), F.lit(t.bench.agg(F.count(F.lit(1))).scalar()))
        first = F.get(T.sentences("text"), F.lit(0))
        none = F.lit(None).cast("string")
        bullets, skills = F.split(F.coalesce("text", F.lit("")), "\n"), F.array(F.coalesce("source", F.lit("")))
        rows = t.docs.select("doc_id", item.alias("item_id"), "source", first.alias("headline"), none.alias("summary"), bullets.alias("bullets"), skills.alias("skills"), F.array(first).alias("titles"))
        self.rows, self.shape = rows, rubrics.format_share(rubrics.text_layer_rubric(t.docs))
        self.answered = rows.select("item_id", "source")
        level = F.get(F.array(*[F.lit(x) for x in ["", *vocab.SENIORITY]]), F.pmod("item_id", F.lit(7)).cast("int"))
        self.postings = t.bench.select("item_id", first.alias("title"), level.alias("seniority"))
        kinds = F.array(F.when(F.length("term") <= 8, F.lit("hard")), F.when(F.length("term") >= 6, F.lit("keyword")))
        self.wanted = t.wanted().select("item_id", F.explode(kinds).alias("kind"), "term").where("kind is not null")
        self.quals = t.bench.select("item_id", F.posexplode(T.sentences("text")).alias("seq", "text")).where("seq > 0")
        self.record = t.docs.select("source", "doc_id", F.concat_ws("\n", "text", "source").alias("text"))
        self.held = t.docs.select("source", first.alias("title"))
        self.terms = t.terms

    @cached_property
    def drafts(self) -> DataFrame:
        """Written, as every step of a score reads it: checks and texts meet once."""
        return written(self.rows.join(self.shape, "doc_id"), "drafts")

    @cached_property
    def want(self) -> scores.Asked:
        return scores.asked(self.wanted, self.quals, self.terms)

    def scored(self) -> scores.Scored:
        return scores.score_drafts(self.drafts, self.postings, self.want)


def draft_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Drafts(spark, sf_dir).scored().scores


def draft_ceilings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source could score at most for the items that its documents are drafts for."""
    d = Drafts(spark, sf_dir)
    return scores.ceilings(d.answered, d.postings, d.record, d.held, d.want)


def draft_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Drafts(spark, sf_dir)
    return scores.draft_gaps(d.drafts, d.scored(), d.record)


def draft_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Drafts(spark, sf_dir)
    scored = d.scored()
    return scores.feedback(d.drafts, scored, scores.draft_gaps(d.drafts, scored, d.record), d.postings, d.quals)


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = scores.document_texts(Drafts(spark, sf_dir).rows)
    return said.select("doc_id", F.md5("searchable").alias("searchable_md5"), F.md5("running").alias("running_md5"), "n_words", "n_bullets")


def score_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.breakdown(draft_scores(spark, sf_dir))


#: The target of the query on notes: the driver's drafts score far below vocab.TARGET.
NOTE_TARGET = 30.0


def score_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Drafts(spark, sf_dir)
    best = scores.ceilings(d.answered, d.postings, d.record, d.held, d.want)
    return scores.notes(d.scored().scores, d.rows, best, NOTE_TARGET)


QUERIES = {f.__name__: f for f in (draft_scores, draft_ceilings, draft_gaps, draft_feedback, document_texts, score_breakdown, score_notes)}
