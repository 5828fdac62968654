"""Whole rubrics on the driver's tables: documents as drafts, assistant turns as letters to benchmark items.

The tables hold no printed dates, headings or addressees, so ids deal them out, good and bad ones; mail
addresses and phone numbers are those in the texts, and the layout is that of the page of the same number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.functions import vocab
from tracewell.operators import reviews
from tracewell.plans.text_queries import Tables, table

MAIL, PHONE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"\(?[0-9]{3}\)?[-. ][0-9]{3}[-. ][0-9]{4}"
PAGE_CHARS = 3000


def draft_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    html = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "html")
    day = F.date_add(F.lit("2015-01-31").cast("date"), F.pmod("doc_id", F.lit(3000)).cast("int"))
    month = F.when(F.pmod("doc_id", F.lit(5)) == 0, F.date_format(day, "MMM yyyy")).otherwise(F.date_format(day, "MMMM yyyy"))
    ends = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.lit("Present")).otherwise(month)
    headings = F.array(*[F.lit(h) for h in [*vocab.STANDARD_HEADINGS, "odds and ends"]])
    drafts = docs.join(html, "doc_id", "left").select(
        "doc_id", "html", F.pmod("doc_id", F.lit(9)).alias("history"), F.array(F.get(headings, F.pmod("doc_id", F.lit(22)).cast("int"))).alias("headings"),
        F.array(F.concat(month, F.lit(" – "), ends), F.when(F.pmod("doc_id", F.lit(4)) == 0, F.lit(""))).alias("dates"),
        F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("bullets"),
        F.regexp_extract("text", MAIL, 0).alias("email"), F.regexp_extract("text", PHONE, 0).alias("phone"), F.col("source").alias("location"),
        F.when(F.pmod("doc_id", F.lit(6)) != 0, F.ceil(F.length("text") / PAGE_CHARS)).alias("pages"),
    )
    return reviews.draft_review(drafts, ["doc_id"])


def letter_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    n_items = t.bench.agg(F.count(F.lit(1))).scalar()
    wanted = t.wanted()
    firms = wanted.groupBy("item_id").agg(F.max("term").alias("company"))
    said = T.sentences("text")
    postings = t.bench.select("item_id", said.alias("qualifications")).join(firms, "item_id", "left").withColumn("company", F.when(F.col("item_id") % 3 != 0, F.col("company")))
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'").withColumn("item_id", F.pmod("conv_id", F.lit(n_items)))
    turns = turns.join(t.bench.select("item_id", F.get(said, F.lit(0)).alias("closing")), "item_id", "left")
    deal = F.col("conv_id") + F.col("turn")
    some = lambda n, c: F.when(deal % n == 0, c)
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda p: F.trim(p) != "")
    paragraphs = F.concat(F.array(some(7, F.lit("I am writing to apply."))), lines, F.array(some(5, F.col("closing"))))
    addressee = F.coalesce(some(4, F.lit("Dear Sir or Madam")), some(3, F.lit("Hiring Manager")))
    letters = turns.select("conv_id", "turn", "item_id", addressee.alias("addressee"), paragraphs.alias("paragraphs"))
    terms = wanted.select("item_id", (-F.length("term")).alias("place"), "term")
    return reviews.letter_review(letters, ["conv_id", "turn"], postings, terms, t.terms.where(F.length("term") >= 9))


def draft_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.verdicts(draft_review(spark, sf_dir), ["doc_id"])


def letter_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.verdicts(letter_review(spark, sf_dir), ["conv_id", "turn"])


QUERIES = {f.__name__: f for f in (draft_review, letter_review, draft_verdicts, letter_verdicts)}
