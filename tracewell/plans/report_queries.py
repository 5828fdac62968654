"""Reporting tables over the fit, gate and run results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.functions import vocab
from tracewell.operators import fit, mentions
from tracewell.plans.record_queries import _attempts, claim_gate
from tracewell.plans.text_queries import Tables, total_score


def score_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, source, component, points) of the components that depend on the pair, for pairs that share a term."""
    t = Tables(spark, sf_dir)
    reqs = fit.requirements(t.bench)
    met = fit.addressed(reqs, t.present_words())
    qual = fit.qualification_score(reqs, met).select("item_id", "source", "score")
    both = fit.coverage(t.wanted(), t.present()).join(qual, ["item_id", "source"], "left")
    part = lambda name, share: F.struct(F.lit(name).alias("component"), F.round(F.coalesce(share, F.lit(0.0)) * vocab.WEIGHTS[name] * 100, 4).alias("points"))
    return both.select("item_id", "source", F.inline(F.array(part("hard_skills", F.col("coverage")), part("qualifications", F.col("score")))))


def ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item: the best total that any record reaches, its gap to the target, and whether it gets there."""
    best = total_score(spark, sf_dir).groupBy("item_id").agg(F.max("total").alias("ceiling"))
    return best.select("item_id", "ceiling", F.round(F.greatest(F.lit(0.0), vocab.TARGET - F.col("ceiling")), 1).alias("gap"), (F.col("ceiling") >= vocab.TARGET).alias("reachable"))


def answers_posting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item, the documents that name any of its first thirty terms (longest first, then by name), and how many terms."""
    t = Tables(spark, sf_dir)
    first = t.wanted().withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc(F.length("term")), "term"))).where("place <= 30")
    # a term is a bit, so one aggregate counts it once, however many of its spellings a document has
    spelled = first.join(mentions.spellings(t.terms).select("term", F.col("spelling").alias("key")), "term").select("key", "item_id", F.expr("shiftleft(1L, place)").alias("bit"))
    if spelled.count() <= mentions.BROADCAST_SPELLINGS:
        spelled = F.broadcast(spelled)
    keyed = t.docs.select("doc_id", F.explode(F.array_distinct(T.runs("text"))).alias("key"))
    return keyed.join(spelled, "key").groupBy("item_id", "doc_id").agg(F.bit_count(F.bit_or("bit")).cast("long").alias("named"))


def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line for each run: attempts, best total, and the totals in order."""
    per = _attempts(spark, sf_dir).groupBy("run_id").agg(F.count(F.lit(1)).alias("attempts"), F.max("total").alias("best"), F.array_sort(F.collect_list(F.struct("attempt", "total"))).alias("t"))
    return per.select("run_id", "attempts", "best", F.array_join(F.transform("t", lambda x: F.format_string("%.1f", x["total"])), " ").alias("totals"))


def violation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation, a summary of its violations by turn, as turn×count in order."""
    per = claim_gate(spark, sf_dir).groupBy("owner_id", "item_id").agg(F.count(F.lit(1)).alias("n"))
    lists = per.groupBy("owner_id").agg(F.sum("n").alias("violations"), F.array_sort(F.collect_list(F.struct("item_id", "n"))).alias("x"))
    return lists.select("owner_id", "violations", F.array_join(F.transform("x", lambda v: F.concat(v["item_id"].cast("string"), F.lit("×"), v["n"].cast("string"))), ", ").alias("summary"))


QUERIES = {f.__name__: f for f in (score_components, ceiling, answers_posting, run_summaries, violation_report)}
