"""Text and fit queries on the driver's tables: benchmark items as postings, sources as records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.functions import vocab
from tracewell.functions.shared import written
from tracewell.operators import fit, ground, mentions, rubrics


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dictionary(bench: DataFrame) -> DataFrame:
    """Words of four letters or more that occur in at most half of the items."""
    words = bench.select("item_id", F.explode(F.array_distinct(T.runs("text"))).alias("term")).where(F.col("term").rlike("^[a-z]{4,}$"))
    total = bench.agg(F.count(F.lit(1))).scalar()
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * 2 <= total).select("term")


class Tables:
    """The roles that the driver's tables play."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.docs, self.bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
        self.terms = dictionary(self.bench)

    def wanted(self) -> DataFrame:
        return mentions.single_word_mentions(self.bench, self.terms, "item_id")

    def in_docs(self) -> DataFrame:
        return mentions.single_word_mentions(self.docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), self.terms)

    def by_source(self) -> DataFrame:
        """(source, doc_id, term), the term found in the document."""
        rules = mentions.spellings(self.terms).select("term", F.col("spelling").alias("key"))
        keyed = self.docs.select("source", "doc_id", F.explode(F.array_distinct(T.runs("text"))).alias("key"))
        return keyed.join(rules, "key").select("source", "doc_id", "term").distinct()

    def present(self) -> DataFrame:
        rules = mentions.spellings(self.terms).select("term", F.col("spelling").alias("key"))
        keyed = self.docs.select("source", F.explode(F.array_distinct(T.runs("text"))).alias("key"))
        return keyed.join(rules, "key").select("source", "term").distinct()

    def present_words(self) -> DataFrame:
        return self.docs.select("source", F.explode(T.content_words("text")).alias("word")).distinct()


def fit_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return fit.coverage(t.wanted(), t.present())


def posting_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return fit.preview(t.wanted(), t.present())


def fit_top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.top_owners(fit_matrix(spark, sf_dir))


def term_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return mentions.mentions(t.docs, t.terms).groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))


def technical_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.technical_tokens(table(spark, sf_dir, "documents"))


def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return mentions.spellings(t.terms).unionByName(mentions.derived_spellings(t.terms)).select("term", "spelling")


def gap_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    record = t.by_source()
    first = t.docs.groupBy("source").agg(F.min("doc_id").alias("doc_id"))
    draft = record.join(first, ["source", "doc_id"]).select("source", "term")
    return fit.gaps(t.wanted(), draft, record)


def requirement_addressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return fit.addressed(fit.requirements(t.bench), t.present_words())


def _met_by_terms(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(requirements, which source meets them), by terms where they name any."""
    spelled = mentions.spellings(t.terms).select("term", F.col("spelling").alias("key"))
    said = t.bench.select("item_id", F.posexplode(T.sentences("text")).alias("seq", "sentence"))
    named = said.select("item_id", "seq", F.explode(F.array_distinct(T.runs("sentence"))).alias("key")).join(spelled, "key").select("item_id", "seq", "term").distinct()
    reqs = fit.requirements(t.bench)
    judged = reqs.join(named.select("item_id", "seq", F.lit("term").alias("named")).distinct(), ["item_id", "seq"], "left")
    judged = judged.select("item_id", "seq", F.when(F.col("named").isNull(), F.col("words")).otherwise(F.array("named")).alias("words"))
    return judged, fit.addressed_by_terms(reqs, named, t.present(), t.present_words())


def requirement_met(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _met_by_terms(Tables(spark, sf_dir))[1]


def requirement_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.qualification_score(*_met_by_terms(Tables(spark, sf_dir)))


def qualification_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    reqs = fit.requirements(t.bench)
    return fit.qualification_score(reqs, fit.addressed(reqs, t.present_words()))


def total_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage as skills and as keywords, requirements met, the first sentence as title."""
    t = Tables(spark, sf_dir)
    reqs = fit.requirements(t.bench)
    met = written(fit.addressed(reqs, t.present_words()), "met")
    qual = fit.qualification_score(reqs, met).select("item_id", "source", "score")
    title = met.where("seq = 0").select("item_id", "source", F.round(F.col("hits") / F.col("needed"), 6).alias("title"))
    both = fit.coverage(t.wanted(), t.present()).join(qual, ["item_id", "source"], "left").join(title, ["item_id", "source"], "left")
    total = fit.weighted(hard_skills=F.col("coverage"), qualifications=F.col("score"), title_fit=F.col("title"), keywords_in_context=F.col("coverage"))
    return both.select("item_id", "source", total.alias("total"))


def unreachable_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    anywhere = t.present().select("term", F.lit(1).alias("found")).distinct()
    return t.wanted().join(anywhere, "term", "left").groupBy("item_id").agg(F.count(F.lit(1)).alias("wanted"), F.count_if(F.col("found").isNull()).alias("nowhere"))


def keyword_stuffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    counts = t.docs.select("doc_id", F.explode(T.runs("text")).alias("term")).join(t.terms, "term").groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    bullets = t.docs.select("doc_id", F.greatest(F.lit(1), F.size(F.split(F.coalesce("text", F.lit("")), "\n"))).alias("bullets"))
    return fit.stuffing(counts, bullets)


def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = table(spark, sf_dir, "documents").select("doc_id", T.normalize("text").alias("norm"))
    return norm.select("doc_id", F.md5("norm").alias("norm_md5"), F.length("norm").alias("n_chars"), F.md5(F.regexp_replace("norm", "[^a-z0-9]+", "")).alias("squash_md5"))


def content_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.words("text")).alias("n_words"), F.size(T.content_words("text")).alias("n_content"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", T.sentences("text").alias("s"))
    return s.select("doc_id", F.size("s").alias("n_sentences"), F.coalesce(F.array_max(F.transform("s", lambda x: F.length(x))), F.lit(0)).alias("longest"), F.md5(F.array_join("s", "|")).alias("digest"))


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "documents").select("doc_id", T.figures("text").alias("f")).where(F.size("f") > 0)
    return f.select("doc_id", F.size("f").alias("n_figures"), F.array_join("f", " ").alias("figures"))


def figure_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of a document that another document of the same source supports."""
    docs = table(spark, sf_dir, "documents")
    claims = ground.figure_claims(docs, ["doc_id", "source"])
    # two texts at most tell whether another document has a key: the smallest and the greatest id
    keys = ground.figure_keys(docs, ["doc_id", "source"]).groupBy("source", "kind", "key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    found = claims.join(keys, ["source", "kind", "key"], "left").withColumn("other", F.coalesce((F.col("low") != F.col("doc_id")) | (F.col("high") != F.col("doc_id")), F.lit(False)))
    each = found.groupBy("doc_id", "figure").agg(F.max("other").alias("ok"))
    return each.groupBy("doc_id").agg(F.count(F.lit(1)).alias("figures"), F.count_if("ok").alias("supported"))


def draft_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, context and format components of each document as a draft for the item that its id falls to.

    An item's first sentence is its title, and its number deals a level to it, or none.
    """
    t = Tables(spark, sf_dir)
    item = F.pmod(F.col("doc_id"), F.lit(t.bench.agg(F.count(F.lit(1))).scalar()))
    docs = t.docs.select("doc_id", item.alias("item_id"), "text")
    level = F.get(F.array(*[F.lit(x) for x in ["", *vocab.SENIORITY]]), F.pmod("item_id", F.lit(7)).cast("int"))
    postings = t.bench.select("item_id", F.get(T.sentences("text"), F.lit(0)).alias("title"), level.alias("seniority"))
    titled = fit.title_fit(docs.join(postings, "item_id").withColumn("levels", F.col("text")), surface="text")
    titled = titled.select("doc_id", "item_id", "overlap", "title_fit", F.array_join("missing_title", " ").alias("missing_title"))
    wanted = written(t.wanted(), "wanted")
    # only the words that a draft's own posting wants are counted: the others are never dealt out
    runs = docs.select("doc_id", "item_id", F.explode(T.runs("text")).alias("term")).join(wanted, ["item_id", "term"])
    counts = runs.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    bullets = docs.select("doc_id", F.greatest(F.lit(1), F.size(F.split(F.coalesce("text", F.lit("")), "\n"))).alias("bullets"))
    told = fit.in_context(wanted, counts, bullets, docs.select("doc_id", "item_id"))
    shape = rubrics.format_share(rubrics.text_layer_rubric(docs))
    return titled.join(told, "doc_id").join(shape, "doc_id")


QUERIES = {f.__name__: f for f in (
    fit_matrix, posting_preview, fit_top_sources, term_mentions, technical_tokens, spelling_variants, gap_classes, requirement_addressed, requirement_met, requirement_score, qualification_score, total_score, draft_components,
    unreachable_terms, keyword_stuffing, normalized_text, content_words, sentences, figures, figure_support,
)}
