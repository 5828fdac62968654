"""Names and whole-document gates on the driver's tables.

A conversation is a document: its user turns are entries, the lines of the assistant turns after them
bullets, its last turn the summary, the first line of its first turn the headline. Terms are the
dictionary's words of six letters or more; words that begin or end alike are synonyms. The tables' texts hold no
figures, so some lines state the number of the turn before them, and most turns their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions import dates
from tracewell.functions.shared import shared_folder, written
from tracewell.operators import documents as D
from tracewell.operators import ground, mentions, names
from tracewell.plans.text_queries import Tables, dictionary, table
from tracewell.sources import evidence, links
from tracewell.sources import pages as P
from tracewell.streaming import stages

ALLOWED = {"answers": ("user",), "questions": ("certification",)}
LONG = 6


def long_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary(table(spark, sf_dir, "benchmark")).where(F.length("term") >= LONG)


def alike(terms: DataFrame) -> DataFrame:
    """(alias, name): each term and the first of those with the same first, or last, five letters."""
    ends = [(F.left("term", F.lit(5)),), (F.right("term", F.lit(5)),)]
    pairs = [terms.select(F.col("term").alias("alias"), F.min("term").over(Window.partitionBy(*e)).alias("name")) for e in ends]
    return pairs[0].unionByName(pairs[1]).where("alias <> name").distinct()


def synonym_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.synonym_classes(alike(long_terms(spark, sf_dir)))


def canonical_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, how many of the long terms it names under canonical names, and the first of them."""
    terms = written(long_terms(spark, sf_dir), "long-terms")
    found = names.canonical_mentions(table(spark, sf_dir, "documents"), terms, alike(terms))
    return found.groupBy("doc_id").agg(F.count("term").alias("n_terms"), F.min("term").alias("first_term"))


def claim_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name under which a dictionary word may be backed."""
    terms = written(Tables(spark, sf_dir).terms, "terms")
    return names.names_of(terms, alike(terms.where(F.length("term") >= LONG)))


class Conversations:
    """The conversations as documents, the turns as their record, and what the documents claim."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        terms = written(long_terms(spark, sf_dir), "long-terms")
        self.names = written(names.names_of(terms, alike(terms)), "names")
        self.groups = D.groups_of(self.names)
        turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("owner_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
        turns = turns.withColumn("text", F.when(F.col("turn") % 4 != 2, F.concat("text", F.lit(" "), F.col("turn").cast("string"))).otherwise(F.col("text")))
        earlier = Window.partitionBy("owner_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
        user = F.last(F.when(F.col("role") == "user", F.col("turn")), True).over(earlier)
        ends = Window.partitionBy("owner_id")
        self.turns = turns = written(turns.withColumns({"before": user, "first": F.min("turn").over(ends), "last": F.max("turn").over(ends)}), "turns")
        kind = F.when(F.col("role") == "system", "certification").otherwise(F.col("role"))
        sources = turns.select("owner_id", F.col("turn").alias("source_id"), kind.alias("kind"), F.when(F.col("role") == "user", F.col("before")).alias("parent_id"))

        odd = (F.col("owner_id") * 3 + F.col("turn")) % 7
        section = F.when(odd == 5, "questions").otherwise("answers")
        entry = F.when(odd == 3, F.col("turn") + 100).otherwise(F.col("turn"))
        entries = turns.where("role = 'user'").select("owner_id", F.col("turn").alias("of_turn"), D.place_of_entry(section, entry).alias("where"), section.alias("section"), entry.alias("entry_id"))

        lines = turns.where("role = 'assistant' and before is not null").select("owner_id", "turn", F.col("before").alias("of_turn"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
        lines = lines.join(entries.select("owner_id", "of_turn", F.col("where").alias("under")), ["owner_id", "of_turn"])
        stated = F.when((F.col("owner_id") + F.col("line")) % 4 == 1, F.concat("text", F.lit(" "), F.col("of_turn").cast("string"))).otherwise(F.col("text"))
        lines = lines.withColumn("text", F.when((F.col("owner_id") + F.col("turn") + F.col("line")) % 17 == 0, F.lit(" ")).otherwise(stated))
        more = F.when((F.col("turn") + F.col("line")) % 5 == 0, F.array("of_turn", F.col("turn") - 3)).otherwise(F.array("of_turn"))
        cites = F.when((F.col("owner_id") + F.col("line")) % 11 == 0, F.array().cast("array<bigint>")).otherwise(more)
        self.bullets = written(lines.select("owner_id", D.under(F.col("under"), F.col("turn") * 1000 + F.col("line")).alias("where"), "under", "text", cites.alias("cites")), "bullets")

        prose = turns.where("turn = last").select("owner_id", F.lit("summary").alias("where"), "text")
        prose = written(prose.unionByName(turns.where("turn = first").select("owner_id", F.lit("headline").alias("where"), F.split("text", "\n")[0].alias("text"))), "prose")
        owners = turns.select("owner_id").distinct()
        cited = owners.select("owner_id", F.explode(F.expr("if(owner_id % 9 = 0, array(0L, 50L), array(0L))")).alias("source_id"))

        said = self.claimed(self.bullets.select("owner_id", "where", "text").unionByName(prose))
        in_turns = written(self.named(turns.select("owner_id", F.col("turn").alias("where"), "text"), self.names.select(F.col("name").alias("term"))), "turn-names").select("owner_id", F.col("where").alias("source_id"), F.col("term").alias("name"))
        keys = written(ground.figure_keys(turns, ["owner_id", "turn"]), "turn-figures").withColumnRenamed("turn", "source_id")
        user_names = in_turns.join(turns.where("role = 'user'").select("owner_id", F.col("turn").alias("source_id")), ["owner_id", "source_id"], "left_semi")
        first_names = in_turns.join(turns.where("turn = first").select("owner_id", F.col("turn").alias("source_id")), ["owner_id", "source_id"], "left_semi")
        self.said = said
        self.owners = owners
        self.record = D.Record(sources, in_turns, keys, first_names.select("owner_id", "name"), user_names.select("owner_id", "name"))
        skills = said.terms.where("where = 'summary'").select("owner_id", F.lit("named").alias("category"), F.col("term").alias("skill"))
        self.documents = D.Documents(entries.drop("of_turn"), self.bullets, skills, owners.select("owner_id", F.lit(0).cast("long").alias("cited")), prose, cited)

    def named(self, texts: DataFrame, lexicon: DataFrame) -> DataFrame:
        """(owner_id, where, term): the lexicon's terms that each text has."""
        keyed = texts.select(F.struct("owner_id", "where").alias("id"), "text")
        return mentions.mentions(keyed, lexicon, "id").select("id.owner_id", "id.where", "term")

    def claimed(self, texts: DataFrame) -> D.Said:
        terms = written(self.named(texts, self.names.select("term").distinct()), "claimed-terms")
        return D.Said(terms, written(ground.figure_claims(texts, ["owner_id", "where"]), "claimed-figures"), self.names, self.groups)


def document_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Conversations(spark, sf_dir)
    return D.violations(c.documents, c.record, c.said, ALLOWED, ("user",))


def document_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Conversations(spark, sf_dir)
    return D.outcomes(c.owners, c.documents, D.repair(c.documents, c.record, c.said, ALLOWED, ("user",)))


def document_parts_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part that stays after the cut, by its place."""
    c = Conversations(spark, sf_dir)
    kept = D.repair(c.documents, c.record, c.said, ALLOWED, ("user",)).kept
    rows = [(kept.entries, "entry", F.col("where")), (kept.bullets, "bullet", F.col("where")), (kept.skills, "skill", F.col("skill")), (kept.certificates, "certificate", F.col("cited").cast("string")), (kept.prose, "prose", F.col("where"))]
    parts = [df.select("owner_id", F.lit(part).alias("part"), place.alias("place")) for df, part, place in rows]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def letter_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a conversation's answers as a letter's paragraphs, two of which must stay."""
    c = Conversations(spark, sf_dir)
    none = c.documents
    empty = lambda df: df.where("false")
    letters = D.Documents(empty(none.entries), c.bullets.withColumn("under", F.lit(None).cast("string")), empty(none.skills), empty(none.certificates), empty(none.prose), empty(none.prose_cites))
    done = D.repaired_letters(c.owners, letters, c.record, c.said)
    return D.outcomes(c.owners, letters, done, 2).drop("entries_kept")


def streamed_item_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations' lines as a stream of items, in batches of files, judged one by one."""
    c = Conversations(spark, sf_dir)
    folder = shared_folder(spark, "lines")
    c.bullets.repartition(4, "owner_id").write.parquet(folder)
    items = spark.readStream.schema(c.bullets.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    return stages.gate_items(items, c.record, c.claimed, c.documents.entries, ("user",), shared_folder(spark, "judged"), shared_folder(spark, "judged-state"))


def post_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the pages' anchors lead that looks like a post."""
    return links.post_links(table(spark, sf_dir, "pages"))


def synced_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' posts synced twice as streams, lines as paragraphs: the second sync adds nothing."""
    store = shared_folder(spark, "evidence")
    for _ in range(2):
        posts = P.extract_posts(stages.file_stream(spark, sf_dir, "pages"))
        out = evidence.sync_posts(posts, store, shared_folder(spark, "sync"), between="\n")
    return out.select("evidence_id", "content_id", "url", "n", F.length("text").alias("n_chars"))


def order_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates as records and mails write them, read again."""
    day = F.col("o_orderdate").cast("timestamp")
    form = F.col("o_orderkey") % 6
    shown = F.when(form == 0, F.date_format(day, "MMM yyyy")).when(form == 1, F.date_format(day, "M/yyyy")).when(form == 2, F.date_format(day, "yyyy-M")).when(form == 3, F.date_format(day, "yyyy"))
    shown = shown.when(form == 4, F.concat(F.lit("early in "), F.date_format(day, "yyyy"))).otherwise(F.date_format(day, "MMMM yyyy"))
    mailed = F.when(form < 3, F.date_format(day, "EEE, d MMM yyyy HH:mm")).otherwise(F.date_format(day, "yyyy-MM-dd HH:mm"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", dates.record_date(shown).alias("r"), dates.post_date(mailed).alias("p"))
    return o.select("o_orderkey", F.col("r.value").alias("month"), F.col("r.family").alias("family"), F.col("p.value").alias("day"), F.col("p.family").alias("day_family"))


QUERIES = {f.__name__: f for f in (synonym_classes, canonical_mentions, claim_names, document_violations, document_repairs, document_parts_kept, letter_repairs, streamed_item_gate, post_links, synced_evidence, order_dates)}
