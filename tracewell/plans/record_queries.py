"""Gate, rubric, page and run queries on the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.functions.shared import shared_folder, written
from tracewell.operators import ground, rubrics, runs, sets
from tracewell.plans.text_queries import Tables, table
from tracewell.sources import pages as P
from tracewell.streaming import stages


def cited_items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(items, sources): assistant turns cite the nearest earlier user turn of their conversation."""
    turns = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    last_user = F.last(F.when(F.col("role") == "user", F.col("turn")), True).over(w)
    items = turns.withColumn("cite", last_user).where("role = 'assistant'")
    items = items.select(F.col("conv_id").alias("owner_id"), F.col("turn").alias("item_id"), "text", F.when(F.col("cite").isNull(), F.expr("cast(array() as array<bigint>)")).otherwise(F.array(F.col("cite").cast("long"))).alias("cites"))
    sources = turns.select(F.col("conv_id").alias("owner_id"), F.col("turn").cast("long").alias("source_id"), F.col("role").alias("kind"), "text", F.lit(None).cast("long").alias("parent_id"))
    return items, sources


def unknown_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant turn also cites the turn two before it; a first answer has none there."""
    items, sources = cited_items(spark, sf_dir)
    items = items.withColumn("cites", F.array_append("cites", F.col("item_id").cast("long") - 2))
    return ground.unknown_citations(items, sources).select("owner_id", "item_id", "source_id")


def misattributed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn sits under the turn before it; citing another user turn is misattribution."""
    items, sources = cited_items(spark, sf_dir)
    items = items.withColumn("entry_id", F.col("item_id").cast("long") - 1).withColumn("cites", F.array_append("cites", F.col("item_id").cast("long") - 3))
    return ground.misattributed(items, sources, ("user",))


def _source_items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(items, sources): a document's source cited by its first document; children are its other documents."""
    docs = table(spark, sf_dir, "documents")
    docs = docs.join(docs.groupBy("source").agg(F.min("doc_id").alias("first")), "source")
    sources = docs.select(F.col("source").alias("owner_id"), F.col("doc_id").alias("source_id"), "text", F.when(F.col("first") != F.col("doc_id"), F.col("first")).alias("parent_id"))
    items = sources.where("parent_id is null").select("owner_id", F.col("source_id").alias("item_id"), F.array("source_id").alias("cites"))
    return items, sources


def supporting_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ground.support_md5s(*_source_items(spark, sf_dir))


def supporting_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that supporting_text digests, each with its place, length and md5."""
    parts = ground.supporting_parts(*_source_items(spark, sf_dir)).select("owner_id", "item_id", "source_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))
    return sets.ranked_in_ranges(parts, ["owner_id", "item_id"], [(F.floor(F.col("source_id") / 65536), False)], [F.col("source_id")], "place")


def _violations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items, sources = cited_items(spark, sf_dir)
    rules = Tables(spark, sf_dir)
    from tracewell.operators.mentions import spellings

    spelled = spellings(rules.terms).select("term", F.col("spelling").alias("key"))
    keyed = lambda df, *cols: df.select(*cols, F.explode(F.array_distinct(T.runs("text"))).alias("key")).join(spelled, "key").select(*cols, "term").distinct()
    claimed = keyed(items, "owner_id", "item_id")
    cited = items.select("owner_id", "item_id", F.explode("cites").alias("source_id")).join(sources.select("owner_id", "source_id", "text"), ["owner_id", "source_id"])
    return items, ground.unsupported_terms(claimed, keyed(cited, "owner_id", "item_id"))


def claim_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _violations(spark, sf_dir)[1]


def gate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claim_gate(spark, sf_dir).groupBy("owner_id").agg(F.count(F.lit(1)).alias("violations"), F.count_distinct("item_id").alias("items"))


def blocked_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ground.blocked_terms(claim_gate(spark, sf_dir))


def repaired_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation, the turns that stay after cutting the violating ones, and their words."""
    items, bad = _violations(spark, sf_dir)
    kept = ground.cut(items, bad).groupBy("owner_id").agg(F.count(F.lit(1)).alias("kept"), F.sum(F.size(T.words("text"))).alias("words"))
    return items.groupBy("owner_id").agg(F.count(F.lit(1)).alias("items")).join(kept, "owner_id", "left").select("owner_id", "items", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("words", F.lit(0)).alias("words"), F.coalesce(F.col("kept") >= 2, F.lit(False)).alias("usable"))


def _keyed(spark: SparkSession, sf_dir: str) -> Callable[..., DataFrame]:
    """Which terms the texts of a table name, by its id columns."""
    from tracewell.operators.mentions import spellings

    spelled = spellings(Tables(spark, sf_dir).terms).select("term", F.col("spelling").alias("key"))
    return lambda df, *cols: df.select(*cols, F.explode(F.array_distinct(T.runs("text"))).alias("key")).join(spelled, "key").select(*cols, "term").distinct()


def _cited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(entries, sources, terms claimed, terms supported, figures unsupported) of the assistant turns.

    Of those that cite anything, one in five also cites the turn three before it, and one in three its own.
    """
    items, sources = cited_items(spark, sf_dir)
    keyed = _keyed(spark, sf_dir)
    turn, deal = F.col("item_id").cast("long"), F.col("owner_id") + F.col("item_id")
    more = F.filter(F.array(F.when(deal % 5 == 0, turn - 3), F.when(deal % 3 == 0, turn)), lambda x: x.isNotNull())
    entries = items.withColumn("entry_id", turn - 1).withColumn("cites", F.when(F.size("cites") > 0, F.array_union("cites", more)).otherwise(F.col("cites")))
    cited = entries.select("owner_id", "item_id", F.explode("cites").alias("source_id")).join(sources.select("owner_id", "source_id", "text"), ["owner_id", "source_id"])
    ids = ["owner_id", "item_id"]
    figures = ground.unsupported_figures(ground.figure_claims(items, ids), ground.figure_keys(cited, ids))
    return entries, sources, keyed(items, *ids), keyed(cited, *ids), figures


def _gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over the assistant turns."""
    entries, sources, claimed, supported, figures = _cited(spark, sf_dir)
    return ground.gate(entries, sources, claimed, supported, ("user",), figures)


def regated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation: the violating turns are cut, and what stays goes through the gate again."""
    entries, sources, claimed, supported, figures = _cited(spark, sf_dir)
    first = written(ground.gate(entries, sources, claimed, supported, ("user",), figures), "gate")
    kept = ground.cut(entries, first)
    again = ground.gate(kept, sources, ground.cut(claimed, first), supported, ("user",), ground.cut(figures, first))
    return ground.repair_outcome(entries, kept, again, 1)


def _letters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(paragraphs, violations): a conversation as a letter that may name the terms of its first turn."""
    turns = table(spark, sf_dir, "conversations")
    entries, sources, claimed, supported, figures = _cited(spark, sf_dir)
    opening = turns.groupBy(F.col("conv_id").alias("owner_id")).agg(F.min_by("text", "turn").alias("text"))
    allowed = _keyed(spark, sf_dir)(opening, "owner_id")
    return entries, ground.letter_gate(opening, entries, sources, claimed, supported, allowed, figures)


def letter_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _letters(spark, sf_dir)[1]


def repaired_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph with its number among those that stay, or null; a letter is usable if two or more stay."""
    paragraphs, bad = _letters(spark, sf_dir)
    kept = ground.renumbered(ground.cut(paragraphs, bad)).select("owner_id", "item_id", "number")
    stay = F.count("number").over(Window.partitionBy("owner_id"))
    return paragraphs.join(kept, ["owner_id", "item_id"], "left").select("owner_id", "item_id", "number", (stay >= 2).alias("usable"))


def profile_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assistant turn is also a section for the turn after it, which must be a user's."""
    entries, sources, claimed, supported, figures = _cited(spark, sf_dir)
    sections = entries.select("owner_id", (F.col("item_id").cast("long") + 1).alias("entry_id"))
    return ground.profile_gate(sections, sources.where("kind = 'user'"), entries, sources, claimed, supported, figures)


def prose_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's last turn is its summary; all turns that any answer cites are selected."""
    items, sources = cited_items(spark, sf_dir)
    turns = table(spark, sf_dir, "conversations")
    prose = turns.groupBy(F.col("conv_id").alias("owner_id")).agg(F.max_by("text", "turn").alias("text")).withColumn("part", F.lit("summary"))
    chosen = items.select("owner_id", F.explode("cites").alias("source_id")).distinct()
    scope = sources.join(chosen, ["owner_id", "source_id"], "left_semi").select("owner_id", "text")
    keyed = _keyed(spark, sf_dir)
    return ground.prose_scope(keyed(prose, "owner_id", "part"), keyed(scope, "owner_id"), ground.figure_claims(prose, ["owner_id", "part"]), ground.figure_keys(scope, ["owner_id"]))


def gate_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gate(spark, sf_dir)


def gate_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ground.kind_counts(_gate(spark, sf_dir))


def entry_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn selects the next one for the other role's section."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("owner_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    entries = turns.select("owner_id", (F.col("turn") + 1).alias("entry_id"), F.when(F.col("role") == "user", "answers").otherwise("questions").alias("section"))
    sources = turns.select("owner_id", F.col("turn").alias("source_id"), F.col("role").alias("kind"))
    bullets = turns.where(F.length("text") > 200).select("owner_id", F.col("turn").alias("entry_id"))
    return ground.entry_checks(entries, sources, bullets, {"answers": ("assistant",), "questions": ("user",)})


def unknown_certifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brand lists all names of its parts as certificates; those of its economy parts are some."""
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("owner_id"), F.col("p_name").alias("source_id"), F.col("p_type").alias("kind"))
    return ground.unknown_certifications(part.select("owner_id", F.col("source_id").alias("cited")), part, "ECONOMY")


def undeclared_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a brand's part types that none of its part names holds."""
    parts = table(spark, sf_dir, "part")
    words = lambda c: parts.select(F.col("p_brand").alias("owner_id"), F.explode(F.split(F.col(c), " ")).alias("skill"))
    return ground.undeclared_skills(words("p_type"), words("p_name"))


def best_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as letters; the order key's remainder by four stands for its failures."""
    keys = table(spark, sf_dir, "orders")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    letters = keys.select(F.col("o_custkey").alias("run_id"), n.alias("attempt"), (F.col("o_orderstatus") == "F").alias("grounded"), (F.col("o_orderstatus") != "P").alias("parses"), (F.col("o_orderkey") % 4).alias("failures"), F.col("o_orderpriority").startswith("1").alias("repaired"))
    return runs.best_letter(letters.withColumn("reads_well", F.col("failures") == 0))


def description_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewell.sources.imports import split_descriptions

    return split_descriptions(table(spark, sf_dir, "documents")).select("doc_id", "n", F.length("line").alias("n_chars"), F.md5("line").alias("digest"))


def claim_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, sources = cited_items(spark, sf_dir)
    cited = items.select("owner_id", "item_id", F.length("text").alias("n_chars"), F.explode("cites").alias("source_id"))
    return cited.join(sources.select("owner_id", "source_id", F.md5(F.coalesce("text", F.lit(""))).alias("source_md5"), F.col("kind").alias("label")), ["owner_id", "source_id"])


def _bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.trim("line") != "")


def bullet_rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rubrics.bullet_rubric(_bullets(spark, sf_dir))


def rubric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rubrics.summary(bullet_rubric(spark, sf_dir), "doc_id")


def letter_rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rubrics.letter_rubric(table(spark, sf_dir, "conversations").where("role = 'assistant'"), ["conv_id", "turn"])


def text_layer_rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rubrics.text_layer_rubric(table(spark, sf_dir, "documents"))


def page_layout_rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rubrics.page_layout_rubric(table(spark, sf_dir, "pages"))


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rubrics.round_trip_rows(table(spark, sf_dir, "documents"), T.sentences("text"))


def verbatim_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = table(spark, sf_dir, "benchmark").select(F.explode(T.sentences("text")).alias("sentence"))
    return rubrics.verbatim_echo(bench, table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("echoed"))


def extracted_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.extract_posts(table(spark, sf_dir, "pages"))
    return p.select("page_id", "title", "date", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def discovered_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.discover_links(table(spark, sf_dir, "pages"))


def evidence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.chunk_texts(table(spark, sf_dir, "documents"))


def evidence_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sources, pages' articles as evidence of the owner that their number falls to."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("owner_id"), F.col("doc_id").alias("source_id"), F.lit("document").alias("kind"), F.length(F.coalesce("text", F.lit(""))).alias("n_chars"))
    pages = P.extract_posts(table(spark, sf_dir, "pages")).select(F.concat(F.lit("src"), (F.col("page_id") % 20).cast("string")).alias("owner_id"), F.col("page_id").alias("source_id"), F.lit("evidence").alias("kind"), F.length("text").alias("n_chars"))
    return P.union_evidence(docs, pages)


def completed_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    pages = P.extract_posts(table(spark, sf_dir, "pages")).select(F.col("page_id").alias("doc_id"), F.col("text").alias("page_text"))
    return P.complete_posts(docs, pages, "doc_id", "source", 40).select("doc_id", "source", "completed", F.length("text").alias("n_chars"))


def contacts_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail addresses and phone-shaped digit runs of each document that has any."""
    found = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0))).alias("m"),
        F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\+?[0-9][0-9 ().-]{7,}[0-9]"), F.lit(0))).alias("p"),
    )
    return found.where("size(m) + size(p) > 0").select("doc_id", F.array_join("m", "|").alias("emails"), F.array_join("p", "|").alias("phones"))


def month_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as dated entries: those in status O are current."""
    start = F.date_format("o_orderdate", "yyyy-MM")
    end = F.when(F.col("o_orderstatus") == "O", F.lit("")).otherwise(F.date_format(F.col("o_orderdate") + F.expr("interval 40 days"), "yyyy-MM"))
    return table(spark, sf_dir, "orders").select("o_orderkey", sets.month_range(start, end).alias("shown"))


def ordered_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order of a customer with its rank."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.concat(F.date_format("o_orderdate", "yyyy-MM-dd "), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("start"), F.when(F.col("o_orderstatus") == "O", F.lit("")).otherwise(F.date_format("o_orderdate", "yyyy-MM")).alias("end"))
    return runs.newest_first(o, "o_custkey", "start", "end").select("o_custkey", "o_orderkey", "rank")


def newest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of a customer's entries, newest first."""
    return ordered_entries(spark, sf_dir)


def entry_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    facts = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return facts.select("s_suppkey", F.concat_ws(", ", "s_name", "n_name").alias("title_line"), F.col("r_name").alias("context_line"))


def entry_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return sets.pair_entries(part.where("p_type = 'ECONOMY'"), part.where("p_type = 'SMALL'"), "p_brand", "p_name", "p_partkey")


def assigned_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.assign_ids(table(spark, sf_dir, "part"), "p_brand", "p_name", "p_partkey").select("p_partkey", "p_brand", "assigned_id")


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as attempts, by date; the ceiling is 5 points over the customer's best."""
    o = table(spark, sf_dir, "orders")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    total = F.round(F.col("o_totalprice") / 6000, 1)
    a = o.select(F.col("o_custkey").alias("run_id"), n.alias("attempt"), total.alias("total"), (F.col("o_orderstatus") != "P").alias("parses"), (F.col("o_orderstatus") == "F").alias("grounded"), F.col("o_orderpriority").startswith("1").alias("repaired"))
    return a.withColumn("ceiling", F.max("total").over(Window.partitionBy("run_id")) + 5)


def best_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.best_attempt(_attempts(spark, sf_dir))


def stop_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.stop_reasons(_attempts(spark, sf_dir)).select("run_id", "attempt", "reason")


def run_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_outcomes(runs.stop_reasons(_attempts(spark, sf_dir)))


def stage_events(events: DataFrame) -> DataFrame:
    attempt = F.coalesce(F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("int"), F.lit(0)) % 4
    return events.select(F.col("user_id").alias("run_id"), attempt.alias("attempt"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), F.col("ts").cast("timestamp").alias("at"), F.col("value").alias("score"))


def attempt_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.attempt_timeline(stage_events(table(spark, sf_dir, "events"))).withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("first_at", "last_at")})


#: Event types as stages of an attempt.
STAGES = {"click": "drafting", "view": "verifying", "purchase": "scored", "error": "rejected", "signup": "repaired"}


def full_events(events: DataFrame) -> DataFrame:
    """Events with all that a stage may say; every fifth kind of props belongs to no attempt."""
    k = F.coalesce(F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("int"), F.lit(0))
    stage = F.create_map(*[F.lit(x) for pair in STAGES.items() for x in pair])[F.col("event_type")]
    only = lambda *kinds: F.col("event_type").isin(*kinds)
    return events.select(
        F.col("user_id").cast("long").alias("run_id"),
        F.when(k % 3 == 1, F.lit("cover_letter")).when(k % 3 == 2, F.lit("resume")).alias("document"),
        F.when(k % 5 != 4, F.col("event_id").cast("int") % 4 + 4 * (F.dayofmonth("ts") % 8)).cast("int").alias("attempt"),
        F.when(k % 2 == 0, F.lit(32)).alias("attempts"),
        F.col("event_id").cast("long").alias("seq"),
        F.col("ts").cast("timestamp").alias("at"),
        stage.alias("stage"),
        F.when(only("purchase"), F.col("value")).alias("score"),
        F.when(only("view"), k > 50).alias("parses"),
        F.when(only("view"), k % 4).alias("pages"),
        F.when(only("click"), k * 10).alias("words"),
        F.when(only("signup") & (k % 7 > 0), k % 7).alias("dropped"),
        F.when(only("signup", "error") & (k > 10), F.concat(F.col("event_type"), F.lit("×"), k.cast("string"))).alias("reason"),
    )


_SHOWN = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def attempt_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.attempt_folds(full_events(table(spark, sf_dir, "events"))).withColumn("last_at", F.date_format("last_at", _SHOWN))


def run_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.milestones(full_events(table(spark, sf_dir, "events"))).select("run_id", "seq", "stage", "score")


def closed_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts that a stream over the events' files has closed: those without an event for a day before the last hour."""
    events = full_events(stages.file_stream(spark, sf_dir, "events", 1_000_000))
    closed = stages.close_attempts(events, shared_folder(spark, "closed"), shared_folder(spark, "closed-state"), "1 hour", 86_400_000)
    return closed.withColumn("last_at", F.date_format("last_at", _SHOWN))


def event_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.event_tail(stage_events(table(spark, sf_dir, "events")), 400, 100).select("run_id", "seq", "stage", "from_end")


def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_quantity").alias("tokens"), F.col("l_extendedprice").alias("seconds"))
    return runs.usage(calls)


def copy_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "conversations").select("conv_id", "role", F.explode(F.split("text", r"(?<=[.!?])[\x09-\x0D\x20]+|\n+")).alias("line")).withColumn("line", T.normalize("line")).where("line <> ''")
    change = sets.drift(lines.where("role = 'user'"), lines.where("role = 'assistant'"), ["conv_id"])
    return change.groupBy("conv_id", "change").agg(F.count(F.lit(1)).alias("lines"))


def all_merged_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item's content words, then those of the documents dealt to it, in order."""
    bench, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    words = lambda df, key, base: df.select(key.alias("item_id"), F.posexplode(T.content_words("text")).alias("seq", "term"), base.alias("base")).withColumn("seq", F.col("base") * 1_000_000 + F.col("seq")).drop("base")
    dealt = F.col("doc_id") % bench.agg(F.count(F.lit(1))).scalar()
    return sets.merge_terms(words(bench, F.col("item_id"), F.lit(0)), words(docs, dealt, F.col("doc_id")), normal=True)


def merged_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All terms of an item, its own first."""
    return all_merged_terms(spark, sf_dir)


def ranked_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.ranked_lists(claim_gate(spark, sf_dir), ["owner_id"], ["item_id", "term"], 25)


def shortlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten longest documents of each source, cut to 120 characters at a word."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"), T.truncate("text", 120).alias("cut"))
    return runs.ranked_lists(d, ["source"], [F.desc("n"), "doc_id"], 10).select("source", "doc_id", "rank", "cut")


def timeline_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timeline as a stream over the events' files; equals the batch result."""
    events = stage_events(stages.file_stream(spark, sf_dir, "events"))
    out = stages.run_to_parquet(stages.timeline_stream(events), shared_folder(spark, "timeline"), shared_folder(spark, "timeline-state"))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("first_at", "last_at")})


def usage_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = stages.file_stream(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("value").alias("tokens"), (F.col("value") * 2).alias("seconds"))
    return stages.run_to_parquet(stages.usage_stream(calls), shared_folder(spark, "usage"), shared_folder(spark, "usage-state"))


QUERIES = {f.__name__: f for f in (
    unknown_citations, misattributed_items, supporting_text, supporting_parts, claim_gate, gate_summary, blocked_terms, repaired_documents, claim_snapshot,
    gate_violations, gate_kinds, regated_documents, letter_violations, repaired_letters, profile_violations, prose_claims, entry_checks, unknown_certifications, undeclared_skills, best_letter, description_lines,
    bullet_rubric, rubric_summary, letter_rubric, text_layer_rubric, page_layout_rubric, round_trip, verbatim_echo, extracted_posts, discovered_links,
    evidence_chunks, evidence_sources, completed_posts, contacts_found, month_ranges, newest_entries, ordered_entries, entry_facts, entry_pairs, assigned_ids,
    best_attempt, stop_reason, run_outcome, attempt_timeline, attempt_folds, run_milestones, closed_attempts, event_tail, usage_rollup, copy_drift, merged_terms, all_merged_terms, ranked_feedback, shortlists,
    timeline_stream, usage_stream,
)}
