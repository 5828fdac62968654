"""The gate: cited items against their sources, and what remains after cutting what fails."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.functions import vocab


def unknown_citations(items: DataFrame, sources: DataFrame) -> DataFrame:
    """(item columns, cited): citations that name no source of the same owner.

    items: (owner_id, item_id, cites array); sources: (owner_id, source_id).
    """
    cited = items.select("owner_id", "item_id", F.explode(F.array_distinct("cites")).alias("source_id"))
    return cited.join(sources.select("owner_id", "source_id").distinct(), ["owner_id", "source_id"], "left_anti")


def misattributed(items: DataFrame, sources: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Citations of entry-kind sources that do not belong to the entry the item sits under.

    items: (owner_id, item_id, entry_id, cites); sources: (owner_id, source_id, kind, parent_id).
    """
    cited = items.select("owner_id", "item_id", "entry_id", F.explode(F.array_distinct("cites")).alias("source_id"))
    found = cited.join(sources.select("owner_id", "source_id", "kind", "parent_id"), ["owner_id", "source_id"])
    own = (F.col("source_id") == F.col("entry_id")) | F.coalesce(F.col("parent_id") == F.col("entry_id"), F.lit(False))
    return found.where(F.col("kind").isin(*kinds) & ~own).select("owner_id", "item_id", "source_id")


def supporting_parts(items: DataFrame, sources: DataFrame) -> DataFrame:
    """(owner_id, item_id, source_id, text): the cited sources and their children, a row for each."""
    cited = items.select("owner_id", "item_id", F.explode("cites").alias("source_id"))
    direct = cited.join(sources.select("owner_id", "source_id", "text"), ["owner_id", "source_id"])
    children = sources.where("parent_id is not null").select("owner_id", F.col("parent_id").alias("source_id"), F.col("source_id").alias("child_id"), "text")
    below = cited.join(children, ["owner_id", "source_id"]).select("owner_id", "item_id", F.col("child_id").alias("source_id"), "text")
    return direct.select("owner_id", "item_id", "source_id", "text").unionByName(below).dropDuplicates(["owner_id", "item_id", "source_id"])


def supporting_text(items: DataFrame, sources: DataFrame) -> DataFrame:
    """(owner_id, item_id, support): the texts of supporting_parts in id order, for items whose support fits one value."""
    parts = supporting_parts(items, sources).groupBy("owner_id", "item_id").agg(F.array_sort(F.collect_list(F.struct("source_id", "text"))).alias("parts"))
    return parts.select("owner_id", "item_id", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("support"))


def support_digests(items: DataFrame, sources: DataFrame) -> DataFrame:
    """(owner_id, item_id, n_parts, n_chars, digest): what supporting_text would hold, which is never put together.

    n_chars counts the line breaks between parts. The digest is the sum, over the parts that have a
    text, of the first eight hex digits of md5('id:md5 of the text'), so tasks add it up in any order.
    """
    part = F.md5(F.concat(F.col("source_id").cast("string"), F.lit(":"), F.md5("text")))
    number = F.conv(F.left(part, F.lit(8)), 16, 10).cast("long")
    zero = lambda c: F.coalesce(c, F.lit(0))
    per = supporting_parts(items, sources).groupBy("owner_id", "item_id").agg(
        F.count("text").alias("n_parts"), zero(F.sum(F.length("text").cast("long"))).alias("n_chars"), zero(F.sum(number)).alias("digest"),
    )
    return per.withColumn("n_chars", F.col("n_chars") + F.greatest(F.lit(0), F.col("n_parts") - 1))


def support_md5s(items: DataFrame, sources: DataFrame) -> DataFrame:
    """(owner_id, item_id, n_chars, digest): length and md5 of supporting_text, which is never put together.

    An item's parts pass through its md5 one by one, in id order; null texts are left out.
    """
    parts = supporting_parts(items, sources)
    schema = parts.select("owner_id", "item_id", F.lit(0).cast("long").alias("n_chars"), F.lit("").alias("digest")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, md5, n, parted, types = None, None, 0, False, ()

        def made() -> pa.RecordBatch:
            columns = [pa.array([x], t) for x, t in zip(at, types, strict=True)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([n], pa.int64()), pa.array([md5.hexdigest()])], names=["owner_id", "item_id", "n_chars", "digest"])

        for batch in batches:
            types = batch.schema.types[:2]
            for owner, item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (owner, item) != at:
                    if at:
                        yield made()
                    at, md5, n, parted = (owner, item), hashlib.md5(), 0, False
                if text is not None:
                    part = "\n" + text if parted else text
                    md5.update(part.encode())
                    n, parted = n + len(part), True
        if at:
            yield made()

    dealt = parts.repartition("owner_id", "item_id").sortWithinPartitions("owner_id", "item_id", "source_id")
    return dealt.select("owner_id", "item_id", "text").mapInArrow(run, schema)


def unsupported_terms(claimed: DataFrame, supported: DataFrame) -> DataFrame:
    """(owner_id, item_id, term): terms of an item that its support does not name."""
    return claimed.join(supported, ["owner_id", "item_id", "term"], "left_anti")


def figure_keys(texts: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """(ids, kind, key): what supports a figure. Value keys compare by value, text keys as written.

    A value key is any number or number word, to nine places; a text key any run of digits that
    starts after neither digit nor point, so 40.5 supports a claim of 40 and 5.05 not one of 05.
    """
    norm = F.replace(T.normalize(text_col), F.lit(","))
    values = F.transform(F.regexp_extract_all(norm, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: F.struct(F.lit("value").alias("kind"), F.round(x.cast("double"), 9).cast("string").alias("key")))
    texts_ = F.transform(F.regexp_extract_all(norm, F.lit(r"(?<![0-9.])(\d+)(?![0-9])"), F.lit(1)), lambda x: F.struct(F.lit("text").alias("kind"), x.alias("key")))
    number = F.create_map(*[F.lit(v) for w, n in vocab.NUMBER_WORDS.items() for v in (w, float(n))])
    said = F.filter(F.regexp_extract_all(norm, F.lit("[a-z]+"), F.lit(0)), lambda w: w.isin(*vocab.NUMBER_WORDS))
    named = F.transform(said, lambda w: F.struct(F.lit("value").alias("kind"), F.element_at(number, w).cast("string").alias("key")))
    return texts.select(*id_cols, F.inline(F.array_distinct(F.concat(values, texts_, named))))


def figure_claims(texts: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """(ids, figure, kind, key): each distinct figure of a text, under both kinds of key."""
    each = texts.select(*id_cols, F.explode(F.array_distinct(T.figures(text_col))).alias("figure"))
    keys = F.array(F.struct(F.lit("value").alias("kind"), F.round(F.col("figure").cast("double"), 9).cast("string").alias("key")), F.struct(F.lit("text").alias("kind"), F.col("figure").alias("key")))
    return each.select(*id_cols, "figure", F.inline(keys))


def undeclared_skills(skills: DataFrame, declared: DataFrame) -> DataFrame:
    """(owner_id, skill): listed skills that no declared skill of the owner spells, in any plural form or case.

    Both: (owner_id, skill). Blank and null skills claim nothing.
    """
    key = T.normalize("skill")
    claimed = skills.select("owner_id", "skill").distinct().withColumn("key", key).where("key <> ''")
    spelled = claimed.select("owner_id", "skill", F.explode(F.array_append(F.transform(T.plural_forms(F.col("key")), lambda p: p["spelling"]), F.col("key"))).alias("key"))
    met = spelled.join(declared.select("owner_id", key.alias("key")).distinct(), ["owner_id", "key"], "left_semi").select("owner_id", "skill").distinct()
    return claimed.select("owner_id", "skill").join(met, ["owner_id", "skill"], "left_anti")


def entry_checks(entries: DataFrame, sources: DataFrame, bullets: DataFrame, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """(owner_id, entry_id, kind): selected entries that no source has, that stand in a section not theirs, or that hold nothing.

    entries: (owner_id, entry_id, section); sources: (owner_id, source_id, kind); bullets: (owner_id,
    entry_id). The first of the three that applies counts. allowed: the kinds of source for a section.
    """
    known = sources.select("owner_id", F.col("source_id").alias("entry_id"), F.col("kind").alias("is")).distinct()
    held = bullets.select("owner_id", "entry_id", F.lit(True).alias("held")).distinct()
    fits = F.lit(False)
    for section, kinds in allowed.items():
        fits = fits | ((F.col("section") == section) & F.col("is").isin(*kinds))
    kind = F.when(F.col("is").isNull(), "unknown_entry").when(~F.coalesce(fits, F.lit(False)), "wrong_section").when(F.col("held").isNull(), "empty_entry")
    joined = entries.join(known, ["owner_id", "entry_id"], "left").join(held, ["owner_id", "entry_id"], "left")
    return joined.select("owner_id", "entry_id", kind.alias("kind")).where("kind is not null").distinct()


def gate(items: DataFrame, sources: DataFrame, claimed: DataFrame, supported: DataFrame, kinds: tuple[str, ...], figures: DataFrame | None = None) -> DataFrame:
    """(owner_id, item_id, level, kind, subject): every item's violations of its earliest failing rule.

    The rules in order: a text without words, no citation, a citation that nothing answers to, one of
    another entry's source, a term or a figure that the support does not name. Null texts are empty.
    items: (owner_id, item_id, entry_id, text, cites); claimed and supported: (owner_id, item_id, term);
    figures: (owner_id, item_id, figure) without support.
    """
    found = _cited_rules(items, sources, claimed, supported, figures)
    return first_failures(found.unionByName(_rule(misattributed(items, sources, kinds), 3, "misattributed", F.col("source_id"))))


def _rule(df: DataFrame, level: int, kind: str, subject: Column) -> DataFrame:
    return df.select("owner_id", "item_id", F.lit(level).alias("level"), F.lit(kind).alias("kind"), subject.cast("string").alias("subject"))


def _cited_rules(items: DataFrame, sources: DataFrame, claimed: DataFrame, supported: DataFrame, figures: DataFrame | None) -> DataFrame:
    """Violations of the rules that any cited text is under, of all levels."""
    none = F.lit("")
    found = _rule(items.where(F.coalesce(F.trim("text"), none) == ""), 0, "empty", none)
    found = found.unionByName(_rule(items.where(F.size(F.coalesce("cites", F.array().cast("array<bigint>"))) == 0), 1, "uncited", none))
    found = found.unionByName(_rule(unknown_citations(items, sources), 2, "unknown_citation", F.col("source_id")))
    found = found.unionByName(_rule(unsupported_terms(claimed, supported), 4, "unsupported_term", F.col("term")))
    return found if figures is None else found.unionByName(_rule(figures, 4, "unsupported_figure", F.col("figure")))


def letter_gate(letters: DataFrame, paragraphs: DataFrame, sources: DataFrame, claimed: DataFrame, supported: DataFrame, allowed: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    """gate for letters: no entries, some terms allowed, and a letter without paragraphs violates (null item_id).

    letters: (owner_id); allowed: (owner_id, term) that a letter may name without support, such as
    those in the name of whom it is written to.
    """
    free = claimed.join(allowed.select("owner_id", "term").distinct(), ["owner_id", "term"], "left_anti")
    found = first_failures(_cited_rules(paragraphs, sources, free, supported, figures))
    bare = letters.select("owner_id").distinct().join(paragraphs.select("owner_id"), "owner_id", "left_anti")
    bare = bare.withColumn("item_id", F.lit(None).cast(paragraphs.schema["item_id"].dataType))
    return found.unionByName(_rule(bare, 0, "empty_letter", F.lit("")))


def profile_gate(sections: DataFrame, roles: DataFrame, items: DataFrame, sources: DataFrame, claimed: DataFrame, supported: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    """gate for profile copy: the rules of cited texts, and sections (null item_id) for a role that is not the owner's.

    sections: (owner_id, entry_id); roles: (owner_id, source_id).
    """
    known = roles.select("owner_id", F.col("source_id").alias("entry_id"))
    strange = sections.select("owner_id", "entry_id").distinct().join(known, ["owner_id", "entry_id"], "left_anti")
    strange = strange.withColumn("item_id", F.lit(None).cast(items.schema["item_id"].dataType))
    return first_failures(_cited_rules(items, sources, claimed, supported, figures)).unionByName(_rule(strange, 0, "unknown_role", F.col("entry_id")))


def renumbered(kept: DataFrame) -> DataFrame:
    """The items that stay, with their number from 1 among them."""
    return kept.withColumn("number", F.row_number().over(Window.partitionBy("owner_id").orderBy("item_id")))


def repair_outcome(items: DataFrame, kept: DataFrame, remaining: DataFrame, least: int) -> DataFrame:
    """Per owner: items, kept, remaining violations of those kept, usable (none remains, and least stay).

    kept: items after cut; remaining: what the gate finds when it is run over kept alone.
    """
    left = kept.groupBy("owner_id").agg(F.count(F.lit(1)).alias("kept"))
    still = remaining.groupBy("owner_id").agg(F.count(F.lit(1)).alias("remaining"))
    both = items.groupBy("owner_id").agg(F.count(F.lit(1)).alias("items")).join(left, "owner_id", "left").join(still, "owner_id", "left")
    both = both.select("owner_id", "items", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("remaining", F.lit(0)).alias("remaining"))
    return both.withColumn("usable", (F.col("remaining") == 0) & (F.col("kept") >= least))


def prose_scope(claimed: DataFrame, supported: DataFrame, figures: DataFrame, keys: DataFrame) -> DataFrame:
    """(owner_id, part, kind, subject): terms and figures of prose about an owner that nothing selected for the owner supports.

    claimed: (owner_id, part, term); supported: (owner_id, term) of all selected sources; figures:
    figure_claims by owner_id and part; keys: figure_keys by owner_id.
    """
    terms = claimed.join(supported.select("owner_id", "term").distinct(), ["owner_id", "term"], "left_anti")
    met = figures.join(keys.distinct(), ["owner_id", "kind", "key"], "left_semi").select("owner_id", "part", "figure").distinct()
    told = figures.select("owner_id", "part", "figure").distinct().join(met, ["owner_id", "part", "figure"], "left_anti")
    kinds = lambda df, kind, subject: df.select("owner_id", "part", F.lit(kind).alias("kind"), F.col(subject).alias("subject"))
    return kinds(terms, "unsupported_term", "term").unionByName(kinds(told, "unsupported_figure", "figure"))


def unsupported_figures(claims: DataFrame, keys: DataFrame) -> DataFrame:
    """(owner_id, item_id, figure): figures of an item that its support gives neither by value nor as written.

    claims: figure_claims of the items; keys: figure_keys of their support, both by owner_id and item_id.
    """
    met = claims.join(keys.distinct(), ["owner_id", "item_id", "kind", "key"], "left_semi").select("owner_id", "item_id", "figure").distinct()
    return claims.select("owner_id", "item_id", "figure").distinct().join(met, ["owner_id", "item_id", "figure"], "left_anti")


def unknown_certifications(listed: DataFrame, sources: DataFrame, kind: str = "certification") -> DataFrame:
    """(owner_id, cited): listed certifications that name no source of that kind of their owner; null ids name none.

    listed: (owner_id, cited); sources: (owner_id, source_id, kind).
    """
    held = sources.where(F.col("kind") == kind).select("owner_id", F.col("source_id").alias("cited"))
    return listed.select("owner_id", "cited").distinct().join(held, ["owner_id", "cited"], "left_anti")


def kind_counts(violations: DataFrame) -> DataFrame:
    """Per owner: how many violations, and the kinds with their counts, sorted by kind."""
    each = violations.groupBy("owner_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "n"))), lambda x: F.concat(x["kind"], F.lit("×"), x["n"].cast("string"))), ", ")
    return each.groupBy("owner_id").agg(F.sum("n").alias("violations"), said.alias("summary"))


def first_failures(violations: DataFrame) -> DataFrame:
    """Per item, only the violations of its earliest failing rule (column level): later rules are skipped."""
    least = F.min("level").over(Window.partitionBy("owner_id", "item_id"))
    return violations.withColumn("_least", least).where("level = _least").drop("_least")


def cut(items: DataFrame, violations: DataFrame) -> DataFrame:
    """The items without a violation."""
    return items.join(violations.select("owner_id", "item_id").distinct(), ["owner_id", "item_id"], "left_anti")


def blocked_terms(violations: DataFrame, subject: str = "term") -> DataFrame:
    """Distinct unsupported subjects, by their normal form, with the first spelling and the items hit."""
    keyed = violations.withColumn("key", T.normalize(subject))
    return keyed.groupBy("key").agg(F.min(subject).alias("first_spelling"), F.count_distinct("owner_id", "item_id").alias("items"))
