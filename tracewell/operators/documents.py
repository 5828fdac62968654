"""The gate over whole documents: entries, bullets, skills, certificates and prose, each under its own rules.

A place in a document is named by a locator: section[entry] for an entry, section[entry].bulletN for
a bullet, skills[category], certifications[id], summary, headline, paragraphN. Violations of an
entry suppress those of what stands under it, an item's earliest failing rule those of later ones. A
repair cuts what violates, and the same gate runs again on what stays.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.functions.shared import written
from tracewell.operators import ground, names

#: Violations of an entry that also settle all that stands under it.
REJECTED = ("unknown_entry", "wrong_section")


class Documents(NamedTuple):
    """Documents by owner, taken apart. where names a place; a place is one owner's.

    entries (owner_id, where, section, entry_id), bullets (owner_id, where, under, text, cites), under
    being the entry's place or null; skills (owner_id, category, skill), certificates (owner_id, cited),
    prose (owner_id, where, text), prose_cites (owner_id, source_id).
    """

    entries: DataFrame
    bullets: DataFrame
    skills: DataFrame
    certificates: DataFrame
    prose: DataFrame
    prose_cites: DataFrame


class Record(NamedTuple):
    """What backs documents: sources (owner_id, source_id, kind, parent_id), the names and figure keys in their texts, and listed names.

    terms (owner_id, source_id, name), figures (owner_id, source_id, kind, key); declared (owner_id, name) backs
    any claim, skills (owner_id, name) the listed skills only.
    """

    sources: DataFrame
    terms: DataFrame
    figures: DataFrame
    declared: DataFrame
    skills: DataFrame


class Groups(NamedTuple):
    """The names of claims as names.grouped has them: those that a text can back, and the spellings that a list can."""

    of_name: DataFrame
    of_term: DataFrame
    of_spelling: DataFrame
    listed: DataFrame


class Said(NamedTuple):
    """What documents claim: terms (owner_id, where, term), figures (owner_id, where, figure, kind, key), and the terms' names."""

    terms: DataFrame
    figures: DataFrame
    names: DataFrame
    groups: Groups | None = None  # of names, where it is known; else a gate works it out

    def grouped(self) -> Said:
        return self if self.groups else self._replace(groups=groups_of(self.names))


def groups_of(said_names: DataFrame) -> Groups:
    return Groups(*names.grouped(said_names, "name"), *names.grouped(names.with_plurals(said_names), "spelling"))


def under(parent: Column, number: Column) -> Column:
    return F.concat(parent, F.lit(".bullet"), number.cast("string"))


def _id(column: str) -> Column:
    """An id as text; a null one is the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def place_of_entry(section: Column, entry: Column) -> Column:
    return F.concat(section, F.lit("["), entry.cast("string"), F.lit("]"))


def widened(cited: DataFrame, sources: DataFrame) -> DataFrame:
    """(owner_id, where, source_id): cited sources that exist, and their children."""
    known = sources.select("owner_id", "source_id").distinct()
    direct = cited.join(known, ["owner_id", "source_id"], "left_semi").select("owner_id", "where", "source_id")
    children = sources.where("parent_id is not null").select("owner_id", F.col("parent_id").alias("source_id"), F.col("source_id").alias("child"))
    return direct.unionByName(cited.join(children, ["owner_id", "source_id"]).select("owner_id", "where", F.col("child").alias("source_id"))).distinct()


def unbacked(terms: DataFrame, figures: DataFrame, scope: DataFrame, record: Record, groups: Groups) -> DataFrame:
    """(owner_id, where, kind, subject): claimed terms and figures that neither the scope's sources nor what is declared backs.

    terms and figures as in Said; scope: (owner_id, where, source_id) as widened gives it. Claims and
    sources meet in groups of names, so a term has not a row for each name of its class.
    """
    named = terms.join(groups.of_term, "term").select("owner_id", "where", "term", "group")
    in_sources = record.terms.join(groups.of_name, "name").select("owner_id", "source_id", "group").distinct()
    told = scope.join(in_sources, ["owner_id", "source_id"]).select("owner_id", "where", "group").distinct()
    in_text = named.join(told, ["owner_id", "where", "group"], "left_semi").select("owner_id", "where", "term")
    spelled = terms.join(groups.listed, "term")
    listed = spelled.join(_grouped_names(record.declared, groups), ["owner_id", "group"], "left_semi").select("owner_id", "where", "term")
    no_term = terms.select("owner_id", "where", "term").distinct().join(in_text.unionByName(listed).distinct(), ["owner_id", "where", "term"], "left_anti")
    keys = scope.join(record.figures, ["owner_id", "source_id"]).select("owner_id", "where", "kind", "key").distinct()
    met = figures.join(keys, ["owner_id", "where", "kind", "key"], "left_semi").select("owner_id", "where", "figure").distinct()
    no_figure = figures.select("owner_id", "where", "figure").distinct().join(met, ["owner_id", "where", "figure"], "left_anti")
    return _found(no_term, "unsupported_term", F.col("term")).unionByName(_found(no_figure, "unsupported_figure", F.col("figure")))


def _grouped_names(listed: DataFrame, groups: Groups) -> DataFrame:
    """Distinct (owner_id, group) of listed names."""
    return listed.select("owner_id", F.col("name").alias("spelling")).join(groups.of_spelling, "spelling").select("owner_id", "group").distinct()


def _found(rows: DataFrame, kind: str | Column, subject: Column | None = None) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return rows.select("owner_id", "where", kind.alias("kind"), F.lit("").alias("subject") if subject is None else subject.cast("string").alias("subject"))


def entry_violations(docs: Documents, record: Record, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """Entries that no source has, that stand in a section of another kind, or that hold nothing."""
    known = record.sources.select("owner_id", F.col("source_id").alias("entry_id"), F.col("kind").alias("of")).distinct()
    held = docs.bullets.where("under is not null").select("owner_id", F.col("under").alias("where"), F.lit(True).alias("held")).distinct()
    fits = F.lit(False)
    for section, kinds in allowed.items():
        fits = fits | ((F.col("section") == section) & F.col("of").isin(*kinds))
    kind = F.when(F.col("of").isNull(), "unknown_entry").when(~F.coalesce(fits, F.lit(False)), "wrong_section").when(F.col("held").isNull(), "empty_entry")
    joined = docs.entries.join(known, ["owner_id", "entry_id"], "left").join(held, ["owner_id", "where"], "left")
    return _found(joined.withColumn("kind", kind).where("kind is not null"), F.col("kind")).distinct()


def _bullet_rules(bullets: DataFrame, entries: DataFrame, record: Record, entry_kinds: tuple[str, ...]) -> DataFrame:
    """(owner_id, where, level, kind, subject): rules of a bullet's citations, before what it claims."""
    with_level = lambda df, level: df.withColumn("level", F.lit(level))
    empty = with_level(_found(bullets.where(F.coalesce(F.trim("text"), F.lit("")) == ""), "empty_bullet"), 0)
    uncited = with_level(_found(bullets.where(F.coalesce(F.size("cites"), F.lit(0)) <= 0), "uncited_bullet"), 1)
    cited = bullets.select("owner_id", "where", "under", F.explode(F.array_distinct("cites")).alias("source_id"))
    known = record.sources.select("owner_id", "source_id").distinct()
    unknown = with_level(_found(cited.join(known, ["owner_id", "source_id"], "left_anti"), "unknown_source", F.col("source_id")), 2)
    entry_of = entries.select("owner_id", F.col("where").alias("under"), "entry_id").distinct()
    placed = cited.join(entry_of, ["owner_id", "under"]).join(record.sources.select("owner_id", "source_id", F.col("kind").alias("of"), "parent_id"), ["owner_id", "source_id"])
    own = (F.col("source_id") == F.col("entry_id")) | F.coalesce(F.col("parent_id") == F.col("entry_id"), F.lit(False))
    foreign = with_level(_found(placed.where(F.col("of").isin(*entry_kinds) & ~own), "misattributed_bullet", F.col("source_id")), 3)
    return empty.unionByName(uncited).unionByName(unknown).unionByName(foreign)


def violations(docs: Documents, record: Record, said: Said, allowed: dict[str, tuple[str, ...]], entry_kinds: tuple[str, ...]) -> DataFrame:
    """(owner_id, where, kind, subject): everything for which a document may not go out.

    allowed: the kinds of source that an entry of each section may be. An entry that is unknown or in
    a wrong section suppresses its bullets' violations; of a bullet only its earliest failing rule counts: no
    text, no citation, an unknown one, one of another entry's source, then terms and figures that its sources do not
    back. Prose is held to all entries that are not rejected and to what it cites itself. Documents
    without any part have no violations; null texts are empty.
    """
    said = said.grouped()
    of_entries = entry_violations(docs, record, allowed)
    rejected = of_entries.where(F.col("kind").isin(*REJECTED)).select("owner_id", "where").distinct()
    live = docs.bullets.join(rejected.withColumnRenamed("where", "under"), ["owner_id", "under"], "left_anti")

    of_items = item_violations(docs._replace(bullets=live), record, said, entry_kinds)
    mine = lambda df, places: df.join(places.select("owner_id", "where").distinct(), ["owner_id", "where"], "left_semi")

    selected = docs.entries.join(rejected, ["owner_id", "where"], "left_anti").select("owner_id", F.col("entry_id").alias("source_id"))
    prose = docs.prose.where(F.coalesce(F.trim("text"), F.lit("")) != "")
    scope = prose.select("owner_id", "where").distinct().join(selected.unionByName(docs.prose_cites.select("owner_id", "source_id")).distinct(), "owner_id")
    of_prose = unbacked(mine(said.terms, prose), mine(said.figures, prose), widened(scope, record.sources), record, said.groups)
    lost = docs.prose_cites.select("owner_id", "source_id").distinct().join(record.sources, ["owner_id", "source_id"], "left_anti")
    of_prose = of_prose.unionByName(_found(lost.withColumn("where", F.lit("summary")), "unknown_source", F.col("source_id")))

    wanted = docs.certificates.select("owner_id", "cited").distinct()
    certificates = ground.unknown_certifications(wanted, record.sources).withColumn("where", F.concat(F.lit("certifications["), _id("cited"), F.lit("]")))
    return of_entries.unionByName(of_items).unionByName(of_prose).unionByName(_found(certificates, "unknown_certification", _id("cited"))).unionByName(undeclared(docs.skills, record, said.groups))


def item_violations(docs: Documents, record: Record, said: Said, entry_kinds: tuple[str, ...]) -> DataFrame:
    """(owner_id, where, kind, subject) of the bullets' earliest failing rules, each bullet judged by itself."""
    said = said.grouped()
    rules = _bullet_rules(docs.bullets, docs.entries, record, entry_kinds)
    least = F.min("level").over(Window.partitionBy("owner_id", "where"))
    first = written(rules.withColumn("_least", least).where("level = _least").drop("_least", "level"), "bullet-rules")
    sound = docs.bullets.join(first.select("owner_id", "where").distinct(), ["owner_id", "where"], "left_anti")
    cited = sound.select("owner_id", "where", F.explode("cites").alias("source_id"))
    mine = lambda df: df.join(sound.select("owner_id", "where").distinct(), ["owner_id", "where"], "left_semi")
    return first.unionByName(unbacked(mine(said.terms), mine(said.figures), widened(cited, record.sources), record, said.groups))


def undeclared(skills: DataFrame, record: Record, groups: Groups) -> DataFrame:
    """Listed skills that the record lists under no name. groups must have the skills' names."""
    listed = skills.withColumn("term", T.normalize("skill")).where("term <> ''").withColumn("where", F.concat(F.lit("skills["), F.col("category"), F.lit("]")))
    spelled = listed.join(groups.listed, "term")
    met = spelled.join(_grouped_names(record.skills, groups), ["owner_id", "group"], "left_semi").select("owner_id", "where", "skill").distinct()
    missing = listed.select("owner_id", "where", "skill").distinct().join(met, ["owner_id", "where", "skill"], "left_anti")
    return _found(missing, "undeclared_skill", F.col("skill"))


def repaired(docs: Documents, bad: DataFrame) -> Documents:
    """The documents without what violates: bullets, entries with all under them, entries left without a bullet, skills, certificates, prose."""
    hit = bad.select("owner_id", "where").distinct()
    of_entries = bad.where(F.col("kind").isin(*REJECTED, "empty_entry")).select("owner_id", F.col("where").alias("under")).distinct()
    bullets = docs.bullets.join(hit, ["owner_id", "where"], "left_anti").join(of_entries, ["owner_id", "under"], "left_anti")
    entries = docs.entries.join(hit, ["owner_id", "where"], "left_anti").join(bullets.select("owner_id", F.col("under").alias("where")).distinct(), ["owner_id", "where"], "left_semi")
    dropped = bad.where("kind = 'undeclared_skill'").select("owner_id", "where", F.lower("subject").alias("low")).distinct()
    skills = docs.skills.withColumns({"where": F.concat(F.lit("skills["), F.col("category"), F.lit("]")), "low": F.lower("skill")}).join(dropped, ["owner_id", "where", "low"], "left_anti").drop("where", "low")
    lost = bad.where("kind = 'unknown_certification'").select("owner_id", F.col("subject").alias("_cited")).distinct()
    certificates = docs.certificates.join(lost, (docs.certificates["owner_id"] == lost["owner_id"]) & (_id("cited") == F.col("_cited")), "left_anti")
    prose = docs.prose.join(hit, ["owner_id", "where"], "left_anti")
    cites = docs.prose_cites.join(hit.where("where = 'summary'").select("owner_id").distinct(), "owner_id", "left_anti")
    return Documents(entries, bullets, skills, certificates, prose, cites)


class Repair(NamedTuple):
    """What the gate found, what stays, and what it finds in that."""

    violations: DataFrame
    kept: Documents
    remaining: DataFrame


def repair(docs: Documents, record: Record, said: Said, allowed: dict[str, tuple[str, ...]], entry_kinds: tuple[str, ...]) -> Repair:
    """The gate, the cut, and the gate again; violations and the parts that stay are written between."""
    said = said.grouped()
    bad = written(violations(docs, record, said, allowed, entry_kinds), "violations")
    kept = Documents(*[written(part, "kept") for part in repaired(docs, bad)])
    return Repair(bad, kept, violations(kept, record, said, allowed, entry_kinds))


def outcomes(owners: DataFrame, docs: Documents, done: Repair, least: int = 1) -> DataFrame:
    """Per owner: bullets, kept, entries_kept, dropped, summary (kinds with counts), remaining, usable.

    usable: nothing remains and at least least bullets stay (1 for a document with entries, 2 for a
    letter's paragraphs). owners: (owner_id); an owner without a document has zeros.
    """
    count = lambda df, name: df.groupBy("owner_id").agg(F.count(F.lit(1)).alias(name))
    out = owners.select("owner_id").distinct()
    for part, name in ((docs.bullets, "bullets"), (done.kept.bullets, "kept"), (done.kept.entries, "entries_kept"), (done.remaining, "remaining")):
        out = out.join(count(part, name), "owner_id", "left")
    kinds = ground.kind_counts(done.violations).select("owner_id", F.col("violations").alias("dropped"), "summary")
    out = out.join(kinds, "owner_id", "left").na.fill(0, ["bullets", "kept", "entries_kept", "remaining", "dropped"]).na.fill("", ["summary"])
    return out.withColumn("usable", (F.col("remaining") == 0) & (F.col("kept") >= least))


def letter_violations(letters: DataFrame, docs: Documents, record: Record, said: Said) -> DataFrame:
    """The gate for letters: paragraphs are bullets under no entry; a letter without any violates too. letters: (owner_id)."""
    bare = letters.select("owner_id").distinct().join(docs.bullets.select("owner_id"), "owner_id", "left_anti")
    return violations(docs, record, said, {}, ()).unionByName(_found(bare.withColumn("where", F.lit("letter")), "empty_letter"))


def repaired_letters(letters: DataFrame, docs: Documents, record: Record, said: Said) -> Repair:
    """Paragraphs that violate go; the rest goes through the letter gate again."""
    said = said.grouped()
    bad = written(letter_violations(letters, docs, record, said), "violations")
    kept = docs._replace(bullets=written(docs.bullets.join(bad.select("owner_id", "where").distinct(), ["owner_id", "where"], "left_anti"), "kept"))
    return Repair(bad, kept, letter_violations(letters, kept, record, said))
