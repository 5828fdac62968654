"""Names that mean the same: classes over synonym pairs, one canonical name for each, and all ways to write a term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.functions import vocab
from tracewell.functions.shared import written
from tracewell.operators import mentions as M


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): for every node of the pairs, the smallest node that can be reached from it, itself included.

    Each round a node takes the least root of its neighbours and then that root's own root, so
    chains shorten by more than half in most rounds. Rounds are written, which cuts lineage. Pairs
    with a null are left out. No pairs, no rows.
    """
    both = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.explode(F.array(F.struct(F.col(a).alias("node"), F.col(b).alias("near")), F.struct(F.col(b).alias("node"), F.col(a).alias("near")))).alias("e"))
    edges = written(both.select("e.*").distinct(), "edges")
    roots = written(edges.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("root")), "roots")
    while True:
        of_near = edges.join(roots.select(F.col("node").alias("near"), F.col("root").alias("r")), "near").groupBy("node").agg(F.min("r").alias("r"))
        met = roots.join(of_near, "node").select("node", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        jumped = met.join(roots.select(F.col("node").alias("root"), F.col("root").alias("beyond")), "root").select("node", "old", F.least("root", "beyond").alias("root"))
        found = written(jumped, "roots")
        roots = found.select("node", "root")
        if not found.where("old <> root").take(1):
            return roots


def synonym_classes(synonyms: DataFrame) -> DataFrame:
    """(spelling, canonical): every spelling of the synonym pairs with the one name of its class.

    synonyms: (alias, name), each in any case. Pairs chain: what shares a class means the same. The
    canonical name is the smallest that is a name and no other name's alias, or where there is none
    the smallest member. Blank and null spellings are left out.
    """
    pairs = synonyms.select(T.normalize("alias").alias("alias"), T.normalize("name").alias("name")).where("alias <> '' and name <> ''").distinct()
    classes = components(pairs, "alias", "name")
    aliases = pairs.where("alias <> name").select(F.col("alias").alias("node"), F.lit(True).alias("aliased")).distinct()
    marked = classes.join(aliases, "node", "left")
    canonical = marked.groupBy("root").agg(F.coalesce(F.min(F.when(F.col("aliased").isNull(), F.col("node"))), F.min("node")).alias("canonical"))
    return classes.join(canonical, "root").select(F.col("node").alias("spelling"), "canonical")


def canonical_mentions(texts: DataFrame, lexicon: DataFrame, synonyms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term): mentions of the lexicon's terms and of all their synonyms, under canonical names.

    A spelling of a synonym class counts wherever any of its spellings does, also if only one of
    the class is in the lexicon.
    """
    terms = lexicon.select(T.normalize("term").alias("term")).where("term <> ''").distinct()
    classes = synonym_classes(synonyms)
    known = terms.join(classes, F.col("term") == F.col("spelling"), "left").select("term", F.coalesce("canonical", "term").alias("canonical"))
    wanted = classes.join(known.select("canonical").distinct(), "canonical", "left_semi")
    named = known.select(F.col("term").alias("spelling"), "canonical").unionByName(wanted.select("spelling", "canonical")).distinct()
    named = written(named, "names")
    found = M.mentions(texts, named.select(F.col("spelling").alias("term")), id_col, text_col)
    return found.join(named.withColumnRenamed("spelling", "term"), "term").select(id_col, F.col("canonical").alias("term")).distinct()


def stripped(term: Column) -> Column:
    """The name that a derived word was built from: its longest ending of vocab.DERIVATIONS goes if three letters stay; else null."""
    out = F.lit(None).cast("string")
    for ending in sorted(vocab.DERIVATIONS, key=len):
        fits = F.endswith(term, F.lit(ending)) & (F.length(term) > len(ending) + 2)
        out = F.when(fits, F.substr(term, F.lit(1), F.length(term) - len(ending))).otherwise(out)
    return out


def names_of(terms: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """(term, name, grown): every name under which a claim of the term may be backed.

    Its own spelling, its synonyms, and what it was derived from; and, marked as grown, the verbs
    that it grows into, which only a text can back. terms: (term); plural forms are left to the
    comparison. Blank and null terms have no names.
    """
    base = terms.select(T.normalize("term").alias("term")).where("term <> ''").distinct()
    own = base.select("term", F.col("term").alias("name"), F.lit(False).alias("grown"))
    out = own.unionByName(base.select("term", stripped(F.col("term")).alias("name"), F.lit(False).alias("grown")).where("name is not null"))
    if synonyms is not None:
        classes = written(synonym_classes(synonyms), "synonyms")
        mine = base.join(classes, F.col("term") == F.col("spelling")).select("term", "canonical")
        out = out.unionByName(mine.join(classes, "canonical").select("term", F.col("spelling").alias("name"), F.lit(False).alias("grown")))
    verbs = M.derived_spellings(terms).select("term", F.col("spelling").alias("name"), F.lit(True).alias("grown"))
    return out.unionByName(verbs).groupBy("term", "name").agg(F.min("grown").alias("grown"))


def with_plurals(names: DataFrame) -> DataFrame:
    """(term, spelling): names that a list can back, with their singular and plural spellings."""
    listed = names.where("not grown")
    more = listed.select("term", F.inline(T.plural_forms(F.col("name")))).select("term", "spelling")
    return listed.select("term", F.col("name").alias("spelling")).unionByName(more).distinct()


def grouped(names: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """((name, group), (group, term)) of distinct pairs (term, name): names that stand for the same terms are one group.

    A term has one group for all the names of its class, where names have a row for each; joining
    the two gives names again. name: the column of names; a group is called by the first of its own.
    """
    sets = names.groupBy(name).agg(F.array_sort(F.collect_set("term")).alias("terms"))
    groups = written(sets.groupBy("terms").agg(F.min(name).alias("group"), F.collect_set(name).alias("names")), "name-groups")
    return groups.select(F.explode("names").alias(name), "group"), groups.select("group", F.explode("terms").alias("term"))
