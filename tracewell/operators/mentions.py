"""Term mentions: every dictionary term in every text, by one tokenisation and one hash join.

A text's runs of letters and digits are joined to n-grams without separators; a dictionary
spelling without separators is looked up among them; and a candidate is confirmed by the exact
rule. Cost follows the tokens, not tokens times dictionary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.functions import vocab

#: Spellings up to which the dictionary is broadcast; a larger one is joined by shuffle.
BROADCAST_SPELLINGS = 500_000


def spellings(lexicon: DataFrame) -> DataFrame:
    """(term, spelling, rule): the normal form of each term and its plural and singular forms."""
    base = lexicon.select(T.normalize("term").alias("term")).where("term <> ''").distinct()
    own = base.select("term", F.col("term").alias("spelling"), F.lit("own").alias("rule"))
    return own.unionByName(base.select("term", F.inline(T.plural_forms(F.col("term"))))).dropDuplicates(["term", "spelling"])


def derived_spellings(lexicon: DataFrame) -> DataFrame:
    """(term, spelling, rule) for the verbs that a one-word name grows into."""
    base = lexicon.select(T.normalize("term").alias("term")).where("term <> '' and length(term) >= 3 and not contains(term, ' ')").distinct()
    stem = F.when(F.endswith("term", F.lit("e")), F.expr("substr(term, 1, length(term) - 1)")).otherwise(F.col("term"))
    return base.select("term", F.explode(F.array_distinct(F.array(*[F.concat(stem, F.lit(x)) for x in vocab.TOOL_VERBS]))).alias("spelling"), F.lit("derived").alias("rule"))


def _bounded(core: Column, left: Column, right: Column) -> Column:
    edge = lambda c, pattern: F.when(c.rlike("[a-z0-9]"), F.lit(pattern)).otherwise(F.lit(""))
    return F.concat(edge(left, "(?<![a-z0-9])"), core, edge(right, "(?![a-z0-9])"))


def _patterns(df: DataFrame) -> DataFrame:
    """(term, key, n, pattern): what to look up, of how many runs, and the rule that confirms it.

    A spelling that is one run needs no confirming, since runs are bounded: its pattern is null.
    """
    quoted = F.regexp_replace("spelling", r"([^a-z0-9 ])", r"\\$1")
    own = df.select("term", "spelling", T.runs("spelling").alias("parts"), _bounded(quoted, F.substring("spelling", 1, 1), F.substring("spelling", -1, 1)).alias("pattern"))
    loose = (
        df.where("rule = 'own'")
        .select("term", "spelling", T.runs("spelling").alias("parts"))
        .where("size(parts) >= 2")
        .withColumn("pattern", F.concat(F.lit("(?<![a-z0-9])"), F.array_join("parts", "[^a-z0-9]{0,2}"), F.lit("(?![a-z0-9])")))
    )
    both = own.withColumn("pattern", F.when(~F.col("spelling").rlike("^[a-z0-9]+$"), F.col("pattern"))).drop("spelling").unionByName(loose.drop("spelling"))
    return both.where("size(parts) > 0").select("term", F.array_join("parts", "").alias("key"), F.size("parts").alias("n"), "pattern")


def mentions(texts: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term): the distinct dictionary terms (column term of lexicon) that each text contains.

    A term counts if its normal form or a plural form occurs bounded on its alphanumeric edges, or
    if its runs occur with up to two other characters between. Terms without a letter or digit
    never match; null texts contain nothing. Only ids and keys are joined to the dictionary; a text
    meets its candidate patterns once, if it has any that need confirming.
    """
    rules = _patterns(spellings(lexicon))
    size = rules.agg(F.count(F.lit(1)).alias("n"), F.max("n").alias("most"), F.count("pattern").alias("doubtful")).first()
    if size.n <= BROADCAST_SPELLINGS:
        rules = F.broadcast(rules)
    most = max(1, size.most or 1)
    norm = texts.select(F.col(id_col), T.normalize(text_col).alias("norm"))
    tokens = norm.select(id_col, F.regexp_extract_all("norm", F.lit("[a-z0-9]+"), F.lit(0)).alias("runs"))
    grams = F.flatten(F.transform("runs", lambda _, i: F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.when(i + n <= F.size("runs"), F.array_join(F.slice("runs", i + 1, n), "")))))
    keyed = tokens.select(id_col, F.explode(F.array_distinct(grams if most > 1 else F.col("runs"))).alias("key")).where("key is not null")
    found = keyed.join(rules, "key").select(id_col, "term", "pattern")
    sure = found.where("pattern is null").select(id_col, "term")
    if not size.doubtful:
        return sure.distinct()
    # at most one candidate for each token and rule of a text, so the list is bounded by the text
    doubts = found.where("pattern is not null").groupBy(F.col(id_col).alias("_of")).agg(F.collect_set(F.struct("term", "pattern")).alias("rules"))
    judged = norm.join(doubts, F.col(id_col).eqNullSafe(F.col("_of"))).select(id_col, "norm", F.inline("rules"))
    return sure.unionByName(judged.where(F.expr("norm rlike pattern")).select(id_col, "term")).distinct()


def single_word_mentions(texts: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As mentions, for a dictionary of plain one-run terms: a run is a spelling, nothing to confirm."""
    rules = spellings(lexicon).select("term", F.col("spelling").alias("key"))
    keyed = texts.select(id_col, F.explode(F.array_distinct(T.runs(text_col))).alias("key"))
    return keyed.join(rules, "key").select(id_col, "term").distinct()


def technical_tokens(texts: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token, squashed): names that assert a technology by their shape, or that known lists.

    known: (id, term) from mentions. Possessives and trailing marks are stripped; of spellings that
    are equal without separators the first stays, known terms before shapes.
    """
    raw = texts.select(id_col, F.posexplode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(vocab.TOKEN), F.lit(0))).alias("pos", "raw"))
    token = F.regexp_replace(F.trim(F.col("raw"), F.lit(".,;:")), r"'s$", "")
    shaped = raw.select(id_col, (F.col("pos") + 1).alias("pos"), token.alias("token")).where((F.col("token") != "") & ~F.col("token").isin(vocab.NOT_A_TOOL) & F.col("token").rlike(vocab.TECHNICAL))
    if known is not None:
        shaped = known.select(id_col, F.lit(0).alias("pos"), F.col("term").alias("token")).unionByName(shaped)
    keyed = shaped.withColumn("squashed", T.squash("token"))
    return keyed.groupBy(id_col, "squashed").agg(F.min_by("token", F.struct("pos", "token")).alias("token"))
