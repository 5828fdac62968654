"""Text expressions that every comparison shares: normal form, words, sentences, figures."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import vocab

#: Typographic signs and what they count as.
_FROM, _TO = "\u2018\u2019\u201c\u201d\u2013\u2014\u2212\u00a0\u2022\u2023\u25aa\u00b7", "''\"\"---     "
_SPACE = r"[\x09-\x0D\x20]+"
FIGURE = r"(?<![A-Za-z0-9.])\$?(\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize(c: Column | str) -> Column:
    """Signs unified, white space collapsed, case folded. Null counts as empty."""
    plain = F.translate(F.coalesce(_col(c), F.lit("")), _FROM, _TO)
    return F.replace(F.lower(F.trim(F.regexp_replace(plain, _SPACE, " "))), F.lit("ß"), F.lit("ss"))


def compose(df: DataFrame, column: str) -> DataFrame:
    """NFKC and full case folding, where texts are not plain: the one step without a built-in function."""
    import unicodedata

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.schema.get_field_index(column)
            new = [None if t is None else t if t.isascii() else unicodedata.normalize("NFKC", t) for t in b.column(k).to_pylist()]
            yield b.set_column(k, column, pa.array(new, pa.string()))

    return df.mapInArrow(run, df.schema)


def squash(c: Column | str) -> Column:
    return F.regexp_replace(normalize(c), "[^a-z0-9]+", "")


def _matches(c: Column | str, pattern: str, signs: str = "") -> Column:
    """All matches in the normal form, of a pattern that holds no white space: so of white space nothing is
    collapsed, and of the signs only those given, that count as ' or -, are replaced."""
    plain = F.lower(F.coalesce(_col(c), F.lit("")))
    for sign in signs:
        plain = F.replace(plain, F.lit(sign), F.lit(_TO[_FROM.index(sign)]))
    return F.regexp_extract_all(F.replace(plain, F.lit("ß"), F.lit("ss")), F.lit(pattern), F.lit(0))


def words(c: Column | str) -> Column:
    return _matches(c, r"[a-z][a-z'\-]*", "\u2018\u2019\u2013\u2014\u2212")


def runs(c: Column | str) -> Column:
    """Runs of ASCII letters and digits of the normal form: what terms are bounded by."""
    return _matches(c, "[a-z0-9]+")


def is_content(word: Column) -> Column:
    return (F.length(word) > 2) & ~word.isin(vocab.STOPWORDS)


def content_words(c: Column | str) -> Column:
    return F.filter(F.array_distinct(words(c)), is_content)


def sentences(c: Column | str) -> Column:
    parts = F.split(F.coalesce(_col(c), F.lit("")), r"(?<=[.!?])[\x09-\x0D\x20]+|\n+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def figures(c: Column | str) -> Column:
    """Standalone quantities without thousands separators; digits glued to letters are names."""
    return F.transform(F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(FIGURE), F.lit(1)), lambda x: F.replace(x, F.lit(",")))


def slug(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(normalize(c), "[^a-z0-9]+", "-"), F.lit("-"))


def truncate(c: Column | str, limit: int) -> Column:
    """Cut to limit characters, at a space if one lies in the last two fifths; a cut ends in an ellipsis."""
    text = F.trim(F.coalesce(_col(c), F.lit("")))
    cut = F.rtrim(F.substring(text, 1, limit - 1))
    last = F.length(cut) - F.locate(" ", F.reverse(cut))  # place of the last space, from 0
    at_space = F.when((F.locate(" ", cut) > 0) & (last > limit * 0.6), F.substr(cut, F.lit(1), last)).otherwise(cut)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(at_space, "[ ,;:-]+$", ""), F.lit("…")))


def plural_forms(c: Column) -> Column:
    """The term's singular and plural spellings, as pairs of (spelling, rule); not the term itself."""
    n = F.length(c)
    pair = lambda cond, s, rule: F.when(cond, F.struct(s.alias("spelling"), F.lit(rule).alias("rule")))
    made = F.array(
        pair(F.endswith(c, F.lit("ies")) & (n > 4), F.concat(F.substr(c, F.lit(1), n - 3), F.lit("y")), "ies"),
        pair(c.rlike("(ses|xes|zes|ches|shes)$"), F.substr(c, F.lit(1), n - 2), "drop_es"),
        pair(F.endswith(c, F.lit("s")) & (n > 2), F.substr(c, F.lit(1), n - 1), "drop_s"),
        pair(F.lit(True), F.concat(c, F.lit("s")), "add_s"),
        pair(c.rlike("(s|x|z|ch|sh)$"), F.concat(c, F.lit("es")), "add_es"),
    )
    return F.when((n >= 2) & c.rlike("[a-z0-9]$"), F.filter(made, lambda x: x.isNotNull())).otherwise(F.expr("cast(array() as array<struct<spelling:string,rule:string>>)"))
