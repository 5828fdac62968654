"""Dates as people and feeds write them: each source has a family of forms, tried in order; what fits none stays as it is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The months' first three letters, in order.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: What stands for an end that has not come.
CURRENT = r"(?i)^(present|current|now)"


def _parts(text: Column, pattern: str, n: int) -> list[Column]:
    return [F.regexp_extract(text, pattern, k + 1) for k in range(n)]


def _month(word: Column) -> Column:
    """Two digits of a month's name, or null."""
    at = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.left(word, F.lit(3))))
    return F.when(at > 0, F.lpad(at.cast("string"), 2, "0"))


def _first(*forms: tuple[str, Column, Column]) -> Column:
    """struct(value, family) of the first form whose condition holds."""
    out = None
    for family, fits, value in forms:
        made = F.struct(value.alias("value"), F.lit(family).alias("family"))
        out = F.when(fits, made) if out is None else out.when(fits, made)
    return out


def record_date(c: Column | str) -> Column:
    """struct(value, family) of a record's date: 'YYYY-MM', or 'YYYY' where no month is told.

    Families: month_name ('Jun 2024'; of an unknown month the year stays), month_number ('6/2024', '06-2024'),
    iso ('2024-6', '2024-06-01'), year; else as_written, blanks trimmed; null and blank texts are empty.
    """
    text = F.regexp_replace(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), r"^[\s ]+|[\s ]+$", "")
    named, numbered, iso = r"^([A-Za-z]{3,9})\s+(\d{4})$", r"^(\d{1,2})[/-](\d{4})$", r"^(\d{4})-(\d{1,2})(?:-\d{1,2})?$"
    word, year = _parts(text, named, 2)
    month, of = _parts(text, numbered, 2)
    iso_year, iso_month = _parts(text, iso, 2)
    return _first(
        ("empty", text == "", F.lit("")),
        ("month_name", text.rlike(named), F.when(_month(word).isNull(), year).otherwise(F.concat_ws("-", year, _month(word)))),
        ("month_number", text.rlike(numbered), F.concat_ws("-", of, F.lpad(month, 2, "0"))),
        ("iso", text.rlike(iso), F.concat_ws("-", iso_year, F.lpad(iso_month, 2, "0"))),
        ("year", text.rlike(r"^\d{4}$"), text),
        ("as_written", F.lit(True), text),
    )


def post_date(c: Column | str) -> Column:
    """struct(value, family) of a post's date: 'YYYY-MM-DD'.

    Families: iso (such a date anywhere in the text), mail ('Tue, 3 Jun 2024 10:00', the day first; an unknown
    month is as_written), else as_written, its first ten characters; null and blank texts are empty.
    """
    text = F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    mail = r"(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4})"
    day, word, year = _parts(text, mail, 3)
    iso = F.regexp_extract(text, r"\d{4}-\d{2}-\d{2}", 0)
    return _first(
        ("empty", text == "", F.lit("")),
        ("iso", iso != "", iso),
        ("mail", (day != "") & _month(word).isNotNull(), F.concat_ws("-", year, _month(word), F.lpad(day, 2, "0"))),
        ("as_written", F.lit(True), F.left(text, F.lit(10))),
    )


def end_date(c: Column | str) -> Column:
    """record_date for an end: family current, with an empty value, for Present, Current and Now."""
    text = F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    return F.when(text.rlike(CURRENT), F.struct(F.lit("").alias("value"), F.lit("current").alias("family"))).otherwise(record_date(text))
