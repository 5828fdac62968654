"""Whole rubrics of drafts and letters: every check with its kind, and the verdict.

A check is a row (ids, name, kind, ok). Failures of kind 'parsing' or 'blocking' fail the document,
those of kind 'reading' or 'advisory' do not. Checks whose input is absent are not run: they have
no row, so they never count as passed. Everything about a document is in its row; only terms are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.functions import vocab
from tracewell.operators import mentions as M

SEVERE = ("parsing", "blocking")


def _list(name: str) -> Column:
    """A list's elements that are not null; a null list is empty."""
    return F.filter(F.coalesce(F.col(name), F.expr("cast(array() as array<string>)")), lambda x: x.isNotNull())


def _rows(df: DataFrame, ids: list[str], checks: dict[str, tuple[str, Column]]) -> DataFrame:
    cases = [F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), ok.alias("ok")) for name, (kind, ok) in checks.items()]
    return df.select(*ids, F.inline(F.array(*cases))).where("ok is not null")


def _given(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def draft_review(drafts: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, name, kind, ok): whether machines can read a draft, and people like to.

    drafts: ids, history (entries of work or projects), headings, dates (printed, of entries) and
    bullets as arrays, email, phone, location, html and pages. The layout is checked where there is
    html and the page budget where pages are known. Entries without a date, and drafts without
    bullets, pass.
    """
    rows = drafts.select(*ids, "history", "html", "pages", *[_given(F.col(c)).alias(c) for c in ("email", "phone", "location")], _list("headings").alias("headings"), _list("dates").alias("dates"), _list("bullets").alias("bullets"))
    n = F.size("bullets")
    faults = F.lower("html").rlike("|".join(f"({p})" for p in vocab.LAYOUT.values()))
    return _rows(rows, ids, {
        "history": ("parsing", F.coalesce(F.col("history") > 0, F.lit(False))),
        "headings": ("parsing", F.forall("headings", lambda h: T.normalize(h).isin(list(vocab.STANDARD_HEADINGS)))),
        "dates": ("parsing", F.forall("dates", lambda d: (d == "") | d.rlike(vocab.DATE_RANGE))),
        "email": ("parsing", F.col("email")),
        "reachable": ("reading", F.col("phone") & F.col("location")),
        "short": ("reading", F.forall("bullets", lambda b: F.length(b) <= vocab.MAX_BULLET_CHARS)),
        "quantified": ("reading", F.size(F.filter("bullets", lambda b: F.size(T.figures(b)) > 0)) >= n * vocab.MIN_QUANTIFIED),
        "openers": ("reading", ~F.exists("bullets", lambda b: F.lower(b).rlike(vocab.WEAK_OPENERS))),
        "impersonal": ("reading", ~F.exists("bullets", lambda b: F.lower(b).rlike(vocab.FIRST_PERSON))),
        "single_column": ("parsing", F.when(F.col("html") != "", ~faults)),
        "page_budget": ("parsing", F.col("pages") <= vocab.MAX_PAGES),
    })


def first_terms(terms: DataFrame, most: int = vocab.POSTING_TERMS) -> DataFrame:
    """(item_id, term): a posting's first terms by place (item_id, place, term), each once."""
    once = terms.where("term <> ''").groupBy("item_id", T.normalize("term").alias("term")).agg(F.min("place").alias("place"))
    return once.withColumn("n", F.row_number().over(Window.partitionBy("item_id").orderBy("place", "term"))).where(F.col("n") <= most).select("item_id", "term")


def letter_review(letters: DataFrame, ids: list[str], postings: DataFrame, terms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(ids, name, kind, ok): whether a letter says something, to whom, and in answer to what.

    letters: ids (not null, unique), item_id, addressee, paragraphs; postings: (item_id, company,
    qualifications), one row an item; terms: (item_id, place, term), of which the first vocab.POSTING_TERMS count;
    lexicon: (term). What a posting does not state cannot be missed: no company, terms or
    requirements, or no such posting, pass.
    """
    rows = letters.join(postings.select("item_id", "company", "qualifications"), "item_id", "left")
    paragraphs = _list("paragraphs")
    rows = rows.select(F.struct(*ids).alias("letter"), "item_id", "company", _list("qualifications").alias("quals"), F.coalesce("addressee", F.lit("")).alias("addressee"), paragraphs.alias("paragraphs"), F.array_join(paragraphs, "\n\n").alias("body"))
    bodies, asked = rows.select("letter", "body"), first_terms(terms)
    firms = rows.where(_given(F.col("company"))).select("letter", T.normalize("company").alias("term"))
    every = lexicon.select(T.normalize("term").alias("term")).unionByName(asked.select("term")).unionByName(firms.select("term")).distinct()
    said = M.mentions(bodies, every, "letter", "body")
    known = said.join(lexicon.select(T.normalize("term").alias("term")).distinct(), "term", "left_semi")
    tools = M.technical_tokens(bodies, known, "letter", "body").groupBy("letter").agg(F.count(F.lit(1)).alias("tools"))
    wanted = rows.select("letter", "item_id").join(asked, "item_id")
    answers = wanted.join(said, ["letter", "term"]).select("letter", F.lit(True).alias("answers")).distinct()
    named = firms.join(said, ["letter", "term"]).select("letter", F.lit(True).alias("named")).distinct()
    asks = asked.groupBy("item_id").agg(F.count(F.lit(1)).alias("asks"))
    facts = rows.select("letter", "item_id").join(asks, "item_id", "left").drop("item_id")
    for more in (tools, answers, named):
        facts = facts.join(more, "letter", "left")
    rows = rows.join(facts, "letter").withColumn("norm", T.normalize("body"))
    first, n = F.lower(F.trim(F.coalesce(F.get("paragraphs", F.lit(0)), F.lit("")))), F.size("paragraphs")
    n_words = F.size(F.regexp_extract_all("body", F.lit(r"\S+"), F.lit(0)))
    opens_i = F.size(F.filter("paragraphs", lambda p: p.rlike(r"^\s*I\b")))
    free_of = lambda phrases: ~_any_of(F.col("norm"), phrases)
    checks = _rows(rows, ["letter"], {
        "opening": ("blocking", first.rlike(r"\S") & ~first.rlike(vocab.DEAD_OPENINGS)),
        "addressee": ("blocking", ~F.lower("addressee").rlike(vocab.DEAD_ADDRESSEES)),
        "length": ("blocking", n_words.between(*vocab.LETTER_WORDS)),
        "paragraphs": ("blocking", n.between(*vocab.LETTER_PARAGRAPHS)),
        "specifics": ("blocking", (F.size(T.figures("body")) > 0) | (F.coalesce("tools", F.lit(0)) >= 2)),
        "answers_posting": ("blocking", F.col("asks").isNull() | F.coalesce("answers", F.lit(False))),
        "names_company": ("advisory", ~_given(F.col("company")) | F.coalesce("named", F.lit(False))),
        "plain_words": ("advisory", free_of(vocab.EXCESS_WORDS)),
        "no_cliche": ("advisory", free_of(vocab.CLICHES)),
        "no_flattery": ("advisory", free_of(vocab.FLATTERY)),
        "varied_openings": ("advisory", (n < 3) | (opens_i < n * vocab.MAX_I_SHARE)),
        "own_words": ("advisory", ~F.exists("quals", lambda q: (F.length(q) > vocab.ECHO_CHARS) & F.contains("norm", T.normalize(q)))),
    })
    return checks.select(*[F.col("letter")[c].alias(c) for c in ids], "name", "kind", "ok")


def _any_of(c: Column, phrases: tuple[str, ...] | list[str]) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(c, p))


def verdicts(checks: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, passed, failed, severe, ok, failures): a document is well if nothing severe failed."""
    severe = ~F.col("ok") & F.col("kind").isin(*SEVERE)
    per = checks.groupBy(*ids).agg(
        F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(severe).alias("severe"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("name")))), ",").alias("failures"),
    )
    return per.withColumn("ok", F.col("severe") == 0)
