"""Postings: sections, header fields, candidate terms, and enrichment by model-extracted fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.sets import merge_terms

#: What marks bullets, headings, levels, roles, and terms that nobody can claim.
BULLET = r"^\s*([-•‣▪·◦*+]|\d+[.)])\s+"
REQUIREMENT = r"(?i)requirement|qualification|what you'?ll need|what we'?re looking for|who you are|about you|you have|must have|basic|minimum|preferred|nice to have|bonus|skills"
RESPONSIBILITY = r"(?i)responsibilit|what you'?ll do|the role|day to day|day-to-day|you will|impact"
LEVELS = {
    "intern": r"\bintern(ship)?\b|\bco-?op\b",
    "entry": r"\bentry[- ]level\b|\bnew grad(uate)?\b|\bjunior\b|\bassociate\b|\bI\b(?!\w)",
    "mid": r"\bmid[- ]level\b|\bintermediate\b|\bII\b",
    "senior": r"\bsenior\b|\bsr\.?\b|\bIII\b",
    "staff": r"\bstaff\b|\bprincipal\b|\bdistinguished\b|\barchitect\b",
    "lead": r"\blead\b|\bmanager\b|\bhead of\b|\bdirector\b",
}
ROLE = r"(?i)engineer|developer|scientist|analyst|manager|designer|researcher|architect|administrator|consultant|specialist|intern|technician|programmer"
ABOUT = r"(?m)^\s*[Aa]bout\s+(?!(?i:the|us|our|this|you|me|role|team|job|position)\b)([A-Z][\w.&' -]{1,40})\s*$"
AT = r"\bat\s+([A-Z][\w.&']*(?:\s+[A-Z][\w.&']*){0,2})\b"
NO_TRAIT = (
    r"(?i)\b(intern|internship|entry[ -]?level|new ?grad|graduate ?scheme|apprentice(ship)?|junior|senior|staff|principal|lead|"
    r"full[ -]?time|part[ -]?time|contract|temporary|permanent|freelance|hybrid|remote|on[ -]?site|in[ -]?office|onsite|relocation|visa|sponsorship|"
    r"salary|compensation|equity|benefits|bonus|stipend|paid|unpaid|perks?|401k|mentorship|mentoring|cohort|programme?|opportunity|culture|mission|"
    r"headquarters|office|team of|we offer|you will receive|competitive)\b"
)
NO_SEARCH_TERM = (
    r"(?i)\b(ability|abilities|willingness|eagerness|desire|passion(ate)?|enthusias\w*|motivat\w*|attitude|mindset|responsiveness|adaptab\w*|self[ -]starter|team ?player|"
    r"attention to|understanding of|knowledge of|familiarity with|exposure to|experience|background|proficien\w*|comfortable|willing|eager|"
    r"strong|excellent|solid|proven|demonstrated|working knowledge|communication skills|interpersonal|soft skills)\b"
)
YEARS = r"(?i)(\d+)\+?\s*(?:-\s*\d+\s*)?years?"
HEAD_LINES, HEAD_CHARS = 12, 600


def lines(postings: DataFrame, posting: str = "posting_id", raw: str = "raw") -> DataFrame:
    """(posting, pos, line): trimmed lines that are not blank."""
    each = postings.select(posting, F.posexplode(F.split(F.coalesce(F.col(raw), F.lit("")), r"\r\n|\r|\n")).alias("pos", "line"))
    return each.withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", "")).where("line <> ''")


def sections(postings: DataFrame, posting: str = "posting_id", raw: str = "raw") -> DataFrame:
    """(posting, seq, bucket, text): bullets, filed by the last heading that names a bucket.

    Bullets before any such heading are requirements; a heading of both kinds is one of
    responsibilities.
    """
    short = ~F.col("line").rlike(BULLET) & (F.length("line") < 80)
    bucket = F.when(short & F.col("line").rlike(RESPONSIBILITY), "responsibility").when(short & F.col("line").rlike(REQUIREMENT), "requirement")
    w = Window.partitionBy(posting).orderBy("pos")
    filed = lines(postings, posting, raw).withColumn("bucket", F.coalesce(F.last(bucket, True).over(w), F.lit("requirement")))
    item = F.trim(F.regexp_replace("line", BULLET, ""), F.lit(" .;"))
    return filed.where(F.col("line").rlike(BULLET)).select(posting, F.col("pos").alias("seq"), "bucket", item.alias("text")).where(F.length("text") > 3)


def _first(*choices: Column) -> Column:
    return F.coalesce(*[F.when(c != "", c) for c in choices], F.lit(""))


def _level(c: Column, flags: str = "") -> Column:
    out = None
    for level, pattern in LEVELS.items():
        hit = c.rlike(flags + pattern)
        out = F.when(hit, level) if out is None else out.when(hit, level)
    return out


def headers(postings: DataFrame, posting: str = "posting_id", raw: str = "raw") -> DataFrame:
    """(posting, title, company, seniority, min_years) by rules in order of trust."""
    text = F.coalesce(F.col(raw), F.lit(""))
    head = lines(postings, posting, raw).withColumn("n", F.row_number().over(Window.partitionBy(posting).orderBy("pos"))).where(F.col("n") <= HEAD_LINES)
    role = (F.length("line") <= 70) & F.col("line").rlike(ROLE) & ~F.col("line").rlike(BULLET)
    top = head.groupBy(posting).agg(
        F.min_by(F.when(role, F.col("line")), F.when(role, F.col("n"))).alias("role_line"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("head"),
    )
    years = sections(postings, posting, raw).where("bucket = 'requirement'").select(posting, F.explode(F.regexp_extract_all("text", F.lit(YEARS), F.lit(1))).alias("y"))
    least = years.groupBy(posting).agg(F.min(F.col("y").cast("int")).alias("min_years"))
    title = _first(F.trim(F.regexp_extract(text, r"(?im)^\s*(?:job\s+)?title\s*:\s*(.+)$", 1)), F.trim(F.regexp_replace(F.coalesce("role_line", F.lit("")), r"\s*[-–—|@]\s*.*$", "")))
    company = _first(F.trim(F.regexp_extract(text, r"(?im)^\s*company\s*:\s*(.+)$", 1)), F.trim(F.regexp_extract(text, ABOUT, 1)), F.trim(F.regexp_extract(F.coalesce("head", F.lit("")), AT, 1)))
    both = postings.join(top, posting, "left").join(least, posting, "left").select(posting, F.col(raw), title.alias("title"), company.alias("company"), "min_years")
    level = F.coalesce(_level(F.col("title")), _level(F.substring(text, 1, HEAD_CHARS), "(?i)"), F.lit(""))
    return both.select(posting, "title", "company", level.alias("seniority"), "min_years")


def candidate_terms(terms: DataFrame, heads: DataFrame, posting: str = "posting_id") -> DataFrame:
    """Terms that a person could claim: short, no trait of the job, not the company, not the title."""
    low = F.lower(F.trim("term"))
    company, title = F.lower(F.trim(F.coalesce("company", F.lit("")))), F.lower(F.trim(F.coalesce("title", F.lit(""))))
    joined = terms.join(heads.select(posting, "company", "title"), posting, "left")
    fine = (low != "") & ~F.col("term").rlike(NO_TRAIT) & ~F.col("term").rlike(NO_SEARCH_TERM) & (F.size(F.split(low, r"\s+")) <= 3)
    own = (company != "") & (F.contains(company, low) | F.contains(low, company)) | (title != "") & (low == title)
    return joined.where(fine & ~own).select(*terms.columns)


def merge_phrases(first: DataFrame, extra: DataFrame, posting: str = "posting_id", most: int = 40, longest: int = 300) -> DataFrame:
    """As merge_terms, for phrases: trimmed marks, and only the first `most` of each posting."""
    tidy = extra.withColumn("term", F.trim("term", F.lit(" .;")))
    return merge_terms(first, tidy, posting, longest).where(F.col("place") <= most)


def enrich(heads: DataFrame, fields: DataFrame, posting: str = "posting_id") -> DataFrame:
    """Header fields that are blank take the model's; a field of the wrong type is no field."""
    text = lambda c: F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "", F.trim(F.col(c).cast("string")))
    given = fields.select(posting, *[text(c).alias(f"_{c}") for c in ("title", "company", "seniority")])
    joined = heads.join(given, posting, "left")
    return joined.select(posting, *[_first(F.col(c), F.coalesce(f"_{c}", F.lit(""))).alias(c) for c in ("title", "company", "seniority")], "min_years")


def enrich_lists(lists: DataFrame, outputs: DataFrame, heads: DataFrame, posting: str = "posting_id") -> DataFrame:
    """(posting, kind, place, term): the rules' lists, each followed by what the model adds to it.

    lists: (posting, kind, seq, term) of the kinds hard_skills, keywords, qualifications and
    responsibilities; outputs: (posting, output), JSON with lists by these names; heads: enrich()'s.
    Skills join the keywords, and of both only what a person could claim stays. A field that is no
    list, or an output that is no JSON, adds nothing; blank and null entries neither.
    """
    texts = lambda kind: F.from_json(F.get_json_object("output", f"$.{kind}"), "array<string>")
    said = lambda kind: outputs.select(posting, F.posexplode(texts(kind)).alias("seq", "term")).where(F.trim("term") != "")
    had = lambda kind: lists.where(F.col("kind") == kind).select(posting, "seq", "term")
    again = lambda merged: merged.withColumnRenamed("place", "seq")
    skills = merge_terms(had("hard_skills"), said("hard_skills"), posting)
    words = merge_terms(again(merge_terms(had("keywords"), again(skills), posting)), said("keywords"), posting)
    made = {"hard_skills": candidate_terms(skills, heads, posting), "keywords": candidate_terms(words, heads, posting)}
    made |= {kind: merge_phrases(had(kind), said(kind), posting) for kind in ("qualifications", "responsibilities")}
    out = None
    for kind, rows in made.items():
        rows = rows.select(posting, F.lit(kind).alias("kind"), "place", "term")
        out = rows if out is None else out.unionByName(rows)
    return out


def fewest_years(heads: DataFrame, merged: DataFrame, posting: str = "posting_id") -> DataFrame:
    """heads whose min_years, where unknown, is the least number of years that a merged qualification states."""
    years = merged.where("kind = 'qualifications'").select(posting, F.explode(F.regexp_extract_all("term", F.lit(YEARS), F.lit(1))).alias("y"))
    least = years.groupBy(posting).agg(F.min(F.expr("try_cast(y as int)")).alias("_least"))
    return heads.join(least, posting, "left").withColumn("min_years", F.coalesce("min_years", "_least")).drop("_least")


def parse_postings(postings: DataFrame, mentions: DataFrame, posting: str = "posting_id", raw: str = "raw") -> DataFrame:
    """One row for each posting: header, terms, requirements and responsibilities in order."""
    parts = sections(postings, posting, raw)
    ordered = lambda bucket: F.transform(F.array_sort(F.collect_list(F.when(F.col("bucket") == bucket, F.struct("seq", "text")))), lambda x: x["text"])
    lists = parts.groupBy(posting).agg(ordered("requirement").alias("qualifications"), ordered("responsibility").alias("responsibilities"))
    # longest terms first, then by name: a fixed order
    terms = mentions.groupBy(posting).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.length("term")).alias("n"), "term"))), lambda x: x["term"]).alias("keywords"))
    empty = F.expr("cast(array() as array<string>)")
    return headers(postings, posting, raw).join(lists, posting, "left").join(terms, posting, "left").withColumns({c: F.coalesce(c, empty) for c in ("qualifications", "responsibilities", "keywords")})


