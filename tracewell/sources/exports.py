"""Export archives: CSV files as cells, and the profiles that their files tell together."""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.functions.dates import record_date
from tracewell.sources.imports import split_descriptions

#: For each kind of file its names, and for each field the columns that may hold it, the first that does counts. Letters only.
FILES = {
    "profile": ("profile",),
    "emails": ("emailaddresses", "emails"),
    "phones": ("phonenumbers",),
    "positions": ("positions",),
    "education": ("education",),
    "projects": ("projects",),
    "certifications": ("certifications",),
    "skills": ("skills",),
}
COLUMNS = {
    "profile": {"first": ("firstname",), "last": ("lastname",), "headline": ("headline",), "summary": ("summary",), "location": ("geolocation", "location"), "websites": ("websites",)},
    "emails": {"email": ("emailaddress", "email"), "primary": ("primary",)},
    "phones": {"phone": ("number", "phonenumber")},
    "positions": {"name": ("companyname", "company"), "title": ("title", "position"), "text": ("description",), "location": ("location",), "start": ("startedon", "startdate"), "end": ("finishedon", "enddate")},
    "education": {"name": ("schoolname", "school"), "title": ("degreename", "degree"), "text": ("notes", "activities"), "start": ("startdate", "startedon"), "end": ("enddate", "finishedon")},
    "projects": {"name": ("title", "name"), "text": ("description",), "url": ("url",), "start": ("startedon", "startdate"), "end": ("finishedon", "enddate")},
    "certifications": {"name": ("name", "title"), "title": ("authority", "issuer"), "url": ("url",), "start": ("startedon", "issuedon", "startdate")},
    "skills": {"skill": ("name", "skill")},
}
#: The sections of a record by the files they come from, and what their ids begin with.
SECTIONS = {"positions": ("experience", "exp"), "education": ("education", "edu"), "projects": ("projects", "proj"), "certifications": ("certifications", "cert")}
PLACEHOLDERS = {"name": "TODO your name", "company": "TODO company", "title": "TODO title"}
ID_PART = 22


def _letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z]", "")


def _records(content: bytes) -> Iterator[list[str]]:
    """A CSV file's records, one after the other; quoted cells may hold line ends. Bad bytes become U+FFFD."""
    csv.field_size_limit(sys.maxsize)
    return csv.reader(io.TextIOWrapper(io.BytesIO(content), "utf-8-sig", errors="replace", newline=""))


def export_cells(spark: SparkSession, path: str) -> DataFrame:
    """(archive, file, row, pos, col, value): every cell of every CSV file under path.

    A file's header is its widest record, the earliest of equals; what stands before it is preamble,
    and records without a value are left out. Columns are named by the header's letters alone, so that they
    match loosely; there may be any number of them. Short records are padded, cells past the header
    dropped; cells are trimmed. row counts the file's records. archive is the folder, file the path.
    A file is read by one task, record by record; empty files have no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cells() -> Iterator[tuple[str, int, int, str, str]]:
            for batch in batches:
                for uri, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    best, width = -1, 0
                    for k, record in enumerate(_records(content)):
                        if len(record) > width:
                            best, width = k, len(record)
                    header: list[str] = []
                    for k, record in enumerate(_records(content)):
                        if k == best:
                            header = ["".join(c for c in h.lower() if "a" <= c <= "z") for h in record]
                        elif k > best and any(c.strip() for c in record):
                            for pos, name in enumerate(header):
                                yield uri, k, pos, name, record[pos].strip() if pos < len(record) else ""

        found = cells()
        while some := list(islice(found, 20_000)):
            columns = [pa.array(c, t) for c, t in zip(zip(*some, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "row", "pos", "col", "value"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[cC][sS][vV]").load(path).select("path", "content")
    cells = files.mapInArrow(run, "file string, row long, pos int, col string, value string")
    return cells.select(F.regexp_extract("file", r"^(.*)/[^/]*$", 1).alias("archive"), "file", "row", "pos", "col", "value")


class Profiles(NamedTuple):
    """What archives tell: basics, a row for each; entries, highlights and skills, a row for each of them."""

    basics: DataFrame
    entries: DataFrame
    highlights: DataFrame
    skills: DataFrame


def _fields(cells: DataFrame) -> DataFrame:
    """(archive, kind, row, field, value): cells under the names of fields, of the first column that has a value.

    Of several files of a kind in an archive the first by path counts, of equal columns the last.
    """
    spark = cells.sparkSession
    kinds = spark.createDataFrame([(name, kind) for kind, names in FILES.items() for name in names], "stem string, kind string")
    wanted = spark.createDataFrame([(kind, col, field, k) for kind, fields in COLUMNS.items() for field, cols in fields.items() for k, col in enumerate(cols)], "kind string, col string, field string, choice int")
    stem = _letters(F.regexp_extract(F.col("file"), r"([^/]*)\.[^./]*$", 1))
    named = cells.withColumn("stem", stem).join(F.broadcast(kinds), "stem")
    first = named.groupBy("archive", "kind").agg(F.min("file").alias("file"))
    of_kind = named.join(first, ["archive", "kind", "file"]).join(F.broadcast(wanted), ["kind", "col"])
    told = of_kind.groupBy("archive", "kind", "row", "field", "choice").agg(F.max_by("value", "pos").alias("value")).where("value <> ''")
    return told.groupBy("archive", "kind", "row", "field").agg(F.min_by("value", "choice").alias("value"))


def _wide(fields: DataFrame, kind: str) -> DataFrame:
    """(archive, row, a column for each field of the kind), empty where nothing is told."""
    mine = fields.where(F.col("kind") == kind)
    return mine.groupBy("archive", "row").agg(*[F.coalesce(F.max(F.when(F.col("field") == f, F.col("value"))), F.lit("")).alias(f) for f in COLUMNS[kind]])


def short_slug(c: Column, limit: int = ID_PART) -> Column:
    """A slug of at most limit characters that ends on a whole word if it has several; empty texts give 'x'."""
    slug = F.trim(F.regexp_replace(T.normalize(c), "[^a-z0-9]+", "-"), F.lit("-"))
    cut = F.left(slug, F.lit(limit))
    whole = F.when(F.contains(cut, F.lit("-")) & (F.substr(slug, F.lit(limit + 1), F.lit(1)) != "-"), F.regexp_replace(cut, "-[^-]*$", "")).otherwise(cut)
    short = F.trim(F.when(F.length(slug) <= limit, slug).otherwise(whole), F.lit("-"))
    return F.when(short == "", "x").otherwise(short)


def _links(websites: Column) -> Column:
    """The URLs among what is told of sites, without labels and brackets around them."""
    parts = F.split(websites, r"[,\s]+")
    urls = F.transform(parts, lambda p: F.regexp_extract(F.rtrim(p, F.lit(")")), r"https?://\S+", 0))
    return F.filter(urls, lambda u: u != "")


def profiles(cells: DataFrame) -> Profiles:
    """Profiles by archive, from export_cells.

    basics (archive, name, headline, summary, email, phone, location, links): the first profile row; the
    email marked as primary, else the first; the first phone. A missing name is a placeholder.
    entries (archive, section, entry_id, row, name, title, location, start, end, url): positions with a company or a
    title (the other one a placeholder), schools, projects and certificates with a name; title is the degree or
    the issuer there. Ids are readable, repeats within an archive get -2, -3. Dates as record_date
    gives them. highlights (archive, entry_id, highlight_id, n, text): lines of descriptions. skills
    (archive, n, skill) in order. Missing files tell nothing; no cells, no rows.
    """
    fields = _fields(cells)
    owners = cells.select("archive").distinct()
    first = lambda df, *order: df.withColumn("_n", F.row_number().over(Window.partitionBy("archive").orderBy(*order))).where("_n = 1").drop("_n", "row")
    profile = first(_wide(fields, "profile"), "row")
    emails = first(_wide(fields, "emails").withColumn("_other", ~F.startswith(F.lower("primary"), F.lit("y"))), "_other", "row").select("archive", "email")
    phones = first(_wide(fields, "phones"), "row").select("archive", "phone")
    basics = owners.join(profile, "archive", "left").join(emails, "archive", "left").join(phones, "archive", "left").na.fill("")
    name = F.trim(F.concat_ws(" ", "first", "last"))
    basics = basics.select("archive", F.when(name == "", PLACEHOLDERS["name"]).otherwise(name).alias("name"), "headline", "summary", "email", "phone", "location", _links(F.col("websites")).alias("links"))

    rows = None
    for k, (kind, (section, prefix)) in enumerate(SECTIONS.items()):
        wide = _wide(fields, kind)
        have = set(COLUMNS[kind])
        get = lambda f: F.col(f) if f in have else F.lit("")  # noqa: B023, E731
        named = [F.when(get(f) != "", short_slug(get(f))) for f in ("name", *(["title"] if kind == "positions" else []))]
        told = wide.where((F.col("name") != "") | (F.col("title") != "")) if kind == "positions" else wide.where("name <> ''")
        shown = {"name": PLACEHOLDERS["company"], "title": PLACEHOLDERS["title"]} if kind == "positions" else {}
        part = told.select(
            "archive", F.lit(k).alias("_section"), F.lit(section).alias("section"), "row", F.concat_ws("-", F.lit(prefix), *named).alias("_base"),
            *[(F.when(get(f) == "", shown[f]).otherwise(get(f)) if f in shown else get(f)).alias(f) for f in ("name", "title", "location")],
            *[record_date(get(f))["value"].alias(f) for f in ("start", "end")], get("url").alias("url"), get("text").alias("text"),
        )
        rows = part if rows is None else rows.unionByName(part)
    n = F.row_number().over(Window.partitionBy("archive", "_base").orderBy("_section", "row"))
    entries = rows.withColumn("_n", n).withColumn("entry_id", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", F.col("_n").cast("string"))))
    lines = split_descriptions(entries.select(F.struct("archive", "entry_id").alias("id"), "text"), "id")
    highlights = lines.select("id.archive", "id.entry_id", F.concat(F.col("id.entry_id"), F.lit(".h"), F.col("n").cast("string")).alias("highlight_id"), "n", F.col("line").alias("text"))
    skills = _wide(fields, "skills").select("archive", F.row_number().over(Window.partitionBy("archive").orderBy("row")).alias("n"), "skill")
    return Profiles(basics, entries.select("archive", "section", "entry_id", "row", "name", "title", "location", "start", "end", "url"), highlights, skills)
