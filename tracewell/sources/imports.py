"""Feeds, sitemaps, export archives, model drafts and run records as tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.sources.pages import strip_html, unescape

#: Element names that may hold each field of a feed entry.
FEED_FIELDS = {"title": "title", "link": "link|id|guid", "date": "pubDate|published|updated|date", "text": "encoded|content|description|summary"}
DRAFT_ITEM = "struct<entries:array<struct<source_id:string,bullets:array<struct<text:string,source_ids:array<string>>>>>,headline:string,summary:string>"
RUN = "run_id string, created_at string, mode string, ok boolean, cancelled boolean, score struct<total:double>, documents array<struct<name:string,files:array<string>>>, _corrupt string"


def split_descriptions(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, line): a description's lines without bullet signs, those of more than two characters, numbered from 1.

    Null and empty texts have none.
    """
    lines = F.split(F.col(text), r"\r\n|[\n\x0B\x0C\r\x1C-\x1E\x85\u2028\u2029]")
    bare = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, r"^[\s]*[•‣▪·◦*–—\-]\s+", ""), r"^\s+|\s+$", ""))
    return df.select(id_col, F.posexplode(F.filter(bare, lambda x: F.length(x) > 2)).alias("n", "line")).withColumn("n", F.col("n") + 1)


def well_formed(xml: Column) -> Column:
    """Whether a text is an XML document: a permissive parse leaves no corrupt record."""
    parsed = F.from_xml(xml, "_corrupt string, `_` string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "ignoreNamespace": "true"})
    return xml.isNotNull() & (F.trim(xml) != "") & parsed["_corrupt"].isNull() & parsed.isNotNull()


def _field(entry: Column, names: str) -> Column:
    """The first non-empty element of these names, in document order; a link may be an attribute."""
    found = F.regexp_extract_all(entry, F.lit(rf"(?is)<(?:\w+:)?(?:{names})\b[^>]*?(?:/>|>.*?</(?:\w+:)?(?:{names})>)"), F.lit(0))
    value = lambda e: F.coalesce(
        F.when(F.regexp_extract(e, r'(?is)^<[^>]*\bhref="([^"]+)"', 1) != "", F.regexp_extract(e, r'(?is)^<[^>]*\bhref="([^"]+)"', 1)),
        F.trim(F.regexp_replace(F.regexp_extract(e, r"(?is)^<[^>]*>(.*)</[^>]*>$", 1), r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")),
    )
    return F.coalesce(F.element_at(F.filter(F.transform(found, value), lambda x: x != ""), 1), F.lit(""))


def parse_feeds(feeds: DataFrame) -> DataFrame:
    """(site, n, title, link, date, text) of each entry of RSS and Atom bodies; a malformed body has none."""
    entry = r"(?is)<(?:\w+:)?(?:item|entry)\b[^>]*>.*?</(?:\w+:)?(?:item|entry)>"
    each = feeds.where(well_formed(F.col("body"))).select("site", F.posexplode(F.regexp_extract_all("body", F.lit(entry), F.lit(0))).alias("n", "entry"))
    raw = each.select("site", "n", *[_field(F.col("entry"), names).alias(k) for k, names in FEED_FIELDS.items()])
    return raw.withColumns({"title": unescape(F.col("title")), "text": strip_html(unescape(F.col("text"))), "date": F.coalesce(F.when(F.regexp_extract("date", r"^\d{4}-\d{2}(-\d{2})?", 0) != "", F.regexp_extract("date", r"^\d{4}-\d{2}(-\d{2})?", 0)), F.col("date"))})


def parse_sitemaps(bodies: DataFrame) -> DataFrame:
    """(site, url): the locations of url sets and indexes; a malformed body has none."""
    return bodies.where(well_formed(F.col("body"))).select("site", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"(?is)<(?:\w+:)?loc\b[^>]*>\s*(.*?)\s*</"), F.lit(1)))).alias("url")).where("url <> ''")


def choose_route(candidates: DataFrame) -> DataFrame:
    """Of the posts that several discovery routes found (site, priority, ...), those of each site's first route."""
    return candidates.withColumn("_rank", F.dense_rank().over(Window.partitionBy("site").orderBy("priority"))).where("_rank = 1").drop("_rank")


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, col, value): the cells of CSV files; see exports.export_cells, which this selects from."""
    from tracewell.sources.exports import export_cells

    return export_cells(spark, path).select("file", "row", "col", "value")


def parse_drafts(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Model outputs (run_id, attempt, output) to (draft items, rejects): fences and prose around the object go."""
    bare = F.trim(F.regexp_replace(F.coalesce("output", F.lit("")), r"(?m)^\s*```\w*\s*$", ""))
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    parsed = raw.select("run_id", "attempt", "output", F.from_json(inner, DRAFT_ITEM, {"mode": "PERMISSIVE"}).alias("d"))
    good = F.coalesce(F.size("d.entries") > 0, F.lit(False))
    entries = parsed.where(good).select("run_id", "attempt", F.posexplode("d.entries").alias("entry_no", "e"))
    items = entries.select("run_id", "attempt", F.col("e.source_id").alias("entry_id"), F.posexplode("e.bullets").alias("item_no", "b"))
    return items.select("run_id", "attempt", "entry_id", "item_no", F.col("b.text").alias("text"), F.coalesce("b.source_ids", F.expr("cast(array() as array<string>)")).alias("source_ids")), parsed.where(~good).select("run_id", "attempt", "output")


def locators(items: DataFrame) -> DataFrame:
    """Items numbered from 1 as entry.bulletN."""
    return items.withColumn("locator", F.format_string("%s.bullet%d", "entry_id", F.col("item_no") + 1))


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """One summary row for each run.json under root, newest first; unreadable ones are kept as legacy."""
    rows = spark.read.schema(RUN).option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True).json(root, multiLine=True)
    legacy = F.col("_corrupt").isNotNull() | F.col("run_id").isNull()
    files = F.array_sort(F.flatten(F.transform(F.coalesce("documents", F.expr("cast(array() as array<struct<name:string,files:array<string>>>)")), lambda d: F.coalesce(d["files"], F.expr("cast(array() as array<string>)")))))
    return rows.select(F.col("_metadata.file_path").alias("path"), "run_id", "created_at", "mode", F.coalesce("ok", F.lit(False)).alias("ok"), F.col("score.total").alias("total"), files.alias("files"), legacy.alias("legacy")).orderBy(F.desc("created_at"), F.desc("run_id"))


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, created_at, mode, ok, cancelled, total, files, legacy) of each run folder right under root, newest first.

    A folder is listed by its files, at any depth, so an empty one is not. Where run.json is absent,
    no JSON or of other types, the run is legacy: named by its folder, dated by its newest file, and
    its files are the PDFs right in it, as they are for a record that names none.
    """
    inside = F.substring_index(F.col("path"), re.sub(r"^[a-z0-9]+:/+", "/", root.rstrip("/")) + "/", -1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    parts = files.select(F.split(inside, "/").alias("parts"), "modificationTime").where("size(parts) > 1")
    name = F.when((F.size("parts") == 2) & F.lower(F.col("parts")[1]).endswith(".pdf"), F.col("parts")[1])
    folders = parts.groupBy(F.col("parts")[0].alias("folder")).agg(F.max("modificationTime").alias("newest"), F.array_sort(F.collect_list(name)).alias("pdfs"))
    said = files.where(F.col("path").endswith("/run.json")).select(F.split(inside, "/").alias("parts"), F.col("content").cast("string").alias("body")).where("size(parts) = 2")
    read = said.select(F.col("parts")[0].alias("folder"), F.from_json("body", RUN, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    rows = folders.join(read, "folder", "left")
    legacy = F.col("r.run_id").isNull() | F.col("r._corrupt").isNotNull()
    none = F.expr("cast(array() as array<string>)")
    named = F.flatten(F.transform(F.coalesce("r.documents", F.expr("cast(array() as array<struct<name:string,files:array<string>>>)")), lambda d: F.coalesce(d["files"], none)))
    own = lambda c: F.when(~legacy, F.col(f"r.{c}"))
    listed = rows.select(
        F.coalesce(own("run_id"), "folder").alias("run_id"), F.coalesce(own("created_at"), F.date_format(F.to_utc_timestamp("newest", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).alias("created_at"),
        own("mode").alias("mode"), F.coalesce(own("ok"), F.lit(False)).alias("ok"), F.coalesce(own("cancelled"), F.lit(False)).alias("cancelled"), own("score.total").alias("total"),
        F.when(~legacy & (F.size(named) > 0), F.array_sort(named)).otherwise(F.col("pdfs")).alias("files"), legacy.alias("legacy"),
    )
    return listed.orderBy(F.desc("created_at"), F.desc("run_id"))


def write_runs(runs: DataFrame, path: str) -> None:
    """Run records as JSON, by day."""
    runs.withColumn("day", F.substring("created_at", 1, 10)).write.mode("append").partitionBy("day").json(path)


def write_evidence(evidence: DataFrame, path: str) -> None:
    evidence.withColumn("generated_at", F.current_timestamp()).write.mode("overwrite").parquet(path)
