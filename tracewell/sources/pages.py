"""Web pages, postings and records as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from tracewell.functions import vocab

#: The named entities that are replaced; the ampersand comes last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}
_HTML_SPACE = r"[\x09-\x0D\x20]+"


def unescape(c: Column) -> Column:
    for k, v in ENTITIES.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def strip_html(c: Column) -> Column:
    """Scripts, styles, comments and tags go, block ends become line ends, entities are replaced."""
    out = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)<br */?>|</(p|div|li|h[1-6]|ul|ol|tr)>", "\n")
    out = unescape(F.regexp_replace(out, r"<[^>]*>", ""))
    out = F.regexp_replace(out, r"[\x09\x0B-\x0D\x20]+", " ")
    return F.trim(F.regexp_replace(out, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def extract_posts(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, date, text): the article's text, h1 else title, a date from tags or the address."""
    html = F.coalesce(F.col("html"), F.lit(""))
    body = F.regexp_extract(html, r"(?is)<article\b[^>]*>(.*)</article>", 1)
    main = F.regexp_extract(html, r"(?is)<main\b[^>]*>(.*)</main>", 1)
    h1 = F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)
    title = F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1)
    tag = F.regexp_extract(html, r"(?is)<time\b[^>]*datetime=\"([0-9]{4}-[0-9]{2}(-[0-9]{2})?)", 1)
    meta = F.regexp_extract(html, r"(?is)published_time\"[^>]*content=\"([0-9]{4}-[0-9]{2}(-[0-9]{2})?)", 1)
    url = F.regexp_replace(F.regexp_extract("url", r"/([0-9]{4}/[0-9]{2}(/[0-9]{2})?)/", 1), "/", "-")
    first = lambda *cs: F.coalesce(*[F.when(c != "", c) for c in cs], F.lit(""))
    return pages.select("page_id", "url", strip_html(first(h1, title)).alias("title"), first(meta, tag, url).alias("date"), strip_html(first(body, main, html)).alias("text"))


def discover_links(pages: DataFrame) -> DataFrame:
    """(page_id, host, link): distinct same-host links, resolved against the page's host."""
    host = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    raw = pages.select("page_id", host.alias("host"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r'href="([^"#?]+)'), F.lit(1)))).alias("href"))
    link = F.when(F.startswith("href", F.lit("/")), F.concat("host", "href")).when(F.col("href").rlike("^https?://"), F.col("href"))
    return raw.select("page_id", "host", link.alias("link")).where("link is not null and (link = host or startswith(link, concat(host, '/')))").distinct()


def complete_posts(posts: DataFrame, pages: DataFrame, key: str, owner: str, most: int) -> DataFrame:
    """Teasers take the page's longer text; the first `most` posts of each owner stay.

    posts: (key, owner, text); pages: (key, page_text).
    """
    joined = posts.join(pages, key, "left")
    short = (F.length(F.coalesce("text", F.lit(""))) < vocab.TEASER_CHARS) & (F.length("page_text") > F.length(F.coalesce("text", F.lit(""))))
    done = joined.withColumn("completed", F.coalesce(short, F.lit(False))).withColumn("text", F.when(F.col("completed"), F.col("page_text")).otherwise(F.col("text")))
    ranked = done.withColumn("_rank", F.row_number().over(Window.partitionBy(owner).orderBy(key)))
    return ranked.where(F.col("_rank") <= most).drop("_rank", "page_text")


def chunk_texts(texts: DataFrame, doc: str = "doc_id", text: str = "text", chars: int = vocab.CHUNK_CHARS, least_words: int = vocab.PARAGRAPH_WORDS) -> DataFrame:
    """(doc, n, chunk): consecutive lines of enough words, packed to about chars characters.

    A line that would take a chunk past chars begins the next one; a longer line stands alone.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda p: F.trim(p)), lambda p: F.size(F.regexp_extract_all(p, F.lit(r"[^\x09-\x0D\x20]+"), F.lit(0))) >= least_words)
    start = F.expr("named_struct('done', cast(array() as array<string>), 'now', '')")
    step = lambda acc, p: F.when(acc["now"] == "", F.struct(acc["done"].alias("done"), p.alias("now"))).when(F.length(acc["now"]) + 1 + F.length(p) <= chars, F.struct(acc["done"].alias("done"), F.concat(acc["now"], F.lit("\n"), p).alias("now"))).otherwise(F.struct(F.array_append(acc["done"], acc["now"]).alias("done"), p.alias("now")))
    end = lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["now"]))
    return texts.select(doc, F.posexplode(F.aggregate(lines, start, step, end)).alias("n", "chunk"))


def union_evidence(sources: DataFrame, evidence: DataFrame | None) -> DataFrame:
    """Sources plus evidence of the same columns; on one owner and id the evidence wins; None adds nothing."""
    if evidence is None:
        return sources
    return evidence.unionByName(sources.join(evidence.select("owner_id", "source_id"), ["owner_id", "source_id"], "left_anti"))


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """(posting, raw): one row per file; bytes that are no UTF-8 become replacement characters."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("posting"), F.col("value").alias("raw"))


_LINK = ST.StructType().add("label", "string").add("url", "string")
_HIGHLIGHT = ST.StructType().add("id", "string").add("text", "string").add("skills", ST.ArrayType(ST.StringType()))
_ENTRY = ST.StructType().add("id", "string").add("title", "string").add("company", "string").add("start", "string").add("end", "string").add("highlights", ST.ArrayType(_HIGHLIGHT))
PROFILE = (
    ST.StructType()
    .add("owner_id", "string")
    .add("basics", ST.StructType().add("name", "string").add("headline", "string").add("email", "string").add("phone", "string").add("location", "string").add("links", ST.ArrayType(_LINK)))
    .add("experience", ST.ArrayType(_ENTRY))
    .add("education", ST.ArrayType(_ENTRY))
    .add("projects", ST.ArrayType(_ENTRY))
    .add("skills", ST.MapType(ST.StringType(), ST.ArrayType(ST.StringType())))
    .add("certifications", ST.ArrayType(ST.StructType().add("id", "string").add("name", "string").add("issuer", "string").add("date", "string")))
    .add("_corrupt", "string")
)


def read_profiles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(profiles, rejects): nested JSON records under a fixed schema; what does not fit is set aside whole."""
    rows = spark.read.schema(PROFILE).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    bad = F.col("_corrupt").isNotNull() | F.col("owner_id").isNull()
    return rows.where(~bad).drop("_corrupt"), rows.where(bad).select("_corrupt")


def build_sources(profiles: DataFrame) -> DataFrame:
    """(owner_id, source_id, kind, text, label, skills, parent_id): entries, highlights, certifications, skills."""
    out = None
    for section in ("experience", "education", "projects"):
        e = profiles.select("owner_id", F.explode(section).alias("e"))
        head = F.concat_ws(", ", F.col("e.title"), F.col("e.company"))
        entry = e.select("owner_id", F.col("e.id").alias("source_id"), F.lit(section).alias("kind"), head.alias("text"), head.alias("label"), F.expr("cast(array() as array<string>)").alias("skills"), F.lit(None).cast("string").alias("parent_id"))
        h = e.select("owner_id", F.col("e.id").alias("parent_id"), head.alias("head"), F.explode("e.highlights").alias("h"))
        high = h.select("owner_id", F.col("h.id").alias("source_id"), F.lit("highlight").alias("kind"), F.concat_ws("\n", "head", "h.text").alias("text"), F.col("h.text").alias("label"), F.coalesce("h.skills", F.expr("cast(array() as array<string>)")).alias("skills"), "parent_id")
        part = entry.unionByName(high)
        out = part if out is None else out.unionByName(part)
    c = profiles.select("owner_id", F.explode("certifications").alias("c"))
    text = F.concat_ws(", ", F.col("c.name"), F.col("c.issuer"), F.col("c.date"))
    cert = c.select("owner_id", F.col("c.id").alias("source_id"), F.lit("certification").alias("kind"), text.alias("text"), F.col("c.name").alias("label"), F.expr("cast(array() as array<string>)").alias("skills"), F.lit(None).cast("string").alias("parent_id"))
    all_skills = F.flatten(F.map_values("skills"))
    skills = profiles.where("size(skills) > 0").select("owner_id", F.lit("skills").alias("source_id"), F.lit("skills").alias("kind"), F.array_join(all_skills, ", ").alias("text"), F.lit("skills").alias("label"), all_skills.alias("skills"), F.lit(None).cast("string").alias("parent_id"))
    return out.unionByName(cert).unionByName(skills)
