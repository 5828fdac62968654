"""Links of pages: references resolved against their base, declared feeds, and addresses that look like posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The parts of an address, types of feeds, endings of assets, and folders that only list posts.
ADDRESS = r"^(?:([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(?:#.*)?$"
FEED_TYPES = ("application/rss+xml", "application/atom+xml", "application/feed+json", "application/json")
ASSET = r"(?i)\.(png|jpe?g|gif|svg|css|js|xml|json|pdf|ico|webp)$"
INDEX = r"(?i)/(tags?|categor(y|ies)|page|author|about|archive)s?(/|$)"


def _parts(address: Column) -> dict[str, Column]:
    """scheme, slashes (with the authority), path, mark (with the query); empty where there is none."""
    return {k: F.regexp_extract(address, ADDRESS, n) for k, n in (("scheme", 1), ("slashes", 2), ("path", 4), ("mark", 5))}


def without_dots(path: Column) -> Column:
    """A path that begins with a slash, with its . and .. segments worked off; a last one leaves a slash."""
    segments = F.split(path, "/")
    rest = F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0)))
    none = F.expr("cast(array() as array<string>)")
    drop = lambda acc: F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(none)
    kept = F.aggregate(rest, none, lambda acc, s: F.when(s == ".", acc).when(s == "..", drop(acc)).otherwise(F.array_append(acc, s)))
    dotted = F.element_at(segments, -1).isin(".", "..")
    return F.when(F.startswith(path, F.lit("/")), F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(dotted & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit("")))).otherwise(path)


def resolve(reference: Column, base: Column) -> Column:
    """The address that a reference names from a base, by the rules of RFC 3986, without its fragment.

    References may have a scheme, begin with // (the base's scheme), / (its host), ? (its path), be relative with . and ..,
    or be empty (the base itself). Nulls give null.
    """
    r, b = _parts(F.trim(reference)), _parts(F.trim(base))
    folder = F.when((b["slashes"] != "") & (b["path"] == ""), F.lit("/")).otherwise(F.regexp_extract(b["path"], r"^(.*/)?", 0))
    path = F.when(r["path"] == "", b["path"]).when(F.startswith(r["path"], F.lit("/")), without_dots(r["path"])).otherwise(without_dots(F.concat(folder, r["path"])))
    mark = F.when((r["path"] == "") & (r["mark"] == ""), b["mark"]).otherwise(r["mark"])
    scheme = F.when(b["scheme"] == "", "").otherwise(F.concat(b["scheme"], F.lit(":")))
    own = F.concat(r["scheme"], F.lit(":"), r["slashes"], F.when(r["slashes"] != "", without_dots(r["path"])).otherwise(r["path"]), r["mark"])
    return F.when(r["scheme"] != "", own).when(r["slashes"] != "", F.concat(scheme, r["slashes"], without_dots(r["path"]), r["mark"])).otherwise(F.concat(scheme, b["slashes"], path, mark))


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in a tag, quoted in either way or not at all; empty if it has none."""
    found = [F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*{q}", 1) for q in (r'"([^"]*)"', r"'([^']*)'", r"([^\s\"'>]+)")]
    return F.coalesce(*[F.when(f != "", f) for f in found], F.lit(""))


def _tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b[^>]*>"), F.lit(0))


def page_base(html: Column, url: Column) -> Column:
    """What a page's references are resolved against: the first base tag's address, itself resolved, else the page's own."""
    named = F.get(F.filter(F.transform(_tags(html, "base"), lambda t: attribute(t, "href")), lambda h: h != ""), F.lit(0))
    return F.when(named.isNull(), url).otherwise(resolve(named, url))


def _with_base(pages: DataFrame) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    return pages.select("page_id", "url", html.alias("html"), page_base(html, F.col("url")).alias("base"))


def declared_feeds(pages: DataFrame) -> DataFrame:
    """(page_id, n, feed): the feeds that a page's link tags declare, in order, each once."""
    tags = _with_base(pages).select("page_id", "base", F.posexplode(_tags(F.col("html"), "link")).alias("n", "tag"))
    told = tags.where(F.lower(attribute(F.col("tag"), "type")).isin(*FEED_TYPES) & F.lower(attribute(F.col("tag"), "rel")).rlike(r"\balternate\b") & (attribute(F.col("tag"), "href") != ""))
    feed = resolve(attribute(F.col("tag"), "href"), F.col("base"))
    return told.select("page_id", "n", feed.alias("feed")).groupBy("page_id", "feed").agg(F.min("n").alias("n")).select("page_id", "n", "feed")


def looks_like_a_post(url: Column, root: Column) -> Column:
    """Whether an address is of the root's host, deeper than its front page, and neither an asset nor a list of posts."""
    a, b = _parts(url), _parts(root)
    path = F.rtrim(a["path"], F.lit("/"))
    return (F.lower(a["slashes"]) == F.lower(b["slashes"])) & (a["slashes"] != "") & F.startswith(path, F.lit("/")) & ~path.rlike(ASSET) & ~path.rlike(INDEX)


def post_links(pages: DataFrame) -> DataFrame:
    """(page_id, n, link): where a page's anchors lead that looks like a post of its host, in order, each once.

    Null pages have no links; n is the place of the first anchor that leads there.
    """
    tags = _with_base(pages).select("page_id", "url", "base", F.posexplode(_tags(F.col("html"), "a")).alias("n", "tag"))
    named = tags.withColumn("href", attribute(F.col("tag"), "href")).where("href <> ''")
    led = named.select("page_id", "url", "n", resolve(F.col("href"), F.col("base")).alias("link"))
    return led.where(looks_like_a_post(F.col("link"), F.col("url"))).groupBy("page_id", "link").agg(F.min("n").alias("n")).select("page_id", "n", "link")


def sitemap_posts(urls: DataFrame) -> DataFrame:
    """The rows of parse_sitemaps (site, url) whose address looks like a post of the site; site is the site's address."""
    return urls.where(looks_like_a_post(F.col("url"), F.col("site")))
