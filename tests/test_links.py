"""References resolved as the standard says, declared feeds, post-like addresses, and evidence that a second sync leaves alone."""

from urllib.parse import urldefrag, urljoin

from pyspark.sql import functions as F

from tracewell.sources import evidence, links

BASES = ["http://a/b/c/d;p?q", "https://blog.example.com", "https://blog.example.com/", "https://x.example/a/b/", "http://h/one?two=/three/../x"]
REFERENCES = ["g:h", "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "/./g", "/../g", "g.", ".g", "..g", "./../g", "./g/.", "g/./h", "g/../h", "g;x=1/../y", "g?y/../x", "mailto:me@x.example", "%7Euser"]


def test_references_are_resolved(spark):
    pairs = [(b, r) for b in BASES for r in REFERENCES]
    rows = spark.createDataFrame(pairs, "base string, ref string").select("base", "ref", links.resolve(F.col("ref"), F.col("base")).alias("got")).collect()
    for r in rows:
        assert r.got == urldefrag(urljoin(r.base, r.ref)).url, (r.base, r.ref)
    one = lambda ref, base: spark.range(1).select(links.resolve(F.lit(ref), F.lit(base)).alias("x")).first().x
    assert one("//g/../x", BASES[0]) == "http://g/x" and one("https://z.example/p/../q?r#s", BASES[0]) == "https://z.example/q?r" and one("a//b", BASES[0]) == "http://a/b/c/a//b"  # dots go here too, as the standard has it
    assert spark.range(1).select(links.resolve(F.lit(None).cast("string"), F.lit("http://a/")).alias("x")).first().x is None


PAGE = """<html><head><base href="/notes/"><link rel="stylesheet" href="a.css"><link type='application/rss+xml' rel='alternate' href=feed.xml>
<LINK REL="alternate" TYPE="application/atom+xml" HREF="//feeds.example.com/atom"><link rel="alternate" hreflang="de" href="/de"></head>
<body><a href="first-post">1</a> <a class=x href='../second/'>2</a> <a href="first-post#more">again</a> <a href="/tag/x">tag</a> <a href="/about">about</a> <a href="pic.PNG">p</a>
<a href="https://other.example/post">o</a> <a href="">self</a> <a name=y>none</a> <a href="/">home</a> <a href="/categories/">c</a> <a href="?page=2">q</a> <a href="mailto:x@y.example">m</a></body></html>"""


def test_feeds_and_posts_of_pages(spark):
    pages = spark.createDataFrame([(1, "https://blog.example.com/index.html", PAGE), (2, "https://x.example/", None), (3, "https://x.example/a/b", '<a href="c">c</a><a href="../d/">d</a>')], "page_id int, url string, html string")
    feeds = [(r.page_id, r.feed) for r in links.declared_feeds(pages).orderBy("page_id", "n").collect()]
    assert feeds == [(1, "https://blog.example.com/notes/feed.xml"), (1, "https://feeds.example.com/atom")]
    got = [(r.page_id, r.link) for r in links.post_links(pages).orderBy("page_id", "n").collect()]
    assert got == [(1, "https://blog.example.com/notes/first-post"), (1, "https://blog.example.com/second/"), (1, "https://blog.example.com/notes/?page=2"), (3, "https://x.example/a/c"), (3, "https://x.example/d/")]


def test_sitemaps_without_lists_and_assets(spark):
    urls = spark.createDataFrame([("https://b.example/", u) for u in ("https://b.example/post-1", "https://b.example/tags/x", "https://b.example/img.jpg", "https://c.example/post", "https://b.example/", "https://b.example/2024/05/x")], "site string, url string")
    assert sorted(r.url for r in links.sitemap_posts(urls).collect()) == ["https://b.example/2024/05/x", "https://b.example/post-1"]


POSTS = "url string, title string, date string, text string"


def words(n, w="word"):
    return " ".join(f"{w}{k}" for k in range(n))


def test_chunks_of_posts(spark):
    long = words(200)
    text = f"A  Title, that is eight words long, indeed\n\n{words(9)}\n \n{words(10)}\n\nshort one\n\n{long}\n\n{words(8, 'x')}"
    posts = [("https://b.example/p/q", "A title, that is eight words long, INDEED", "2024-01-02", text), ("https://b.example/p/q/", None, None, words(8)), (None, " ", None, None), ("https://b.example/", "", "", words(8))]
    got = {r.evidence_id: r for r in evidence.post_chunks(spark.createDataFrame(posts, POSTS)).collect()}
    name = "blog:a-title-that-is-eight-words-long-indeed"
    assert [got[f"{name}#{n}"].text for n in (1, 2, 3)] == [f"{words(9)}\n\n{words(10)}", long, words(8, "x")]
    assert set(got) == {f"{name}#1", f"{name}#2", f"{name}#3", "blog:p-q#1", "blog:post#1"}


def test_syncs_add_what_is_new_and_survive_restarts(spark, tmp_path):
    folder, store = str(tmp_path / "in"), str(tmp_path / "store")
    put = lambda name, rows: spark.createDataFrame(rows, POSTS).coalesce(1).write.parquet(f"{folder}/{name}")
    stream = lambda: spark.readStream.schema(POSTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    rows = lambda df: sorted((r.evidence_id, r.text) for r in df.collect())
    put("a", [("https://b.example/1", "One", "", words(20)), ("https://b.example/2", "Two", "", words(20))])
    put("b", [("https://b.example/1", "One", "", words(20))])  # the same again in a later file
    first = rows(evidence.sync_posts(stream(), store, str(tmp_path / "c1")))
    assert [i for i, _ in first] == ["blog:one#1", "blog:two#1"]
    assert rows(evidence.sync_posts(stream(), store, str(tmp_path / "c1"))) == first  # a restart
    assert rows(evidence.sync_posts(stream(), store, str(tmp_path / "c2"))) == first  # a sync from the start
    put("c", [("https://b.example/1", "One", "", words(20) + " new"), ("https://b.example/3", "Three", "", words(9))])
    third = rows(evidence.sync_posts(stream(), store, str(tmp_path / "c1")))
    assert [i for i, _ in third] == ["blog:one#1", "blog:one#1", "blog:three#1", "blog:two#1"] and set(first) < set(third)
    chunks = evidence.post_chunks(spark.createDataFrame([("https://b.example/4", "Four", "", words(9))], POSTS))
    for _ in range(2):  # a batch that is run again replaces itself
        evidence.add_to_store(chunks, store, "x", 5)
    assert evidence.stored(spark, store, chunks.schema).count() == 5
