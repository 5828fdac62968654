"""Posts to evidence with ids that stay, and a store that a sync adds to only what it has not."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import vocab
from tracewell.sources.exports import short_slug

#: Characters of a post's name in the ids of its chunks.
NAME_CHARS = 40
_SPACE = r"[\x09-\x0D\x20]+"


def _plain(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, _SPACE, " ")))


def post_chunks(posts: DataFrame, chars: int = vocab.CHUNK_CHARS, least_words: int = vocab.PARAGRAPH_WORDS, between: str = r"\n\s*\n") -> DataFrame:
    """(evidence_id, content_id, title, url, date, n, text): paragraphs of enough words, packed to about chars characters.

    posts: (url, title, date, text). A paragraph that only repeats the title is left out. A chunk takes
    the next paragraph while their characters together are no more than chars, so a longer one stands alone. evidence_id names the
    post, by its title or its address, and the chunk's number from 1; content_id is a digest of address and text, the
    same in every sync. between parts paragraphs. Null texts and titles are empty.
    """
    title, text = F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))
    parts = F.transform(F.split(text, between), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    kept = F.filter(parts, lambda p: (F.size(F.regexp_extract_all(p, F.lit(r"\S+"), F.lit(0))) >= least_words) & (_plain(p) != _plain(title)))
    start = F.expr("named_struct('done', cast(array() as array<string>), 'now', '')")
    full = lambda acc, p: (acc["now"] != "") & (F.length(acc["now"]) + F.length(p) > chars)
    joined = lambda acc, p: F.when(acc["now"] == "", p).otherwise(F.concat(acc["now"], F.lit("\n\n"), p))
    step = lambda acc, p: F.when(full(acc, p), F.struct(F.array_append(acc["done"], acc["now"]).alias("done"), p.alias("now"))).otherwise(F.struct(acc["done"].alias("done"), joined(acc, p).alias("now")))
    end = lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["now"]))
    path = F.trim(F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("")), F.lit("/"))
    name = F.when(F.trim(title) != "", title).when(path != "", F.replace(path, F.lit("/"), F.lit("-"))).otherwise(F.lit("post"))
    packed = posts.select(short_slug(name, NAME_CHARS).alias("name"), F.aggregate(kept, start, step, end).alias("chunks"), title.alias("_title"), "url", "date")
    each = packed.select("name", F.col("_title").alias("title"), "url", "date", F.posexplode("chunks").alias("at", "chunk"))
    content = F.sha2(F.concat_ws("\n", F.coalesce("url", F.lit("")), "chunk").cast("binary"), 256)
    return each.select(F.concat(F.lit("blog:"), "name", F.lit("#"), (F.col("at") + 1).cast("string")).alias("evidence_id"), content.alias("content_id"), "title", "url", "date", (F.col("at") + 1).alias("n"), F.col("chunk").alias("text"))


def _has_files(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def stored(spark: SparkSession, store: str, schema) -> DataFrame:
    """All evidence of a store, with the sync and batch that brought it; an absent store is empty."""
    if not _has_files(spark, store):
        return spark.createDataFrame([], schema).withColumns({"sync": F.lit(""), "batch": F.lit(0).cast("long")})
    return spark.read.option("basePath", store).schema(f"{_ddl(schema)}, sync string, batch long").parquet(store)


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def add_to_store(chunks: DataFrame, store: str, sync: str, batch: int) -> None:
    """One commit: the chunks that the store has not, each content once, as the batch's own folder.

    What the same batch wrote before does not count as stored and is replaced, so that a batch that
    is run again after a failure leaves what it would have left.
    """
    spark = chunks.sparkSession
    had = stored(spark, store, chunks.schema).where((F.col("sync") != sync) | (F.col("batch") != batch)).select("content_id")
    new = chunks.dropDuplicates(["content_id"]).join(had, "content_id", "left_anti").select(*chunks.columns)
    new.write.mode("overwrite").parquet(f"{store}/sync={sync}/batch={batch}")


def sync_posts(posts: DataFrame, store: str, checkpoint: str, **chunking) -> DataFrame:
    """Add a stream of posts to the store, all that is there now, and return the store's evidence.

    A restart from the same checkpoint goes on where it stopped; a sync from another checkpoint reads
    all posts again and adds only what is new. No state is kept in the stream.
    """
    sync = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    schema = post_chunks(posts, **chunking).schema

    def add(batch: DataFrame, number: int) -> None:
        add_to_store(post_chunks(batch, **chunking), store, sync, number)

    posts.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stored(posts.sparkSession, store, schema)
