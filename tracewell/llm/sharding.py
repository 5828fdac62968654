"""Sharding by proportional stratified interleaving.

Within each source, rows are ranked in a seeded shuffle. A row's fractional rank is its place
within its source as a share of the source; all rows sorted by fractional rank are cut into shards
of equal counts, so each shard holds every source in the corpus's proportion.

Ranks are found without a task that holds a whole source: rows fall into ranges of the shuffle's
hash (then of the fraction), each range is ranked alone, and the rows in earlier ranges, counted
beforehand, are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one range of the shuffle or of the fraction should hold.
RANGE_ROWS = 20_000
OVERHEAD_BYTES = 16


def interleave(rows: DataFrame, shards: int = 40, seed: int = 7, id_col: str = "doc_id", stratum_col: str = "source") -> DataFrame:
    """rows plus shard and slot; shards hold counts at most one apart, slots are gapless from 0.

    A null stratum is a stratum of its own. Rows that share an id are told apart by their other
    columns; fully equal rows take neighbouring places in either order. No rows give no rows.
    """
    total = rows.count()
    ranges = max(1, -(-total // RANGE_ROWS))
    stratum = F.coalesce(F.concat(F.lit("="), F.col(stratum_col).cast("string")), F.lit(""))
    shuffled = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    mixed = rows.withColumns({"_stratum": stratum, "_order": shuffled})
    mixed = mixed.withColumn("_range", F.floor(F.conv(F.substring("_order", 1, 8), 16, 10).cast("double") * ranges / float(1 << 32)).cast("long"))
    others = [c for c in rows.columns if c not in (stratum_col,)]
    within = Window.partitionBy("_stratum", "_range").orderBy("_order", *others)
    ranked = mixed.withColumn("_rank", F.row_number().over(within).cast("long") - 1)

    earlier = Window.partitionBy("_stratum").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_stratum")
    counts = mixed.groupBy("_stratum", "_range").count()
    counts = counts.select(F.col("_stratum").alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"), F.sum("count").over(whole).alias("_n"))
    fraction = (F.col("_rank") + F.col("_before") + 0.5) / F.col("_n")
    placed = ranked.join(counts, (F.col("_stratum") == F.col("_s")) & (F.col("_range") == F.col("_r"))).withColumn("_at", fraction)
    placed = placed.withColumn("_cut", F.floor(F.col("_at") * ranges).cast("long"))

    cuts = placed.groupBy("_cut").count()
    so_far = Window.orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    cuts = cuts.select(F.col("_cut").alias("_c"), F.coalesce(F.sum("count").over(so_far), F.lit(0)).alias("_ahead"))
    in_cut = Window.partitionBy("_cut").orderBy("_at", "_stratum")
    position = F.col("_ahead") + F.row_number().over(in_cut) - 1
    out = placed.join(cuts, F.col("_cut") == F.col("_c")).withColumn("_pos", position.cast("long"))
    out = out.withColumn("shard", F.expr(f"cast(_pos * {shards} div {max(1, total)} as int)"))
    return out.withColumn("slot", F.expr(f"_pos - (shard * {max(1, total)}L + {shards - 1}) div {shards}")).select(*rows.columns, "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 7) -> DataFrame:
    """Every document's size (UTF-8 bytes plus 16; null text: none), text crc32, shard and slot.

    Only ids, sources, sizes and checksums are shuffled; texts stay where they are.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), (F.octet_length(text) + OVERHEAD_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return interleave(slim, shards, seed).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
