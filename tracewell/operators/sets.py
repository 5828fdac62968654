"""Merging, drift, naming and dates: set operations and small normalisations over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import text as T


def ranked_in_ranges(rows: DataFrame, owner: list[str], ranges: list[tuple[Column, bool]], within: list[Column], name: str) -> DataFrame:
    """rows plus their place within the owner, from 1, without sorting a large owner in one task.

    ranges: what rows are ordered by first, each with True where it descends; rows that agree in
    all of it are sorted together, by within. Only the ranges' counts meet in one window an owner.
    """
    keys = [f"_range{k}" for k in range(len(ranges))]
    cut = rows.withColumns({k: c for k, (c, _) in zip(keys, ranges, strict=True)})
    by = [F.col(k).desc() if down else F.col(k).asc() for k, (_, down) in zip(keys, ranges, strict=True)]
    earlier = Window.partitionBy(*owner).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(*owner, *keys).count()
    counts = counts.select(*[F.col(c).alias(f"_of_{c}") for c in [*owner, *keys]], F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    ranked = cut.withColumn("_rank", F.row_number().over(Window.partitionBy(*owner, *keys).orderBy(*within)))
    same = F.lit(True)
    for c in [*owner, *keys]:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return ranked.join(counts, same).select(*rows.columns, (F.col("_before") + F.col("_rank")).cast("int").alias(name))


def merge_terms(first: DataFrame, extra: DataFrame, posting: str = "item_id", longest: int = 60, normal: bool = False) -> DataFrame:
    """(posting, term, place): the first list in order, then extra terms not in it by normal form.

    normal: all terms are normal forms themselves, so none is worked out, and two numbers tell where a term stands first.
    """
    both = first.select(posting, "term", "seq", F.lit(0).alias("part")).unionByName(extra.select(posting, "term", "seq", F.lit(1).alias("part")))
    both = both.where((F.col("part") == 0) | (F.length("term") < longest))
    if normal:
        firsts = [F.min(F.when(F.col("part") == k, F.col("seq"))).alias(f"_first{k}") for k in (0, 1)]
        kept = both.where("term <> ''").groupBy(posting, "term").agg(*firsts)
        kept = kept.select(posting, F.when(F.col("_first0").isNull(), 1).otherwise(0).alias("part"), F.coalesce("_first0", "_first1").alias("seq"), "term")
    else:
        both = both.withColumn("key", T.normalize("term")).where("key <> ''")
        kept = both.groupBy(posting, "key").agg(F.min(F.struct("part", "seq", "term")).alias("x")).select(posting, "x.*")
    ranges = [(F.col("part"), False), (F.floor(F.col("seq") / 65536), False)]
    return ranked_in_ranges(kept, [posting], ranges, [F.col("seq")], "place").select(posting, "term", "place")


def drift(current: DataFrame, proposed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line, change): lines removed, added and kept between two copies, with repeats."""
    cols = [*keys, "line"]
    a, b = current.select(*cols), proposed.select(*cols)
    mark = lambda df, name: df.withColumn("change", F.lit(name))
    return mark(a.exceptAll(b), "removed").unionByName(mark(b.exceptAll(a), "added")).unionByName(mark(a.intersectAll(b), "kept"))


def assign_ids(entries: DataFrame, owner: str, name: str, order: str) -> DataFrame:
    """A readable id for each entry: the name's slug; repeats within an owner get -2, -3 and so on."""
    base = F.when(T.slug(name) == "", F.lit("item")).otherwise(T.slug(name))
    n = F.row_number().over(Window.partitionBy(owner, "_base").orderBy(order))
    return entries.withColumn("_base", base).withColumn("_n", n).withColumn("assigned_id", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", F.col("_n").cast("string")))).drop("_base", "_n")


def month_name(c: Column) -> Column:
    """'2024-03' or a longer date as 'March 2024'; other texts as they are."""
    names = F.array(*[F.lit(x) for x in "January February March April May June July August September October November December".split()])
    month = F.regexp_extract(c, r"^\d{4}-(\d{2})", 1)
    ok = month.between("01", "12")
    return F.when(ok, F.concat_ws(" ", F.get(names, F.try_to_number(month, F.lit("99")).cast("int") - 1), F.substring(c, 1, 4))).otherwise(c)


def month_range(start: Column, end: Column) -> Column:
    """'March 2024 – Present'; a missing start leaves the end alone."""
    last = F.when(F.coalesce(end, F.lit("")) == "", F.lit("Present")).otherwise(month_name(end))
    return F.when(F.coalesce(start, F.lit("")) == "", last).otherwise(F.concat(month_name(start), F.lit(" – "), last))


def pair_entries(skeleton: DataFrame, detail: DataFrame, owner: str, key: str, order: str) -> DataFrame:
    """Entries of two sources matched one to one: of equal keys the first with the first, and so on."""
    w = Window.partitionBy(owner, key).orderBy(order)
    a = skeleton.select(owner, key, F.col(order).alias("skeleton_id"), F.row_number().over(w).alias("n"))
    b = detail.select(owner, key, F.col(order).alias("detail_id"), F.row_number().over(w).alias("n"))
    return a.join(b, [owner, key, "n"], "full")
