"""One record from two sources: entries matched one to one, contact blocks, skills, and what is left to check."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Words that do not tell companies apart, and what stands for a missing name.
COMPANY_NOISE = r"(?i)\b(inc|llc|ltd|corp|corporation|co|company|the|university|college)\b"
PLACEHOLDER = "TODO"


def company_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), COMPANY_NOISE, " ")), "[^a-z0-9]+", "")


def match_entries(skeleton: DataFrame, detail: DataFrame) -> DataFrame:
    """(owner_id, skeleton_id, detail_id): each skeleton entry, in order, takes the first unused detail
    entry whose key is equal to its own or holds it, or is held by it; what is left stands alone.

    skeleton, detail: (owner_id, entry_id, seq, name). One owner's entries, a few dozen at most, are
    matched in one call; owners are dealt out by key.
    """
    side = lambda df, name: df.select("owner_id", "entry_id", "seq", company_key(F.col("name")).alias("key"), F.lit(name).alias("side"))

    def assign(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq")
        free = list(group[group.side == "detail"][["entry_id", "key"]].itertuples(index=False, name=None))
        out = []
        for entry, key in group[group.side == "skeleton"][["entry_id", "key"]].itertuples(index=False, name=None):
            hit = next((x for x in free if key and x[1] and (key in x[1] or x[1] in key)), None)
            if hit:
                free.remove(hit)
            out.append((entry, hit[0] if hit else None))
        out += [(None, entry) for entry, _ in free]
        return pd.DataFrame([(group.owner_id.iloc[0], a, b) for a, b in out], columns=["owner_id", "skeleton_id", "detail_id"])

    both = side(skeleton, "skeleton").unionByName(side(detail, "detail"))
    return both.groupBy("owner_id").applyInPandas(assign, "owner_id string, skeleton_id string, detail_id string")


def merge_highlights(matches: DataFrame, highlights: DataFrame) -> DataFrame:
    """(owner_id, entry_id, n, text): the detail's highlights where it has any, else the skeleton's, renumbered.

    highlights: (owner_id, side, entry_id, n, text).
    """
    entry = matches.select("owner_id", F.coalesce("skeleton_id", "detail_id").alias("entry_id"), F.posexplode(F.array(F.struct(F.lit("detail").alias("side"), F.col("detail_id").alias("from_id")), F.struct(F.lit("skeleton").alias("side"), F.col("skeleton_id").alias("from_id")))).alias("prefer", "x")).select("owner_id", "entry_id", "prefer", "x.side", "x.from_id").where("from_id is not null")
    found = entry.join(highlights.withColumnRenamed("entry_id", "from_id"), ["owner_id", "side", "from_id"])
    lists = found.groupBy("owner_id", "entry_id", "prefer").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("h"))
    best = lists.groupBy("owner_id", "entry_id").agg(F.min_by("h", "prefer").alias("h"))
    return best.select("owner_id", "entry_id", F.posexplode(F.transform("h", lambda x: x["text"])).alias("n", "text")).withColumn("n", F.col("n") + 1)


def merge_basics(skeleton: DataFrame, detail: DataFrame, fields: tuple[str, ...] = ("name", "headline", "summary", "email", "phone", "location")) -> DataFrame:
    """The skeleton's value of each field unless it is blank or a placeholder; then the detail's."""
    d = detail.select("owner_id", *[F.col(f).alias(f"_{f}") for f in fields])
    both = skeleton.join(d, "owner_id", "full")
    real = lambda f: F.when((F.coalesce(F.col(f), F.lit("")) != "") & ~F.startswith(F.coalesce(F.col(f), F.lit("")), F.lit(PLACEHOLDER)), F.col(f))
    return both.select("owner_id", *[F.coalesce(real(f), F.col(f"_{f}"), F.col(f), F.lit("")).alias(f) for f in fields])


def merge_links(skeleton: DataFrame, detail: DataFrame) -> DataFrame:
    """(owner_id, label, url): links of both, one for each address; of equal ones the detail's."""
    key = F.lower(F.rtrim(F.col("url"), F.lit("/")))
    both = skeleton.select("owner_id", "label", "url", F.lit(0).alias("side")).unionByName(detail.select("owner_id", "label", "url", F.lit(1).alias("side")))
    return both.groupBy("owner_id", key.alias("key")).agg(F.max_by(F.struct("label", "url"), "side").alias("x")).select("owner_id", "x.label", "x.url")


def merge_skills(skeleton: DataFrame, detail: DataFrame) -> DataFrame:
    """(owner_id, category, skill): the detail's categories; what only the skeleton has goes under Skills."""
    low = F.lower("skill").alias("low")
    extra = skeleton.select("owner_id", "skill", low).join(detail.select("owner_id", low), ["owner_id", "low"], "left_anti")
    return detail.select("owner_id", "category", "skill").unionByName(extra.dropDuplicates(["owner_id", "low"]).select("owner_id", F.lit("Skills").alias("category"), "skill"))


def distinct_skills(skills: DataFrame) -> DataFrame:
    """(owner_id, skill): the first spelling of each skill. skills: (owner_id, seq, skill)."""
    key = F.lower(F.trim("skill"))
    return skills.where(F.trim(F.coalesce("skill", F.lit(""))) != "").groupBy("owner_id", key.alias("key")).agg(F.min_by(F.trim("skill"), "seq").alias("skill")).drop("key")


def audit(profiles: DataFrame) -> DataFrame:
    """(owner_id, subject, problem): what somebody still has to look at in each record."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    no = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    todo = lambda c: F.startswith(F.coalesce(c, F.lit("")), F.lit(PLACEHOLDER))
    row = lambda cond, subject, problem: F.when(cond, F.struct(F.lit(subject).alias("subject"), F.lit(problem).alias("problem")))
    whole = F.array(
        row(blank(F.col("basics.name")) | todo(F.col("basics.name")), "basics.name", "not set"),
        *[row(blank(F.col(f"basics.{f}")), f"basics.{f}", "empty") for f in ("email", "phone", "location")],
        row(no("experience") & no("projects"), "record", "no experience or projects"),
        row(F.coalesce(F.size("skills"), F.lit(0)) <= 0, "skills", "empty"),
    )
    out = profiles.select("owner_id", F.inline(F.filter(whole, lambda x: x.isNotNull())))
    e = profiles.select("owner_id", F.explode("experience").alias("e"))
    entry = lambda cond, problem: F.when(cond, F.struct(F.col("e.id").alias("subject"), F.lit(problem).alias("problem")))
    each = F.array(entry(todo(F.col("e.company")) | todo(F.col("e.title")), "name needs checking"), entry(no("e.highlights"), "no bullets"), entry(blank(F.col("e.start")), "no start date"))
    return out.unionByName(e.select("owner_id", F.inline(F.filter(each, lambda x: x.isNotNull()))))


def current_copy(entries: DataFrame, exported: DataFrame | None, highlights: DataFrame) -> DataFrame:
    """(owner_id, entry_id, copy): the exported text of the entry's company, or the record's highlights.

    Where an export is given it decides, also by being empty. exported: (owner_id, company, text);
    entries: (owner_id, entry_id, company); highlights: (owner_id, entry_id, n, text).
    """
    if exported is not None:
        e = exported.select("owner_id", F.lower("company").alias("low"), F.col("text").alias("copy")).dropDuplicates(["owner_id", "low"])
        return entries.withColumn("low", F.lower("company")).join(e, ["owner_id", "low"], "left").select("owner_id", "entry_id", F.coalesce("copy", F.lit("")).alias("copy"))
    own = highlights.groupBy("owner_id", "entry_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n").alias("copy"))
    return entries.select("owner_id", "entry_id").join(own, ["owner_id", "entry_id"], "left").select("owner_id", "entry_id", F.coalesce("copy", F.lit("")).alias("copy"))


