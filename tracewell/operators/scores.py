"""Drafts scored on all components against their postings, what a record can reach, and what a draft still lacks.

Every step follows the pairs that are asked for: a draft or record meets the terms and
requirements of its own postings only. An owner is a draft or a record. Tables:

* drafts (doc_id, item_id, source, headline, summary, bullets, skills, titles, format): one row for
  a draft (rows without an id or posting are left out); bullets, skills and titles (of the entries
  it holds, and the record's own headline) are arrays, format is the share of format checks passed.
* postings (item_id, title, seniority), wanted (item_id, kind, term) of kind 'hard' or 'keyword',
  quals (item_id, seq, text), lexicon (term).
* record (source, doc_id, text), held (source, title).

Nulls and empty texts hold nothing; a posting that asks for nothing of a kind counts in full.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.functions import vocab
from tracewell.functions.shared import written
from tracewell.operators import fit
from tracewell.operators import mentions as M

#: Entries of each list of feedback, in the order of the lists; null is all.
LISTS = {"unsurfaced": 15, "title_words": 8, "unaddressed": 10, "stuffed": None, "absent": 15}


class Asked(NamedTuple):
    """What postings ask for, prepared once for all owners."""

    terms: DataFrame  # (item_id, term, hard, keyword)
    sizes: DataFrame  # (item_id, n_hard, n_keyword)
    named: DataFrame  # (item_id, seq, term)
    needs: DataFrame  # (item_id, seq, n_terms, words)
    lexicon: DataFrame  # (term): the dictionary and all terms asked for


def running_text() -> Column:
    """A draft's summary and bullets: where a keyword counts as used in context."""
    return F.concat_ws("\n", "summary", F.array_join("bullets", "\n"))


def searchable_text() -> Column:
    """All that a draft says: headline, running text and skills."""
    return F.concat_ws("\n", "headline", running_text(), F.array_join("skills", ", "))


def _surface() -> Column:
    return F.concat_ws(" ", "headline", F.array_join("titles", " "))


def asked(wanted: DataFrame, quals: DataFrame, lexicon: DataFrame) -> Asked:
    """The postings' terms by kind, their requirements, and the terms that each requirement names."""
    one = wanted.select("item_id", "kind", T.normalize("term").alias("term")).where("item_id is not null and term <> ''")
    terms = written(one.groupBy("item_id", "term").agg(F.max(F.col("kind") == "hard").alias("hard"), F.max(F.col("kind") == "keyword").alias("keyword")), "asked")
    sizes = terms.groupBy("item_id").agg(F.count_if("hard").alias("n_hard"), F.count_if("keyword").alias("n_keyword"))
    dictionary = written(lexicon.select(T.normalize("term").alias("term")).unionByName(terms.select("term")).where("term <> ''").distinct(), "lexicon")
    said = quals.where("item_id is not null").select(F.struct("item_id", "seq").alias("part"), "text")
    named = written(M.mentions(said, lexicon, "part", "text").select("part.item_id", "part.seq", "term"), "named")
    counts = named.groupBy("item_id", "seq").agg(F.count(F.lit(1)).alias("n_terms"))
    needs = quals.select("item_id", "seq", T.content_words("text").alias("words")).join(counts, ["item_id", "seq"], "left")
    return Asked(terms, sizes, named, needs.withColumn("n_terms", F.coalesce("n_terms", F.lit(0))), dictionary)


def judge(pairs: DataFrame, said: DataFrame, words: DataFrame, want: Asked) -> DataFrame:
    """(owner, item_id, seq, addressed) for every requirement of every pair.

    A requirement that names terms is met by half of them, another by 40 of 100 of its content words;
    one without either is met by everybody. Words that no requirement is judged by go before they are
    dealt out. said: distinct (owner, term), words: distinct (owner, word).
    """
    all_of = pairs.join(want.needs, "item_id").select("owner", "item_id", "seq", "n_terms", F.size("words").alias("n_words"))
    by_term = pairs.join(want.named, "item_id").join(said.select("owner", "term"), ["owner", "term"]).select("owner", "item_id", "seq")
    needed = written(want.needs.where("n_terms = 0").select("item_id", "seq", F.explode("words").alias("word")), "needed")
    wanted = needed.select("word").distinct()
    if wanted.count() <= M.BROADCAST_SPELLINGS:
        wanted = F.broadcast(wanted)
    by_word = pairs.join(needed, "item_id").join(words.join(wanted, "word", "left_semi"), ["owner", "word"]).select("owner", "item_id", "seq")
    hits = by_term.unionByName(by_word).groupBy("owner", "item_id", "seq").agg(F.count(F.lit(1)).alias("hits"))
    both = all_of.join(hits, ["owner", "item_id", "seq"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    met = F.when(F.col("n_terms") > 0, F.col("hits") * 2 >= F.col("n_terms")).otherwise((F.col("n_words") == 0) | (F.col("hits") * 10 >= F.col("n_words") * 4))
    return both.select("owner", "item_id", "seq", met.alias("addressed"))


def _shares(pairs: DataFrame, said: DataFrame, judged: DataFrame, want: Asked) -> DataFrame:
    """(owner, item_id, hard_skills, qualifications, keywords) of each pair, unrounded."""
    matched = pairs.join(want.terms, "item_id").join(said, ["owner", "term"])
    hits = matched.groupBy("owner", "item_id").agg(F.count_if("hard").alias("hard"), F.count_if(F.col("keyword") & F.col("running")).alias("used"))
    quals = judged.groupBy("owner", "item_id").agg((F.count_if("addressed") / F.count(F.lit(1))).alias("qualifications"))
    rows = pairs.join(want.sizes, "item_id", "left").join(hits, ["owner", "item_id"], "left").join(quals, ["owner", "item_id"], "left")
    share = lambda n, of: F.when(F.coalesce(of, F.lit(0)) == 0, F.lit(1.0)).otherwise(F.coalesce(n, F.lit(0)) / of)
    return rows.select("owner", "item_id", share(F.col("hard"), F.col("n_hard")).alias("hard_skills"), F.coalesce("qualifications", F.lit(1.0)).alias("qualifications"), share(F.col("used"), F.col("n_keyword")).alias("keywords"))


def points(**shares: Column) -> Column:
    """The weighted total of unrounded shares, to one decimal; halves go to the even digit."""
    total = sum((shares[name] * (weight * 100) for name, weight in vocab.WEIGHTS.items()), F.lit(0.0))
    return F.bround(F.round(total, 9), 1)


def draft_terms(drafts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(owner, term, running): the terms that each draft says, and whether its running text does.

    A term does not reach from the headline or the skills into the running text.
    """
    front = F.concat_ws("\n", "headline", F.array_join("skills", ", "))
    both = F.array(F.struct(F.lit(False).alias("running"), front.alias("text")), F.struct(F.lit(True).alias("running"), running_text().alias("text")))
    parts = drafts.select("doc_id", F.inline(both)).where("text <> ''").select(F.struct("doc_id", "running").alias("part"), "text")
    return M.mentions(parts, lexicon, "part", "text").groupBy(F.col("part.doc_id").alias("owner"), "term").agg(F.max("part.running").alias("running"))


def stuffed_terms(drafts: DataFrame, used: DataFrame) -> DataFrame:
    """(owner, stuffed): the used terms that a draft's running text repeats too often, in order; drafts without any have no row.

    used: (owner, term), the keywords of a draft's posting that are in its running text. More often
    than two fifths of the bullets, and than three times, is too often; own spellings are counted.
    """
    lists = used.groupBy("owner").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    limit = F.greatest(F.lit(3), F.bround(F.greatest(F.lit(1), F.size("bullets")) * 0.4).cast("int"))
    rows = drafts.select(F.col("doc_id").alias("owner"), T.normalize(running_text()).alias("norm"), limit.alias("most")).join(lists, "owner")
    pattern = lambda t: F.concat(F.lit("(?<![a-z0-9])"), F.regexp_replace(t, r"([^a-z0-9 ])", r"\\$1"), F.lit("(?![a-z0-9])"))
    over = F.filter("terms", lambda t: F.regexp_count(F.col("norm"), pattern(t)) > F.col("most"))
    return rows.select("owner", over.alias("stuffed")).where("size(stuffed) > 0")


class Scored(NamedTuple):
    scores: DataFrame  # (doc_id, item_id, one column a component, total)
    judged: DataFrame  # (owner, item_id, seq, addressed)
    said: DataFrame  # (owner, term, running)
    stuffed: DataFrame  # (owner, stuffed)
    want: Asked


def score_drafts(drafts: DataFrame, postings: DataFrame, want: Asked) -> Scored:
    """Each draft's five components and total against its posting, with what they come from.

    Title: fit.title_fit over headline and titles. Keywords in context lose a tenth for each stuffed
    term, up to half. A null format counts as no check passed.
    """
    drafts = drafts.where("doc_id is not null and item_id is not null")
    pairs = written(drafts.select(F.col("doc_id").alias("owner"), "item_id"), "pairs")
    said = written(draft_terms(drafts, want.lexicon), "said")
    words = drafts.select(F.col("doc_id").alias("owner"), F.explode(T.content_words(searchable_text())).alias("word"))
    judged = written(judge(pairs, said, words, want), "judged")
    used = pairs.join(want.terms.where("keyword"), "item_id").join(said.where("running"), ["owner", "term"]).select("owner", "term")
    stuffed = written(stuffed_terms(drafts, used), "stuffed")
    shown = drafts.select(F.col("doc_id").alias("owner"), "item_id", _surface().alias("surface"), F.coalesce("format", F.lit(0.0)).alias("format"))
    titled = fit.title_fit(shown.join(postings.select("item_id", "title", "seniority"), "item_id", "left"), levels="surface", digits=12).select("owner", "title_fit", "format")
    rows = _shares(pairs, said, judged, want).join(titled, "owner").join(stuffed, "owner", "left")
    penalty = F.least(F.lit(0.5), F.coalesce(F.size("stuffed"), F.lit(0)) * 0.1)
    rows = rows.withColumn("keywords_in_context", F.col("keywords") * (1 - penalty))
    total = points(**{name: F.col(name) for name in vocab.WEIGHTS})
    scores = rows.select(F.col("owner").alias("doc_id"), "item_id", *[F.round(name, 6).alias(name) for name in vocab.WEIGHTS], total.alias("total"))
    return Scored(scores, judged, said, stuffed, want)


def record_terms(record: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(owner, term, found_in): the terms of a record's sources, and the first source that has each."""
    parts = record.where("source is not null").select(F.struct("source", "doc_id").alias("part"), "text")
    return M.mentions(parts, lexicon, "part", "text").groupBy(F.col("part.source").alias("owner"), "term").agg(F.min("part.doc_id").alias("found_in"))


def levels_shown(held: DataFrame, postings: DataFrame) -> DataFrame:
    """Distinct (owner, seniority): the levels that a record's titles show.

    A level outside vocab.SENIORITY is shown by a title that names it.
    """
    norm = held.where("source is not null").select(F.col("source").alias("owner"), T.normalize("title").alias("text"))
    known = F.filter(F.array(*[F.when(F.col("text").rlike(p), F.lit(level)) for level, p in vocab.SENIORITY.items()]), lambda x: x.isNotNull())
    other = postings.select(T.normalize("seniority").alias("term")).where((F.col("term") != "") & ~F.col("term").isin(list(vocab.SENIORITY))).distinct()
    listed = norm.select("owner", F.explode(known).alias("seniority"))
    return listed.unionByName(M.mentions(norm, other, "owner", "text").select("owner", F.col("term").alias("seniority"))).distinct()


def ceilings(pairs: DataFrame, postings: DataFrame, record: DataFrame, held: DataFrame, want: Asked) -> DataFrame:
    """(item_id, source, components, ceiling, unreachable): what a perfect selection from a record could score.

    pairs: distinct (item_id, source). Any keyword of the record can be brought into context, title
    words are free to use and format checks can all pass; a level can only be shown by a title held.
    unreachable counts the terms asked for that are nowhere in the record.
    """
    pairs = pairs.where("item_id is not null and source is not null").select(F.col("source").alias("owner"), "item_id").distinct()
    said = written(record_terms(record, want.lexicon), "record").select("owner", "term", F.lit(True).alias("running"))
    words = record.where("source is not null").select(F.col("source").alias("owner"), F.explode(T.content_words("text")).alias("word")).distinct()
    judged = judge(pairs, said, words, want)
    sizes = want.terms.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_terms"))
    found = pairs.join(want.terms.select("item_id", "term"), "item_id").join(said, ["owner", "term"]).groupBy("owner", "item_id").agg(F.count(F.lit(1)).alias("n_found"))
    shown = levels_shown(held, postings).withColumn("shown", F.lit(1.0))
    level = postings.select("item_id", T.normalize("seniority").alias("seniority"))
    rows = _shares(pairs, said, judged, want).join(level, "item_id", "left").join(shown, ["owner", "seniority"], "left").join(sizes, "item_id", "left").join(found, ["owner", "item_id"], "left")
    title = F.when(F.coalesce("seniority", F.lit("")) == "", F.lit(1.0)).otherwise(F.coalesce("shown", F.lit(0.0)) * 0.5 + 0.5)
    rows = rows.withColumns({"title_fit": title, "keywords_in_context": F.col("keywords"), "format": F.lit(1.0)})
    total = points(**{name: F.col(name) for name in vocab.WEIGHTS})
    lost = F.coalesce("n_terms", F.lit(0)) - F.coalesce("n_found", F.lit(0))
    return rows.select("item_id", F.col("owner").alias("source"), *[F.round(name, 6).alias(name) for name in vocab.WEIGHTS], total.alias("ceiling"), lost.alias("unreachable"))


def draft_gaps(drafts: DataFrame, scored: Scored, record: DataFrame) -> DataFrame:
    """(doc_id, item_id, term, in_record, found_in): every term asked for that a draft does not say.

    in_record: the draft's own record (its source) has it; found_in: the first of its sources that does.
    """
    has = record_terms(record, scored.want.lexicon).withColumnsRenamed({"owner": "source"})
    own = drafts.where("doc_id is not null and item_id is not null").select("doc_id", "item_id", "source")
    missing = own.join(scored.want.terms.select("item_id", "term"), "item_id").join(scored.said.select(F.col("owner").alias("doc_id"), "term"), ["doc_id", "term"], "left_anti")
    return missing.join(has, ["source", "term"], "left").select("doc_id", "item_id", "term", F.col("found_in").isNotNull().alias("in_record"), "found_in")


def feedback(drafts: DataFrame, scored: Scored, gaps: DataFrame, postings: DataFrame, quals: DataFrame) -> DataFrame:
    """(doc_id, list, rank, entry): what a rewrite is told, as LISTS has them, each cut at its length.

    Terms of the record come by name; words of the posting's title that the draft lacks by name;
    requirements that are not met in their order.
    """
    surface = drafts.where("doc_id is not null and item_id is not null").select("doc_id", "item_id", _surface().alias("surface"))
    lost = F.array_except(T.content_words("title"), T.content_words("surface"))
    titles = surface.join(postings.select("item_id", "title"), "item_id").select("doc_id", F.explode(lost).alias("entry"))
    unmet = scored.judged.where("not addressed").join(quals.select("item_id", "seq", "text"), ["item_id", "seq"])
    row = lambda df, name, entry, place: df.select("doc_id", F.lit(name).alias("list"), F.col(entry).alias("entry"), place.alias("place"))
    none = F.lit(0)
    rows = row(gaps.where("in_record"), "unsurfaced", "term", none).unionByName(row(titles, "title_words", "entry", none))
    rows = rows.unionByName(row(unmet.withColumnRenamed("owner", "doc_id"), "unaddressed", "text", F.col("seq")))
    rows = rows.unionByName(row(scored.stuffed.select(F.col("owner").alias("doc_id"), F.explode("stuffed").alias("entry")), "stuffed", "entry", none))
    rows = rows.unionByName(row(gaps.where("not in_record"), "absent", "term", none))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id", "list").orderBy("place", "entry")))
    longest = F.lit(None).cast("int")
    for name, most in LISTS.items():
        longest = F.when(F.col("list") == name, F.lit(most)).otherwise(longest)
    return ranked.where(longest.isNull() | (F.col("rank") <= longest)).select("doc_id", "list", "rank", "entry")


def document_texts(drafts: DataFrame) -> DataFrame:
    """(doc_id, searchable, running, n_words, n_bullets): what a draft says, what of it is running text, and how much that is.

    Words are runs without white space.
    """
    said = drafts.select("doc_id", searchable_text().alias("searchable"), running_text().alias("running"), F.size(F.filter("bullets", lambda b: F.trim(b) != "")).alias("n_bullets"))
    return said.withColumns({"n_words": F.size(F.regexp_extract_all("searchable", F.lit(r"\S+"), F.lit(0))), "n_bullets": F.greatest(F.lit(0), F.coalesce("n_bullets", F.lit(0)))})


def breakdown(scores: DataFrame) -> DataFrame:
    """(doc_id, item_id, component, weight, share, points): one row for each component of score_drafts' scores."""
    rows = [F.struct(F.lit(name).alias("component"), F.lit(w).alias("weight"), F.col(name).alias("share"), F.round(F.col(name) * (w * 100), 4).alias("points")) for name, w in vocab.WEIGHTS.items()]
    return scores.select("doc_id", "item_id", F.inline(F.array(*rows)))


def notes(scores: DataFrame, owners: DataFrame, best: DataFrame, target: float = vocab.TARGET) -> DataFrame:
    """(doc_id, item_id, total, ceiling, note): what a total means against what its record could reach.

    owners: (doc_id, source); best: ceilings(). 'reached', or 'tailoring' where the record could have
    reached the target, or 'out_of_reach' where no draft of it can. Without a ceiling the note is null.
    """
    both = scores.join(owners.select("doc_id", "source"), "doc_id").join(best.select("item_id", "source", "ceiling"), ["item_id", "source"], "left")
    note = F.when(F.col("ceiling") < target, "out_of_reach").when(F.col("total") >= target, "reached").when(F.col("ceiling") >= target, "tailoring")
    return both.select("doc_id", "item_id", "total", "ceiling", note.alias("note"))
