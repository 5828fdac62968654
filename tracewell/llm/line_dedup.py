"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line's tokens are its distinct runs of five consecutive words (the whole line, if shorter). Lines
of equal words form a class; classes are joined if the Jaccard similarity of their token sets is at
least THRESHOLD:

1. Every line is read once. It keeps its class and the few tokens that come first by the hash of their
   first word, then their own: two similar lines share at least PARTNERS of those. Classes in which fewer are shared with any other class have no
   similar line and go; in prose that is nearly all.
2. For the others, tokens are counted over all of them, and each class orders its tokens by rarity.
   Tokens of its own come first, so the prefix of a line that shares just a passage holds nothing
   shared, however many lines have that passage.
3. Classes meet on prefix tokens, if lengths allow the threshold, if the tokens after the place where
   they meet suffice for the overlap, and if they met on no earlier token: each pair comes once.
4. Candidates' full token sets are compared.

Of similar lines all but the first, by doc_id and line number, are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import release_shuffles, written

SHINGLE, THRESHOLD = 5, 0.8
#: Shared tokens of least hash that a class needs to stay (fewer in lines that have fewer tokens).
PARTNERS = 3
#: A token in more than one of so many places is hot: at most so many are, and a literal holds them.
HOT_SHARE, COUNTERS = 1000, 1 << 13
#: Lines to read again (12 bytes each) up to which their places are broadcast; beyond, a shuffled join.
BROADCAST_ROWS = 1_000_000


def _text_lines() -> Column:
    return F.split(F.col("text").cast("string"), "\n")


def _with_words(lines: DataFrame) -> DataFrame:
    """doc_id, line_no and the lower-case words of column line; every white space parts words.

    Replacing goes through a line slowly even where it finds nothing, so only lines that have a white
    space other than the space are replaced in. low is named often, so that the plan keeps it as a column.
    """
    low, odd, plain = F.col("low"), F.lit(False), F.col("low")
    for c in "\t\r\x0b\x0c":
        odd, plain = odd | F.contains(low, F.lit(c)), F.replace(plain, F.lit(c), F.lit(" "))
    line = F.when(odd, plain).otherwise(low)
    return lines.select("doc_id", "line_no", F.lower("line").alias("low")).select("doc_id", "line_no", F.array_remove(F.split(line, " "), "").alias("words"))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0) and lower-case words of each line; a null text gives one row with null words."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_lines().alias("lines"))
    return _with_words(slim.select("doc_id", F.posexplode_outer("lines").alias("line_no", "line")))


def _numbered_lines(docs: DataFrame) -> DataFrame:
    """The same for the lines whose numbers the rows list (column numbers); those that a text has not are left out.

    Only these lines, not the whole texts, are put in lower case.
    """
    slim = docs.select("doc_id", "numbers", _text_lines().alias("lines"))
    picked = F.transform("numbers", lambda n: F.struct(n.alias("line_no"), F.get("lines", n).alias("line")))
    return _with_words(slim.select("doc_id", F.inline(picked)).where("line is not null"))


def _hashed(lines: DataFrame) -> DataFrame:
    """Each line's place, class and word hashes; the words themselves are not carried on.

    Two hashes, of 96 bits together, name a line's words; they are null for a line without words.
    """
    some = F.size("hashes") > 0
    short = lines.select("doc_id", "line_no", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    return short.select("doc_id", "line_no", F.when(some, F.xxhash64("hashes")).alias("c1"), F.when(some, F.hash("hashes")).alias("c2"), "hashes")


def _tokens() -> Column:
    """A hashed line's distinct tokens, as 64-bit hashes: runs of SHINGLE words, or all words with their number."""
    size = F.size("hashes")
    m = F.greatest(size - SHINGLE + 1, F.lit(1))
    runs = F.get(F.transform(F.array("hashes"), lambda x: F.transform(F.slice("hashes", 1, m), lambda h, i: F.xxhash64(h, *[F.get(x, i + j) for j in range(1, SHINGLE)]))), F.lit(0))
    return F.array_distinct(F.when(size >= SHINGLE, runs).otherwise(F.array(F.xxhash64(size, F.col("hashes")))))


def _ceil(x: str, share: int, of: int = 1000) -> str:
    """SQL for the least whole number that is x * share / of or more."""
    return f"((({x}) * {share}L + {of - 1}) div {of})"


def line_rows(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every line: doc_id, line_no, its class c1 and c2, and its least tokens; null for a line without words.

    Of n tokens at least the share threshold is common with a similar line, so at most the rest is
    not, and of that many and PARTNERS more by any one order, PARTNERS are common to both lines. The
    order is by the first word's hash (upper half of a token here), then the run's (lower half), so only
    runs that start with one of the least words are hashed. A line holds as many distinct tokens as it
    has runs, or fewer; where repeated runs leave too few tokens, all its runs are hashed.
    """
    line = _hashed(_lines(docs)).withColumn("m", F.greatest(F.size("hashes") - SHINGLE + 1, F.lit(1)))
    line = line.withColumn("k", F.expr(f"cast(m - {_ceil('m', round(threshold * 1000))} + {PARTNERS} as int)"))
    line = line.withColumn("heads", F.expr("slice(hashes, 1, m)")).withColumn("sorted", F.expr("sort_array(heads)"))
    line = line.withColumn("cut", F.expr("get(sorted, least(size(sorted), k) - 1) | 4294967295L"))
    run = ", ".join(["h", *[f"get(x, i + {j})" for j in range(1, SHINGLE)]])
    token = f"(h & -4294967296L) | (xxhash64({run}) & 4294967295L)"
    # hashes as the variable x of an outer function: a column would be fetched from its row anew for every word
    packed = lambda of: f"sort_array(array_compact(array_distinct(get(transform(array(hashes), x -> transform(heads, (h, i) -> {of})), 0))))"
    # cut is named twice, so that the plan keeps it as a column and does not work it out for every word
    line = line.withColumn("some", F.expr(f"if(cut is null, array(), {packed(f'if(h <= cut, {token}, null)')})"))
    most = F.expr(f"if(size(some) >= least(k, m), some, {packed(token)})")
    least = F.when(F.size("hashes") >= SHINGLE, F.slice(most, F.lit(1), F.col("k"))).when(F.size("hashes") > 0, F.array(F.xxhash64(F.size("hashes"), F.col("hashes"))))
    return line.select("doc_id", "line_no", "c1", "c2", least.alias("least"))


def class_places(rows: DataFrame) -> DataFrame:
    """c1, c2, first (smallest doc_id and line) and copies of every class.

    Where all ids and line numbers fit in one long, their least is found by hashing; else (null or very
    large ids) as a struct, for which Spark sorts the lines.
    """
    ends = rows.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max("line_no").alias("most"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    bits = (ends.most or 0).bit_length()
    fits = not ends.nulls and max(abs(ends.low or 0), abs(ends.high or 0)) < 1 << (62 - bits)
    place = F.shiftleft("doc_id", bits).bitwiseOR(F.col("line_no").cast("long")) if fits else F.struct("doc_id", "line_no")
    found = rows.where("c1 is not null").groupBy("c1", "c2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies"))
    if not fits:
        return found
    line_no = F.col("first").bitwiseAND((1 << bits) - 1).cast("int")
    return found.withColumn("first", F.struct(F.shiftright("first", bits).alias("doc_id"), line_no.alias("line_no")))


def _hot(places: DataFrame) -> dict[int, int]:
    """Tokens of more than one in HOT_SHARE places, and at least 1000, with their counts.

    Places are counted by COUNTERS remainders first; only tokens of a remainder with enough of them
    are counted one by one. So few are hot that a literal holds them.
    """
    rest = F.pmod("t", F.lit(COUNTERS)).cast("int")
    counted = {r.rest: r["count"] for r in places.groupBy(rest.alias("rest")).count().collect()}
    least = max(1000, sum(counted.values()) // HOT_SHARE)
    full = [k for k, n in counted.items() if n > least]
    if not full:
        return {}
    return {r.t: r["count"] for r in places.where(rest.isin(full)).groupBy("t").count().where(F.col("count") > least).collect()}


def _shared(places: DataFrame) -> DataFrame:
    """The places (id, t) whose token is in those of more than one id, with the number k of places.

    Hot tokens are not dealt out by their key. The others are dealt once: the counting reads both
    columns, so that it and the look-up use the same exchange. An id is never null; that the plan
    knows it keeps it from putting another test for that into one of the two, which would deal them
    twice. Places of copies of a line repeat.
    """
    places = places.select(F.coalesce("id", F.lit(0)).alias("id"), "t")
    hot = _hot(places)
    dealt = (places.where(~F.col("t").isin([*hot])) if hot else places).repartition(F.col("t"))
    counts = dealt.groupBy("t").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("t", "k")
    cold = dealt.join(counts.hint("shuffle_hash"), "t").select("id", "t", "k")
    if not hot:
        return cold
    k = F.create_map(*[F.lit(x).cast("long") for pair in hot.items() for x in pair])[F.col("t")]
    return cold.unionByName(places.where(F.col("t").isin([*hot])).select("id", "t", k.alias("k")))


def partnered_classes(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """key of every class that may have a similar one: enough of its tokens of least hash are in other classes too.

    A key is c1 with, in its two low bits, how many shared tokens are enough.
    """
    need = F.expr(f"least({PARTNERS}, {_ceil('size(least)', round(threshold * 1000))})")
    places = rows.where("c1 is not null").select(_key(need).alias("id"), F.explode("least").alias("t"))
    return _shared(places).dropDuplicates(["id", "t"]).groupBy(F.col("id").alias("key")).agg(F.count(F.lit(1)).alias("k")).where("k >= (key & 3)").select("key")


def _key(need: Column) -> Column:
    return F.shiftleft(F.shiftright("c1", 2), 2).bitwiseOR(need)


def token_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """members (c1, c2, first) with an id, n and the full token set of each, from the texts where they stand first."""
    places = members.groupBy(F.col("first.doc_id").alias("at")).agg(F.collect_set("first.line_no").alias("numbers"))
    few = members.count() <= BROADCAST_ROWS
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.join(F.broadcast(places) if few else places, F.col("doc_id").eqNullSafe(F.col("at")))
    lines = _numbered_lines(texts).where(F.size("words") > 0)
    picked = _hashed(lines).select("c1", "c2", _tokens().alias("tokens"))
    # rows that repeat an id may have other lines in these places
    one = picked.groupBy("c1", "c2").agg(F.first("tokens").alias("tokens")).join(members, ["c1", "c2"])
    return one.select(F.monotonically_increasing_id().alias("id"), "c1", "c2", "first", F.size("tokens").alias("n"), "tokens")


def ordered_sets(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """sets with their shared tokens, rarest first, in place of all tokens.

    Rarity is the number of binary digits of the number of sets that hold a token; it is put before the
    token's 57 low bits, so that one sort of longs gives the order. Tokens that no other set holds come
    before all of these and need no place. Sets too few of whose tokens are shared for any similar one
    go. bits: 512 bits, of which each shared token sets one.
    """
    places = sets.select("id", F.explode("tokens").alias("t"))
    bits = [F.bit_or(F.expr(f"if(t & 7 = {k}, shiftleft(1L, cast(shiftright(t, 3) & 63 as int)), 0L)")) for k in range(8)]
    ranked = F.shiftleft(F.length(F.bin("k")).cast("long"), 57).bitwiseOR(F.col("t").bitwiseAND((1 << 57) - 1))
    order = _shared(places).select("id", ranked.alias("t")).repartition(F.col("id")).groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("s"), F.array(*bits).alias("bits"))
    met = sets.drop("tokens").join(order, "id")
    return met.where(F.size("s") * 1000 >= F.col("n") * round(threshold * 1000)).select("c1", "c2", "first", "n", F.col("s").alias("tokens"), "bits")


def candidates(ordered: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of classes that share a prefix token and pass the length and positional filters, each once.

    The shorter of two (a) need be looked up by a shorter prefix, since the longer one raises the
    overlap that both must reach. Each bit that only one of them sets stands for a token, or more,
    that the other lacks, as do tokens that no other set holds.
    """
    mille = round(threshold * 1000)
    alone = "(n - size(tokens))"  # tokens before the shared ones
    taken = f"slice(tokens, 1, cast(greatest(n - {_ceil('n', mille)} + 1 - {alone}, 0) as int))"
    words = [F.col("bits")[k].alias(f"b{k}") for k in range(8)]
    rows = ordered.select("c1", "c2", "n", "tokens", *words, F.expr(alone).alias("alone"), F.posexplode(F.expr(taken)).alias("k", "t"))
    rows = rows.select("c1", "c2", "n", "alone", *[f"b{k}" for k in range(8)], (F.col("alone") + F.col("k")).alias("pos"), "t", F.expr("slice(tokens, 1, k)").alias("before"))
    overlap = _ceil("a.n + b.n", mille, 1000 + mille)
    apart = lambda x, y: f"{x}.n - {x}.alone - (" + " + ".join(f"bit_count({x}.b{k} & ~{y}.b{k})" for k in range(8)) + ")"
    met = rows.where(f"pos <= n - {_ceil('n', 2 * mille, 1000 + mille)}").alias("a").join(
        rows.alias("b"),
        F.expr(
            "a.t = b.t and (a.n < b.n or (a.n = b.n and (a.c1 < b.c1 or (a.c1 = b.c1 and a.c2 < b.c2))))"
            f" and a.n * 1000L >= b.n * {mille}L and least(a.n - a.pos, b.n - b.pos) >= {overlap}"
            f" and {apart('a', 'b')} >= {overlap} and {apart('b', 'a')} >= {overlap}"
            " and not arrays_overlap(a.before, b.before)"
        ),
    )
    return met.select(F.col("a.c1").alias("a1"), F.col("a.c2").alias("a2"), F.col("b.c1").alias("b1"), F.col("b.c2").alias("b2"))


def links_of(ordered: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs whose Jaccard similarity is at least the threshold, with the places where the two stand first."""
    a = ordered.select(F.col("c1").alias("a1"), F.col("c2").alias("a2"), F.col("first").alias("fa"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    b = ordered.select(F.col("c1").alias("b1"), F.col("c2").alias("b2"), F.col("first").alias("fb"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    common = F.size(F.array_intersect("ta", "tb"))
    both = pairs.join(a, ["a1", "a2"]).join(b, ["b1", "b2"])
    return both.where(common * 1000 >= (F.col("na") + F.col("nb") - common) * round(threshold * 1000)).select("a1", "a2", "fa", "b1", "b2", "fb")


def similar_classes(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(lines, marks): every line's place and class, and the classes that have copies or similar ones.

    marks: c1, c2, first (smallest doc_id and line), n_links to other classes, lost if one of those
    stands before. Links are counted as they are found; they are not kept.
    """
    rows = written(line_rows(docs, threshold), "line-rows", dictionary=False)
    classes = written(class_places(rows), "line-classes")
    partnered = written(partnered_classes(rows, threshold), "line-partners")
    release_shuffles(docs.sparkSession)
    members = classes.join(partnered.select(F.shiftright("key", 2).alias("key")), F.shiftright("c1", 2) == F.col("key"), "left_semi")
    members = written(members.select("c1", "c2", "first"), "line-members")  # read three times
    sets = written(token_sets(docs, members), "line-sets")
    ordered = written(ordered_sets(sets, threshold), "line-ordered")
    release_shuffles(docs.sparkSession)
    links = links_of(ordered, candidates(ordered, threshold), threshold)
    later = F.col("fa") < F.col("fb")
    ends = F.array(F.struct(F.col("a1").alias("c1"), F.col("a2").alias("c2"), (~later).alias("lost")), F.struct(F.col("b1").alias("c1"), F.col("b2").alias("c2"), later.alias("lost")))
    linked = links.select(F.inline(ends)).groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n_links"), F.max("lost").alias("lost"))
    marks = classes.join(linked, ["c1", "c2"], "left").where("copies > 1 or n_links > 0")
    marks = marks.select("c1", "c2", "first", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("lost", F.lit(False)).alias("lost"))
    kept = written(marks, "line-marks")
    release_shuffles(docs.sparkSession)
    return rows.select("doc_id", "line_no", "c1", "c2"), kept


def removed_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every line of every text: doc_id, line_no, removed, n_links of its class.

    Lines without words are never removed. A line is removed if an earlier one (by doc_id, then line
    number; null ids first) is equal or similar, whether that one stays or not. Rows that share an
    id count as one document. Null texts give one row with a null line_no. No documents, no rows.
    """
    lines, marks = similar_classes(docs, threshold)
    marks = marks.withColumnsRenamed({"c1": "m1", "c2": "m2"})
    found = lines.join(marks, (F.col("c1") == F.col("m1")) & (F.col("c2") == F.col("m2")), "left")
    own = F.struct("doc_id", "line_no").eqNullSafe(F.col("first"))
    return found.select("doc_id", "line_no", (F.col("m1").isNotNull() & (~own | F.col("lost"))).alias("removed"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def line_report(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per doc_id: lines, removed lines and their numbers, and links of its lines to other distinct lines."""
    lines = removed_lines(docs, threshold)
    return lines.groupBy("doc_id").agg(
        F.count("line_no").alias("n_lines"),
        F.count_if("removed").alias("n_removed"),
        F.sum("n_links").cast("long").alias("n_links"),
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.when(F.col("removed"), F.col("line_no")))), lambda x: x.cast("string"))).alias("removed"),
    )


def drop_repeated_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, with the removed lines cut from their texts (null stays null)."""
    gone = removed_lines(docs, threshold).where("removed").groupBy("doc_id").agg(F.collect_set("line_no").alias("_gone")).withColumnRenamed("doc_id", "_gone_id")
    lines = F.split(F.col("text").cast("string"), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_gone")
    kept = F.transform(stay, lambda i: F.get(lines, i))
    text = F.when(F.col("_gone").isNull(), F.col("text").cast("string")).otherwise(F.array_join(kept, "\n"))
    return docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("_gone_id")), "left").withColumn("text", text).select(*docs.columns)
