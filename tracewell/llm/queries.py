"""The corpus operators bound to the driver's tables: one query for each, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import bpe, decontaminate, divergence, exact_dedup, language_id, line_dedup, packing, quality, resampling, secret_scan, sharding, simhash, token_files
from tracewell.llm.common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The public vocabulary file that the token operators are run with."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_report(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_report(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_report(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_report(table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), of_fit=True)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_simhash": op2_simhash,
        "op3_token_files": op3_token_files,
        "op4_sharding": op4_sharding,
        "op5_quality": op5_quality,
        "op6_language_id": op6_language_id,
        "op7_line_dedup": op7_line_dedup,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_bpe": op9_bpe,
        "op10_decontamination": op10_decontamination,
        "op11_divergence": op11_divergence,
        "op12_resampling": op12_resampling,
        "op13_packing": op13_packing,
    }


#: Words and windows as the contract states them; hit words are those inside any window's occurrence.
_OP10 = r"""
WITH ascii AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), up, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents, ascii),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), up, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark, ascii),
m AS (SELECT item_id, ws, least(10, len(ws)) AS k FROM i WHERE len(ws) > 0),
w AS (SELECT DISTINCT item_id, k, array_to_string(ws[p : p + k - 1], ' ') AS win
      FROM (SELECT item_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS p FROM m)),
ks AS (SELECT DISTINCT k FROM w),
dw AS (SELECT doc_id, k, p, array_to_string(ws[p : p + k - 1], ' ') AS win
       FROM (SELECT doc_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS p FROM d, ks WHERE len(ws) >= k)),
o AS (SELECT dw.doc_id, dw.p, w.k, w.item_id FROM dw JOIN w ON dw.k = w.k AND dw.win = w.win),
h AS (SELECT doc_id, count(DISTINCT p + j) AS n_hit FROM (SELECT doc_id, p, unnest(generate_series(0, k - 1)) AS j FROM o) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
       sha256(coalesce(n.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""


#: The checksum's table by its rule (polynomial 0xEDB88320), then byte by byte; ranks as in the operator.
_OP4 = """
WITH RECURSIVE t(n, k, v) AS (SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL SELECT n, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM t WHERE k < 8),
tab AS (SELECT list(v ORDER BY n) AS crc FROM t WHERE k = 8),
hx AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, source, length(h) // 2 + 16 AS size, list_transform(generate_series(1, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT)) AS bytes FROM hx),
d AS (SELECT doc_id, source, size, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], bytes), lambda a, x: xor(a >> 8, crc[CAST(xor(a, x) & 255 AS INTEGER) + 1])), 4294967295) AS text_crc32 FROM b, tab),
r AS (SELECT *, coalesce('=' || source, '') AS stratum, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id)) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS total FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY (rank + CAST(0.5 AS DOUBLE)) / n, stratum) - 1 AS pos FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(pos * 40 // total AS INTEGER) AS shard, pos - (pos * 40 // total * total + 39) // 40 AS slot, CAST(NULL AS INTEGER) AS grown_shard, source FROM p
"""
_OP8 = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256 FROM d JOIN g USING (norm)
"""


#: Dense: every kept term with every group of its language, zeros included.
_OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT rid, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER s + count(*) OVER s) AS p FROM f WINDOW s AS (PARTITION BY lang, source)),
ln AS (SELECT lang, term, sum(n) AS n FROM f GROUP BY ALL),
lq AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER s + count(*) OVER s) AS q FROM ln WINDOW s AS (PARTITION BY lang)),
pr AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pa AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pr.value, 0) AS value
       FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pr ON pr.lang = a.lang AND pr.source = a.source AND pr.item = b.source),
te AS (SELECT p.lang, p.source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN lq USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pa UNION ALL FROM te))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
#: crc32 byte by byte over distinct words, with the table by its rule.
_OP12 = r"""
WITH RECURSIVE t(n, k, v) AS (SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL SELECT n, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM t WHERE k < 8),
tab AS (SELECT list(v ORDER BY n) AS crc FROM t WHERE k = 8),
ascii AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), up, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents, ascii),
dw AS (SELECT doc_id, unnest(ws) AS w FROM d),
bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), up, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark, ascii),
u AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
uc AS (SELECT w, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(generate_series(1, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT))), lambda a, x: xor(a >> 8, crc[CAST(xor(a, x) & 255 AS INTEGER) + 1])), 4294967295) % 10000 AS b FROM u, tab),
s AS (SELECT b, count(*) AS n FROM dw JOIN uc USING (w) GROUP BY b),
tb AS (SELECT b, count(*) AS n FROM bw JOIN uc USING (w) GROUP BY b),
al AS (SELECT CAST(range AS BIGINT) AS b FROM range(10000)),
tot AS (SELECT CAST((SELECT count(*) FROM dw) AS DOUBLE) AS S, CAST((SELECT count(*) FROM bw) AS DOUBLE) AS T),
gain AS (SELECT al.b, CAST(floor(1000 * ln((coalesce(tb.n, 0) + 1.0::DOUBLE) * (S + 10000) / ((coalesce(s.n, 0) + 1.0::DOUBLE) * (T + 10000)))) AS BIGINT) AS gain FROM al LEFT JOIN s USING (b) LEFT JOIN tb USING (b), tot),
sums AS (SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM dw JOIN uc USING (w) JOIN gain USING (b) GROUP BY doc_id),
wt AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight, CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN sums USING (doc_id)),
sc AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM wt),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sc WHERE n_features >= 20)
SELECT sc.doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM d) // 100 THEN rank END AS rank FROM sc LEFT JOIN r USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_sharding": _OP4, "op8_exact_dedup": _OP8, "op10_decontamination": _OP10, "op11_divergence": _OP11, "op12_resampling": _OP12}
