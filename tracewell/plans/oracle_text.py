"""SQL that the text queries are compared with."""

from __future__ import annotations

from tracewell.functions import text, vocab

_quote = lambda s: "'" + s.replace("'", "''") + "'"
_STOP = ", ".join(_quote(w) for w in vocab.STOPWORDS)


def norm(column: str) -> str:
    return f"replace(lower(trim(regexp_replace(translate(coalesce({column}, ''), {_quote(text._FROM)}, {_quote(text._TO)}), '[\\x09-\\x0D\\x20]+', ' ', 'g'))), 'ß', 'ss')"


def sentences(column: str) -> str:
    return f"list_filter(list_transform(string_split_regex(regexp_replace(coalesce({column}, ''), '([.!?])[\\x09-\\x0D\\x20]+', '\\1\n', 'g'), '\n+'), lambda x: trim(x)), lambda x: x <> '')"


def content(norm_expr: str, distinct: str = "list_distinct") -> str:
    return f"{distinct}(list_filter(regexp_extract_all({norm_expr}, '[a-z][a-z''\\-]*'), lambda w: length(w) > 2 AND w NOT IN ({_STOP})))"


PRE = f"""
nd AS (SELECT doc_id, source, text, {norm('text')} AS norm FROM documents),
nb AS (SELECT item_id, text, {norm('text')} AS norm FROM benchmark),
dict AS (SELECT term FROM (SELECT item_id, unnest(list_distinct(regexp_extract_all(norm, '[a-z0-9]+'))) AS term FROM nb)
         WHERE regexp_full_match(term, '[a-z]{{4,}}') GROUP BY term HAVING count(*) * 2 <= (SELECT count(*) FROM benchmark)),
spell AS (SELECT term, term AS spelling, 'own' AS rule FROM dict
  UNION ALL SELECT term, substr(term, 1, length(term) - 3) || 'y', 'ies' FROM dict WHERE term LIKE '%ies' AND length(term) > 4
  UNION ALL SELECT term, substr(term, 1, length(term) - 2), 'drop_es' FROM dict WHERE regexp_matches(term, '(ses|xes|zes|ches|shes)$')
  UNION ALL SELECT term, substr(term, 1, length(term) - 1), 'drop_s' FROM dict WHERE term LIKE '%s' AND length(term) > 2
  UNION ALL SELECT term, term || 's', 'add_s' FROM dict
  UNION ALL SELECT term, term || 'es', 'add_es' FROM dict WHERE regexp_matches(term, '(s|x|z|ch|sh)$')),
dment AS (SELECT DISTINCT doc_id, source, term FROM (SELECT doc_id, source, unnest(list_distinct(regexp_extract_all(norm, '[a-z0-9]+'))) AS key FROM nd) JOIN spell ON key = spelling),
wanted AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(list_distinct(regexp_extract_all(norm, '[a-z0-9]+'))) AS key FROM nb) JOIN spell ON key = spelling),
present AS (SELECT DISTINCT source, term FROM dment),
wn AS (SELECT item_id, count(*) AS wanted FROM wanted GROUP BY item_id),
fit AS (SELECT item_id, source, count(*) AS matched FROM wanted JOIN present USING (term) GROUP BY item_id, source),
reqs AS (SELECT item_id, seq - 1 AS seq, {content(norm('sentence'))} AS words FROM (SELECT item_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS seq FROM (SELECT item_id, {sentences('text')} AS s FROM benchmark))),
pword AS (SELECT DISTINCT source, unnest({content('norm')}) AS word FROM nd),
met AS (SELECT item_id, seq, source, count(*) AS hits, needed, count(*) * 10 >= needed * 4 AS addressed
        FROM (SELECT item_id, seq, len(words) AS needed, unnest(words) AS word FROM reqs) JOIN pword USING (word) GROUP BY item_id, seq, source, needed),
rn AS (SELECT item_id, count(*) AS total, count(*) FILTER (WHERE len(words) = 0) AS free FROM reqs GROUP BY item_id),
qual AS (SELECT item_id, source, count(*) FILTER (WHERE addressed) + min(free) AS addressed, min(total) AS total FROM met JOIN rn USING (item_id) GROUP BY item_id, source)
"""
_TERM_MET = f"""
said AS (SELECT item_id, seq - 1 AS seq, {norm('sentence')} AS x FROM (SELECT item_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS seq FROM (SELECT item_id, {sentences('text')} AS s FROM benchmark))),
named AS (SELECT DISTINCT item_id, seq, term FROM (SELECT item_id, seq, unnest(regexp_extract_all(x, '[a-z0-9]+')) AS key FROM said) JOIN spell ON key = spelling),
tsize AS (SELECT item_id, seq, count(*) AS needed FROM named GROUP BY item_id, seq),
tmet AS (SELECT item_id, seq, source, count(*) AS hits, needed, count(*) * 2 >= needed AS addressed FROM named JOIN tsize USING (item_id, seq) JOIN present USING (term) GROUP BY item_id, seq, source, needed
  UNION ALL SELECT item_id, seq, source, hits, needed, addressed FROM met ANTI JOIN tsize USING (item_id, seq)),
tn AS (SELECT item_id, count(*) AS total, count(*) FILTER (WHERE len(words) = 0 AND (item_id, seq) NOT IN (SELECT (item_id, seq) FROM tsize)) AS free FROM reqs GROUP BY item_id)
"""

SQL = {
    "fit_matrix": f"WITH {PRE} SELECT item_id, source, matched, wanted, round(matched / wanted, 6) AS coverage FROM fit JOIN wn USING (item_id)",
    "posting_preview": f"WITH {PRE} SELECT item_id, source, covered, n_covered, wanted - n_covered AS n_missing FROM (SELECT item_id, source, string_agg(term, ' ' ORDER BY term) AS covered, CAST(count(*) AS INTEGER) AS n_covered FROM wanted JOIN present USING (term) GROUP BY item_id, source) JOIN wn USING (item_id)",
    "fit_top_sources": f"WITH {PRE} SELECT * FROM (SELECT item_id, source, matched, wanted, round(matched / wanted, 6) AS coverage, row_number() OVER (PARTITION BY item_id ORDER BY matched DESC, source) AS rank FROM fit JOIN wn USING (item_id)) WHERE rank <= 3",
    "term_mentions": f"WITH {PRE} SELECT term, count(*) AS n_docs, min(doc_id) AS first_doc FROM dment GROUP BY term",
    "spelling_variants": f"WITH {PRE} SELECT term, spelling FROM (SELECT DISTINCT term, spelling FROM spell) UNION ALL SELECT term, CASE WHEN term LIKE '%e' THEN substr(term, 1, length(term) - 1) ELSE term END || v FROM dict, (VALUES {', '.join(f'({_quote(v)})' for v in vocab.TOOL_VERBS)}) AS t(v)",
    "technical_tokens": f"""
SELECT doc_id, squashed, token FROM (SELECT doc_id, token, squashed, row_number() OVER (PARTITION BY doc_id, squashed ORDER BY pos, token) AS r FROM (
  SELECT doc_id, pos, token, regexp_replace({norm('token')}, '[^a-z0-9]+', '', 'g') AS squashed FROM (
    SELECT doc_id, pos, regexp_replace(trim(raw, '.,;:'), '''s$', '') AS token FROM (SELECT doc_id, unnest(t) AS raw, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_quote(vocab.TOKEN)}) AS t FROM documents)))
  WHERE token <> '' AND token NOT IN ({', '.join(_quote(w) for w in vocab.NOT_A_TOOL)}) AND regexp_matches(token, {_quote(vocab.TECHNICAL)}))) WHERE r = 1""",
    "gap_classes": f"""WITH {PRE}, firsts AS (SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source),
draft AS (SELECT source, term FROM dment JOIN firsts USING (source, doc_id)),
rec AS (SELECT source, term, min(doc_id) AS found_in FROM dment GROUP BY source, term)
SELECT item_id, source, term, found_in FROM wanted JOIN rec USING (term) WHERE NOT EXISTS (SELECT 1 FROM draft WHERE draft.source = rec.source AND draft.term = rec.term)""",
    "requirement_addressed": f"WITH {PRE} SELECT item_id, CAST(seq AS INTEGER) AS seq, source, hits, needed, addressed FROM met",
    "qualification_score": f"WITH {PRE} SELECT item_id, source, addressed, total, round(addressed / total, 6) AS score FROM qual",
    "requirement_met": f"WITH {PRE}, {_TERM_MET} SELECT item_id, CAST(seq AS INTEGER) AS seq, source, hits, needed, addressed FROM tmet",
    "requirement_score": f"WITH {PRE}, {_TERM_MET} SELECT item_id, source, count(*) FILTER (WHERE addressed) + min(free) AS addressed, min(total) AS total, round((count(*) FILTER (WHERE addressed) + min(free)) / min(total), 6) AS score FROM tmet JOIN tn USING (item_id) GROUP BY item_id, source",
    "total_score": f"""WITH {PRE} SELECT fit.item_id, fit.source, round(40.0 * round(matched / wanted, 6) + 15.0 * coalesce(round(qual.addressed / total, 6), 0) + 15.0 * coalesce(round(CAST(hits AS DOUBLE) / needed, 6), 0) + 20.0 * round(matched / wanted, 6) + 10.0, 1) AS total
FROM fit JOIN wn USING (item_id) LEFT JOIN qual USING (item_id, source) LEFT JOIN (SELECT * FROM met WHERE seq = 0) t USING (item_id, source)""",
    "draft_components": f"""WITH {PRE}, d AS (SELECT doc_id, norm, text, doc_id % (SELECT count(*) FROM benchmark) AS item_id, {content('norm')} AS have FROM nd),
p AS (SELECT item_id, {content(norm('title'))} AS want, (['', {', '.join(_quote(x) for x in vocab.SENIORITY)}])[item_id % 7 + 1] AS level FROM (SELECT item_id, {sentences('text')}[1] AS title FROM benchmark)),
t AS (SELECT doc_id, item_id, level, coalesce(list_sort(list_filter(want, lambda w: NOT list_contains(have, w))), []) AS lost, coalesce(len(want), 0) AS n,
  CASE level {' '.join(f'WHEN {_quote(x)} THEN regexp_matches(norm, {_quote(r)})' for x, r in vocab.SENIORITY.items())} END AS shown FROM d JOIN p USING (item_id)),
o AS (SELECT *, CASE WHEN n > 0 THEN (n - len(lost)) / n ELSE 1.0 END AS overlap FROM t),
k AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(norm, '[a-z0-9]+')) AS term FROM nd) JOIN dict USING (term) GROUP BY doc_id, term),
h AS (SELECT d.doc_id, count(*) AS hits, count(*) FILTER (WHERE k.n > greatest(3, CAST(round_even(greatest(1, len(string_split(coalesce(d.text, ''), '
'))) * 0.4, 0) AS INTEGER))) AS stuffed
  FROM d JOIN k USING (doc_id) JOIN wanted w ON w.item_id = d.item_id AND w.term = k.term GROUP BY d.doc_id),
f AS (SELECT doc_id, round((3 - CAST(regexp_matches(coalesce(text, ''), {_quote(vocab.LIGATURES)}) AS INTEGER) - CAST(regexp_matches(coalesce(text, ''), {_quote(vocab.PRIVATE_USE)}) AS INTEGER) - CAST(regexp_matches(coalesce(text, ''), {_quote(vocab.SPACED_OUT)}) AS INTEGER)) / 3, 6) AS format FROM documents)
SELECT o.doc_id, o.item_id, round(overlap, 6) AS overlap, round(CASE WHEN level = '' THEN overlap ELSE overlap * 0.5 + CAST(shown AS DOUBLE) * 0.5 END, 6) AS title_fit, array_to_string(lost, ' ') AS missing_title,
  round(CASE WHEN wanted IS NULL THEN 1.0 ELSE coalesce(hits, 0) / wanted * (1 - least(0.5, 0.1 * coalesce(stuffed, 0))) END, 6) AS in_context, format
FROM o JOIN f USING (doc_id) LEFT JOIN wn USING (item_id) LEFT JOIN h USING (doc_id)""",
    "unreachable_terms": f"WITH {PRE} SELECT item_id, count(*) AS wanted, count(*) FILTER (WHERE term NOT IN (SELECT term FROM present)) AS nowhere FROM wanted GROUP BY item_id",
    "keyword_stuffing": f"""WITH {PRE}, n AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(norm, '[a-z0-9]+')) AS term FROM nd) JOIN dict USING (term) GROUP BY doc_id, term),
b AS (SELECT doc_id, greatest(1, len(string_split(coalesce(text, ''), '\n'))) AS bullets FROM documents)
SELECT doc_id, count(*) FILTER (WHERE n > greatest(3, CAST(round_even(bullets * 0.4, 0) AS INTEGER))) AS stuffed, round(least(0.5, 0.1 * count(*) FILTER (WHERE n > greatest(3, CAST(round_even(bullets * 0.4, 0) AS INTEGER)))), 6) AS penalty
FROM n JOIN b USING (doc_id) GROUP BY doc_id""",
    "normalized_text": f"SELECT doc_id, md5(norm) AS norm_md5, length(norm) AS n_chars, md5(regexp_replace(norm, '[^a-z0-9]+', '', 'g')) AS squash_md5 FROM (SELECT doc_id, {norm('text')} AS norm FROM documents)",
    "content_words": f"SELECT doc_id, len(regexp_extract_all(norm, '[a-z][a-z''\\-]*')) AS n_words, len({content('norm')}) AS n_content FROM (SELECT doc_id, {norm('text')} AS norm FROM documents)",
    "sentences": f"SELECT doc_id, len(s) AS n_sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS longest, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, {sentences('text')} AS s FROM documents)",
    "figures": r"SELECT doc_id, len(f) AS n_figures, array_to_string(list_transform(f, lambda x: replace(x, ',', '')), ' ') AS figures FROM (SELECT doc_id, regexp_extract_all(text, '(^|[^A-Za-z0-9.])\$?(\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?)', 2) AS f FROM documents) WHERE len(f) > 0",
    "figure_support": f"""WITH c AS (SELECT DISTINCT doc_id, source, replace(f, ',', '') AS figure FROM (SELECT doc_id, source, unnest(regexp_extract_all(text, '(^|[^A-Za-z0-9.])\\$?(\\d{{1,3}}(?:,\\d{{3}})+|\\d+(?:\\.\\d+)?)', 2)) AS f FROM documents)),
h AS (SELECT doc_id, source, replace({norm('text')}, ',', '') AS hay FROM documents),
v AS (SELECT DISTINCT doc_id, source, round(CAST(unnest(regexp_extract_all(hay, '\\d+(?:\\.\\d+)?')) AS DOUBLE), 9) AS val FROM h
      UNION SELECT doc_id, source, n FROM (SELECT doc_id, source, unnest(regexp_extract_all(hay, '[a-z]+')) AS w FROM h) JOIN (VALUES {', '.join(f"('{w}', CAST({n} AS DOUBLE))" for w, n in vocab.NUMBER_WORDS.items())}) AS t(w, n) USING (w)),
x AS (SELECT DISTINCT doc_id, source, unnest(regexp_extract_all(hay, '(^|[^0-9.])(\\d+)', 2)) AS txt FROM h)
SELECT doc_id, count(*) AS figures, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM v WHERE v.source = c.source AND v.doc_id <> c.doc_id AND v.val = round(CAST(figure AS DOUBLE), 9))
   OR EXISTS (SELECT 1 FROM x WHERE x.source = c.source AND x.doc_id <> c.doc_id AND x.txt = figure)) AS supported FROM c GROUP BY doc_id""",
}
