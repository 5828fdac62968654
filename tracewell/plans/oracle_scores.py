"""SQL that the draft scores are compared with."""

from __future__ import annotations

from tracewell.functions import vocab
from tracewell.operators.scores import LISTS
from tracewell.plans.oracle_text import _TERM_MET, PRE, _quote, content, norm, sentences
from tracewell.plans.score_queries import NOTE_TARGET

_SHOWN = lambda c: "CASE level " + " ".join(f"WHEN {_quote(x)} THEN regexp_matches({c}, {_quote(r)})" for x, r in vocab.SENIORITY.items()) + " END"
_ADDRESSED = "CASE WHEN t.needed IS NOT NULL THEN coalesce(mt.hits, 0) * 2 >= t.needed ELSE len(q.words) = 0 OR coalesce(mw.hits, 0) * 10 >= len(q.words) * 4 END"
_TOTAL = lambda *shares: "round_even(round(" + " + ".join(f"{w * 100} * {s}" for w, s in zip(vocab.WEIGHTS.values(), shares)) + ", 9), 1)"
_DRAFTS = f"""WITH {PRE}, {_TERM_MET},
d AS (SELECT doc_id, source, text, doc_id % (SELECT count(*) FROM benchmark) AS item_id, {norm("concat_ws(chr(10), text, source)")} AS hay, {norm(f"{sentences('text')}[1]")} AS head FROM documents),
p AS (SELECT item_id, coalesce({content(norm('title'))}, []) AS want, (['', {', '.join(_quote(x) for x in vocab.SENIORITY)}])[item_id % 7 + 1] AS level FROM (SELECT item_id, {sentences('text')}[1] AS title FROM benchmark)),
asked AS (SELECT item_id, term, length(term) <= 8 AS hard, length(term) >= 6 AS keyword FROM wanted),
asize AS (SELECT item_id, count(*) AS n, count(*) FILTER (WHERE hard) AS n_hard, count(*) FILTER (WHERE keyword) AS n_keyword FROM asked GROUP BY item_id),
hment AS (SELECT DISTINCT doc_id, source, term FROM (SELECT doc_id, source, unnest(list_distinct(regexp_extract_all(hay, '[a-z0-9]+'))) AS key FROM d) JOIN spell ON key = spelling),
hword AS (SELECT DISTINCT doc_id, source, unnest({content('hay')}) AS word FROM d),
asks AS (SELECT item_id, seq, words, sentence FROM reqs JOIN (SELECT item_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS seq FROM (SELECT item_id, {sentences('text')} AS s FROM benchmark)) USING (item_id, seq) WHERE seq > 0),
qword AS (SELECT item_id, seq, unnest(words) AS word FROM asks ANTI JOIN tsize USING (item_id, seq))"""


def _judged(pairs: str, key: str) -> str:
    """The requirements of (key, item_id) pairs, judged."""
    return f"""
mt AS (SELECT {key}, item_id, seq, count(*) AS hits FROM {pairs} JOIN named USING (item_id) JOIN (SELECT DISTINCT {key}, term FROM hment) USING ({key}, term) GROUP BY ALL),
mw AS (SELECT {key}, item_id, seq, count(*) AS hits FROM {pairs} JOIN qword USING (item_id) JOIN (SELECT DISTINCT {key}, word FROM hword) USING ({key}, word) GROUP BY ALL),
judged AS (SELECT {key}, item_id, seq, sentence, {_ADDRESSED} AS addressed FROM {pairs} JOIN asks q USING (item_id) LEFT JOIN tsize t USING (item_id, seq) LEFT JOIN mt USING ({key}, item_id, seq) LEFT JOIN mw USING ({key}, item_id, seq)),
dmet AS (SELECT {key}, item_id, count(*) FILTER (WHERE addressed) / count(*) AS qualifications FROM judged GROUP BY ALL)"""


_SCORED = f"""{_DRAFTS},
{_judged('d', 'doc_id')},
hits AS (SELECT d.doc_id, count(*) FILTER (WHERE hard) AS hard, count(*) FILTER (WHERE keyword AND r.doc_id IS NOT NULL) AS used
  FROM d JOIN asked a USING (item_id) JOIN hment h ON h.doc_id = d.doc_id AND h.term = a.term LEFT JOIN dment r ON r.doc_id = d.doc_id AND r.term = a.term GROUP BY d.doc_id),
stuffed AS (SELECT doc_id, term FROM (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(norm, '[a-z0-9]+')) AS term FROM nd) GROUP BY doc_id, term)
  JOIN d USING (doc_id) JOIN asked USING (item_id, term) WHERE keyword AND n > greatest(3, CAST(round_even(len(string_split(coalesce(text, ''), chr(10))) * 0.4, 0) AS INTEGER))),
penalty AS (SELECT doc_id, least(0.5, 0.1 * count(*)) AS penalty FROM stuffed GROUP BY doc_id),
shape AS (SELECT doc_id, (3 - CAST(regexp_matches(coalesce(text, ''), {_quote(vocab.LIGATURES)}) AS INTEGER) - CAST(regexp_matches(coalesce(text, ''), {_quote(vocab.PRIVATE_USE)}) AS INTEGER) - CAST(regexp_matches(coalesce(text, ''), {_quote(vocab.SPACED_OUT)}) AS INTEGER)) / 3 AS format FROM documents),
title AS (SELECT doc_id, item_id, list_filter(want, lambda w: NOT list_contains(have, w)) AS lost, len(want) AS n, level, {_SHOWN('head')} AS shown FROM (SELECT *, {content('head')} AS have FROM d) JOIN p USING (item_id)),
titled AS (SELECT doc_id, CASE WHEN level = '' THEN overlap ELSE overlap * 0.5 + CAST(shown AS DOUBLE) * 0.5 END AS title_fit FROM (SELECT *, CASE WHEN n > 0 THEN (n - len(lost)) / n ELSE 1.0 END AS overlap FROM title)),
parts AS (SELECT doc_id, item_id, CASE WHEN coalesce(n_hard, 0) = 0 THEN 1.0 ELSE coalesce(hard, 0) / n_hard END AS hard_skills, coalesce(qualifications, 1.0) AS qualifications, title_fit,
  CASE WHEN coalesce(n_keyword, 0) = 0 THEN 1.0 ELSE coalesce(used, 0) / n_keyword END * (1 - coalesce(penalty, 0)) AS keywords_in_context, format
  FROM d JOIN titled USING (doc_id) JOIN shape USING (doc_id) LEFT JOIN asize USING (item_id) LEFT JOIN hits USING (doc_id) LEFT JOIN dmet USING (doc_id, item_id) LEFT JOIN penalty USING (doc_id)),
lack AS (SELECT d.doc_id, d.item_id, a.term, found_in FROM d JOIN asked a USING (item_id) ANTI JOIN hment h ON h.doc_id = d.doc_id AND h.term = a.term LEFT JOIN (SELECT source, term, min(doc_id) AS found_in FROM hment WHERE source IS NOT NULL GROUP BY source, term) r ON r.source = d.source AND r.term = a.term)
"""
_ROUNDED = ", ".join(f"round({name}, 6) AS {name}" for name in vocab.WEIGHTS)
_LONGEST = " ".join(f"WHEN '{name}' THEN {most}" for name, most in LISTS.items() if most)

SQL = {
    "draft_scores": f"{_SCORED} SELECT doc_id, item_id, {_ROUNDED}, {_TOTAL(*vocab.WEIGHTS)} AS total FROM parts",
    "draft_gaps": f"{_SCORED} SELECT doc_id, item_id, term, found_in IS NOT NULL AS in_record, found_in FROM lack",
    "draft_feedback": f"""{_SCORED}, lists AS (
  SELECT doc_id, CASE WHEN found_in IS NULL THEN 'absent' ELSE 'unsurfaced' END AS list, term AS entry, 0 AS place FROM lack
  UNION ALL SELECT doc_id, 'title_words', unnest(lost), 0 FROM title
  UNION ALL SELECT doc_id, 'unaddressed', sentence, seq FROM judged WHERE NOT addressed
  UNION ALL SELECT doc_id, 'stuffed', term, 0 FROM stuffed)
SELECT doc_id, list, CAST(rank AS INTEGER) AS rank, entry FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, list ORDER BY place, entry) AS rank FROM lists) WHERE rank <= CASE list {_LONGEST} ELSE rank END""",
}
_MORE = f"""{_DRAFTS},
pair AS (SELECT DISTINCT item_id, source FROM d WHERE source IS NOT NULL),
{_judged('pair', 'source')},
had AS (SELECT DISTINCT source, term FROM hment),
hits AS (SELECT source, item_id, count(*) AS n_found, count(*) FILTER (WHERE hard) AS hard, count(*) FILTER (WHERE keyword) AS used FROM pair JOIN asked USING (item_id) JOIN had USING (source, term) GROUP BY ALL),
levels AS (SELECT DISTINCT source, level FROM (SELECT source, head, unnest([{', '.join(_quote(x) for x in vocab.SENIORITY)}]) AS level FROM d) WHERE {_SHOWN('head')}),
parts AS (SELECT item_id, source, CASE WHEN coalesce(n_hard, 0) = 0 THEN 1.0 ELSE coalesce(hard, 0) / n_hard END AS hard_skills, coalesce(qualifications, 1.0) AS qualifications,
  CASE WHEN p.level = '' THEN 1.0 WHEN l.level IS NULL THEN 0.5 ELSE 1.0 END AS title_fit, CASE WHEN coalesce(n_keyword, 0) = 0 THEN 1.0 ELSE coalesce(used, 0) / n_keyword END AS keywords_in_context, 1.0 AS format,
  coalesce(n, 0) - coalesce(n_found, 0) AS unreachable
  FROM pair JOIN p USING (item_id) LEFT JOIN levels l USING (source, level) LEFT JOIN asize USING (item_id) LEFT JOIN hits USING (source, item_id) LEFT JOIN dmet USING (source, item_id))
"""
SQL["draft_ceilings"] = f"{_MORE} SELECT item_id, source, {_ROUNDED}, {_TOTAL(*vocab.WEIGHTS)} AS ceiling, unreachable FROM parts"
_ROWS = " UNION ALL ".join(f"SELECT doc_id, item_id, '{name}' AS component, CAST({w} AS DOUBLE) AS weight, {name} AS share, round({name} * {w * 100}, 4) AS points FROM scored" for name, w in vocab.WEIGHTS.items())
SQL["score_breakdown"] = f"WITH scored AS ({SQL['draft_scores']}) {_ROWS}"
SQL["score_notes"] = f"""SELECT s.doc_id, s.item_id, total, ceiling, CASE WHEN ceiling < {NOTE_TARGET} THEN 'out_of_reach' WHEN total >= {NOTE_TARGET} THEN 'reached' WHEN ceiling >= {NOTE_TARGET} THEN 'tailoring' END AS note
FROM ({SQL['draft_scores']}) s JOIN (SELECT doc_id, source FROM documents) d ON d.doc_id = s.doc_id LEFT JOIN ({SQL['draft_ceilings']}) c ON c.item_id = s.item_id AND c.source = d.source"""
SQL["document_texts"] = f"""SELECT doc_id, md5(all_of) AS searchable_md5, md5(coalesce(text, '')) AS running_md5, len(regexp_extract_all(all_of, '[^\\x09-\\x0D\\x20]+')) AS n_words, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda b: trim(b) <> '')) AS n_bullets
FROM (SELECT doc_id, text, concat_ws(chr(10), {sentences('text')}[1], coalesce(text, ''), coalesce(source, '')) AS all_of FROM documents)"""
