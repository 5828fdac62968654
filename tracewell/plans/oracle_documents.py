"""SQL that the queries of names and whole documents are compared with."""

from __future__ import annotations

from tracewell.functions import vocab
from tracewell.plans.document_queries import LONG
from tracewell.plans.oracle_records import _FIG, _PLURALS, _POSTS
from tracewell.plans.oracle_text import PRE, norm

_tokens = lambda c: f"unnest(list_distinct(regexp_extract_all({norm(c)}, '[a-z0-9]+')))"
#: Synonyms among the long terms, and every pair of terms that reach each other.
_CLASSES = f"""
longd AS (SELECT term FROM dict WHERE length(term) >= {LONG}),
syn AS (SELECT DISTINCT alias, name FROM (SELECT term AS alias, min(term) OVER (PARTITION BY left(term, 5)) AS name FROM longd UNION ALL SELECT term, min(term) OVER (PARTITION BY right(term, 5)) FROM longd) WHERE alias <> name),
edge AS (SELECT alias AS a, name AS b FROM syn UNION SELECT name, alias FROM syn),
reach AS (SELECT a AS node, a AS other FROM edge UNION SELECT r.node, e.b FROM reach r JOIN edge e ON r.other = e.a),
root AS (SELECT node, min(other) AS root, coalesce(min(CASE WHEN other NOT IN (SELECT alias FROM syn) THEN other END), min(other)) AS canonical FROM reach GROUP BY node)
"""
_plurals = lambda rel, k, more: f"(SELECT {more}, {k} AS spelling FROM {rel} UNION SELECT {more}, x FROM (SELECT {more}, unnest(p) AS x FROM (SELECT {more}, list_filter({_PLURALS}, lambda y: y IS NOT NULL) AS p FROM (SELECT {more}, {k} AS k FROM {rel}))))"


def _stripped(c: str) -> str:
    cases = " ".join(f"WHEN {c} LIKE '%{e}' AND length({c}) > {len(e) + 2} THEN left({c}, length({c}) - {len(e)})" for e in sorted(vocab.DERIVATIONS, key=len, reverse=True))
    return f"CASE {cases} END"


def _names(terms: str) -> str:
    verbs = ", ".join(f"('{v}')" for v in vocab.TOOL_VERBS)
    return f"""
alln AS (SELECT term, term AS name, false AS grown FROM {terms} UNION ALL SELECT term, {_stripped('term')}, false FROM {terms} WHERE {_stripped('term')} IS NOT NULL
  UNION ALL SELECT t.term, r.other, false FROM {terms} t JOIN reach r ON t.term = r.node
  UNION ALL SELECT term, CASE WHEN term LIKE '%e' THEN left(term, length(term) - 1) ELSE term END || v, true FROM {terms}, (VALUES {verbs}) AS q(v)),
names AS (SELECT term, name, bool_and(grown) AS grown FROM alln GROUP BY term, name)"""


_DOCS = f"""
{PRE}, {_CLASSES}, {_names('longd')},
nspell AS {_plurals('names', 'name', 'name')},
tspell AS {_plurals('longd', 'term', 'term')},
lspell AS {_plurals('(SELECT * FROM names WHERE NOT grown)', 'name', 'term')},
tn AS (SELECT conv_id AS owner_id, CAST(turn AS BIGINT) AS turn, role, coalesce(text, '') || CASE WHEN turn % 4 <> 2 THEN ' ' || turn ELSE '' END AS text, CAST(max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS before,
  min(turn) OVER (PARTITION BY conv_id) AS first, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
sr AS (SELECT owner_id, turn AS source_id, CASE WHEN role = 'system' THEN 'certification' ELSE role END AS of, CASE WHEN role = 'user' THEN before END AS parent_id FROM tn),
e1 AS (SELECT owner_id, of_turn, section || '[' || entry_id || ']' AS wh, section, entry_id FROM (SELECT owner_id, turn AS of_turn, CASE WHEN (owner_id * 3 + turn) % 7 = 5 THEN 'questions' ELSE 'answers' END AS section, CASE WHEN (owner_id * 3 + turn) % 7 = 3 THEN turn + 100 ELSE turn END AS entry_id FROM tn WHERE role = 'user')),
ln AS (SELECT owner_id, turn, before AS of_turn, unnest(string_split(text, '\n')) AS text, generate_subscripts(string_split(text, '\n'), 1) - 1 AS line FROM tn WHERE role = 'assistant' AND before IS NOT NULL),
b1 AS (SELECT owner_id, wh || '.bullet' || (turn * 1000 + line) AS wh, wh AS under, CASE WHEN (owner_id + turn + line) % 17 = 0 THEN ' ' WHEN (owner_id + line) % 4 = 1 THEN ln.text || ' ' || of_turn ELSE ln.text END AS text, CASE WHEN (owner_id + line) % 11 = 0 THEN CAST([] AS BIGINT[]) WHEN (turn + line) % 5 = 0 THEN [of_turn, turn - 3] ELSE [of_turn] END AS cites FROM ln JOIN e1 USING (owner_id, of_turn)),
p1 AS (SELECT owner_id, 'summary' AS wh, text FROM tn WHERE turn = last UNION ALL SELECT owner_id, 'headline', string_split(text, '\n')[1] FROM tn WHERE turn = first),
pc1 AS (SELECT DISTINCT owner_id, unnest(CASE WHEN owner_id % 9 = 0 THEN [0, 50] ELSE [0] END) AS source_id FROM tn),
c1 AS (SELECT DISTINCT owner_id, 0 AS cited FROM tn),
words AS (SELECT owner_id, wh, text FROM b1 UNION ALL SELECT owner_id, wh, text FROM p1),
st AS (SELECT DISTINCT owner_id, wh, term FROM (SELECT owner_id, wh, {_tokens('text')} AS key FROM words) JOIN tspell ON key = spelling),
sf AS (SELECT DISTINCT owner_id, wh, replace(f, ',', '') AS figure FROM (SELECT owner_id, wh, unnest(regexp_extract_all(text, '{_FIG}', 2)) AS f FROM words)),
rt AS (SELECT DISTINCT owner_id, source_id, name FROM (SELECT owner_id, turn AS source_id, {_tokens('text')} AS key FROM tn) JOIN nspell ON key = spelling),
hay AS (SELECT owner_id, turn AS source_id, replace({norm('text')}, ',', '') AS hay FROM tn),
rv AS (SELECT owner_id, source_id, round(CAST(unnest(regexp_extract_all(hay, '\\d+(?:\\.\\d+)?')) AS DOUBLE), 9) AS val FROM hay
  UNION SELECT owner_id, source_id, n FROM (SELECT owner_id, source_id, unnest(regexp_extract_all(hay, '[a-z]+')) AS w FROM hay) JOIN (VALUES {', '.join(f"('{w}', CAST({n} AS DOUBLE))" for w, n in vocab.NUMBER_WORDS.items())}) AS t(w, n) USING (w)),
rx AS (SELECT DISTINCT owner_id, source_id, unnest(regexp_extract_all(hay, '(^|[^0-9.])(\\d+)', 2)) AS txt FROM hay),
rd AS (SELECT DISTINCT rt.owner_id, name FROM rt JOIN tn ON rt.owner_id = tn.owner_id AND source_id = turn WHERE turn = first),
rs AS (SELECT DISTINCT rt.owner_id, name FROM rt JOIN tn ON rt.owner_id = tn.owner_id AND source_id = turn WHERE role = 'user'),
s1 AS (SELECT owner_id, term AS skill FROM st WHERE wh = 'summary')
"""


def _unbacked(k: str, places: str, scope: str) -> str:
    """CTEs k: violations of the claims at places by scope (owner_id, wh, source_id), which children widen."""
    return f"""
{k}w AS (SELECT DISTINCT owner_id, wh, source_id FROM {scope} SEMI JOIN sr USING (owner_id, source_id) UNION SELECT c.owner_id, c.wh, sr.source_id FROM {scope} c JOIN sr ON c.owner_id = sr.owner_id AND c.source_id = sr.parent_id),
{k}t AS (SELECT * FROM st SEMI JOIN {places} USING (owner_id, wh)),
{k}m AS (SELECT DISTINCT owner_id, wh, term FROM {k}t JOIN names USING (term) SEMI JOIN (SELECT DISTINCT owner_id, wh, name FROM {k}w JOIN rt USING (owner_id, source_id)) USING (owner_id, wh, name)
  UNION SELECT DISTINCT t.owner_id, wh, t.term FROM {k}t t JOIN lspell l ON t.term = l.term SEMI JOIN rd ON rd.owner_id = t.owner_id AND rd.name = l.spelling),
{k} AS (SELECT owner_id, wh, 'unsupported_term' AS kind, term AS subject FROM {k}t ANTI JOIN {k}m USING (owner_id, wh, term)
  UNION ALL SELECT owner_id, wh, 'unsupported_figure', figure FROM sf SEMI JOIN {places} USING (owner_id, wh)
    WHERE NOT EXISTS (SELECT 1 FROM {k}w w JOIN rv USING (owner_id, source_id) WHERE w.owner_id = sf.owner_id AND w.wh = sf.wh AND val = round(CAST(figure AS DOUBLE), 9))
      AND NOT EXISTS (SELECT 1 FROM {k}w w JOIN rx USING (owner_id, source_id) WHERE w.owner_id = sf.owner_id AND w.wh = sf.wh AND txt = figure))"""


def _gate(n: int) -> str:
    """CTE v<n>: all violations of the documents e<n>, b<n>, s<n>, c<n>, p<n>, pc<n>."""
    return f"""
ev{n} AS (SELECT DISTINCT e.owner_id, e.wh, CASE WHEN sr.of IS NULL THEN 'unknown_entry' WHEN NOT ((section = 'answers' AND sr.of = 'user') OR (section = 'questions' AND sr.of = 'certification')) THEN 'wrong_section' ELSE 'empty_entry' END AS kind, '' AS subject
  FROM e{n} e LEFT JOIN sr ON sr.owner_id = e.owner_id AND sr.source_id = e.entry_id LEFT JOIN (SELECT DISTINCT owner_id, under FROM b{n}) b ON b.owner_id = e.owner_id AND b.under = e.wh
  WHERE sr.of IS NULL OR NOT ((section = 'answers' AND sr.of = 'user') OR (section = 'questions' AND sr.of = 'certification')) OR b.under IS NULL),
rj{n} AS (SELECT DISTINCT owner_id, wh AS under FROM ev{n} WHERE kind IN ('unknown_entry', 'wrong_section')),
lb{n} AS (SELECT * FROM b{n} ANTI JOIN rj{n} USING (owner_id, under)),
lc{n} AS (SELECT DISTINCT owner_id, wh, under, unnest(cites) AS source_id FROM lb{n}),
r{n} AS (SELECT owner_id, wh, 0 AS level, 'empty_bullet' AS kind, '' AS subject FROM lb{n} WHERE trim(text) = '' UNION ALL SELECT owner_id, wh, 1, 'uncited_bullet', '' FROM lb{n} WHERE len(cites) = 0
  UNION ALL SELECT owner_id, wh, 2, 'unknown_source', CAST(source_id AS VARCHAR) FROM lc{n} ANTI JOIN sr USING (owner_id, source_id)
  UNION ALL SELECT c.owner_id, c.wh, 3, 'misattributed_bullet', CAST(c.source_id AS VARCHAR) FROM lc{n} c JOIN e{n} e ON e.owner_id = c.owner_id AND e.wh = c.under JOIN sr ON sr.owner_id = c.owner_id AND sr.source_id = c.source_id
    WHERE sr.of = 'user' AND c.source_id <> e.entry_id AND coalesce(sr.parent_id <> e.entry_id, true)),
f{n} AS (SELECT owner_id, wh, kind, subject FROM r{n} QUALIFY level = min(level) OVER (PARTITION BY owner_id, wh)),
sb{n} AS (SELECT * FROM lb{n} ANTI JOIN f{n} USING (owner_id, wh)),
bs{n} AS (SELECT owner_id, wh, unnest(cites) AS source_id FROM sb{n}),
{_unbacked(f'ub{n}', f'sb{n}', f'bs{n}')},
pp{n} AS (SELECT * FROM p{n} WHERE trim(text) <> ''),
ps{n} AS (SELECT pp.owner_id, pp.wh, x.source_id FROM pp{n} pp JOIN (SELECT owner_id, entry_id AS source_id FROM e{n} WHERE (owner_id, wh) NOT IN (SELECT (owner_id, under) FROM rj{n}) UNION SELECT owner_id, source_id FROM pc{n}) x USING (owner_id)),
{_unbacked(f'up{n}', f'pp{n}', f'ps{n}')},
us{n} AS (SELECT owner_id, skill FROM s{n} ANTI JOIN (SELECT s.owner_id, s.skill FROM s{n} s JOIN lspell l ON l.term = s.skill SEMI JOIN rs ON rs.owner_id = s.owner_id AND rs.name = l.spelling) m USING (owner_id, skill)),
v{n} AS (FROM ev{n} UNION ALL FROM f{n} UNION ALL FROM ub{n} UNION ALL FROM up{n}
  UNION ALL SELECT owner_id, 'summary', 'unknown_source', CAST(source_id AS VARCHAR) FROM pc{n} ANTI JOIN sr USING (owner_id, source_id)
  UNION ALL SELECT owner_id, 'certifications[' || cited || ']', 'unknown_certification', CAST(cited AS VARCHAR) FROM c{n} WHERE NOT EXISTS (SELECT 1 FROM sr WHERE sr.owner_id = c{n}.owner_id AND sr.source_id = cited AND sr.of = 'certification')
  UNION ALL SELECT owner_id, 'skills[named]', 'undeclared_skill', skill FROM us{n})"""


_CUT = """
b2 AS (SELECT * FROM b1 ANTI JOIN v1 USING (owner_id, wh) ANTI JOIN (SELECT owner_id, wh AS under FROM ev1) x USING (owner_id, under)),
e2 AS (SELECT * FROM e1 ANTI JOIN v1 USING (owner_id, wh) SEMI JOIN (SELECT owner_id, under AS wh FROM b2) x USING (owner_id, wh)),
s2 AS (SELECT * FROM s1 ANTI JOIN us1 USING (owner_id, skill)),
c2 AS (SELECT * FROM c1 ANTI JOIN (SELECT owner_id FROM v1 WHERE kind = 'unknown_certification') x USING (owner_id)),
p2 AS (SELECT * FROM p1 ANTI JOIN v1 USING (owner_id, wh)),
pc2 AS (SELECT * FROM pc1 ANTI JOIN (SELECT owner_id FROM v1 WHERE wh = 'summary') x USING (owner_id))"""
_KINDS = "SELECT owner_id, CAST(sum(n) AS BIGINT) AS dropped, string_agg(kind || '×' || n, ', ' ORDER BY kind) AS summary FROM (SELECT owner_id, kind, count(*) AS n FROM v1 GROUP BY owner_id, kind) GROUP BY owner_id"
_n = lambda rel, name: f"(SELECT owner_id, count(*) AS {name} FROM {rel} GROUP BY owner_id) USING (owner_id)"
_BOTH = f"WITH RECURSIVE {_DOCS}, {_gate(1)}, {_CUT}, {_gate(2)}"


def _letter(n: int) -> str:
    """CTE v<n>: the violations of letters whose paragraphs are b<n>."""
    return f"""
lc{n} AS (SELECT DISTINCT owner_id, wh, unnest(cites) AS source_id FROM b{n}),
r{n} AS (SELECT owner_id, wh, 0 AS level, 'empty_bullet' AS kind, '' AS subject FROM b{n} WHERE trim(text) = '' UNION ALL SELECT owner_id, wh, 1, 'uncited_bullet', '' FROM b{n} WHERE len(cites) = 0
  UNION ALL SELECT owner_id, wh, 2, 'unknown_source', CAST(source_id AS VARCHAR) FROM lc{n} ANTI JOIN sr USING (owner_id, source_id)),
f{n} AS (SELECT owner_id, wh, kind, subject FROM r{n} QUALIFY level = min(level) OVER (PARTITION BY owner_id, wh)),
sb{n} AS (SELECT * FROM b{n} ANTI JOIN f{n} USING (owner_id, wh)),
bs{n} AS (SELECT owner_id, wh, unnest(cites) AS source_id FROM sb{n}),
{_unbacked(f'ub{n}', f'sb{n}', f'bs{n}')},
v{n} AS (FROM f{n} UNION ALL FROM ub{n} UNION ALL SELECT DISTINCT owner_id, 'letter', 'empty_letter', '' FROM tn WHERE owner_id NOT IN (SELECT owner_id FROM b{n}))"""


#: The same rules for lines whose entries are not judged.
_ITEM = _gate(1).replace("lb1 AS (SELECT * FROM b1 ANTI JOIN rj1 USING (owner_id, under))", "lb1 AS (SELECT * FROM b1)")
_PARAGRAPHS = f"""{_POSTS},
l AS (SELECT page_id, url, title, list_filter(list_transform(string_split(text, '\n'), lambda p: trim(p, ' \t\r')), lambda p: len(regexp_extract_all(p, '\\S+')) >= {vocab.PARAGRAPH_WORDS} AND lower(trim(regexp_replace(p, '[\\x09-\\x0D\\x20]+', ' ', 'g'))) <> lower(trim(regexp_replace(title, '[\\x09-\\x0D\\x20]+', ' ', 'g')))) AS ps FROM posts),
k(page_id, url, title, ps, i, n, now) AS (SELECT page_id, url, title, ps, 1, 1, ps[1] FROM l WHERE len(ps) > 0
  UNION ALL SELECT page_id, url, title, ps, i + 1, CASE WHEN length(now) + length(ps[i + 1]) > {vocab.CHUNK_CHARS} THEN n + 1 ELSE n END, CASE WHEN length(now) + length(ps[i + 1]) > {vocab.CHUNK_CHARS} THEN ps[i + 1] ELSE now || '\n\n' || ps[i + 1] END FROM k WHERE i < len(ps)),
ck AS (SELECT page_id, url, title, n, arg_max(now, i) AS chunk FROM k GROUP BY page_id, url, title, n),
nm AS (SELECT *, trim(regexp_replace({norm("CASE WHEN trim(title) <> '' THEN title ELSE replace(trim(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/'), '/', '-') END")}, '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM ck),
sl AS (SELECT *, trim(CASE WHEN length(slug) <= 40 THEN slug WHEN contains(left(slug, 40), '-') AND substr(slug, 41, 1) <> '-' THEN regexp_replace(left(slug, 40), '-[^-]*$', '') ELSE left(slug, 40) END, '-') AS short FROM nm)"""

SQL = {
    "streamed_item_gate": f"WITH RECURSIVE {_DOCS}, {_ITEM} SELECT owner_id, wh AS \"where\", kind, subject FROM f1 UNION ALL SELECT owner_id, wh, kind, subject FROM ub1",
    "post_links": r"""WITH t AS (SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS host, unnest(regexp_extract_all(coalesce(html, ''), '(?is)<a\b[^>]*>')) AS tag, generate_subscripts(regexp_extract_all(coalesce(html, ''), '(?is)<a\b[^>]*>'), 1) - 1 AS n FROM pages),
h AS (SELECT page_id, n, host, regexp_extract(regexp_extract(tag, '(?is)\shref\s*=\s*"([^"]*)"', 1), '^[^#]*') AS href FROM t),
r AS (SELECT page_id, n, host, CASE WHEN regexp_matches(href, '^https?://') THEN href ELSE host || href END AS link FROM h WHERE href <> ''),
p AS (SELECT page_id, n, link, rtrim(regexp_extract(link, '^https?://[^/?#]*([^?#]*)', 1), '/') AS path FROM r WHERE starts_with(link, host || '/'))
SELECT page_id, CAST(min(n) AS INTEGER) AS n, link FROM p WHERE starts_with(path, '/') AND NOT regexp_matches(path, '(?i)\.(png|jpe?g|gif|svg|css|js|xml|json|pdf|ico|webp)$') AND NOT regexp_matches(path, '(?i)/(tags?|categor(y|ies)|page|author|about|archive)s?(/|$)') GROUP BY page_id, link""".replace("\\\\", "\\"),
    "synced_evidence": f"WITH RECURSIVE {_PARAGRAPHS} SELECT 'blog:' || CASE WHEN short = '' THEN 'x' ELSE short END || '#' || n AS evidence_id, sha256(coalesce(url, '') || '\n' || chunk) AS content_id, url, CAST(n AS INTEGER) AS n, length(chunk) AS n_chars FROM sl QUALIFY row_number() OVER (PARTITION BY coalesce(url, '') || '\n' || chunk ORDER BY n) = 1",
    "order_dates": """WITH o AS (SELECT o_orderkey, o_orderdate AS d, o_orderkey % 6 AS f FROM orders)
SELECT o_orderkey, CASE f WHEN 3 THEN strftime(d, '%Y') WHEN 4 THEN 'early in ' || strftime(d, '%Y') ELSE strftime(d, '%Y-%m') END AS month, CASE f WHEN 1 THEN 'month_number' WHEN 2 THEN 'iso' WHEN 3 THEN 'year' WHEN 4 THEN 'as_written' ELSE 'month_name' END AS family,
  strftime(d, '%Y-%m-%d') AS day, CASE WHEN f < 3 THEN 'mail' ELSE 'iso' END AS day_family FROM o""",
    "synonym_classes": f"WITH RECURSIVE {PRE}, {_CLASSES} SELECT node AS spelling, canonical FROM root",
    "canonical_mentions": f"""WITH RECURSIVE {PRE}, {_CLASSES}, nm AS (SELECT term AS spelling, coalesce(canonical, term) AS canonical FROM longd LEFT JOIN root ON term = node),
sp AS {_plurals('nm', 'spelling', 'canonical')}
SELECT doc_id, count(DISTINCT canonical) AS n_terms, min(canonical) AS first_term FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(norm, '[a-z0-9]+'))) AS key FROM nd) JOIN sp ON key = sp.spelling GROUP BY doc_id""",
    "claim_names": f"WITH RECURSIVE {PRE}, {_CLASSES}, {_names('dict')} SELECT term, name, grown FROM names",
    "document_violations": f"WITH RECURSIVE {_DOCS}, {_gate(1)} SELECT owner_id, wh AS \"where\", kind, subject FROM v1",
    "document_repairs": f"""{_BOTH} SELECT owner_id, coalesce(bullets, 0) AS bullets, coalesce(kept, 0) AS kept, coalesce(entries_kept, 0) AS entries_kept, coalesce(remaining, 0) AS remaining, coalesce(dropped, 0) AS dropped, coalesce(summary, '') AS summary, coalesce(remaining, 0) = 0 AND coalesce(kept, 0) >= 1 AS usable
FROM (SELECT DISTINCT owner_id FROM tn) LEFT JOIN {_n('b1', 'bullets')} LEFT JOIN {_n('b2', 'kept')} LEFT JOIN {_n('e2', 'entries_kept')} LEFT JOIN {_n('v2', 'remaining')} LEFT JOIN ({_KINDS}) USING (owner_id)""",
    "document_parts_kept": f"WITH RECURSIVE {_DOCS}, {_gate(1)}, {_CUT} SELECT owner_id, 'entry' AS part, wh AS place FROM e2 UNION ALL SELECT owner_id, 'bullet', wh FROM b2 UNION ALL SELECT owner_id, 'skill', skill FROM s2 UNION ALL SELECT owner_id, 'certificate', CAST(cited AS VARCHAR) FROM c2 UNION ALL SELECT owner_id, 'prose', wh FROM p2",
    "letter_repairs": f"""WITH RECURSIVE {_DOCS}, {_letter(1)}, b2 AS (SELECT * FROM b1 ANTI JOIN v1 USING (owner_id, wh)), {_letter(2)}
SELECT owner_id, coalesce(bullets, 0) AS bullets, coalesce(kept, 0) AS kept, coalesce(remaining, 0) AS remaining, coalesce(dropped, 0) AS dropped, coalesce(summary, '') AS summary, coalesce(remaining, 0) = 0 AND coalesce(kept, 0) >= 2 AS usable
FROM (SELECT DISTINCT owner_id FROM tn) LEFT JOIN {_n('b1', 'bullets')} LEFT JOIN {_n('b2', 'kept')} LEFT JOIN {_n('v2', 'remaining')} LEFT JOIN ({_KINDS}) USING (owner_id)""",
}
