"""SQL that the gate, rubric, page and run queries are compared with."""

from __future__ import annotations

from tracewell.functions import vocab
from tracewell.plans.oracle_text import PRE, _quote, content, norm, sentences

_ITEMS = """
turns AS (SELECT conv_id, turn, role, text, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cite FROM conversations),
items AS (SELECT conv_id AS owner_id, turn AS item_id, text, CAST(cite AS BIGINT) AS cite FROM turns WHERE role = 'assistant'),
src AS (SELECT conv_id AS owner_id, CAST(turn AS BIGINT) AS source_id, role AS kind, text FROM conversations)
"""
_GATE = f"""
{PRE}, {_ITEMS},
claimed AS (SELECT DISTINCT owner_id, item_id, term FROM (SELECT owner_id, item_id, unnest(list_distinct(regexp_extract_all({norm('text')}, '[a-z0-9]+'))) AS key FROM items) JOIN spell ON key = spelling),
backed AS (SELECT DISTINCT owner_id, item_id, term FROM (SELECT i.owner_id, i.item_id, unnest(list_distinct(regexp_extract_all({norm('s.text')}, '[a-z0-9]+'))) AS key FROM items i JOIN src s ON i.owner_id = s.owner_id AND i.cite = s.source_id) JOIN spell ON key = spelling),
bad AS (SELECT owner_id, item_id, term FROM claimed ANTI JOIN backed USING (owner_id, item_id, term))
"""
_STRIP = lambda c: f"trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace({c}, '(?is)<(script|style)\\b.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '(?i)<br */?>|</(p|div|li|h[1-6]|ul|ol|tr)>', '\n', 'g'), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[\\x09\\x0B-\\x0D\\x20]+', ' ', 'g'), ' ?\n[ \n]*', '\n', 'g'), ' \n')"
_POSTS = f"""
raw AS (SELECT page_id, url, coalesce(html, '') AS html, regexp_extract(coalesce(html, ''), '(?is)<article\\b[^>]*>(.*)</article>', 1) AS body, regexp_extract(coalesce(html, ''), '(?is)<main\\b[^>]*>(.*)</main>', 1) AS main,
  regexp_extract(coalesce(html, ''), '(?is)<h1\\b[^>]*>(.*?)</h1>', 1) AS h1, regexp_extract(coalesce(html, ''), '(?is)<title\\b[^>]*>(.*?)</title>', 1) AS title,
  regexp_extract(coalesce(html, ''), '(?is)<time\\b[^>]*datetime="([0-9]{{4}}-[0-9]{{2}}(-[0-9]{{2}})?)', 1) AS tag, regexp_extract(coalesce(html, ''), '(?is)published_time"[^>]*content="([0-9]{{4}}-[0-9]{{2}}(-[0-9]{{2}})?)', 1) AS meta,
  replace(regexp_extract(url, '/([0-9]{{4}}/[0-9]{{2}}(/[0-9]{{2}})?)/', 1), '/', '-') AS udate FROM pages),
posts AS (SELECT page_id, url, {_STRIP("coalesce(nullif(h1, ''), title)")} AS title, coalesce(nullif(meta, ''), nullif(tag, ''), udate) AS date, {_STRIP("coalesce(nullif(body, ''), nullif(main, ''), html)")} AS text FROM raw)
"""
_CHECKS = lambda ids, checks: " UNION ALL ".join(f"SELECT {ids}, '{k}' AS name, {v} AS ok FROM base" for k, v in checks.items())
_anyof = lambda phrases: "(" + " OR ".join(f"contains(norm, {_quote(p)})" for p in phrases) + ")"
_FIG = r"(^|[^A-Za-z0-9.])\$?(\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?)"
_BULLETS = f"""
line AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, '\n')) AS line FROM documents) WHERE trim(line) <> ''),
base AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE length(line) > {vocab.MAX_BULLET_CHARS}) AS long, count(*) FILTER (WHERE len(regexp_extract_all(line, '{_FIG}', 2)) > 0) AS quantified,
  count(*) FILTER (WHERE regexp_matches(lower(line), {_quote(vocab.WEAK_OPENERS)})) AS weak, count(*) FILTER (WHERE regexp_matches(lower(line), {_quote(vocab.FIRST_PERSON)})) AS personal FROM line GROUP BY doc_id),
checks AS ({_CHECKS('doc_id', {'short': 'long = 0', 'quantified': f'quantified >= n * CAST({vocab.MIN_QUANTIFIED} AS DOUBLE)', 'openers': 'weak = 0', 'impersonal': 'personal = 0'})})
"""
_ATTEMPTS = """
a0 AS (SELECT o_custkey AS run_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS attempt, round(o_totalprice / 6000, 1) AS total, o_orderstatus <> 'P' AS parses, o_orderstatus = 'F' AS grounded, starts_with(o_orderpriority, '1') AS repaired FROM orders),
a AS (SELECT *, max(total) OVER (PARTITION BY run_id) + 5 AS ceiling FROM a0)
"""
_REASONS = f"""{_ATTEMPTS}, r AS (SELECT *, CASE WHEN parses THEN CASE WHEN total >= {vocab.TARGET} THEN 'threshold' WHEN total >= ceiling - {vocab.SLACK} THEN 'ceiling' WHEN total - best < {vocab.MIN_GAIN} THEN 'plateau' END END AS reason
FROM (SELECT *, max(total) OVER (PARTITION BY run_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM a))"""
_EVENTS = "e AS (SELECT user_id AS run_id, coalesce(try_cast(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS INTEGER), 0) % 4 AS attempt, event_id AS seq, event_type AS stage, ts AS tm, value AS score FROM events)"
_FULL = """ev0 AS (SELECT *, coalesce(try_cast(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER), 0) AS k FROM events),
ev AS (SELECT CAST(user_id AS BIGINT) AS run_id, CASE k % 3 WHEN 1 THEN 'cover_letter' ELSE 'resume' END AS document, CASE WHEN k % 5 <> 4 THEN CAST(event_id % 4 + 4 * (day(ts) % 8) AS INTEGER) END AS attempt, CASE WHEN k % 2 = 0 THEN 32 END AS attempts,
  CAST(event_id AS BIGINT) AS seq, ts AS tm, CASE event_type WHEN 'click' THEN 'drafting' WHEN 'view' THEN 'verifying' WHEN 'purchase' THEN 'scored' WHEN 'error' THEN 'rejected' WHEN 'signup' THEN 'repaired' END AS stage,
  CASE WHEN event_type = 'purchase' THEN value END AS score, CASE WHEN event_type = 'view' THEN k > 50 END AS parses, CASE WHEN event_type = 'view' THEN k % 4 END AS pages, CASE WHEN event_type = 'click' THEN k * 10 END AS words,
  CASE WHEN event_type = 'signup' AND k % 7 > 0 THEN k % 7 END AS dropped, CASE WHEN event_type IN ('signup', 'error') AND k > 10 THEN event_type || '×' || k END AS reason FROM ev0),
fo AS (SELECT run_id, document, attempt, coalesce(arg_min_null(attempts, seq), attempt) AS attempts, min(seq) AS first_seq, count(*) AS events, max(tm) AS last_tm, arg_max(stage, seq) AS stage,
  arg_max(score, seq) FILTER (WHERE score IS NOT NULL) AS score, arg_max(parses, seq) FILTER (WHERE parses IS NOT NULL) AS parses, arg_max(pages, seq) FILTER (WHERE pages IS NOT NULL) AS pages, arg_max(words, seq) FILTER (WHERE words IS NOT NULL) AS words,
  bool_or(stage = 'repaired') AS repaired, coalesce(arg_max(coalesce(dropped, 0), seq) FILTER (WHERE stage = 'repaired'), 0) AS dropped, coalesce(arg_max(coalesce(reason, ''), seq) FILTER (WHERE stage IN ('repaired', 'rejected')), '') AS reason,
  coalesce(CASE arg_max(stage, seq) FILTER (WHERE stage IN ('rejected', 'scored')) WHEN 'rejected' THEN 'rejected' WHEN 'scored' THEN 'finished' END, 'open') AS outcome FROM ev WHERE attempt IS NOT NULL GROUP BY run_id, document, attempt)"""
_FOLD = "run_id, document, attempt, attempts, first_seq, events, strftime(last_tm, '%Y-%m-%d %H:%M:%S.%f') AS last_at, stage, score, parses, pages, words, repaired, dropped, reason, outcome"
_SLUG = f"trim(regexp_replace({norm('p_name')}, '[^a-z0-9]+', '-', 'g'), '-')"
_MONTH = lambda d: f"monthname({d}) || ' ' || strftime({d}, '%Y')"

_RULES = f"""{_GATE},
fc AS (SELECT DISTINCT owner_id, item_id, replace(f, ',', '') AS figure FROM (SELECT owner_id, item_id, unnest(regexp_extract_all(text, '{_FIG}', 2)) AS f FROM items)),
c AS (SELECT DISTINCT owner_id, item_id, unnest(list_concat([cite], list_concat(CASE WHEN (owner_id + item_id) % 5 = 0 THEN [CAST(item_id AS BIGINT) - 3] ELSE [] END, CASE WHEN (owner_id + item_id) % 3 = 0 THEN [CAST(item_id AS BIGINT)] ELSE [] END))) AS source_id FROM items WHERE cite IS NOT NULL),
cbad AS (SELECT owner_id, item_id, term FROM claimed ANTI JOIN (SELECT DISTINCT owner_id, item_id, term FROM (SELECT owner_id, item_id, unnest(list_distinct(regexp_extract_all({norm('s.text')}, '[a-z0-9]+'))) AS key FROM c JOIN src s USING (owner_id, source_id)) JOIN spell ON key = spelling) USING (owner_id, item_id, term)),
fh AS (SELECT owner_id, item_id, replace({norm('s.text')}, ',', '') AS hay FROM c JOIN src s USING (owner_id, source_id)),
fv AS (SELECT owner_id, item_id, round(CAST(unnest(regexp_extract_all(hay, '\\d+(?:\\.\\d+)?')) AS DOUBLE), 9) AS val FROM fh
  UNION SELECT owner_id, item_id, n FROM (SELECT owner_id, item_id, unnest(regexp_extract_all(hay, '[a-z]+')) AS w FROM fh) JOIN (VALUES {', '.join(f"('{w}', CAST({n} AS DOUBLE))" for w, n in vocab.NUMBER_WORDS.items())}) AS t(w, n) USING (w)),
fx AS (SELECT DISTINCT owner_id, item_id, unnest(regexp_extract_all(hay, '(^|[^0-9.])(\\d+)', 2)) AS txt FROM fh),
v AS (SELECT owner_id, item_id, 0 AS level, 'empty' AS kind, '' AS subject FROM items WHERE trim(coalesce(text, '')) = ''
  UNION ALL SELECT owner_id, item_id, 1, 'uncited', '' FROM items WHERE cite IS NULL
  UNION ALL SELECT owner_id, item_id, 2, 'unknown_citation', CAST(source_id AS VARCHAR) FROM c ANTI JOIN src USING (owner_id, source_id)
  UNION ALL SELECT owner_id, item_id, 3, 'misattributed', CAST(source_id AS VARCHAR) FROM c JOIN src USING (owner_id, source_id) WHERE kind = 'user' AND source_id <> item_id - 1
  UNION ALL SELECT owner_id, item_id, 4, 'unsupported_term', term FROM cbad
  UNION ALL SELECT owner_id, item_id, 4, 'unsupported_figure', figure FROM fc
    WHERE NOT EXISTS (SELECT 1 FROM fv WHERE fv.owner_id = fc.owner_id AND fv.item_id = fc.item_id AND fv.val = round(CAST(figure AS DOUBLE), 9))
      AND NOT EXISTS (SELECT 1 FROM fx WHERE fx.owner_id = fc.owner_id AND fx.item_id = fc.item_id AND fx.txt = figure)),
g AS (SELECT * FROM v QUALIFY level = min(level) OVER (PARTITION BY owner_id, item_id))"""
#: What the gate of letters and of profile copy share: no misattribution; a letter may name the terms of the first turn.
_OPENING = f"""op AS (SELECT DISTINCT owner_id, term FROM (SELECT conv_id AS owner_id, unnest(list_distinct(regexp_extract_all({norm('text')}, '[a-z0-9]+'))) AS key FROM conversations QUALIFY turn = min(turn) OVER (PARTITION BY conv_id)) JOIN spell ON key = spelling),
lv AS (SELECT * FROM v WHERE kind <> 'misattributed' AND NOT (kind = 'unsupported_term' AND EXISTS (SELECT 1 FROM op WHERE op.owner_id = v.owner_id AND op.term = v.subject))),
lg AS (SELECT * FROM lv QUALIFY level = min(level) OVER (PARTITION BY owner_id, item_id))"""
_PLURALS = "[k, k || 's', CASE WHEN k LIKE '%ies' AND length(k) > 4 THEN left(k, length(k) - 3) || 'y' END, CASE WHEN regexp_matches(k, '(ses|xes|zes|ches|shes)$') THEN left(k, length(k) - 2) END, CASE WHEN k LIKE '%s' AND length(k) > 2 THEN left(k, length(k) - 1) END, CASE WHEN regexp_matches(k, '(s|x|z|ch|sh)$') THEN k || 'es' END]"

SQL = {
    "attempt_folds": f"WITH {_FULL} SELECT {_FOLD} FROM fo",
    "run_milestones": f"WITH {_FULL} SELECT run_id, seq, stage, score FROM ev WHERE attempt IS NULL",
    "closed_attempts": f"WITH {_FULL} SELECT {_FOLD} FROM fo WHERE epoch_ms(last_tm) + 86400000 < (SELECT epoch_ms(max(tm)) FROM ev WHERE attempt IS NOT NULL) - 3600000",
    "gate_violations": f"WITH {_RULES} SELECT owner_id, item_id, level, kind, subject FROM g",
    "gate_kinds": f"WITH {_RULES}, k AS (SELECT owner_id, kind, count(*) AS n FROM g GROUP BY owner_id, kind) SELECT owner_id, CAST(sum(n) AS BIGINT) AS violations, string_agg(kind || '×' || n, ', ' ORDER BY kind) AS summary FROM k GROUP BY owner_id",
    "regated_documents": f"WITH {_RULES}, k AS (SELECT owner_id, count(*) AS kept, CAST(sum((SELECT count(*) FROM v WHERE v.owner_id = s.owner_id AND v.item_id = s.item_id)) AS BIGINT) AS remaining FROM items s ANTI JOIN g USING (owner_id, item_id) GROUP BY owner_id) SELECT owner_id, items, coalesce(kept, 0) AS kept, coalesce(remaining, 0) AS remaining, coalesce(remaining, 0) = 0 AND coalesce(kept, 0) >= 1 AS usable FROM (SELECT owner_id, count(*) AS items FROM items GROUP BY owner_id) LEFT JOIN k USING (owner_id)",
    "letter_violations": f"WITH {_RULES}, {_OPENING} SELECT owner_id, item_id, level, kind, subject FROM lg UNION ALL SELECT DISTINCT conv_id, NULL, 0, 'empty_letter', '' FROM conversations WHERE conv_id NOT IN (SELECT owner_id FROM items)",
    "repaired_letters": f"WITH {_RULES}, {_OPENING}, k AS (SELECT owner_id, item_id, CAST(row_number() OVER (PARTITION BY owner_id ORDER BY item_id) AS INTEGER) AS number FROM items ANTI JOIN lg USING (owner_id, item_id)) SELECT owner_id, item_id, number, count(number) OVER (PARTITION BY owner_id) >= 2 AS usable FROM items LEFT JOIN k USING (owner_id, item_id)",
    "profile_violations": f"""WITH {_RULES}, lg AS (SELECT * FROM v WHERE kind <> 'misattributed' QUALIFY level = min(level) OVER (PARTITION BY owner_id, item_id))
SELECT owner_id, item_id, level, kind, subject FROM lg UNION ALL SELECT owner_id, NULL, 0, 'unknown_role', CAST(CAST(item_id AS BIGINT) + 1 AS VARCHAR) FROM items i WHERE NOT EXISTS (SELECT 1 FROM src WHERE src.owner_id = i.owner_id AND src.source_id = CAST(i.item_id AS BIGINT) + 1 AND src.kind = 'user')""",
    "prose_claims": f"""WITH {PRE}, {_ITEMS}, p AS (SELECT conv_id AS owner_id, text FROM conversations QUALIFY turn = max(turn) OVER (PARTITION BY conv_id)),
s AS (SELECT owner_id, text FROM src WHERE EXISTS (SELECT 1 FROM items i WHERE i.owner_id = src.owner_id AND i.cite = src.source_id)),
pt AS (SELECT DISTINCT owner_id, term FROM (SELECT owner_id, unnest(list_distinct(regexp_extract_all({norm('text')}, '[a-z0-9]+'))) AS key FROM p) JOIN spell ON key = spelling),
st AS (SELECT DISTINCT owner_id, term FROM (SELECT owner_id, unnest(list_distinct(regexp_extract_all({norm('text')}, '[a-z0-9]+'))) AS key FROM s) JOIN spell ON key = spelling),
fc AS (SELECT DISTINCT owner_id, replace(f, ',', '') AS figure FROM (SELECT owner_id, unnest(regexp_extract_all(text, '{_FIG}', 2)) AS f FROM p)),
fh AS (SELECT owner_id, replace({norm('text')}, ',', '') AS hay FROM s),
fv AS (SELECT owner_id, round(CAST(unnest(regexp_extract_all(hay, '\\d+(?:\\.\\d+)?')) AS DOUBLE), 9) AS val FROM fh
  UNION SELECT owner_id, n FROM (SELECT owner_id, unnest(regexp_extract_all(hay, '[a-z]+')) AS w FROM fh) JOIN (VALUES {', '.join(f"('{w}', CAST({n} AS DOUBLE))" for w, n in vocab.NUMBER_WORDS.items())}) AS t(w, n) USING (w)),
fx AS (SELECT DISTINCT owner_id, unnest(regexp_extract_all(hay, '(^|[^0-9.])(\\d+)', 2)) AS txt FROM fh)
SELECT owner_id, 'summary' AS part, 'unsupported_term' AS kind, term AS subject FROM pt ANTI JOIN st USING (owner_id, term)
UNION ALL SELECT owner_id, 'summary', 'unsupported_figure', figure FROM fc WHERE NOT EXISTS (SELECT 1 FROM fv WHERE fv.owner_id = fc.owner_id AND fv.val = round(CAST(figure AS DOUBLE), 9)) AND NOT EXISTS (SELECT 1 FROM fx WHERE fx.owner_id = fc.owner_id AND fx.txt = figure)""",
    "entry_checks": """WITH t AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations)
SELECT DISTINCT a.conv_id AS owner_id, a.turn + 1 AS entry_id, CASE WHEN b.role IS NULL THEN 'unknown_entry' WHEN b.role <> CASE WHEN a.role = 'user' THEN 'assistant' ELSE 'user' END THEN 'wrong_section' ELSE 'empty_entry' END AS kind
FROM t a LEFT JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE b.role IS NULL OR b.role <> CASE WHEN a.role = 'user' THEN 'assistant' ELSE 'user' END OR coalesce(length(b.text), 0) <= 200""",
    "unknown_certifications": "SELECT DISTINCT p_brand AS owner_id, p_name AS cited FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_brand = a.p_brand AND b.p_name = a.p_name AND b.p_type = 'ECONOMY')",
    "undeclared_skills": f"""WITH s AS (SELECT DISTINCT p_brand AS owner_id, unnest(string_split(p_type, ' ')) AS skill FROM part), n AS (SELECT owner_id, skill, {norm('skill')} AS k FROM s),
d AS (SELECT DISTINCT owner_id, {norm('skill')} AS k FROM (SELECT p_brand AS owner_id, unnest(string_split(p_name, ' ')) AS skill FROM part)),
f AS (SELECT owner_id, skill, unnest({_PLURALS}) AS k FROM n WHERE k <> ''), m AS (SELECT DISTINCT owner_id, skill FROM f SEMI JOIN d USING (owner_id, k))
SELECT owner_id, skill FROM n ANTI JOIN m USING (owner_id, skill) WHERE k <> ''""",
    "best_letter": "WITH l AS (SELECT o_custkey AS run_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS attempt, o_orderstatus = 'F' AS grounded, o_orderstatus <> 'P' AS parses, o_orderkey % 4 AS failures, starts_with(o_orderpriority, '1') AS repaired FROM orders) SELECT run_id, attempt, failures = 0 AS reads_well, failures FROM l QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY grounded DESC, parses DESC, failures = 0 DESC, failures, repaired, attempt) = 1",
    "description_lines": r"""WITH l AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\x0B\x0C\r\x1C-\x1E\x{85}\x{2028}\x{2029}]'), lambda x: regexp_replace(regexp_replace(x, '^[ \t]*[•‣▪·◦*–—-][ \t]+', ''), '^[ \t]+|[ \t]+$', '', 'g')), lambda x: length(x) > 2)) AS line, generate_subscripts(list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\x0B\x0C\r\x1C-\x1E\x{85}\x{2028}\x{2029}]'), lambda x: regexp_replace(regexp_replace(x, '^[ \t]*[•‣▪·◦*–—-][ \t]+', ''), '^[ \t]+|[ \t]+$', '', 'g')), lambda x: length(x) > 2), 1) AS n FROM documents)
SELECT doc_id, CAST(n AS INTEGER) AS n, length(line) AS n_chars, md5(line) AS digest FROM l""",
    "unknown_citations": f"WITH {_ITEMS}, c AS (SELECT DISTINCT owner_id, item_id, source_id FROM (SELECT owner_id, item_id, unnest([cite, CAST(item_id AS BIGINT) - 2]) AS source_id FROM items) WHERE source_id IS NOT NULL) SELECT owner_id, item_id, source_id FROM c ANTI JOIN src USING (owner_id, source_id)",
    "misattributed_items": f"WITH {_ITEMS}, c AS (SELECT DISTINCT owner_id, item_id, source_id FROM (SELECT owner_id, item_id, unnest([cite, CAST(item_id AS BIGINT) - 3]) AS source_id FROM items) WHERE source_id IS NOT NULL) SELECT owner_id, item_id, source_id FROM c JOIN src USING (owner_id, source_id) WHERE kind = 'user' AND source_id <> item_id - 1",
    "supporting_text": "SELECT source AS owner_id, min(doc_id) AS item_id, CAST(length(string_agg(text, '\n' ORDER BY doc_id)) AS INTEGER) AS n_chars, md5(string_agg(text, '\n' ORDER BY doc_id)) AS digest FROM documents GROUP BY source",
    "supporting_parts": "SELECT source AS owner_id, min(doc_id) OVER (PARTITION BY source) AS item_id, doc_id AS source_id, length(text) AS n_chars, md5(text) AS digest, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents WHERE source IS NOT NULL",
    "claim_gate": f"WITH {_GATE} SELECT owner_id, item_id, term FROM bad",
    "gate_summary": f"WITH {_GATE} SELECT owner_id, count(*) AS violations, count(DISTINCT item_id) AS items FROM bad GROUP BY owner_id",
    "blocked_terms": f"WITH {_GATE} SELECT term AS key, term AS first_spelling, count(DISTINCT (owner_id, item_id)) AS items FROM bad GROUP BY term",
    "repaired_documents": f"""WITH {_GATE}, k AS (SELECT owner_id, count(*) AS kept, sum(len(regexp_extract_all({norm('text')}, '[a-z][a-z''\\-]*'))) AS words FROM items ANTI JOIN bad USING (owner_id, item_id) GROUP BY owner_id)
SELECT owner_id, items, coalesce(kept, 0) AS kept, coalesce(words, 0) AS words, coalesce(kept, 0) >= 2 AS usable FROM (SELECT owner_id, count(*) AS items FROM items GROUP BY owner_id) LEFT JOIN k USING (owner_id)""",
    "claim_snapshot": f"WITH {_ITEMS} SELECT i.owner_id, i.item_id, length(i.text) AS n_chars, s.source_id, md5(coalesce(s.text, '')) AS source_md5, s.kind AS label FROM items i JOIN src s ON i.owner_id = s.owner_id AND i.cite = s.source_id",
    "bullet_rubric": f"WITH {_BULLETS} SELECT * FROM checks",
    "rubric_summary": f"WITH {_BULLETS} SELECT doc_id, count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS failed, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE NOT ok), '') AS failures FROM checks GROUP BY doc_id",
    "letter_rubric": f"""WITH base AS (SELECT conv_id, turn, {norm('text')} AS norm, list_filter(string_split(coalesce(text, ''), '\n'), lambda p: trim(p) <> '') AS ps, len(regexp_extract_all({norm('text')}, '[a-z][a-z''\\-]*')) AS nw, len(regexp_extract_all(text, '{_FIG}', 2)) AS nf FROM conversations WHERE role = 'assistant')
{_CHECKS('conv_id, turn', {'opening': f'NOT regexp_matches(norm, {_quote(vocab.DEAD_OPENINGS)})', 'length': 'nw BETWEEN 200 AND 400', 'paragraphs': 'len(ps) BETWEEN 3 AND 4', 'specifics': 'nf >= 1', 'plain_words': 'NOT ' + _anyof(vocab.EXCESS_WORDS), 'no_cliche': 'NOT ' + _anyof(vocab.CLICHES), 'no_flattery': 'NOT ' + _anyof(vocab.FLATTERY), 'varied_openings': "len(ps) = 0 OR len(list_filter(ps, lambda p: regexp_matches(lower(trim(p)), '^i\\b'))) < len(ps) * 0.75"})}""",
    "text_layer_rubric": f"WITH base AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) {_CHECKS('doc_id', {'no_ligatures': f'NOT regexp_matches(t, {_quote(vocab.LIGATURES)})', 'no_private_use': f'NOT regexp_matches(t, {_quote(vocab.PRIVATE_USE)})', 'no_spaced_letters': f'NOT regexp_matches(t, {_quote(vocab.SPACED_OUT)})'})}",
    "page_layout_rubric": f"WITH base AS (SELECT page_id, lower(coalesce(html, '')) AS t FROM pages) {_CHECKS('page_id', {f'no_{k}': f'NOT regexp_matches(t, {_quote(p)})' for k, p in vocab.LAYOUT.items()})}",
    "round_trip": f"""WITH f AS (SELECT doc_id, {norm("regexp_replace(coalesce(text, ''), '[-­][\\x09-\\x0D\\x20]*\n[\\x09-\\x0D\\x20]*', '', 'g')")} AS flat, {sentences('text')} AS s FROM documents),
i AS (SELECT doc_id, flat, unnest(s) AS item FROM f) SELECT doc_id, count(*) AS items, count(*) FILTER (WHERE NOT contains(flat, {norm("regexp_replace(item, '[-­][\\x09-\\x0D\\x20]*\n[\\x09-\\x0D\\x20]*', '', 'g')")})) AS missing FROM i GROUP BY doc_id""",
    "verbatim_echo": f"WITH s AS (SELECT DISTINCT {norm('x')} AS x FROM (SELECT unnest({sentences('text')}) AS x FROM benchmark)), d AS (SELECT doc_id, {norm('text')} AS n FROM documents) SELECT doc_id, count(*) AS echoed FROM d, s WHERE length(x) > 25 AND contains(n, x) GROUP BY doc_id",
    "extracted_posts": f"WITH {_POSTS} SELECT page_id, title, date, length(text) AS n_chars, md5(text) AS text_md5 FROM posts",
    "discovered_links": """WITH l AS (SELECT DISTINCT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS host, unnest(regexp_extract_all(coalesce(html, ''), 'href="([^"#?]+)', 1)) AS href FROM pages),
r AS (SELECT page_id, host, CASE WHEN starts_with(href, '/') THEN host || href WHEN regexp_matches(href, '^https?://') THEN href END AS link FROM l)
SELECT DISTINCT page_id, host, link FROM r WHERE link = host OR starts_with(link, host || '/')""",
    "evidence_chunks": f"""WITH RECURSIVE l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), '\n'), lambda p: trim(p)), lambda p: len(regexp_extract_all(p, '[^\\x09-\\x0D\\x20]+')) >= {vocab.PARAGRAPH_WORDS}) AS ps FROM documents),
c(doc_id, ps, i, n, chunk) AS (SELECT doc_id, ps, 1, 0, ps[1] FROM l WHERE len(ps) > 0
  UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN length(chunk) + 1 + length(ps[i + 1]) <= {vocab.CHUNK_CHARS} THEN n ELSE n + 1 END, CASE WHEN length(chunk) + 1 + length(ps[i + 1]) <= {vocab.CHUNK_CHARS} THEN chunk || '\n' || ps[i + 1] ELSE ps[i + 1] END FROM c WHERE i < len(ps))
SELECT doc_id, n, arg_max(chunk, i) AS chunk FROM c GROUP BY doc_id, n""",
    "evidence_sources": f"""WITH {_POSTS}, e AS (SELECT 'src' || (page_id % 20) AS owner_id, page_id AS source_id, 'evidence' AS kind, length(text) AS n_chars FROM posts)
SELECT * FROM e UNION ALL SELECT source, doc_id, 'document', length(coalesce(text, '')) FROM documents WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.owner_id = source AND e.source_id = doc_id)""",
    "completed_posts": f"""WITH {_POSTS}, j AS (SELECT d.doc_id, d.source, d.text, p.text AS page_text, row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) AS r FROM documents d LEFT JOIN posts p ON d.doc_id = p.page_id)
SELECT doc_id, source, coalesce(length(coalesce(text, '')) < {vocab.TEASER_CHARS} AND length(page_text) > length(coalesce(text, '')), false) AS completed, CASE WHEN length(coalesce(text, '')) < {vocab.TEASER_CHARS} AND length(page_text) > length(coalesce(text, '')) THEN length(page_text) ELSE length(text) END AS n_chars FROM j WHERE r <= 40""",
    "contacts_found": r"""SELECT * FROM (SELECT doc_id, (SELECT coalesce(string_agg(x, '|' ORDER BY p), '') FROM (SELECT x, min(p) AS p FROM (SELECT unnest(m) AS x, generate_subscripts(m, 1) AS p) GROUP BY x)) AS emails, (SELECT coalesce(string_agg(x, '|' ORDER BY p), '') FROM (SELECT x, min(p) AS p FROM (SELECT unnest(ph) AS x, generate_subscripts(ph, 1) AS p) GROUP BY x)) AS phones
FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS m, regexp_extract_all(text, '\+?[0-9][0-9 ().-]{7,}[0-9]') AS ph FROM documents)) WHERE emails <> '' OR phones <> ''""",
    "month_ranges": f"SELECT o_orderkey, {_MONTH('o_orderdate')} || ' – ' || CASE WHEN o_orderstatus = 'O' THEN 'Present' ELSE {_MONTH('(o_orderdate + INTERVAL 40 DAY)')} END AS shown FROM orders",
    "newest_entries": "SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'O' DESC, CASE WHEN o_orderstatus = 'O' THEN '' ELSE strftime(o_orderdate, '%Y-%m') END DESC, strftime(o_orderdate, '%Y-%m-%d ') || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') DESC) AS rank FROM orders)",
    "ordered_entries": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'O' DESC, CASE WHEN o_orderstatus = 'O' THEN '' ELSE strftime(o_orderdate, '%Y-%m') END DESC, strftime(o_orderdate, '%Y-%m-%d ') || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') DESC) AS rank FROM orders",
    "entry_facts": "SELECT s_suppkey, s_name || ', ' || n_name AS title_line, r_name AS context_line FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "entry_pairs": """WITH s AS (SELECT p_brand, p_name, p_partkey, row_number() OVER (PARTITION BY p_type, p_brand, p_name ORDER BY p_partkey) AS n, p_type FROM part)
SELECT p_brand, p_name, n, a.p_partkey AS skeleton_id, b.p_partkey AS detail_id FROM (SELECT * FROM s WHERE p_type = 'ECONOMY') a FULL JOIN (SELECT * FROM s WHERE p_type = 'SMALL') b USING (p_brand, p_name, n)""",
    "assigned_ids": f"SELECT p_partkey, p_brand, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS assigned_id FROM (SELECT p_partkey, p_brand, base, row_number() OVER (PARTITION BY p_brand, base ORDER BY p_partkey) AS n FROM (SELECT p_partkey, p_brand, coalesce(nullif({_SLUG}, ''), 'item') AS base FROM part))",
    "best_attempt": f"WITH {_ATTEMPTS} SELECT run_id, attempt, total, grounded, n AS attempts FROM (SELECT *, count(*) OVER (PARTITION BY run_id) AS n, row_number() OVER (PARTITION BY run_id ORDER BY grounded DESC, parses DESC, total DESC, repaired, attempt) AS r FROM a) WHERE r = 1",
    "stop_reason": f"WITH {_REASONS} SELECT run_id, attempt, reason FROM r",
    "run_outcome": f"""WITH {_REASONS}, p AS (SELECT run_id, min(attempt) FILTER (WHERE reason IS NOT NULL) AS stop_at, arg_min(reason, attempt) FILTER (WHERE reason IS NOT NULL) AS why, max(attempt) AS last, bool_or(grounded) AS g, max(total) AS best, max(ceiling) AS ceiling FROM r GROUP BY run_id)
SELECT run_id, coalesce(stop_at, last) AS used, coalesce(why, CASE WHEN g THEN 'exhausted' ELSE 'ungrounded' END) AS reason, best >= {vocab.TARGET} AS met, ceiling >= {vocab.TARGET} AS reachable, best >= ceiling - {vocab.SLACK} AS at_ceiling FROM p""",
    "attempt_timeline": f"WITH {_EVENTS} SELECT run_id, attempt, count(*) AS events, strftime(min(tm), '%Y-%m-%d %H:%M:%S.%f') AS first_at, strftime(max(tm), '%Y-%m-%d %H:%M:%S.%f') AS last_at, arg_max(stage, seq) AS last_stage, arg_max(score, seq) AS last_score, bool_or(stage = 'error') AS failed FROM e GROUP BY run_id, attempt",
    "event_tail": f"WITH {_EVENTS} SELECT run_id, seq, stage, from_end FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS from_end FROM e) WHERE from_end <= 400 AND seq > 100",
    "usage_rollup": "SELECT l_orderkey AS run_id, count(*) AS calls, sum(coalesce(l_quantity, 0)) AS tokens, round(sum(coalesce(l_extendedprice, 0)), 2) AS seconds FROM lineitem GROUP BY ROLLUP (l_orderkey)",
    "copy_drift": f"""WITH l AS (SELECT conv_id, role, line FROM (SELECT conv_id, role, {norm('x')} AS line FROM (SELECT conv_id, role, unnest({sentences('text')}) AS x FROM conversations)) WHERE line <> ''),
c AS (SELECT conv_id, line, count(*) FILTER (WHERE role = 'user') AS u, count(*) FILTER (WHERE role = 'assistant') AS a FROM l GROUP BY conv_id, line)
SELECT conv_id, change, CAST(sum(n) AS BIGINT) AS lines FROM (SELECT conv_id, 'removed' AS change, greatest(u - a, 0) AS n FROM c UNION ALL SELECT conv_id, 'added', greatest(a - u, 0) FROM c UNION ALL SELECT conv_id, 'kept', least(u, a) FROM c) GROUP BY conv_id, change HAVING sum(n) > 0""",
    "merged_terms": f"""WITH w AS (SELECT item_id, 0 AS part, unnest(c) AS term, generate_subscripts(c, 1) AS seq FROM (SELECT item_id, {content(norm('text'), '')} AS c FROM benchmark)
  UNION ALL SELECT doc_id % (SELECT count(*) FROM benchmark), 1, unnest(c), doc_id * 1000000 + generate_subscripts(c, 1) FROM (SELECT doc_id, {content(norm('text'), '')} AS c FROM documents)),
k AS (SELECT item_id, term, part, seq, row_number() OVER (PARTITION BY item_id, term ORDER BY part, seq) AS r FROM w WHERE part = 0 OR length(term) < 60)
SELECT item_id, term, place FROM (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY part, seq) AS place FROM k WHERE r = 1)""",
    "all_merged_terms": f"""WITH w AS (SELECT item_id, 0 AS part, unnest(c) AS term, generate_subscripts(c, 1) AS seq FROM (SELECT item_id, {content(norm('text'), '')} AS c FROM benchmark)
  UNION ALL SELECT doc_id % (SELECT count(*) FROM benchmark), 1, unnest(c), doc_id * 1000000 + generate_subscripts(c, 1) FROM (SELECT doc_id, {content(norm('text'), '')} AS c FROM documents)),
k AS (SELECT item_id, term, part, seq, row_number() OVER (PARTITION BY item_id, term ORDER BY part, seq) AS r FROM w WHERE part = 0 OR length(term) < 60)
SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY part, seq) AS place FROM k WHERE r = 1""",
    "ranked_feedback": f"WITH {_GATE} SELECT owner_id, item_id, term, rank FROM (SELECT owner_id, item_id, term, row_number() OVER (PARTITION BY owner_id ORDER BY item_id, term) AS rank FROM bad) WHERE rank <= 25",
    "shortlists": """WITH d AS (SELECT source, doc_id, length(coalesce(text, '')) AS n, trim(coalesce(text, '')) AS t FROM documents), c AS (SELECT *, rtrim(substr(t, 1, 119)) AS cut0 FROM d),
s AS (SELECT *, length(cut0) - strpos(reverse(cut0), ' ') AS last FROM c)
SELECT source, doc_id, rank, CASE WHEN length(t) <= 120 THEN t ELSE regexp_replace(CASE WHEN contains(cut0, ' ') AND last > 72 THEN substr(cut0, 1, last) ELSE cut0 END, '[ ,;:-]+$', '') || '…' END AS cut FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, doc_id) AS rank FROM s) WHERE rank <= 10""",
}

SQL["timeline_stream"] = SQL["attempt_timeline"]
SQL["usage_stream"] = "SELECT user_id AS run_id, count(*) AS calls, sum(coalesce(value, 0)) AS tokens, round(sum(coalesce(value, 0) * 2), 2) AS seconds FROM events GROUP BY user_id"
