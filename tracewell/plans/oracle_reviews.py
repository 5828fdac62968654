"""SQL that the whole rubrics are compared with."""

from __future__ import annotations

from tracewell.functions import vocab
from tracewell.plans.oracle_records import _FIG, _anyof
from tracewell.plans.oracle_text import PRE, _quote, norm, sentences
from tracewell.plans.review_queries import MAIL, PAGE_CHARS, PHONE

_ONE_OF = lambda words: ", ".join(_quote(w) for w in words)
_LINES = "list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')"
_NONE = lambda items, test: f"len(list_filter({items}, lambda x: {test})) = 0"


def _stack(ids: str, checks: dict[str, tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT {ids}, '{name}' AS name, '{kind}' AS kind, {ok} AS ok FROM base" for name, (kind, ok) in checks.items())


_DRAFT = f"""month AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN strftime(day, '%b %Y') ELSE strftime(day, '%B %Y') END AS m FROM (SELECT doc_id, DATE '2015-01-31' + CAST(doc_id % 3000 AS INTEGER) AS day FROM documents)),
base AS (SELECT doc_id, coalesce(text, '') AS t, source, lower(html) AS html, {_LINES} AS lines, ([{_ONE_OF([*vocab.STANDARD_HEADINGS, 'odds and ends'])}])[doc_id % 22 + 1] AS heading,
  m || ' – ' || CASE WHEN doc_id % 3 = 0 THEN 'Present' ELSE m END AS printed, CASE WHEN doc_id % 6 <> 0 THEN ceil(length(coalesce(text, '')) / {PAGE_CHARS}) END AS pages
  FROM documents JOIN month USING (doc_id) LEFT JOIN pages ON page_id = doc_id),
checks AS (SELECT * FROM ({_stack('doc_id', {
    'history': ('parsing', 'doc_id % 9 > 0'),
    'headings': ('parsing', f"heading IN ({_ONE_OF(vocab.STANDARD_HEADINGS)})"),
    'dates': ('parsing', f"regexp_matches(printed, {_quote(vocab.DATE_RANGE)})"),
    'email': ('parsing', f"regexp_matches(t, {_quote(MAIL)})"),
    'reachable': ('reading', f"regexp_matches(t, {_quote(PHONE)}) AND trim(coalesce(source, '')) <> ''"),
    'short': ('reading', _NONE('lines', f'length(x) > {vocab.MAX_BULLET_CHARS}')),
    'quantified': ('reading', f"len(list_filter(lines, lambda x: len(regexp_extract_all(x, '{_FIG}', 2)) > 0)) >= len(lines) * CAST({vocab.MIN_QUANTIFIED} AS DOUBLE)"),
    'openers': ('reading', _NONE('lines', f'regexp_matches(lower(x), {_quote(vocab.WEAK_OPENERS)})')),
    'impersonal': ('reading', _NONE('lines', f'regexp_matches(lower(x), {_quote(vocab.FIRST_PERSON)})')),
    'single_column': ('parsing', f"CASE WHEN html <> '' THEN NOT ({' OR '.join(f'regexp_matches(html, {_quote(p)})' for p in vocab.LAYOUT.values())}) END"),
    'page_budget': ('parsing', f'pages <= {vocab.MAX_PAGES}'),
})}) WHERE ok IS NOT NULL)"""

_LETTER = f"""{PRE},
posting AS (SELECT item_id, {sentences('text')} AS quals, CASE WHEN item_id % 3 <> 0 THEN company END AS company FROM benchmark LEFT JOIN (SELECT item_id, max(term) AS company FROM wanted GROUP BY item_id) USING (item_id)),
letter AS (SELECT conv_id, turn, item_id, quals, company, CASE WHEN (conv_id + turn) % 4 = 0 THEN 'Dear Sir or Madam' ELSE 'Hiring Manager' END AS addressee,
  list_concat(list_concat(CASE WHEN (conv_id + turn) % 7 = 0 THEN ['I am writing to apply.'] ELSE [] END, {_LINES}), CASE WHEN (conv_id + turn) % 5 = 0 AND len(quals) > 0 THEN [quals[1]] ELSE [] END) AS ps
  FROM (SELECT *, conv_id % (SELECT count(*) FROM benchmark) AS item_id FROM conversations WHERE role = 'assistant') LEFT JOIN posting USING (item_id)),
body AS (SELECT *, array_to_string(ps, chr(10) || chr(10)) AS b, {norm("array_to_string(ps, chr(10) || chr(10))")} AS norm FROM letter),
said AS (SELECT DISTINCT conv_id, turn, item_id, company, term FROM (SELECT conv_id, turn, item_id, company, unnest(list_distinct(regexp_extract_all(norm, '[a-z0-9]+'))) AS key FROM body) JOIN spell ON key = spelling),
first AS (SELECT item_id, term FROM (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY length(term) DESC, term) AS r FROM wanted) WHERE r <= {vocab.POSTING_TERMS}),
shape AS (SELECT conv_id, turn, regexp_replace({norm('token')}, '[^a-z0-9]+', '', 'g') AS squashed FROM (SELECT conv_id, turn, regexp_replace(trim(raw, '.,;:'), '''s$', '') AS token FROM (SELECT conv_id, turn, unnest(regexp_extract_all(b, {_quote(vocab.TOKEN)})) AS raw FROM body))
  WHERE token <> '' AND token NOT IN ({_ONE_OF(vocab.NOT_A_TOOL)}) AND regexp_matches(token, {_quote(vocab.TECHNICAL)})),
tools AS (SELECT conv_id, turn, count(DISTINCT squashed) AS tools FROM (SELECT * FROM shape UNION ALL SELECT conv_id, turn, term FROM said WHERE length(term) >= 9) GROUP BY conv_id, turn),
answer AS (SELECT DISTINCT conv_id, turn, true AS answers FROM said JOIN first USING (item_id, term)),
firm AS (SELECT DISTINCT conv_id, turn, true AS named FROM said WHERE term = company),
base AS (SELECT *, lower(trim(coalesce(ps[1], ''))) AS opening, (SELECT count(*) FROM first f WHERE f.item_id = body.item_id) AS asks
  FROM body LEFT JOIN tools USING (conv_id, turn) LEFT JOIN answer USING (conv_id, turn) LEFT JOIN firm USING (conv_id, turn)),
checks AS ({_stack('conv_id, turn', {
    'opening': ('blocking', f"opening <> '' AND NOT regexp_matches(opening, {_quote(vocab.DEAD_OPENINGS)})"),
    'addressee': ('blocking', f"NOT regexp_matches(lower(addressee), {_quote(vocab.DEAD_ADDRESSEES)})"),
    'length': ('blocking', "len(regexp_extract_all(b, '[^\\x09-\\x0D\\x20]+')) BETWEEN 200 AND 400"),
    'paragraphs': ('blocking', 'len(ps) BETWEEN 3 AND 4'),
    'specifics': ('blocking', f"len(regexp_extract_all(b, '{_FIG}', 2)) > 0 OR coalesce(tools, 0) >= 2"),
    'answers_posting': ('blocking', 'asks = 0 OR coalesce(answers, false)'),
    'names_company': ('advisory', 'company IS NULL OR coalesce(named, false)'),
    'plain_words': ('advisory', 'NOT ' + _anyof(vocab.EXCESS_WORDS)),
    'no_cliche': ('advisory', 'NOT ' + _anyof(vocab.CLICHES)),
    'no_flattery': ('advisory', 'NOT ' + _anyof(vocab.FLATTERY)),
    'varied_openings': ('advisory', "len(ps) < 3 OR len(list_filter(ps, lambda x: regexp_matches(x, '^\\s*I\\b'))) < len(ps) * 0.75"),
    'own_words': ('advisory', _NONE('quals', f'length(x) > {vocab.ECHO_CHARS} AND contains(norm, {norm("x")})')),
})})"""
_VERDICT = "count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS failed, count(*) FILTER (WHERE NOT ok AND kind IN ('parsing', 'blocking')) AS severe, count(*) FILTER (WHERE NOT ok AND kind IN ('parsing', 'blocking')) = 0 AS ok, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE NOT ok), '') AS failures FROM checks"

SQL = {
    "draft_review": f"WITH {_DRAFT} SELECT * FROM checks",
    "letter_review": f"WITH {_LETTER} SELECT * FROM checks",
    "draft_verdicts": f"WITH {_DRAFT} SELECT doc_id, {_VERDICT} GROUP BY doc_id",
    "letter_verdicts": f"WITH {_LETTER} SELECT conv_id, turn, {_VERDICT} GROUP BY conv_id, turn",
}
