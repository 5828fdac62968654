"""SQL that the reporting queries are compared with."""

from __future__ import annotations

from tracewell.functions import vocab
from tracewell.plans.oracle_records import _ATTEMPTS, _GATE
from tracewell.plans.oracle_text import PRE
from tracewell.plans.oracle_text import SQL as TEXT

SQL = {
    "score_components": f"""WITH {PRE}, b AS (SELECT fit.item_id, fit.source, round(matched / wanted, 6) AS c, round(qual.addressed / total, 6) AS q FROM fit JOIN wn USING (item_id) LEFT JOIN qual USING (item_id, source))
SELECT item_id, source, 'hard_skills' AS component, round(c * 40.0, 4) AS points FROM b UNION ALL SELECT item_id, source, 'qualifications', round(coalesce(q, 0) * 15.0, 4) FROM b""",
    "ceiling": f"WITH t AS ({TEXT['total_score']}) SELECT item_id, max(total) AS ceiling, round(greatest(0.0, {vocab.TARGET} - max(total)), 1) AS gap, max(total) >= {vocab.TARGET} AS reachable FROM t GROUP BY item_id",
    "answers_posting": f"WITH {PRE}, f AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY length(term) DESC, term) AS place FROM wanted) SELECT item_id, doc_id, count(*) AS named FROM f JOIN (SELECT DISTINCT doc_id, term FROM dment) USING (term) WHERE place <= 30 GROUP BY item_id, doc_id",
    "run_summaries": f"WITH {_ATTEMPTS} SELECT run_id, count(*) AS attempts, max(total) AS best, string_agg(printf('%.1f', total), ' ' ORDER BY attempt) AS totals FROM a GROUP BY run_id",
    "violation_report": f"WITH {_GATE}, n AS (SELECT owner_id, item_id, count(*) AS n FROM bad GROUP BY owner_id, item_id) SELECT owner_id, CAST(sum(n) AS BIGINT) AS violations, string_agg(item_id || '×' || n, ', ' ORDER BY item_id) AS summary FROM n GROUP BY owner_id",
}
