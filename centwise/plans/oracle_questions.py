"""DuckDB oracle SQL for the question and reply queries (QNA1-QNA4, SCL10)."""

from __future__ import annotations

from centwise.plans.oracle_fixtures import MONTH_RANKS, MONTH_TOTALS, TX_BASE, f, pct, r, with_

# Month names in calendar order, the explicit period and year patterns; below, the question
# templates and the answer texts.
TEMPLATE_MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
                   "November", "December"]
MONTH_NAMES = [m.lower() for m in TEMPLATE_MONTHS]
EXPLICIT_PERIOD = r"(20\d\d)\s*[-/]\s*(\d{1,2})"
YEAR_IN_TEXT = r"(20\d\d)"

STRIP = r"^\s+|\s+$"

QS = ("qs AS (SELECT conv_id * 100 + turn AS question_id, conv_id AS user_id, CASE k "
      "WHEN 0 THEN 'Summarize my ' || mname || ' spending' "
      "WHEN 1 THEN 'Where did I overspend this month?' "
      "WHEN 2 THEN 'Compare this month with last month' "
      "WHEN 3 THEN 'How can I save more?' "
      "WHEN 4 THEN 'Which was my highest spending month?' "
      "WHEN 5 THEN 'What was my income in ' || yr || '-' || lpad(CAST(mno AS VARCHAR), 2, '0') || '?' "
      "WHEN 6 THEN 'How much did I spend in ' || mname || ' ' || yr || '?' "
      "ELSE 'Give me a summary' END AS question FROM ("
      "SELECT *, [" + ", ".join("'" + m + "'" for m in TEMPLATE_MONTHS) + "][mno] AS mname FROM ("
      "SELECT conv_id, turn, (conv_id + turn) % 8 AS k, CAST((turn + conv_id) % 12 + 1 AS INTEGER) AS mno, "
      "CAST(2000 + conv_id % 2 AS VARCHAR) AS yr FROM conversations WHERE role = 'user')))")

NAMES = "nm AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{n}', '{i + 1:02d}')" for i, n in enumerate(MONTH_NAMES)) + ") t(idx, name, num))"

QM = f"""q AS (SELECT question_id, user_id, regexp_replace(question, '{STRIP}', '', 'g') AS q FROM qs),
e AS (SELECT *, regexp_extract(q, '{EXPLICIT_PERIOD}', 1) AS ey,
             TRY_CAST(regexp_extract(q, '{EXPLICIT_PERIOD}', 2) AS INTEGER) AS em FROM q),
e2 AS (SELECT *, CASE WHEN ey <> '' AND em BETWEEN 1 AND 12 THEN ey || '-' || lpad(CAST(em AS VARCHAR), 2, '0') END
              AS explicit FROM e),
cand AS (SELECT e2.question_id, e2.user_id, regexp_extract(lower(e2.q), '{YEAR_IN_TEXT}', 1) AS yt, nm.idx, nm.num
         FROM e2 JOIN nm ON instr(lower(e2.q), nm.name) > 0 WHERE e2.explicit IS NULL),
pm AS (SELECT DISTINCT user_id, strftime(month, '%Y-%m') AS month FROM fact),
j AS (SELECT c.question_id, c.idx, pm.month,
             CASE WHEN substr(pm.month, 1, 4) = c.yt THEN 1 WHEN substr(pm.month, 1, 4) = '2001' THEN 2
                  WHEN substr(pm.month, 1, 4) = '2026' THEN 3 WHEN substr(pm.month, 1, 4) = '2025' THEN 4
                  WHEN substr(pm.month, 1, 4) = '2024' THEN 5 ELSE 9 END AS prio
      FROM cand c JOIN pm ON pm.user_id = c.user_id AND substr(pm.month, 6, 2) = c.num),
best AS (SELECT question_id, arg_min(month, (idx, prio, month)) AS by_name FROM j GROUP BY 1),
qm AS (SELECT e2.question_id, e2.user_id, e2.q, COALESCE(e2.explicit, best.by_name) AS target_month
       FROM e2 LEFT JOIN best ON best.question_id = e2.question_id)"""

LT = """lt AS (
  SELECT mt.user_id,
         max(CASE WHEN mrank = 1 THEN mt.month END) AS cur_month, max(CASE WHEN mrank = 1 THEN income END) AS inc,
         max(CASE WHEN mrank = 1 THEN expense END) AS exp, max(CASE WHEN mrank = 2 THEN mt.month END) AS prev_month,
         max(CASE WHEN mrank = 2 THEN income END) AS prev_inc, max(CASE WHEN mrank = 2 THEN expense END) AS prev_exp
  FROM mt JOIN mr ON mr.user_id = mt.user_id AND mr.month = mt.month AND mr.mrank <= 2 GROUP BY mt.user_id)"""


def m2(x: str) -> str:
    return f(x, 2)


def build(oracle: dict[str, str]) -> None:
    def sub(name: str) -> str:
        return "(" + oracle[name] + ")"

    oracle["question_month"] = with_(*TX_BASE, QS, NAMES, QM) + """
SELECT question_id, user_id, target_month FROM qm"""

    spend = ("(contains(ql, 'spend') OR contains(ql, 'spent') OR contains(ql, 'spending') "
             "OR contains(ql, 'expense') OR contains(ql, 'sped'))")
    conds = [
        ("q = ''", "'blank'",
         "'Please ask a finance question, for example: ''Where did I overspend this month?'''"),
        ("cur_month IS NULL", "'no_data'",
         "'I need more transaction history before I can answer. Add a few income and expense entries first.'"),
        ("target_month IS NOT NULL AND t_inc IS NULL", "'month_not_found'",
         "'No records were found for ' || target_month || '. Please check the month or add transactions for that period.'"),
        (f"(contains(ql, 'highest') OR contains(ql, 'max')) AND {spend}", "'highest_spend'",
         f"'Your highest spending month is ' || hi_month || ' with total expenses of Rs. ' || {m2('total_expense')} || '.'"),
        ("target_month IS NOT NULL AND (contains(ql, 'income') OR contains(ql, 'earn') OR contains(ql, 'salary'))",
         "'month_income'", f"'Income for ' || target_month || ' is Rs. ' || {m2('t_inc')} || '.'"),
        (f"target_month IS NOT NULL AND {spend}", "'month_spend'",
         f"'Total expenses for ' || target_month || ' are Rs. ' || {m2('t_exp')} || '.'"),
        ("contains(ql, 'overspend')", "'overspend'",
         "CASE WHEN alerts IS NOT NULL THEN 'Top overspending signals: ' || alerts "
         "ELSE 'No major overspending alert is active right now. Your current expense pattern is within the "
         "configured thresholds.' END"),
        ("contains(ql, 'compare') AND contains(ql, 'last month') AND prev_month IS NOT NULL", "'compare'",
         f"CASE WHEN prev_exp > 0 THEN 'Comparison for ' || cur || ' vs ' || prev || ': expenses are ' "
         f"|| {f('abs(delta)', 1)} || '% ' || CASE WHEN delta >= 0 THEN 'up' ELSE 'down' END || ' (Rs. ' "
         f"|| {m2('exp')} || ' vs Rs. ' || {m2('prev_exp')} || ').' "
         f"ELSE 'Comparison is limited because last month (' || prev || ') has very low or zero expenses recorded.' END"),
        ("contains(ql, 'save') OR contains(ql, 'saving')", "'save'",
         "CASE WHEN ps_title IS NOT NULL THEN 'Top savings action: ' || ps_title || '. ' || ps_message "
         "ELSE 'Your savings pattern looks stable. Keep monthly expense caps for discretionary categories to "
         "preserve savings.' END"),
        ("contains(ql, 'summarize') OR contains(ql, 'summary')", "'summary'",
         f"CASE WHEN target_month IS NOT NULL AND t_inc IS NOT NULL THEN 'Summary for ' || target_month "
         f"|| ': income Rs. ' || {m2('t_inc')} || ', expenses Rs. ' || {m2('t_exp')} || ', balance Rs. ' "
         f"|| {m2('t_inc - t_exp')} || '. Top categories: ' "
         f"|| COALESCE(tm_text, 'no expense categories recorded for this month.') "
         f"ELSE 'Summary for ' || cur || ': income Rs. ' || {m2('inc')} || ', expenses Rs. ' || {m2('exp')} "
         f"|| ', balance Rs. ' || {m2('inc - exp')} || '. Top categories: ' "
         f"|| COALESCE(tl_text, 'no major expense categories yet') || '.' END"),
    ]
    default = (f"'For ' || cur || ', your income is Rs. ' || {m2('inc')} || ', expenses are Rs. ' || {m2('exp')} "
               f"|| ', and savings rate is ' || {f(r(pct('inc - exp', 'inc')), 1)} || '%.' "
               f"|| CASE WHEN ci_cat IS NOT NULL THEN ' Biggest increase: ' || ci_cat || ' up ' || {f('ci_chg', 1)} "
               f"|| '% (Rs. ' || {m2('ci_prev')} || ' to Rs. ' || {m2('ci_cur')} || ').' ELSE '' END")
    intent = "CASE " + " ".join(f"WHEN {c} THEN {i}" for c, i, _ in conds) + " ELSE 'default' END"
    answer = "CASE " + " ".join(f"WHEN {c} THEN {a}" for c, _, a in conds) + f" ELSE {default} END"

    oracle["question_answers"] = with_(*TX_BASE, MONTH_TOTALS, MONTH_RANKS, LT, QS, NAMES, QM) + f"""
, tgt AS (SELECT user_id, strftime(month, '%Y-%m') AS target_month, income AS t_inc, expense AS t_exp FROM mt)
, hm AS (SELECT user_id, month AS hi_month, total_expense FROM {sub('highest_month')})
, al AS (SELECT user_id, string_agg(message, ' ' ORDER BY seq) AS alerts FROM {sub('context_alerts')}
         WHERE seq <= 3 GROUP BY 1)
, ps AS (SELECT user_id, title AS ps_title, message AS ps_message FROM {sub('personalized_suggestions')} WHERE rank = 1)
, tm AS (SELECT user_id, month AS target_month,
                string_agg(category || ' (Rs. ' || {m2('amount')} || ')', ', ' ORDER BY rank) AS tm_text
         FROM {sub('top_categories_by_month')} WHERE rank <= 3 GROUP BY 1, 2)
, tl AS (SELECT user_id, string_agg(category || ' (Rs. ' || {m2('amount')} || ')', ', ' ORDER BY rank) AS tl_text
         FROM {sub('top_categories_latest')} WHERE rank <= 3 GROUP BY 1)
, ci AS (SELECT user_id, category AS ci_cat, change_percent AS ci_chg, previous AS ci_prev, current AS ci_cur
         FROM {sub('category_increases')} WHERE rank = 1)
, x AS (SELECT qm.*, lower(qm.q) AS ql, lt.cur_month, lt.inc, lt.exp, lt.prev_month, lt.prev_exp, tgt.t_inc,
               tgt.t_exp, hm.hi_month, hm.total_expense, al.alerts, ps.ps_title, ps.ps_message, tm.tm_text,
               tl.tl_text, ci.ci_cat, ci.ci_chg, ci.ci_prev, ci.ci_cur,
               strftime(lt.cur_month, '%Y-%m') AS cur, strftime(lt.prev_month, '%Y-%m') AS prev,
               CASE WHEN lt.prev_exp <> 0
                    THEN CAST(lt.exp - lt.prev_exp AS DOUBLE) / CAST(lt.prev_exp AS DOUBLE) * 100.0 END AS delta
        FROM qm LEFT JOIN lt ON lt.user_id = qm.user_id
        LEFT JOIN tgt ON tgt.user_id = qm.user_id AND tgt.target_month = qm.target_month
        LEFT JOIN hm ON hm.user_id = qm.user_id LEFT JOIN al ON al.user_id = qm.user_id
        LEFT JOIN ps ON ps.user_id = qm.user_id
        LEFT JOIN tm ON tm.user_id = qm.user_id AND tm.target_month = qm.target_month
        LEFT JOIN tl ON tl.user_id = qm.user_id LEFT JOIN ci ON ci.user_id = qm.user_id)
SELECT question_id, user_id, target_month, {intent} AS intent, {answer} AS answer, 'local' AS source FROM x"""

    replies = """rp AS (
  SELECT conv_id * 100 + turn AS reply_id,
         CASE (conv_id + turn) % 6
           WHEN 0 THEN CAST(to_json({'text': text}) AS VARCHAR)
           WHEN 1 THEN CAST(to_json({'response': text}) AS VARCHAR)
           WHEN 2 THEN CAST(to_json({'choices': [{'message': {'content': text}}]}) AS VARCHAR)
           WHEN 3 THEN CAST(to_json({'choices': [{'text': text}]}) AS VARCHAR)
           WHEN 4 THEN CAST(to_json({'text': turn, 'response': text}) AS VARCHAR)
           ELSE CAST(to_json([text]) AS VARCHAR) END AS body
  FROM conversations WHERE role = 'assistant')"""

    def pick(path: str) -> str:
        return (f"CASE WHEN json_valid(body) AND json_type(body, '{path}') = 'VARCHAR' "
                f"THEN json_extract_string(body, '{path}') END")

    oracle["llm_reply_text"] = with_(replies) + f"""
SELECT reply_id, regexp_replace(COALESCE({pick('$.text')}, {pick('$.response')},
       {pick('$.choices[0].message.content')}, {pick('$.choices[0].text')}), '{STRIP}', '', 'g') AS answer
FROM rp"""
