"""DuckDB oracle SQL for reports (PRJ3, RPT1, SNK8, OUT2)."""

from __future__ import annotations

from centwise.plans.oracle_fixtures import EXP_MONTHS, FACT, TX_BASE, TX_FULL, USER_TOTALS, USERS, d, f, pct, r, with_

# A month as YYYY-MM or YYYY-M.
MONTH_TEXT = "^[0-9]{4}-(1[0-2]|0[1-9]|[1-9])$"

REQ = """reqraw AS (
  SELECT o_orderkey AS request_id, o_custkey AS user_id,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'monthly' WHEN '2-HIGH' THEN 'Yearly ' WHEN '3-MEDIUM' THEN 'yearly'
                              WHEN '5-LOW' THEN 'weekly' END AS report_type,
         CASE o_orderpriority WHEN '1-URGENT' THEN strftime(CAST(o_orderdate AS DATE), '%Y-%m')
                              WHEN '4-NOT SPECIFIED' THEN ''
                              WHEN '5-LOW' THEN year(o_orderdate) || '-' || month(o_orderdate) END AS month,
         CASE o_orderpriority WHEN '2-HIGH' THEN CAST(year(o_orderdate) AS VARCHAR) WHEN '3-MEDIUM' THEN 'abcd' END AS year,
         CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN 'last_month' END AS compare_range
  FROM orders)"""

RQ = f"""rq0 AS (
  SELECT request_id, user_id,
         CASE WHEN lower(trim(COALESCE(report_type, 'monthly'))) = 'yearly' THEN 'yearly' ELSE 'monthly' END AS report_type,
         CASE WHEN regexp_matches(trim(COALESCE(month, '')), '{MONTH_TEXT}') AND NOT starts_with(trim(COALESCE(month, '')), '0000')
              THEN trim(month) ELSE '2001-01' END AS month_text,
         CASE WHEN regexp_matches(trim(COALESCE(year, '')), '^[0-9]{{4}}$') AND trim(year) <> '0000'
              THEN trim(year) ELSE '2001' END AS year,
         CASE WHEN lower(trim(COALESCE(compare_range, ''))) = 'last_month' THEN 1 ELSE 3 END AS compare_months,
         COALESCE(report_type, '') = '' AS whole
  FROM reqraw),
rq1 AS (SELECT *, make_date(CAST(split_part(month_text, '-', 1) AS INTEGER), CAST(split_part(month_text, '-', 2) AS INTEGER), 1)
                  AS month_start FROM rq0),
rq2 AS (SELECT *, CASE WHEN report_type = 'yearly' THEN year ELSE strftime(month_start, '%b-%Y') END AS period FROM rq1),
rq AS (SELECT *, report_type || '-report-' || lower(replace(period, ' ', '-')) || '.csv' AS file_name FROM rq2)"""

TXALL = TX_FULL.replace("tx AS (", "txall AS (", 1)

SCOPED = """tx AS (
  SELECT r.request_id AS user_id, t.id, t.amount, t.category, t.type, t.description, t.date, t.month
  FROM txall t JOIN rq r ON r.user_id = t.user_id AND r.report_type = 'monthly' AND t.month = r.month_start
  UNION ALL
  SELECT r.request_id, t.id, t.amount, t.category, t.type, t.description, t.date, t.month
  FROM txall t JOIN rq r ON r.user_id = t.user_id AND r.report_type = 'yearly' AND CAST(year(t.date) AS VARCHAR) = r.year)"""

REQ_USERS = "users_v AS (SELECT request_id AS id FROM rq)"
NAMES = "names AS (SELECT c_custkey AS user_id, c_name AS name, lower(c_name) || '@example.com' AS email FROM customer)"

CAT_DIST = """cd AS (
  SELECT user_id, category, amount,
         row_number() OVER (PARTITION BY user_id ORDER BY amount DESC, category) AS rank
  FROM (SELECT user_id, COALESCE(NULLIF(category, ''), 'Other') AS category, SUM(amount) AS amount
        FROM fact WHERE type = 'Expense' GROUP BY 1, 2))"""


def _cols(c1="NULL", c2="NULL", c3="NULL", c4="NULL", c5="NULL", k_date="NULL", k_id="NULL") -> str:
    return (f"CAST({c1} AS VARCHAR) AS c1, CAST({c2} AS VARCHAR) AS c2, CAST({c3} AS VARCHAR) AS c3, "
            f"CAST({c4} AS VARCHAR) AS c4, CAST({c5} AS VARCHAR) AS c5, CAST({k_date} AS VARCHAR) AS k_date, "
            f"CAST({k_id} AS BIGINT) AS k_id")


def build(oracle: dict[str, str]) -> None:
    prefix = with_(*TX_BASE, USER_TOTALS, EXP_MONTHS)
    ps = oracle["period_suggestions"]
    assert ps.startswith(prefix)
    tail = ps[len(prefix):]
    cut = tail.rindex("\nSELECT ")
    ps_ctes, ps_select = tail[:cut], tail[cut:]
    base = with_(USERS.replace("users_v AS (", "cust AS (", 1), REQ, RQ, TXALL, SCOPED, FACT, REQ_USERS,
                 USER_TOTALS, EXP_MONTHS) + ps_ctes + f"""
, sugg AS ({ps_select})
, {NAMES}
, {CAT_DIST}
, summ AS (SELECT user_id AS request_id, {d('income')} AS total_income, {d('expense')} AS total_expenses,
                  {d('income - expense')} AS balance, {r(pct('income - expense', 'income'))} AS savings_rate FROM ut)
, sp AS (SELECT user_id, CAST(year(month) AS VARCHAR) AS year, month(month) AS month_no, SUM(amount) AS amount
         FROM fact WHERE type = 'Expense' GROUP BY 1, 2, 3)
, trend AS (SELECT y.request_id, g.month_no,
                   strftime(make_date(CAST(y.year AS INTEGER), CAST(g.month_no AS INTEGER), 1), '%b') AS mon,
                   COALESCE(sp.amount, 0) AS amount
            FROM (SELECT request_id, year FROM rq WHERE report_type = 'yearly') y
            CROSS JOIN (SELECT unnest(range(1, 13)) AS month_no) g
            LEFT JOIN sp ON sp.user_id = y.request_id AND sp.year = y.year AND sp.month_no = g.month_no)
, lines AS (
  SELECT request_id, 0 AS section_no, 1 AS line_no, {_cols("'Financial Report'")} FROM rq
  UNION ALL SELECT request_id, 0, 2, {_cols("'User'", "COALESCE(n.name, 'User')")}
            FROM rq LEFT JOIN names n ON n.user_id = rq.user_id
  UNION ALL SELECT request_id, 0, 3, {_cols("'Report Type'", "CASE WHEN report_type = 'yearly' THEN 'Yearly' ELSE 'Monthly' END")} FROM rq
  UNION ALL SELECT request_id, 0, 4, {_cols("'Period'", "period")} FROM rq
  UNION ALL SELECT request_id, 0, 5, {_cols("'Title'", "'Financial Report - ' || period")} FROM rq
  UNION ALL SELECT request_id, 1, 1, {_cols("'Summary'")} FROM summ
  UNION ALL SELECT request_id, 1, 2, {_cols("'Total Income'", f('total_income', 2))} FROM summ
  UNION ALL SELECT request_id, 1, 3, {_cols("'Total Expenses'", f('total_expenses', 2))} FROM summ
  UNION ALL SELECT request_id, 1, 4, {_cols("'Balance'", f('balance', 2))} FROM summ
  UNION ALL SELECT request_id, 1, 5, {_cols("'Savings Rate (%)'", f('savings_rate', 2))} FROM summ
  UNION ALL SELECT request_id, 2, 0, {_cols("'Suggestions'")} FROM rq
  UNION ALL SELECT user_id, 2, seq, {_cols("message")} FROM sugg
  UNION ALL SELECT request_id, 3, 0, {_cols("'Category-wise Breakdown'")} FROM rq
  UNION ALL SELECT request_id, 3, 1, {_cols("'Category'", "'Total Expense'")} FROM rq
  UNION ALL SELECT user_id, 3, rank + 1, {_cols("category", f('CAST(amount AS DOUBLE)', 2))} FROM cd
  UNION ALL SELECT request_id, 3, 2, {_cols("'No expense categories available'", "'0.00'")}
            FROM rq WHERE request_id NOT IN (SELECT user_id FROM cd)
  UNION ALL SELECT request_id, 4, 0, {_cols("'Monthly Trend (Expenses)'")} FROM rq WHERE report_type = 'yearly'
  UNION ALL SELECT request_id, 4, 1, {_cols("'Month'", "'Amount'")} FROM rq WHERE report_type = 'yearly'
  UNION ALL SELECT request_id, 4, month_no + 1, {_cols("mon", f('CAST(amount AS DOUBLE)', 2))} FROM trend
  UNION ALL SELECT request_id, 5, 0, {_cols("'Transactions'")} FROM rq
  UNION ALL SELECT request_id, 5, 1, {_cols("'Date'", "'Description'", "'Category'", "'Type'", "'Amount'")} FROM rq
  UNION ALL SELECT user_id, 5, 2, {_cols("strftime(date, '%Y-%m-%d')", "description", "category", "type",
                                          f('amount', 2), "strftime(date, '%Y-%m-%d')", "id")} FROM tx
  UNION ALL SELECT request_id, 5, 2, {_cols("'-'", "'No transactions available for this ' || report_type || ' report'",
                                             "'-'", "'-'", "'0.00'")}
            FROM rq WHERE request_id NOT IN (SELECT user_id FROM tx)
  UNION ALL SELECT request_id, s.sec, 100000, {_cols()} FROM rq, (VALUES (0), (1), (2), (3)) s(sec)
  UNION ALL SELECT request_id, 4, 100000, {_cols()} FROM rq WHERE report_type = 'yearly')
"""
    oracle["report_lines"] = base + """
SELECT l.request_id, CAST(l.section_no AS INTEGER) AS section_no, CAST(l.line_no AS BIGINT) AS line_no,
       l.c1, l.c2, l.c3, l.c4, l.c5, l.k_date, l.k_id, rq.user_id, rq.report_type, rq.period, rq.file_name
FROM lines l JOIN rq ON rq.request_id = l.request_id"""

    oracle["report_notices"] = base + """
, cells AS (SELECT request_id,
                   max(CASE WHEN section_no = 1 AND line_no = 2 THEN c2 END) AS inc,
                   max(CASE WHEN section_no = 1 AND line_no = 3 THEN c2 END) AS exp,
                   max(CASE WHEN section_no = 1 AND line_no = 4 THEN c2 END) AS bal,
                   max(CASE WHEN section_no = 1 AND line_no = 5 THEN c2 END) AS sr
            FROM lines GROUP BY 1)
SELECT rq.request_id, rq.user_id, n.email,
       CASE WHEN rq.report_type = 'yearly' THEN 'Yearly' ELSE 'Monthly' END || ' Report - ' || rq.period AS subject,
       'Hi ' || COALESCE(n.name, 'User') || ',' || chr(10) || chr(10) || 'Your ' || rq.report_type || ' report for '
         || rq.period || ' is attached.' || chr(10) || chr(10) || 'Summary:' || chr(10) || '- Total Income: Rs. ' || c.inc
         || chr(10) || '- Total Expenses: Rs. ' || c.exp || chr(10) || '- Balance: Rs. ' || c.bal || chr(10)
         || '- Savings Rate: ' || c.sr || '%' || chr(10) || chr(10) || 'Thank you.' || chr(10) AS body,
       rq.file_name AS attachment
FROM rq JOIN cells c ON c.request_id = rq.request_id JOIN names n ON n.user_id = rq.user_id
WHERE rq.request_id IN (SELECT user_id FROM tx) AND n.email IS NOT NULL AND trim(n.email) <> ''"""
