"""DuckDB oracle SQL, one string per registered query (written independently
of the Spark code; same fixtures, same rounding rules)."""

from __future__ import annotations

from centwise.plans.oracle_fixtures import (
    BUDGETS, BUDGETS_EFF, DEFAULTS, EXP_MONTHS, FACT, MONTH_CAT, MONTH_RANKS, MONTH_TOTALS,
    TX_BASE, TX_FULL, TX_ORDERS, USER_TOTALS, USERS, d, f, ml, pct, r, with_,
)

AS_OF_MONTH = "DATE '2001-01-01'"
AS_OF_YEAR = "'2001'"

ORACLE: dict[str, str] = {}


def _summary(inc: str = "income", exp: str = "expense", exp_name: str = "total_expense") -> str:
    return (f"{d(inc)} AS total_income, {d(exp)} AS {exp_name}, {d(f'{inc} - {exp}')} AS balance, "
            f"{r(pct(f'{inc} - {exp}', inc))} AS savings_rate")


ORACLE["user_summary"] = with_(*TX_BASE, USER_TOTALS) + f"""
SELECT user_id, {_summary(exp_name='total_expenses')} FROM ut"""

ORACLE["monthly_summary"] = with_(*TX_BASE, MONTH_TOTALS) + f"""
SELECT user_id, {ml('month')} AS month, {_summary()} FROM mt"""

ORACLE["monthly_spending"] = with_(*TX_BASE, EXP_MONTHS) + f"""
SELECT user_id, {ml('month')} AS month, {d('amount')} AS amount FROM em"""

_CAT_DIST = """cd AS (
  SELECT user_id, category, amount,
         row_number() OVER (PARTITION BY user_id ORDER BY amount DESC, category) AS rank
  FROM (SELECT user_id, COALESCE(NULLIF(category, ''), 'Other') AS category, SUM(amount) AS amount
        FROM fact WHERE type = 'Expense' GROUP BY 1, 2))"""

ORACLE["category_distribution"] = with_(*TX_BASE, _CAT_DIST) + f"""
SELECT user_id, category, {d('amount')} AS amount, rank FROM cd"""

ORACLE["top_categories"] = with_(*TX_BASE, _CAT_DIST) + f"""
SELECT user_id, category, {d('amount')} AS amount, rank FROM cd WHERE rank <= 3"""

ORACLE["avg_monthly_expense"] = with_(*TX_BASE, EXP_MONTHS) + f"""
SELECT user_id, {r('CAST(SUM(amount) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE)')} AS average_monthly_expense
FROM em GROUP BY user_id"""

_YEARS = f"""yrs AS (
  SELECT DISTINCT user_id, CAST(year(month) AS VARCHAR) AS year FROM fact
  UNION
  SELECT id, {AS_OF_YEAR} FROM users_v)"""

ORACLE["report_years"] = with_(*TX_BASE, _YEARS) + "SELECT user_id, year FROM yrs"

ORACLE["yearly_trend_zero_filled"] = with_(*TX_BASE, _YEARS) + f"""
, sp AS (SELECT user_id, CAST(year(month) AS VARCHAR) AS year, month(month) AS month_no, SUM(amount) AS amount
         FROM fact WHERE type = 'Expense' GROUP BY 1, 2, 3)
SELECT y.user_id, y.year, CAST(g.month_no AS INTEGER) AS month_no,
       strftime(make_date(CAST(y.year AS INTEGER), CAST(g.month_no AS INTEGER), 1), '%b') AS month,
       {d('COALESCE(sp.amount, 0)')} AS amount
FROM yrs y CROSS JOIN (SELECT unnest(range(1, 13)) AS month_no) g
LEFT JOIN sp ON sp.user_id = y.user_id AND sp.year = y.year AND sp.month_no = g.month_no"""

ORACLE["income_expense_savings"] = with_(*TX_BASE) + f"""
, lm AS (SELECT user_id, max(month) AS latest FROM fact GROUP BY user_id)
, g AS (SELECT f.user_id, f.month,
               COALESCE(SUM(CASE WHEN type = 'Income' THEN amount END), 0) AS income,
               COALESCE(SUM(CASE WHEN type <> 'Income' THEN amount END), 0) AS expense
        FROM fact f JOIN lm ON lm.user_id = f.user_id
        WHERE f.month > lm.latest - INTERVAL 3 MONTH GROUP BY f.user_id, f.month)
SELECT user_id, {ml('month')} AS month, {d('income')} AS income, {d('expense')} AS expense,
       {d('income - expense')} AS savings FROM g"""

ORACLE["overspend_ratio"] = with_(*TX_BASE, USER_TOTALS) + f"""
SELECT user_id,
       (income > 0 AND CAST(expense AS DOUBLE) / CAST(income AS DOUBLE) > 0.8) AS is_overspending,
       CASE WHEN income > 0 THEN {r('CAST(expense AS DOUBLE) / CAST(income AS DOUBLE) * 100.0')} ELSE 0.0 END AS ratio,
       CASE WHEN NOT income > 0 THEN 'Add income transactions to enable overspending analysis.'
            WHEN CAST(expense AS DOUBLE) / CAST(income AS DOUBLE) > 0.8 THEN 'Warning: You have spent over 80% of your income.'
            ELSE 'Your spending is currently within a manageable range.' END AS message
FROM ut"""

ORACLE["latest_transactions"] = with_(TX_ORDERS) + f"""
SELECT id, user_id, {d('amount')} AS amount, category, type, description, strftime(date, '%Y-%m-%d') AS date, rank
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date DESC, id DESC) AS rank FROM txo)
WHERE rank <= 5"""

ORACLE["top_categories_by_month"] = with_(*TX_BASE, MONTH_CAT) + f"""
SELECT user_id, {ml('month')} AS month, category, {d('amount')} AS amount, rank
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, month ORDER BY amount DESC, category) AS rank FROM mc)
WHERE rank <= 5"""

ORACLE["top_categories_latest"] = with_(*TX_BASE, MONTH_CAT, MONTH_RANKS) + f"""
, cur AS (SELECT mc.*, SUM(mc.amount) OVER (PARTITION BY mc.user_id) AS month_expense,
                 row_number() OVER (PARTITION BY mc.user_id ORDER BY mc.amount DESC, mc.category) AS rank
          FROM mc JOIN mr ON mr.user_id = mc.user_id AND mr.month = mc.month AND mr.mrank = 1)
SELECT user_id, {ml('month')} AS month, category, {d('amount')} AS amount,
       {r(pct('amount', 'month_expense'))} AS share_of_current_expense, rank
FROM cur WHERE rank <= 5"""

ORACLE["highest_month"] = with_(*TX_BASE, MONTH_TOTALS) + f"""
SELECT user_id, {ml('month')} AS month, {d('expense')} AS total_expense
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY expense DESC, month) AS rn FROM mt)
WHERE rn = 1"""

ORACLE["mom_change"] = with_(*TX_BASE, EXP_MONTHS) + f"""
SELECT user_id, {ml('month')} AS month, {d('amount')} AS amount, {d('prev')} AS prev_amount,
       CASE WHEN prev > 0 THEN {r('CAST(amount - prev AS DOUBLE) / CAST(prev AS DOUBLE) * 100.0')} END AS change_percent
FROM (SELECT *, lag(amount) OVER (PARTITION BY user_id ORDER BY month) AS prev FROM em)"""

_INCREASES = """inc AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY change_percent DESC, category) AS rank
  FROM (SELECT *, CAST(ROUND(CAST(chg AS DECIMAL(38,6)), 2) AS DOUBLE) AS change_percent
        FROM (SELECT user_id, category, cur, prev,
                     CAST(cur - prev AS DOUBLE) / CAST(prev AS DOUBLE) * 100.0 AS chg
              FROM (SELECT f.user_id, f.category,
                           SUM(CASE WHEN mr.mrank = 1 THEN f.amount END) AS cur,
                           SUM(CASE WHEN mr.mrank = 2 THEN f.amount END) AS prev
                    FROM fact f JOIN mr ON mr.user_id = f.user_id AND mr.month = f.month AND mr.mrank <= 2
                    WHERE f.type = 'Expense' GROUP BY f.user_id, f.category)
              WHERE cur IS NOT NULL AND prev > 0)
        WHERE chg > 0))"""

ORACLE["category_increases"] = with_(*TX_BASE, MONTH_RANKS, _INCREASES) + f"""
SELECT user_id, category, {d('prev')} AS previous, {d('cur')} AS current, change_percent, rank
FROM inc WHERE rank <= 5"""

ORACLE["category_overspend_alerts"] = with_(*TX_BASE) + f"""
, g AS (SELECT user_id, category,
               SUM(CASE WHEN month = {AS_OF_MONTH} THEN amount END) AS cur,
               SUM(CASE WHEN month < {AS_OF_MONTH} THEN amount END) AS hist
        FROM fact WHERE type = 'Expense' AND month >= {AS_OF_MONTH} - INTERVAL 6 MONTH AND month <= {AS_OF_MONTH}
        GROUP BY user_id, category)
, a AS (SELECT *, CAST(cur * 6 - hist AS DOUBLE) / CAST(hist AS DOUBLE) AS inc
        FROM g WHERE cur IS NOT NULL AND hist > 0)
SELECT user_id, category, {d('cur')} AS current_total, {r('CAST(hist AS DOUBLE) / 6.0')} AS six_month_average,
       {r('inc * 100.0', 1)} AS increase_percent,
       'Overspending alert: ' || category || ' spending is ' || {f('inc * 100.0', 1)}
         || '% above your 6-month average this month.' AS message
FROM a WHERE inc > 0.30"""


# ---- budgets ---------------------------------------------------------------------
_B = [USERS, TX_FULL, FACT, DEFAULTS, BUDGETS, BUDGETS_EFF]

ORACLE["budgets_with_defaults"] = with_(USERS, DEFAULTS, BUDGETS, BUDGETS_EFF) + f"""
SELECT user_id, category, {d('monthly_budget')} AS monthly_budget, is_default FROM beff"""


def _alerts_sql(fact: str = "fact") -> str:
    return f"""(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY usage_percent DESC, idx, category) AS rank
  FROM (SELECT b.user_id, b.category, b.idx, {d('b.monthly_budget')} AS budget,
               {d('COALESCE(s.spent, 0)')} AS spent, ratio,
               {r('ratio * 100.0', 1)} AS usage_percent, ratio >= 1.0 AS is_exceeded,
               'Alert: You have used ' || {f('ratio * 100.0', 1)} || '% of your monthly ' || lower(b.category)
                 || ' budget.' AS message
        FROM (SELECT *, 0 AS z FROM beff) b
        LEFT JOIN (SELECT user_id, category, SUM(amount) AS spent FROM {fact}
                   WHERE type = 'Expense' AND month = {AS_OF_MONTH} GROUP BY 1, 2) s
          ON s.user_id = b.user_id AND s.category = b.category,
        LATERAL (SELECT CASE WHEN b.monthly_budget > 0
                   THEN CAST(COALESCE(s.spent, 0) AS DOUBLE) / CAST(b.monthly_budget AS DOUBLE) ELSE 0.0 END AS ratio)
        WHERE ratio >= 0.85))"""


ORACLE["budget_alerts"] = with_(*_B) + f"""
SELECT user_id, category, budget, spent, usage_percent, is_exceeded, message, rank FROM {_alerts_sql()}"""

ORACLE["budget_usage_latest"] = with_(*_B, MONTH_RANKS) + f"""
, lm AS (SELECT user_id, month FROM mr WHERE mrank = 1)
, sp AS (SELECT f.user_id, f.category, SUM(f.amount) AS spent FROM fact f
         JOIN lm ON lm.user_id = f.user_id AND lm.month = f.month WHERE f.type = 'Expense' GROUP BY 1, 2)
, u AS (SELECT b.user_id, lm.month, b.category, b.idx, COALESCE(sp.spent, 0) AS spent, b.monthly_budget,
               {r(pct('COALESCE(sp.spent, 0)', 'b.monthly_budget'))} AS usage_percent
        FROM beff b JOIN lm ON lm.user_id = b.user_id
        LEFT JOIN sp ON sp.user_id = b.user_id AND sp.category = b.category)
SELECT user_id, {ml('month')} AS month, category, {d('spent')} AS spent, {d('monthly_budget')} AS budget,
       usage_percent, row_number() OVER (PARTITION BY user_id ORDER BY usage_percent DESC, idx, category) AS rank
FROM u"""


def _cands_sql(fact: str) -> str:
    return f"""(SELECT a.user_id, a.category, '2001-01' AS month, t.th AS threshold_percent, a.usage_percent,
         a.budget, a.spent, a.idx,
         'You crossed ' || CAST(t.th AS VARCHAR) || '% of your monthly ' || lower(a.category) || ' budget ('
           || {f('a.usage_percent', 1)} || '% used).' AS message
  FROM {_alerts_sql(fact)} a, (VALUES (85), (100)) t(th) WHERE a.usage_percent >= t.th)"""


ORACLE["budget_crossings_new"] = with_(*_B) + f"""
, fact_mid AS (SELECT user_id, month, type, category, SUM(amount) AS amount FROM tx
               WHERE date <= DATE '2001-01-15' GROUP BY 1, 2, 3, 4)
, fresh AS (SELECT * FROM {_cands_sql('fact')} c
            WHERE NOT EXISTS (SELECT 1 FROM {_cands_sql('fact_mid')} p
                              WHERE p.user_id = c.user_id AND p.category = c.category
                                AND p.month = c.month AND p.threshold_percent = c.threshold_percent))
SELECT user_id, category, month, threshold_percent, usage_percent, budget, spent, message,
       row_number() OVER (PARTITION BY user_id ORDER BY threshold_percent DESC, usage_percent DESC, idx, category) AS rank
FROM fresh"""

ORACLE["expense_forecast"] = with_(*TX_BASE, EXP_MONTHS) + f"""
, ix AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY month) - 1 AS x FROM em)
, g AS (SELECT user_id, COUNT(*) AS n, CAST(SUM(CAST(amount AS DECIMAL(20,2))) AS DECIMAL(38,2)) AS sy,
               CAST(SUM(x * CAST(amount AS DECIMAL(20,2))) AS DECIMAL(38,2)) AS sxy, max(month) AS last_month
        FROM ix GROUP BY user_id)
, seen AS (SELECT user_id, COUNT(*) FILTER (type = 'Expense') AS n_exp FROM fact GROUP BY user_id)
SELECT u.id AS user_id,
       CASE WHEN seen.user_id IS NULL THEN 'insufficient-data' WHEN seen.n_exp = 0 THEN 'no-expenses'
            WHEN g.n IS NULL THEN 'invalid-dates'
            WHEN g.n = 1 THEN 'limited-history' ELSE 'predicted' END AS status,
       CASE WHEN g.n >= 2 THEN {r('greatest(CAST(g.sxy * 6 - g.sy * (2 * (g.n - 1)) AS DOUBLE) / CAST(g.n * (g.n - 1) AS DOUBLE), 0.0)')}
            WHEN g.n = 1 THEN {d('g.sy')} ELSE 0.0 END AS predicted_expense,
       CASE WHEN g.n >= 2 THEN {ml('g.last_month + INTERVAL 1 MONTH')} END AS next_month,
       CASE WHEN g.n >= 2 THEN g.n END AS months_used,
       CASE WHEN g.n >= 2 THEN {r('CAST(g.sxy * 12 - g.sy * (6 * (g.n - 1)) AS DOUBLE) / CAST(g.n * (g.n * g.n - 1) AS DOUBLE)')} END AS trend_slope,
       CASE WHEN g.n >= 2 THEN {r('CAST(g.sy AS DOUBLE) / CAST(g.n AS DOUBLE)')} END AS average_monthly_expense
FROM users_v u LEFT JOIN seen ON seen.user_id = u.id LEFT JOIN g ON g.user_id = u.id"""


# ---- rule-based insights -----------------------------------------------------------
ORACLE["global_suggestions"] = with_(*TX_BASE, USER_TOTALS) + """
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY k) AS seq, message FROM (
  SELECT user_id, 1 AS k, 'Add transactions to unlock AI suggestions.' AS message FROM ut WHERE n_fact = 0
  UNION ALL
  SELECT user_id, 2, 'Add at least one income transaction so AI suggestions can be calculated.'
  FROM ut WHERE n_fact > 0 AND NOT income > 0
  UNION ALL
  SELECT user_id, 3, 'Food spending is above 30% of income. Consider reducing dining out.'
  FROM ut WHERE n_fact > 0 AND income > 0 AND COALESCE(food, 0) * 10 > income * 3
  UNION ALL
  SELECT user_id, 4, 'Savings are below 20% of income. Consider setting a stricter budget.'
  FROM ut WHERE n_fact > 0 AND income > 0 AND (income - expense) * 5 < income
  UNION ALL
  SELECT user_id, 5, 'Your spending and savings pattern looks healthy. Keep tracking consistently.'
  FROM ut WHERE n_fact > 0 AND income > 0 AND NOT (COALESCE(food, 0) * 10 > income * 3)
    AND NOT ((income - expense) * 5 < income))"""

ORACLE["period_suggestions"] = with_(*TX_BASE, USER_TOTALS, EXP_MONTHS) + f"""
, ut2 AS (SELECT * FROM ut WHERE n_fact > 0)
, cats AS (SELECT user_id, category, SUM(amount) AS amount FROM fact WHERE type = 'Expense' GROUP BY 1, 2)
, two AS (SELECT user_id, max(CASE WHEN rn = 1 THEN amount END) AS cur, max(CASE WHEN rn = 2 THEN amount END) AS prev
          FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY month DESC) AS rn FROM em)
          WHERE rn <= 2 GROUP BY 1)
, top AS (SELECT user_id, string_agg(category, ', ' ORDER BY rk) AS names
          FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY amount DESC, category) AS rk FROM cats)
          WHERE rk <= 3 GROUP BY 1)
, rules AS (
  SELECT user_id, 1 AS rule, '' AS sub,
         'Your savings are ' || {f(r(pct('income - expense', 'income')), 1)}
         || '% of income. Consider a budget that protects at least 20% for savings.' AS message
  FROM ut2 WHERE income > 0 AND CAST(income - expense AS DOUBLE) / CAST(income AS DOUBLE) < 0.2
  UNION ALL
  SELECT c.user_id, 2, c.category,
         c.category || ' spending is taking ' || {f('CAST(c.amount AS DOUBLE) / CAST(u.income AS DOUBLE) * 100.0', 1)}
         || '% of your income. Review this category for possible cuts.'
  FROM cats c JOIN ut2 u ON u.user_id = c.user_id
  WHERE u.income > 0 AND CAST(c.amount AS DOUBLE) / CAST(u.income AS DOUBLE) > 0.30
  UNION ALL
  SELECT user_id, 3, '', 'This month''s expenses are up ' || {f('up * 100.0', 1)}
         || '% compared to last month. Investigate the categories driving the increase.'
  FROM (SELECT user_id, CAST(cur - prev AS DOUBLE) / CAST(prev AS DOUBLE) AS up FROM two WHERE prev > 0)
  WHERE up > 0.40
  UNION ALL
  SELECT user_id, 4, '', 'Your top spending categories are ' || names
         || '. Reviewing these first will have the biggest impact.' FROM top)
, allr AS (
  SELECT * FROM rules
  UNION ALL
  SELECT user_id, 5, '', 'Your spending is balanced right now. Continue logging transactions consistently to keep insights accurate.'
  FROM ut2 WHERE user_id NOT IN (SELECT user_id FROM rules)
  UNION ALL
  SELECT user_id, 0, '', 'Add income and expense transactions to unlock personalized financial suggestions.'
  FROM ut WHERE n_fact = 0)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY rule, sub) AS seq, message FROM allr"""

_LT = """lt AS (
  SELECT mt.user_id,
         max(CASE WHEN mrank = 1 THEN mt.month END) AS cur_month, max(CASE WHEN mrank = 1 THEN income END) AS inc,
         max(CASE WHEN mrank = 1 THEN expense END) AS exp, max(CASE WHEN mrank = 2 THEN mt.month END) AS prev_month,
         max(CASE WHEN mrank = 2 THEN income END) AS prev_inc, max(CASE WHEN mrank = 2 THEN expense END) AS prev_exp
  FROM mt JOIN mr ON mr.user_id = mt.user_id AND mr.month = mt.month AND mr.mrank <= 2 GROUP BY mt.user_id)"""

_USAGE = f"""usage AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY usage_percent DESC, idx, category) AS rank
  FROM (SELECT b.user_id, b.category, b.idx, CAST(COALESCE(sp.spent, 0) AS DOUBLE) AS spent,
               CAST(b.monthly_budget AS DOUBLE) AS budget,
               {pct('COALESCE(sp.spent, 0)', 'b.monthly_budget')} AS usage,
               {r(pct('COALESCE(sp.spent, 0)', 'b.monthly_budget'))} AS usage_percent
        FROM beff b JOIN (SELECT user_id, month FROM mr WHERE mrank = 1) lm ON lm.user_id = b.user_id
        LEFT JOIN (SELECT f.user_id, f.category, SUM(f.amount) AS spent FROM fact f
                   JOIN mr ON mr.user_id = f.user_id AND mr.month = f.month AND mr.mrank = 1
                   WHERE f.type = 'Expense' GROUP BY 1, 2) sp
          ON sp.user_id = b.user_id AND sp.category = b.category))"""

ORACLE["context_alerts"] = with_(*_B, MONTH_TOTALS, MONTH_RANKS, _LT, _USAGE) + f"""
, allr AS (
  SELECT user_id, 0 AS grp, -1 AS idx, '' AS category,
         'Current month expenses are ' || {f('ratio * 100.0', 1)} || '% of income, above the 80% threshold.' AS message
  FROM (SELECT user_id, CAST(exp AS DOUBLE) / CAST(inc AS DOUBLE) AS ratio FROM lt WHERE inc > 0) WHERE ratio > 0.8
  UNION ALL
  SELECT user_id, 1, idx, category,
         category || ' budget is at ' || {f('usage', 1)} || '% usage this month (Rs. ' || {f('spent', 2)}
         || ' / Rs. ' || {f('budget', 2)} || ').'
  FROM usage WHERE budget > 0 AND usage >= 85.0
  UNION ALL
  SELECT id, 0, -1, '', 'Add more transactions to unlock personalized insights.'
  FROM users_v WHERE id NOT IN (SELECT user_id FROM fact))
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY grp, idx, category) AS seq, message FROM allr"""

ORACLE["personalized_suggestions"] = with_(*_B, MONTH_TOTALS, MONTH_RANKS, MONTH_CAT, _LT, _USAGE, _INCREASES) + f"""
, top AS (SELECT user_id, category,
                 {r(pct('amount', 'month_expense'))} AS share
          FROM (SELECT mc.*, SUM(mc.amount) OVER (PARTITION BY mc.user_id) AS month_expense,
                       row_number() OVER (PARTITION BY mc.user_id ORDER BY mc.amount DESC, mc.category) AS rk
                FROM mc JOIN mr ON mr.user_id = mc.user_id AND mr.month = mc.month AND mr.mrank = 1)
          WHERE rk <= 5)
, shares AS (SELECT user_id, max(CASE WHEN category = 'Food' THEN share END) AS food,
                    max(CASE WHEN category = 'Shopping' THEN share END) AS shopping,
                    max(CASE WHEN category = 'Entertainment' THEN share END) AS entertainment
             FROM top GROUP BY 1)
, inc5 AS (SELECT * FROM inc WHERE rank <= 5)
, rules AS (
  SELECT user_id, 100 AS priority, 0 AS ord, 'warning' AS type, 'Low Savings Rate' AS title,
         'Your savings this month are ' || {f('sr', 1)}
         || '% of income. Set a target of at least 20% and cap non-essential spending.' AS message
  FROM (SELECT user_id, inc, {r(pct('inc - exp', 'inc'))} AS sr FROM lt) WHERE inc > 0 AND sr < 20
  UNION ALL
  SELECT user_id, 95, 0, 'danger', 'Overspending Risk',
         'Expenses are ' || {f('er * 100.0', 1)} || '% of your income this month. Delay optional purchases until savings recover.'
  FROM (SELECT user_id, CAST(exp AS DOUBLE) / CAST(inc AS DOUBLE) AS er FROM lt WHERE inc > 0) WHERE er > 0.8
  UNION ALL
  SELECT s.user_id, 90, 0, 'warning', 'High Food Spending',
         'Food spending is ' || {f('s.food', 1)} || '% of your current month expenses. Consider reducing restaurant and delivery orders.'
  FROM shares s JOIN lt ON lt.user_id = s.user_id WHERE lt.inc > 0 AND s.food > 30.0
  UNION ALL
  SELECT user_id, 80, rank, 'warning', category || ' Is Rising',
         category || ' increased by ' || {f('change_percent', 1)} || '% versus last month (Rs. ' || {f('prev', 2)}
         || ' to Rs. ' || {f('cur', 2)} || ').'
  FROM inc5 WHERE change_percent > 20.0
  UNION ALL
  SELECT user_id, 75, 0, 'info', 'Discretionary Spend Check',
         'Shopping is ' || {f('shopping', 1)} || '% of this month''s expenses. Set a tighter weekly cap for discretionary purchases.'
  FROM shares WHERE shopping >= 18.0
  UNION ALL
  SELECT user_id, 75, 1, 'info', 'Discretionary Spend Check',
         'Entertainment is ' || {f('entertainment', 1)} || '% of this month''s expenses. Set a tighter weekly cap for discretionary purchases.'
  FROM shares WHERE entertainment >= 18.0
  UNION ALL
  SELECT user_id, 70, 0, 'info', 'Transport Cost Optimization',
         'Transport spending rose ' || {f('change_percent', 1)} || '% month-over-month. Try route clustering, ride sharing, or public transport passes.'
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rank) AS rt FROM inc5 WHERE lower(category) = 'transport')
  WHERE rt = 1 AND change_percent > 10.0
  UNION ALL
  SELECT user_id, 88, 0, 'danger', 'Budget Limit Near',
         category || ' has used ' || {f('usage_percent', 1)} || '% of this month''s budget. Reduce spend in this category to avoid crossing the limit.'
  FROM usage WHERE rank = 1 AND usage_percent >= 90.0)
, s50 AS (
  SELECT user_id, 50 AS priority, 0 AS ord, 'success' AS type, 'Good Spending Control' AS title,
         'Expenses are down by ' || {f('abs(delta)', 1)} || '% compared to last month. Keep this pattern to grow savings.' AS message
  FROM (SELECT *, CAST(exp - prev_exp AS DOUBLE) / CAST(prev_exp AS DOUBLE) * 100.0 AS delta FROM lt
        WHERE prev_month IS NOT NULL AND inc > 0 AND prev_exp > 0 AND user_id NOT IN (SELECT user_id FROM rules))
  WHERE delta <= 0)
, found AS (SELECT * FROM rules UNION ALL SELECT * FROM s50)
, allr AS (
  SELECT * FROM found
  UNION ALL
  SELECT user_id, 0, 0, 'success', 'Stable Month',
         'Your spending pattern looks balanced this month. Keep tracking transactions regularly.'
  FROM lt WHERE user_id NOT IN (SELECT user_id FROM found)
  UNION ALL
  SELECT id, 0, 0, 'info', 'Need More Data', 'Add income and expense transactions to unlock personalized saving suggestions.'
  FROM users_v WHERE id NOT IN (SELECT user_id FROM lt))
SELECT user_id, rank, priority, type, title, message
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY priority DESC, ord) AS rank FROM allr)
WHERE rank <= 5"""


# ---- categoriser -------------------------------------------------------------------
from centwise.functions.stop_words import ENGLISH_STOP_WORDS  # noqa: E402  (fixed values)

# A token, and the health keywords (substring match).
TOKEN_PATTERN = "[\\p{L}\\p{N}_][\\p{L}\\p{N}_]+"
HEALTH_PATTERN = ("medical|hospital|clinic|doctor|pharmacy|medicine|checkup|dental|physio|therapy|counsel|vaccin|"
                  "lab test|blood test")


_DOC_TRAIN = """SELECT DISTINCT text AS description, lang AS category FROM documents
                WHERE text IS NOT NULL AND lang IS NOT NULL"""


def _nb_model_sql(train_select: str = _DOC_TRAIN) -> str:
    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH_STOP_WORDS)
    return f"""stop AS (SELECT unnest([{stop}]) AS term),
tdocs AS (SELECT description, category, sha256(category || chr(1) || description) AS doc
          FROM ({train_select})),
ttf AS (SELECT doc, category, term, count(*) AS tf
        FROM (SELECT doc, category, unnest(regexp_extract_all(lower(description), '{TOKEN_PATTERN}')) AS term FROM tdocs)
        WHERE term NOT IN (SELECT term FROM stop) GROUP BY 1, 2, 3),
nd AS (SELECT count(*) AS n FROM tdocs),
vocab AS (SELECT term, ln(CAST(1 + n AS DOUBLE) / CAST(1 + count(*) AS DOUBLE)) + 1.0 AS idf
          FROM ttf, nd GROUP BY term, n),
tw AS (SELECT doc, category, term, tf * idf AS w FROM ttf JOIN vocab USING (term)),
tn AS (SELECT doc, category, sqrt(sum(w * w)) AS norm FROM tw GROUP BY 1, 2),
fc AS (SELECT tw.category, term, sum(w / norm) AS fc FROM tw JOIN tn USING (doc, category) GROUP BY 1, 2),
vs AS (SELECT count(*) AS v FROM vocab),
prior AS (SELECT c.category, c.doc_count, ln(CAST(c.doc_count AS DOUBLE) / CAST(nd.n AS DOUBLE)) AS log_prior,
                 ln(COALESCE(t.tot, 0.0) + CAST(vs.v AS DOUBLE)) AS log_den
          FROM (SELECT category, count(*) AS doc_count FROM tdocs GROUP BY 1) c
          LEFT JOIN (SELECT category, sum(fc) AS tot FROM fc GROUP BY 1) t USING (category), nd, vs),
nbterm AS (SELECT category, term, ln(fc + 1.0) AS log_num FROM fc)"""


ORACLE["nb_train"] = "WITH " + _nb_model_sql() + f"""
SELECT category, doc_count, {r('log_prior', 6)} AS log_prior, {r('log_den', 6)} AS log_den FROM prior"""

def _nb_predict_sql(src: str) -> str:
    """CTEs flag / best over ``src`` (doc_id, text); needs the model CTEs first."""
    return f"""flag AS (SELECT doc_id, txt, txt = '' AS blank, regexp_matches(lower(txt), '{HEALTH_PATTERN}') AS health
         FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS txt FROM ({src}))),
ptf AS (SELECT doc_id, term, count(*) AS tf
        FROM (SELECT doc_id, unnest(regexp_extract_all(lower(txt), '{TOKEN_PATTERN}')) AS term
              FROM flag WHERE NOT blank AND NOT health)
        WHERE term NOT IN (SELECT term FROM stop) GROUP BY 1, 2),
pw AS (SELECT doc_id, term, tf * idf AS w FROM ptf JOIN vocab USING (term)),
pn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM pw GROUP BY 1),
px AS (SELECT doc_id, term, w / norm AS x FROM pw JOIN pn USING (doc_id)),
sx AS (SELECT doc_id, sum(x) AS sx FROM px GROUP BY 1),
part AS (SELECT doc_id, category, sum(x * log_num) AS dot FROM px JOIN nbterm USING (term) GROUP BY 1, 2),
grid AS (SELECT f.doc_id, p.category,
                p.log_prior - p.log_den * COALESCE(sx.sx, 0.0) + COALESCE(part.dot, 0.0) AS score
         FROM flag f CROSS JOIN prior p
         LEFT JOIN sx ON sx.doc_id = f.doc_id
         LEFT JOIN part ON part.doc_id = f.doc_id AND part.category = p.category
         WHERE NOT f.blank AND NOT f.health),
best AS (SELECT doc_id, category FROM
         (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, category) AS rn FROM grid) WHERE rn = 1),
pred AS (SELECT f.doc_id, CASE WHEN f.blank THEN 'Other' WHEN f.health THEN 'Health' ELSE b.category END AS category
         FROM flag f LEFT JOIN best b ON b.doc_id = f.doc_id)"""


ORACLE["nb_predict"] = "WITH " + _nb_model_sql() + ",\n" + _nb_predict_sql(
    "SELECT doc_id, text FROM documents") + """
SELECT doc_id, category FROM pred"""


# ---- cleaning and validation ---------------------------------------------------------
# Number text, date text, e-mail text.
AMOUNT_PATTERN = "^\\s*[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*$"
DATE_PATTERN = "^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"
EMAIL_PATTERN = "^[^@\\s]+@[^@\\s]+$"

RAW_TX = """raw AS (
  SELECT o_orderkey AS id, o_custkey AS user_id, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amount,
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '' ELSE o_orderpriority END AS category,
         CASE WHEN o_orderstatus = 'O' THEN 'Income' WHEN o_orderstatus = 'F' THEN 'Expense' ELSE 'expense' END AS type,
         'order ' || CAST(o_orderkey AS VARCHAR) AS description,
         CASE WHEN o_orderstatus = 'P'
              THEN CAST(year(d) AS VARCHAR) || '-' || CAST(month(d) AS VARCHAR) || '-' || CAST(day(d) AS VARCHAR)
              ELSE strftime(d, '%Y-%m-%d') END AS date
  FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders))"""


def _amt(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{AMOUNT_PATTERN}') THEN TRY_CAST(trim({x}) AS DECIMAL(18,2)) END"


def _date(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{DATE_PATTERN}') THEN CAST(TRY_STRPTIME({x}, '%Y-%m-%d') AS DATE) END"


ORACLE["clean_transactions"] = with_(RAW_TX) + f"""
SELECT id, user_id, amount, category, type, description, strftime(dt, '%Y-%m-%d') AS date,
       strftime(dt, '%Y-%m') AS month
FROM (SELECT id, user_id, CAST(COALESCE({_amt('amount')}, 0) AS DOUBLE) AS amount, category, type, description,
             {_date('date')} AS dt FROM raw)
WHERE dt IS NOT NULL"""

_TX_EXPENSE_TRAIN = """SELECT DISTINCT description, category FROM tx
                WHERE type = 'Expense' AND description IS NOT NULL AND category IS NOT NULL"""

ORACLE["validated_transactions"] = with_(USERS, TX_FULL, RAW_TX) + ", " + _nb_model_sql(_TX_EXPENSE_TRAIN) + ",\n" + \
    _nb_predict_sql("SELECT id AS doc_id, trim(description) AS text FROM raw "
                    "WHERE trim(category) = '' AND trim(type) = 'Expense'") + f"""
, t AS (SELECT id, user_id, trim(amount) AS amount_txt, trim(category) AS category, trim(type) AS type,
               trim(description) AS description, trim(date) AS date_txt FROM raw)
, p AS (SELECT t.*, {_amt('amount_txt')} AS amt, {_date('date_txt')} AS dt,
               EXISTS (SELECT 1 FROM users_v u WHERE u.id = t.user_id) AS known FROM t)
, c AS (SELECT p.*, concat_ws(',',
          CASE WHEN amt IS NULL THEN 'amount_invalid' END,
          CASE WHEN amt < 0 THEN 'amount_negative' END,
          CASE WHEN COALESCE(description, '') = '' THEN 'description_missing' END,
          CASE WHEN COALESCE(date_txt, '') = '' THEN 'date_missing' END,
          CASE WHEN COALESCE(date_txt, '') <> '' AND dt IS NULL THEN 'date_invalid' END,
          CASE WHEN COALESCE(type, '') NOT IN ('Income', 'Expense') THEN 'type_invalid' END,
          CASE WHEN NOT known THEN 'user_unknown' END) AS error_codes FROM p)
SELECT c.id, c.user_id, c.error_codes = '' AS is_valid, c.error_codes, CAST(c.amt AS DOUBLE) AS amount,
       CASE WHEN COALESCE(c.category, '') = '' THEN
            CASE WHEN c.type = 'Expense' THEN pred.category ELSE 'Income' END
            ELSE c.category END AS category,
       c.type, c.description, strftime(c.dt, '%Y-%m-%d') AS date
FROM c LEFT JOIN pred ON pred.doc_id = c.id"""

RAW_BUDGET_FORM = """form AS (
  SELECT c_custkey AS user_id, category, CAST(CAST(c_acctbal * (idx + 1) AS DECIMAL(18,2)) AS VARCHAR) AS monthly_budget,
         CAST(idx AS BIGINT) AS seq
  FROM customer, defaults
  UNION ALL
  SELECT c_custkey, category, CAST(CAST((idx + 1) * CASE WHEN c_custkey % 2 = 0 THEN 1000 ELSE -1 END AS DECIMAL(18,2)) AS VARCHAR),
         CAST(idx + 100 AS BIGINT)
  FROM customer, defaults WHERE idx % 3 = 0)"""

_VB = f"""vb AS (
  SELECT user_id, category, concat_ws(',', CASE WHEN amt IS NULL THEN 'budget_invalid' END,
                                         CASE WHEN amt < 0 THEN 'budget_negative' END) AS error_codes,
         CAST(amt AS DOUBLE) AS monthly_budget, seq
  FROM (SELECT user_id, trim(category) AS category, {_amt('monthly_budget')} AS amt, seq FROM form))"""

ORACLE["validated_budgets"] = with_(DEFAULTS, RAW_BUDGET_FORM, _VB) + """
SELECT user_id, category, error_codes = '' AS is_valid, error_codes, monthly_budget FROM vb"""

ORACLE["budgets_upsert"] = with_(DEFAULTS, BUDGETS, RAW_BUDGET_FORM, _VB) + """
, allr AS (SELECT user_id, category, monthly_budget AS b, -1 AS seq FROM budgets
           UNION ALL
           SELECT user_id, category, CAST(monthly_budget AS DECIMAL(18,2)), seq FROM vb WHERE error_codes = '')
SELECT user_id, category, CAST(arg_max(b, seq) AS DOUBLE) AS monthly_budget FROM allr GROUP BY user_id, category"""

ORACLE["validated_users"] = f"""WITH raw AS (
  SELECT c_custkey AS id, c_name AS name, lower(c_name) || '@example.com' AS email FROM customer
  UNION ALL
  SELECT c_custkey + 1000000000, c_name, '  ' || upper(lower(c_name) || '@example.com') || ' ' FROM customer
  WHERE c_acctbal < 0),
t AS (SELECT id, trim(name) AS name, lower(trim(email)) AS email FROM raw),
f AS (SELECT email, min(id) AS first_id FROM t WHERE name <> '' AND regexp_matches(email, '{EMAIL_PATTERN}') GROUP BY email),
c AS (SELECT t.*, concat_ws(',',
        CASE WHEN COALESCE(name, '') = '' THEN 'name_missing' END,
        CASE WHEN COALESCE(t.email, '') = '' THEN 'email_missing' END,
        CASE WHEN COALESCE(t.email, '') <> '' AND NOT regexp_matches(t.email, '{EMAIL_PATTERN}') THEN 'email_invalid' END,
        CASE WHEN f.first_id IS NOT NULL AND f.first_id <> t.id THEN 'email_duplicate' END) AS error_codes
      FROM t LEFT JOIN f ON f.email = t.email)
SELECT id, name, email, error_codes = '' AS is_valid, error_codes FROM c"""


# ---- event-driven crossings --------------------------------------------------------
_REPLAY = with_(USERS, DEFAULTS, BUDGETS, BUDGETS_EFF) + f""", ev AS (
  SELECT e.event_id AS id, e.user_id, b.category, strftime(CAST(e.ts AS DATE), '%Y-%m') AS month,
         CAST(e.value AS DECIMAL(18,2)) AS amount, CAST(b.monthly_budget / 100 AS DECIMAL(18,2)) AS budget
  FROM events e JOIN beff b ON b.user_id = e.user_id
    AND b.category = CASE e.event_type WHEN 'purchase' THEN 'Shopping' WHEN 'view' THEN 'Entertainment'
                                       WHEN 'click' THEN 'Food' ELSE 'Other' END
  WHERE e.event_type <> 'signup'),
run AS (SELECT *, SUM(amount) OVER (PARTITION BY user_id, category, month ORDER BY id
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM ev),
u AS (SELECT *, {r('CAST(running AS DOUBLE) / CAST(budget AS DOUBLE) * 100.0', 1)} AS usage_percent
      FROM run),
t AS (SELECT u.*, v.th FROM u, (VALUES (85), (100)) v(th) WHERE usage_percent >= v.th)
SELECT user_id, category, month, CAST(th AS INTEGER) AS threshold_percent, id,
       CAST(running AS DOUBLE) AS running_spent, usage_percent
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, category, month, th ORDER BY id) AS rn FROM t)
WHERE rn = 1"""

ORACLE["budget_crossings_replay"] = _REPLAY
ORACLE["stream_crossings"] = _REPLAY


# ---- table changes -------------------------------------------------------------------
_CHANGES = """changes AS (
  SELECT l_orderkey * 10 + l_linenumber AS seq, 'U' AS op, o_orderkey AS id, o_custkey AS user_id,
         CAST(CAST(greatest(o_totalprice - l_extendedprice, 0.0) AS DECIMAL(18,2)) AS VARCHAR) AS amount,
         o_orderpriority AS category, CASE WHEN o_orderstatus = 'O' THEN 'Income' ELSE 'Expense' END AS type,
         'order ' || CAST(o_orderkey AS VARCHAR) || ' returned line ' || CAST(l_linenumber AS VARCHAR) AS description,
         strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'
  UNION ALL
  SELECT o_orderkey * 10, 'D', o_orderkey, o_custkey, NULL, NULL, NULL, NULL, NULL
  FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW')"""

ORACLE["apply_changes"] = with_(TX_ORDERS, _CHANGES) + f"""
, lu AS (SELECT id, user_id, arg_max(amount, k) AS amount, arg_max(category, k) AS category,
                arg_max(type, k) AS type, arg_max(description, k) AS description, arg_max(date, k) AS date
         FROM (SELECT *, (seq, {_amt('amount')}) AS k FROM changes) WHERE op = 'U' GROUP BY id, user_id)
SELECT t.id, t.user_id,
       CASE WHEN lu.id IS NOT NULL THEN CAST(COALESCE({_amt('lu.amount')}, 0) AS DOUBLE) ELSE CAST(t.amount AS DOUBLE) END AS amount,
       CASE WHEN lu.id IS NOT NULL THEN lu.category ELSE t.category END AS category,
       CASE WHEN lu.id IS NOT NULL THEN lu.type ELSE t.type END AS type,
       CASE WHEN lu.id IS NOT NULL THEN lu.description ELSE t.description END AS description,
       strftime(CASE WHEN lu.id IS NOT NULL THEN {_date('lu.date')} ELSE t.date END, '%Y-%m-%d') AS date
FROM txo t LEFT JOIN lu ON lu.id = t.id AND lu.user_id = t.user_id
WHERE NOT EXISTS (SELECT 1 FROM changes c WHERE c.op = 'D' AND c.id = t.id AND c.user_id = t.user_id)"""

ORACLE["seed_income"] = with_(USERS, TX_ORDERS) + """
SELECT id AS user_id, CAST(0 AS DOUBLE) AS amount, 'Salary' AS category, 'Income' AS type, 'Initial balance setup' AS description,
       '2001-01-31' AS date
FROM users_v WHERE id NOT IN (SELECT user_id FROM txo WHERE type = 'Income')"""


# ---- dashboard (composed from the per-part oracles) ---------------------------------
def _sub(name: str) -> str:
    return "(" + ORACLE[name] + ")"


ORACLE["dashboard"] = f"""
WITH users_v AS (SELECT c_custkey AS id FROM customer)
SELECT u.id AS user_id, s.total_income, s.total_expenses, s.balance, s.savings_rate,
       CASE WHEN s.total_income > 0 THEN {r('s.total_expenses / s.total_income * 100.0')} ELSE 0.0 END AS expense_ratio,
       a.message IS NOT NULL AS is_overspending,
       COALESCE(a.message, 'Your category-wise spending is currently within expected levels.') AS overspending_message,
       g.message AS suggestion, p.title AS top_saving_action, f.predicted_expense, f.status AS forecast_status,
       COALESCE(b.n, 0) AS budget_alert_count, b.top AS top_budget_alert, COALESCE(rc.ids, '') AS recent_ids,
       f.next_month, f.months_used, f.trend_slope, f.average_monthly_expense,
       COALESCE(a.l, '[]') AS overspend_alerts, COALESCE(g.l, '[]') AS suggestions,
       COALESCE(p.l, '[]') AS saving_actions, COALESCE(b.l, '[]') AS budget_alerts,
       COALESCE(rc.l, '[]') AS recent_transactions
FROM users_v u
LEFT JOIN {_sub('user_summary')} s ON s.user_id = u.id
LEFT JOIN (SELECT user_id, arg_min(message, category) AS message, CAST(to_json(list({{'category': category,
             'current_total': current_total, 'six_month_average': six_month_average, 'increase_percent': increase_percent,
             'message': message}} ORDER BY category)) AS VARCHAR) AS l
           FROM {_sub('category_overspend_alerts')} GROUP BY 1) a
  ON a.user_id = u.id
LEFT JOIN (SELECT user_id, arg_min(message, seq) AS message,
                  CAST(to_json(list({{'message': message}} ORDER BY seq)) AS VARCHAR) AS l
           FROM {_sub('global_suggestions')} GROUP BY 1) g ON g.user_id = u.id
LEFT JOIN (SELECT user_id, arg_min(title, rank) AS title, CAST(to_json(list({{'priority': priority, 'type': type,
             'title': title, 'message': message}} ORDER BY rank)) AS VARCHAR) AS l
           FROM {_sub('personalized_suggestions')} GROUP BY 1) p ON p.user_id = u.id
LEFT JOIN {_sub('expense_forecast')} f ON f.user_id = u.id
LEFT JOIN (SELECT user_id, count(*) AS n, arg_min(category, rank) AS top, CAST(to_json(list({{'category': category,
             'budget': budget, 'spent': spent, 'usage_percent': usage_percent, 'is_exceeded': is_exceeded,
             'message': message}} ORDER BY rank)) AS VARCHAR) AS l
           FROM {_sub('budget_alerts')} GROUP BY 1) b
  ON b.user_id = u.id
LEFT JOIN (SELECT user_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rk) AS ids, CAST(to_json(list({{'id': id,
             'amount': CAST(amount AS DOUBLE), 'category': category, 'type': type, 'description': description,
             'date': strftime(date, '%Y-%m-%d')}} ORDER BY rk)) AS VARCHAR) AS l
           FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date DESC, id DESC) AS rk
                 FROM ({with_(TX_FULL)} SELECT * FROM tx)) WHERE rk <= 5 GROUP BY 1) rc ON rc.user_id = u.id"""


# ---- questions and replies -------------------------------------------------------------
from centwise.plans import oracle_questions as _oq  # noqa: E402

_oq.build(ORACLE)


# ---- notifications and cool-down ---------------------------------------------------
ORACLE["alert_outbox"] = f"""
WITH users_v AS (SELECT c_custkey AS id, c_name AS name, lower(c_name) || '@example.com' AS email FROM customer)
SELECT e.user_id, u.email, e.category, e.month, e.threshold_percent,
       'Budget Alert: ' || CAST(e.threshold_percent AS VARCHAR) || '% crossed for ' || e.category AS subject,
       'Hi ' || COALESCE(u.name, 'User') || ',' || chr(10) || chr(10) || e.message || chr(10)
         || 'Month: ' || e.month || chr(10) || 'Category: ' || e.category || chr(10)
         || 'Spent: Rs. ' || {f('e.spent', 2)} || chr(10) || 'Budget: Rs. ' || {f('e.budget', 2)} || chr(10)
         || 'Usage: ' || {f('e.usage_percent', 1)} || '%' || chr(10) || chr(10)
         || 'Please review your budget settings and recent transactions.' || chr(10) AS body,
       CASE WHEN e.threshold_percent >= 100 THEN 'danger' ELSE 'warning' END AS severity,
       e.rank = 1 AS is_top
FROM {_sub('budget_crossings_new')} e JOIN users_v u ON u.id = e.user_id
WHERE u.email IS NOT NULL AND trim(u.email) <> ''"""

ORACLE["throttle_requests"] = """
WITH RECURSIVE req AS (
  SELECT event_id AS request_id, user_id, epoch_us(ts) AS t,
         row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS rn FROM events),
r AS (
  SELECT request_id, user_id, rn, t, t AS last, true AS accepted, CAST(0 AS BIGINT) AS remaining FROM req WHERE rn = 1
  UNION ALL
  SELECT q.request_id, q.user_id, q.rn, q.t,
         CASE WHEN q.t - r.last >= 10000000 THEN q.t ELSE r.last END,
         q.t - r.last >= 10000000,
         CASE WHEN q.t - r.last >= 10000000 THEN 0 ELSE greatest(1, (10000000 - (q.t - r.last)) // 1000000) END
  FROM r JOIN req q ON q.user_id = r.user_id AND q.rn = r.rn + 1)
SELECT request_id, user_id, accepted, remaining AS remaining_seconds FROM r"""


# ---- streaming categoriser: same answer as the batch prediction -----------------
ORACLE["stream_categorize"] = ORACLE["nb_predict"]


# ---- reports -------------------------------------------------------------------------
from centwise.plans import oracle_reports as _orp  # noqa: E402

_orp.build(ORACLE)


# ---- lookups and counts ------------------------------------------------------------
ORACLE["transaction_lookup"] = with_(TX_ORDERS, _CHANGES) + """
SELECT id, user_id, CAST(amount AS DOUBLE) AS amount, category, type, description, strftime(date, '%Y-%m-%d') AS date
FROM txo WHERE EXISTS (SELECT 1 FROM changes c WHERE c.id = txo.id AND c.user_id = txo.user_id)"""

ORACLE["report_transaction_counts"] = with_(_orp.REQ, _orp.RQ, _orp.TXALL) + """
SELECT r.request_id, count(t.id) AS monthly_transaction_count
FROM rq r LEFT JOIN txall t ON t.user_id = r.user_id
  AND CASE WHEN r.report_type = 'yearly' THEN CAST(year(t.date) AS VARCHAR) = r.year ELSE t.month = r.month_start END
GROUP BY r.request_id"""


# ---- JSON feed (amounts stay below 1e7 here, where both engines print plain decimals) ----
ORACLE["transactions_feed"] = with_(TX_ORDERS) + """
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY date DESC, id DESC) AS rank,
       CAST(to_json({'id': id, 'user_id': user_id, 'amount': CAST(amount AS DOUBLE), 'category': category,
                     'type': type, 'description': description, 'date': strftime(date, '%Y-%m-%d')}) AS VARCHAR) AS json
FROM txo"""


# ---- chart payload as JSON (per-user totals stay below 1e7 here, where both engines print plain decimals) ----
ORACLE["chart_payload"] = f"""
WITH users_v AS (SELECT c_custkey AS id FROM customer),
cd AS (SELECT user_id, list({{'category': category, 'amount': amount}} ORDER BY rank) AS l
       FROM {_sub('category_distribution')} GROUP BY user_id),
ms AS (SELECT user_id, list({{'month': month, 'amount': amount}} ORDER BY month) AS l
       FROM {_sub('monthly_spending')} GROUP BY user_id),
sv AS (SELECT user_id, list({{'month': month, 'income': income, 'expense': expense, 'savings': savings}} ORDER BY month) AS l
       FROM {_sub('income_expense_savings')} GROUP BY user_id)
SELECT s.user_id, CAST(to_json({{
  'summary': {{'total_income': s.total_income, 'total_expenses': s.total_expenses, 'balance': s.balance,
               'savings_rate': s.savings_rate}},
  'prediction': {{'predicted_expense': f.predicted_expense, 'status': f.status, 'next_month': f.next_month,
                  'months_used': f.months_used}},
  'category_distribution': COALESCE(cd.l, []),
  'monthly_spending': COALESCE(ms.l, []),
  'savings_vs_expenses': COALESCE(sv.l, [])}}) AS VARCHAR) AS payload_json
FROM {_sub('user_summary')} s
LEFT JOIN {_sub('expense_forecast')} f ON f.user_id = s.user_id
LEFT JOIN cd ON cd.user_id = s.user_id LEFT JOIN ms ON ms.user_id = s.user_id LEFT JOIN sv ON sv.user_id = s.user_id"""


# ---- chart payload of each report request: its period, its compare range, all history for the forecast ----
ORACLE["chart_payload_requests"] = with_(_orp.REQ, _orp.RQ, _orp.TXALL) + f""",
scoped AS (
  SELECT r.request_id, t.* FROM rq r JOIN txall t ON t.user_id = r.user_id
  WHERE r.whole OR CASE WHEN r.report_type = 'yearly' THEN CAST(year(t.date) AS VARCHAR) = r.year
                        ELSE t.month = r.month_start END),
tot AS (SELECT r.request_id, COALESCE(SUM(CASE WHEN s.type = 'Income' THEN s.amount END), 0) AS income,
               COALESCE(SUM(CASE WHEN s.type = 'Expense' THEN s.amount END), 0) AS expense
        FROM rq r LEFT JOIN scoped s ON s.request_id = r.request_id GROUP BY r.request_id),
cat AS (SELECT request_id, COALESCE(NULLIF(category, ''), 'Other') AS category, SUM(amount) AS amount
        FROM scoped WHERE type = 'Expense' GROUP BY 1, 2),
cd AS (SELECT request_id, list({{'category': category, 'amount': CAST(amount AS DOUBLE)}} ORDER BY amount DESC, category) AS l
       FROM cat GROUP BY request_id),
mon AS (SELECT request_id, month, SUM(amount) AS amount FROM scoped WHERE type = 'Expense' GROUP BY 1, 2),
ms AS (SELECT request_id, list({{'month': {ml('month')}, 'amount': CAST(amount AS DOUBLE)}} ORDER BY month) AS l
       FROM mon GROUP BY request_id),
lm AS (SELECT user_id, max(month) AS latest FROM txall GROUP BY user_id),
ies AS (SELECT t.user_id, t.month, lm.latest, COALESCE(SUM(CASE WHEN type = 'Income' THEN amount END), 0) AS income,
               COALESCE(SUM(CASE WHEN type <> 'Income' THEN amount END), 0) AS expense
        FROM txall t JOIN lm ON lm.user_id = t.user_id GROUP BY 1, 2, 3),
sv AS (SELECT r.request_id, list({{'month': {ml('i.month')}, 'income': CAST(i.income AS DOUBLE),
                                   'expense': CAST(i.expense AS DOUBLE), 'savings': CAST(i.income - i.expense AS DOUBLE)}}
                                 ORDER BY i.month) AS l
       FROM rq r JOIN ies i ON i.user_id = r.user_id AND i.month > i.latest - to_months(r.compare_months)
       GROUP BY r.request_id)
SELECT r.request_id, r.user_id, CAST(to_json({{
  'summary': {{'total_income': CAST(tot.income AS DOUBLE), 'total_expenses': CAST(tot.expense AS DOUBLE),
               'balance': CAST(tot.income - tot.expense AS DOUBLE),
               'savings_rate': {r(pct('tot.income - tot.expense', 'tot.income'))}}},
  'prediction': {{'predicted_expense': f.predicted_expense, 'status': f.status, 'next_month': f.next_month,
                  'months_used': f.months_used}},
  'category_distribution': COALESCE(cd.l, []),
  'monthly_spending': COALESCE(ms.l, []),
  'savings_vs_expenses': COALESCE(sv.l, [])}}) AS VARCHAR) AS payload_json
FROM rq r JOIN tot USING (request_id) LEFT JOIN {_sub('expense_forecast')} f ON f.user_id = r.user_id
LEFT JOIN cd ON cd.request_id = r.request_id LEFT JOIN ms ON ms.request_id = r.request_id
LEFT JOIN sv ON sv.request_id = r.request_id"""


# ---- financial context as JSON (same plain-decimal condition as the chart payload) ----
def _summ(a: str) -> str:
    return (f"{{'total_income': {a}.total_income, 'total_expense': {a}.total_expense, 'balance': {a}.balance, "
            f"'savings_rate': {a}.savings_rate}}")


ORACLE["financial_context"] = f"""
WITH users_v AS (SELECT c_custkey AS id FROM customer),
ms AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY month DESC) AS rk FROM {_sub('monthly_summary')}),
top AS (SELECT user_id, list({{'category': category, 'amount': amount, 'share_of_current_expense': share_of_current_expense}}
                             ORDER BY rank) AS l FROM {_sub('top_categories_latest')} GROUP BY user_id),
trend AS (SELECT user_id, list({{'month': month, 'amount': total_expense}} ORDER BY month) AS l FROM ms GROUP BY user_id),
bym AS (SELECT user_id, map_from_entries(list({{'k': month, 'v': {_summ('ms')}}} ORDER BY month)) AS m
        FROM ms GROUP BY user_id),
inc AS (SELECT user_id, list({{'category': category, 'previous': previous, 'current': current,
                              'change_percent': change_percent}} ORDER BY rank) AS l
        FROM {_sub('category_increases')} GROUP BY user_id),
al AS (SELECT user_id, list(message ORDER BY seq) AS l FROM {_sub('context_alerts')} GROUP BY user_id),
bu AS (SELECT user_id, list({{'category': category, 'spent': spent, 'budget': budget, 'usage_percent': usage_percent}}
                            ORDER BY rank) AS l FROM {_sub('budget_usage_latest')} GROUP BY user_id)
SELECT ov.user_id, CAST(to_json({{
  'currency': 'Rs',
  'overall': {{'total_income': ov.total_income, 'total_expense': ov.total_expenses, 'balance': ov.balance,
               'savings_rate': ov.savings_rate}},
  'current_month': CASE WHEN c.month IS NOT NULL THEN {{'period': c.month, 'summary': {_summ('c')}}} END,
  'previous_month': CASE WHEN p.month IS NOT NULL THEN {{'period': p.month, 'summary': {_summ('p')}}} END,
  'top_categories': COALESCE(top.l, []),
  'monthly_spending_trend': COALESCE(trend.l, []),
  'monthly_summary_by_month': COALESCE(bym.m, MAP {{}}),
  'categories_increased': COALESCE(inc.l, []),
  'overspending_alerts': COALESCE(al.l, []),
  'budget_usage': COALESCE(bu.l, [])}}) AS VARCHAR) AS context_json
FROM {_sub('user_summary')} ov
LEFT JOIN ms c ON c.user_id = ov.user_id AND c.rk = 1
LEFT JOIN ms p ON p.user_id = ov.user_id AND p.rk = 2
LEFT JOIN top ON top.user_id = ov.user_id LEFT JOIN trend ON trend.user_id = ov.user_id
LEFT JOIN bym ON bym.user_id = ov.user_id LEFT JOIN inc ON inc.user_id = ov.user_id
LEFT JOIN al ON al.user_id = ov.user_id LEFT JOIN bu ON bu.user_id = ov.user_id"""

from centwise.plans import oracle_tables as _ot  # noqa: E402

_ot.fill(ORACLE, _B, _cands_sql, _nb_model_sql, _nb_predict_sql, _CHANGES)
