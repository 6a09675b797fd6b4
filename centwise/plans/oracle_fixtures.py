"""The FIXTURES.md section 4 views as DuckDB SQL (independent of the Spark code).

Each constant is a list of ``name AS (...)`` CTE bodies; ``with_(...)`` joins the
ones a query needs.  Helpers mirror the numeric rules of
``centwise.functions.columns``.
"""

from __future__ import annotations


def r(x: str, n: int = 2) -> str:
    return f"CAST(ROUND(CAST(({x}) AS DECIMAL(38,6)), {n}) AS DOUBLE)"


def f(x: str, n: int) -> str:
    return f"CAST(CAST(ROUND(CAST(({x}) AS DECIMAL(38,6)), {n}) AS DECIMAL(38,{n})) AS VARCHAR)"


def d(x: str) -> str:
    return f"CAST(({x}) AS DOUBLE)"


def pct(num: str, den: str) -> str:
    return f"CASE WHEN ({den}) > 0 THEN CAST(({num}) AS DOUBLE) / CAST(({den}) AS DOUBLE) * 100.0 ELSE 0.0 END"


def ml(x: str) -> str:
    return f"strftime({x}, '%Y-%m')"


USERS = """users_v AS (
  SELECT c_custkey AS id, c_name AS name, lower(c_name) || '@example.com' AS email FROM customer)"""

TX_FULL = """tx AS (
  SELECT o_orderkey * 10 AS id, o_custkey AS user_id, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
         'Salary' AS category, 'Income' AS type, 'monthly salary credit' AS description,
         CAST(o_orderdate AS DATE) AS date, date_trunc('month', CAST(o_orderdate AS DATE)) AS month
  FROM orders
  UNION ALL
  SELECT l_orderkey * 10 + l_linenumber, o_custkey, CAST(l_extendedprice AS DECIMAL(18,2)),
         CASE WHEN p_brand = 'Brand#25' THEN 'Other'
              WHEN p_type LIKE 'STANDARD%' THEN 'Food'
              WHEN p_type LIKE 'ECONOMY%' THEN 'Transport'
              WHEN p_type LIKE 'MEDIUM%' THEN 'Bills'
              WHEN p_type LIKE 'SMALL%' THEN 'Entertainment'
              WHEN p_type LIKE 'LARGE%' THEN 'Health'
              WHEN p_type LIKE 'PROMO%' THEN 'Shopping'
              ELSE 'Other' END,
         'Expense', p_name, CAST(l_shipdate AS DATE), date_trunc('month', CAST(l_shipdate AS DATE))
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

TX_ORDERS = """txo AS (
  SELECT o_orderkey AS id, o_custkey AS user_id, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
         o_orderpriority AS category, CASE WHEN o_orderstatus = 'O' THEN 'Income' ELSE 'Expense' END AS type,
         'order ' || CAST(o_orderkey AS VARCHAR) AS description, CAST(o_orderdate AS DATE) AS date,
         date_trunc('month', CAST(o_orderdate AS DATE)) AS month
  FROM orders)"""

FACT = """fact AS (
  SELECT user_id, month, type, category, SUM(amount) AS amount, COUNT(*) AS n_tx
  FROM tx GROUP BY user_id, month, type, category)"""

MONTH_TOTALS = """mt AS (
  SELECT user_id, month,
         COALESCE(SUM(CASE WHEN type = 'Income' THEN amount END), 0) AS income,
         COALESCE(SUM(CASE WHEN type = 'Expense' THEN amount END), 0) AS expense
  FROM fact GROUP BY user_id, month)"""

MONTH_RANKS = """mr AS (
  SELECT user_id, month, row_number() OVER (PARTITION BY user_id ORDER BY month DESC) AS mrank
  FROM (SELECT DISTINCT user_id, month FROM fact))"""

EXP_MONTHS = """em AS (
  SELECT user_id, month, SUM(amount) AS amount FROM fact WHERE type = 'Expense' GROUP BY user_id, month)"""

MONTH_CAT = """mc AS (
  SELECT user_id, month, category, SUM(amount) AS amount FROM fact WHERE type = 'Expense'
  GROUP BY user_id, month, category)"""

USER_TOTALS = """ut AS (
  SELECT u.id AS user_id,
         COALESCE(SUM(CASE WHEN f.type = 'Income' THEN f.amount END), 0) AS income,
         COALESCE(SUM(CASE WHEN f.type = 'Expense' THEN f.amount END), 0) AS expense,
         SUM(CASE WHEN f.type = 'Expense' AND lower(f.category) = 'food' THEN f.amount END) AS food,
         COUNT(f.user_id) AS n_fact
  FROM users_v u LEFT JOIN fact f ON f.user_id = u.id GROUP BY u.id)"""

DEFAULTS = """defaults AS (
  SELECT * FROM (VALUES (0, 'Food', 12000.0), (1, 'Transport', 6000.0), (2, 'Bills', 9000.0),
                        (3, 'Entertainment', 5000.0), (4, 'Health', 7000.0), (5, 'Shopping', 8000.0),
                        (6, 'Other', 4000.0)) AS t(idx, category, base))"""

BUDGETS = """budgets AS (
  SELECT c_custkey AS user_id, category,
         CAST(20000 + 15000 * ((c_custkey * 7 + idx) % 5) AS DECIMAL(18,2)) AS monthly_budget
  FROM customer, defaults WHERE (c_custkey + idx) % 4 <> 0)"""

BUDGETS_EFF = """beff AS (
  SELECT u.id AS user_id, d.category, d.idx,
         COALESCE(b.monthly_budget, CAST(d.base * 5 AS DECIMAL(18,2))) AS monthly_budget,
         b.user_id IS NULL AS is_default
  FROM users_v u CROSS JOIN defaults d
  LEFT JOIN budgets b ON b.user_id = u.id AND b.category = d.category
  UNION ALL
  SELECT b.user_id, b.category, 99, b.monthly_budget, false
  FROM budgets b WHERE b.category NOT IN (SELECT category FROM defaults))"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


TX_BASE = [USERS, TX_FULL, FACT]
