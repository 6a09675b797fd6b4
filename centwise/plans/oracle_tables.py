"""DuckDB oracle SQL for the queries of ``plans.table_queries``."""

from __future__ import annotations

from collections.abc import Callable

from centwise.plans.oracle_fixtures import BUDGETS, BUDGETS_EFF, DEFAULTS, TX_FULL, TX_ORDERS, USERS, d, with_


def fill(oracle: dict[str, str], b: list[str], cands: Callable[[str], str], model: Callable[[str], str],
         predict: Callable[[str], str], changes: str) -> None:
    """``b``: the budget fixtures; ``cands``: the crossing candidates of a fact; ``model`` and ``predict``:
    the categoriser trained on one select and applied to another; ``changes``: the edits of orders -- all
    as in ``plans.oracle``."""
    pick = "user_id, category, month, threshold_percent, usage_percent"
    oracle["crossing_events"] = with_(*b) + f"""
, fact_mid AS (SELECT user_id, month, type, category, SUM(amount) AS amount FROM tx
               WHERE date <= DATE '2001-01-15' GROUP BY 1, 2, 3, 4)
, mid AS (SELECT {pick} FROM {cands('fact_mid')} c)
SELECT {pick}, '2001-01-15' AS created, CAST(1 AS BIGINT) AS batch FROM mid
UNION ALL
SELECT {pick}, '2001-01-31', 2 FROM {cands('fact')} c
WHERE NOT EXISTS (SELECT 1 FROM mid p WHERE p.user_id = c.user_id AND p.category = c.category
                    AND p.month = c.month AND p.threshold_percent = c.threshold_percent)"""

    oracle["stored_transaction_lookup"] = with_(TX_ORDERS, changes) + f"""
SELECT id, user_id, {d('amount')} AS amount, category, type, description, strftime(date, '%Y-%m-%d') AS date
FROM txo WHERE (id, user_id) IN (SELECT id, user_id FROM changes WHERE op = 'D')"""

    oracle["reference_violations"] = """
WITH k AS (SELECT 'transactions' AS table_name, o_custkey AS user_id FROM orders
           UNION ALL SELECT 'budgets', c_custkey FROM customer, range(7) t(idx) WHERE (c_custkey + idx) % 4 <> 0
           UNION ALL SELECT 'events', user_id FROM events
           UNION ALL SELECT 'report_requests', o_custkey FROM orders
           UNION ALL SELECT 'questions', conv_id FROM conversations WHERE role = 'user'
           UNION ALL SELECT 'sign_ups', c_custkey FROM customer
           UNION ALL SELECT 'sign_ups', c_custkey + 1000000000 FROM customer WHERE c_acctbal < 0)
SELECT table_name, user_id, count(*) AS n_rows FROM k
WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = k.user_id) GROUP BY 1, 2"""

    oracle["merged_transactions"] = oracle["apply_changes"]

    oracle["monthly_fact_kept"] = f"""
SELECT user_id, substr(date, 1, 7) AS month, type, category, {d('SUM(CAST(amount AS DECIMAL(18,2)))')} AS amount, COUNT(*) AS n_tx
FROM ({oracle['apply_changes']}) GROUP BY 1, 2, 3, 4"""

    oracle["latest_transactions_kept"] = f"""
SELECT id, user_id, amount, category, type, description, date, rank
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date DESC NULLS LAST, id DESC) AS rank
      FROM ({oracle['apply_changes']})) WHERE rank <= 5"""

    changed = f"""tx AS (
  SELECT id, user_id, CAST(amount AS DECIMAL(18,2)) AS amount, category, type, description, CAST(date AS DATE) AS date,
         date_trunc('month', CAST(date AS DATE)) AS month
  FROM ({oracle['apply_changes']}))"""
    oracle["dashboard_kept"] = oracle["dashboard"].replace(TX_FULL, changed)

    oracle["budgets_seeded"] = with_(USERS, DEFAULTS, BUDGETS, BUDGETS_EFF) + f"""
SELECT user_id, category, {d('monthly_budget')} AS monthly_budget, CAST(CASE WHEN is_default THEN 1 ELSE 0 END AS BIGINT) AS batch
FROM beff"""

    seed = """SELECT p_partkey, p_name AS description,
              CASE WHEN p_brand = 'Brand#25' THEN 'Other' WHEN p_type LIKE 'STANDARD%' THEN 'Food'
                   WHEN p_type LIKE 'ECONOMY%' THEN 'Transport' WHEN p_type LIKE 'MEDIUM%' THEN 'Bills'
                   WHEN p_type LIKE 'SMALL%' THEN 'Entertainment' WHEN p_type LIKE 'LARGE%' THEN 'Health'
                   WHEN p_type LIKE 'PROMO%' THEN 'Shopping' ELSE 'Other' END AS category FROM part"""
    rows = f"""SELECT DISTINCT description, category FROM (
      SELECT description, category FROM ({seed})
      UNION ALL SELECT description, category FROM txo WHERE type = 'Expense') WHERE description IS NOT NULL AND category IS NOT NULL"""
    texts = f"""SELECT DISTINCT seq AS doc_id, description AS text FROM changes WHERE op = 'U'
      UNION ALL SELECT -p_partkey, description FROM ({seed})"""
    oracle["model_life_cycle"] = with_(TX_ORDERS, changes) + ", " + model(rows) + ",\n" + predict(texts) + """
SELECT doc_id, category FROM pred"""

    oracle["report_files"] = f"""
WITH l AS ({oracle['report_lines']}),
q AS (SELECT request_id, file_name, section_no, line_no, k_date, k_id, c2, c5,
             [CASE WHEN regexp_matches(c, '[",\r\n]') THEN '"' || replace(c, '"', '""') || '"' ELSE c END
              FOR c IN [COALESCE(c1, ''), COALESCE(c2, ''), COALESCE(c3, ''), COALESCE(c4, ''), COALESCE(c5, '')]] AS cells,
             CASE WHEN k_id IS NOT NULL OR c5 IS NOT NULL THEN 5 WHEN c4 IS NOT NULL THEN 4 WHEN c3 IS NOT NULL THEN 3
                  WHEN c2 IS NOT NULL THEN 2 WHEN c1 IS NOT NULL THEN 1 ELSE 0 END AS n FROM l),
t AS (SELECT request_id, file_name,
             string_agg(COALESCE(array_to_string(cells[1:n], ','), '') || chr(13) || chr(10), ''
                        ORDER BY section_no, line_no, k_date DESC NULLS LAST, k_id DESC NULLS LAST, c2 NULLS FIRST, c5 NULLS FIRST) AS body
      FROM q GROUP BY ALL)
SELECT request_id, file_name, CAST(strlen(body) AS BIGINT) AS n_bytes, sha256(body) AS sha256 FROM t"""
