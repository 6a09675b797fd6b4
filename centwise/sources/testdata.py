"""Finance-shaped views over the driver's parquet tables (FIXTURES.md section 4).

Every view is a lazy DataFrame over the parquet scan: columns are pruned and
filters pushed down by Catalyst, nothing is collected.  The SQL oracle builds
the same views in ``centwise.plans.oracle_fixtures``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from centwise.functions.columns import MONEY, month_of
from centwise.schema import DEFAULT_BUDGETS

# The month the scale fixtures treat as "today".
SCALE_AS_OF = dt.date(2001, 1, 31)
# The category that each event type spends in; a sign-up is income.
EVENT_CATEGORY: list[tuple[str, str]] = [
    ("purchase", "Shopping"), ("view", "Entertainment"), ("click", "Food"), ("error", "Other"), ("signup", "Bills"),
]

# Expense category by part type; brand 25 is 'Other'.
PART_TYPE_CATEGORY: list[tuple[str, str]] = [
    ("STANDARD", "Food"),
    ("ECONOMY", "Transport"),
    ("MEDIUM", "Bills"),
    ("SMALL", "Entertainment"),
    ("LARGE", "Health"),
    ("PROMO", "Shopping"),
]
OTHER_BRAND = "Brand#25"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lower(F.col("c_name")), F.lit("@example.com")).alias("email"),
    )


def _category_from_part() -> F.Column:
    expr = F.when(F.col("p_brand") == OTHER_BRAND, F.lit("Other"))
    for prefix, category in PART_TYPE_CATEGORY:
        expr = expr.when(F.col("p_type").startswith(prefix), F.lit(category))
    return expr.otherwise(F.lit("Other"))


def transactions_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Income from orders, expenses from line items (clean schema + month)."""
    orders = table(spark, sf_dir, "orders")
    income = orders.select(
        (F.col("o_orderkey") * 10).alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_totalprice").cast(MONEY).alias("amount"),
        F.lit("Salary").alias("category"),
        F.lit("Income").alias("type"),
        F.lit("monthly salary credit").alias("description"),
        F.col("o_orderdate").cast("date").alias("date"),
    )
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    expense = (
        li.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
            F.col("o_custkey").alias("user_id"),
            F.col("l_extendedprice").cast(MONEY).alias("amount"),
            _category_from_part().alias("category"),
            F.lit("Expense").alias("type"),
            F.col("p_name").alias("description"),
            F.col("l_shipdate").cast("date").alias("date"),
        )
    )
    return income.unionByName(expense).withColumn("month", month_of("date"))


def transactions_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per order; unique id.  Used where ids must be unique."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_totalprice").cast(MONEY).alias("amount"),
        F.col("o_orderpriority").alias("category"),
        F.when(F.col("o_orderstatus") == "O", F.lit("Income")).otherwise(F.lit("Expense")).alias("type"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("description"),
        F.col("o_orderdate").cast("date").alias("date"),
    ).withColumn("month", month_of("date"))


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text-typed transactions as an input form would deliver them.

    Orders in status 'P' are written with unpadded dates (valid) and a
    lower-case type (invalid); priority '4-NOT SPECIFIED' leaves the category
    blank, so the category default applies.
    """
    o = table(spark, sf_dir, "orders")
    d = F.col("o_orderdate").cast("date")
    unpadded = F.concat_ws("-", F.year(d).cast("string"), F.month(d).cast("string"),
                           F.dayofmonth(d).cast("string"))
    status = F.col("o_orderstatus")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_totalprice").cast(MONEY).cast("string").alias("amount"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(""))
        .otherwise(F.col("o_orderpriority")).alias("category"),
        F.when(status == "O", F.lit("Income")).when(status == "F", F.lit("Expense"))
        .otherwise(F.lit("expense")).alias("type"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("description"),
        F.when(status == "P", unpadded).otherwise(F.date_format(d, "yyyy-MM-dd")).alias("date"),
    )


def _default_entries() -> F.Column:
    return F.array(*[
        F.struct(F.lit(i).alias("idx"), F.lit(c).alias("category"),
                 F.lit(a * 5).cast(MONEY).alias("default_budget"))
        for i, (c, a) in enumerate(DEFAULT_BUDGETS)
    ])


def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User budgets: customer x 7 categories with some rows absent."""
    c = table(spark, sf_dir, "customer").select("c_custkey").repartition("c_custkey")   # spread before they multiply
    e = c.select("c_custkey", F.explode(_default_entries()).alias("e"))
    return (
        e.filter((F.col("c_custkey") + F.col("e.idx")) % 4 != 0)
        .select(
            F.col("c_custkey").alias("user_id"),
            F.col("e.category").alias("category"),
            (F.lit(20000) + F.lit(15000) * ((F.col("c_custkey") * 7 + F.col("e.idx")) % 5))
            .cast(MONEY).alias("monthly_budget"),
        )
    )


def as_transactions(events: DataFrame) -> DataFrame:
    """Events (a table or a stream) as transactions: the event type gives category and type."""
    ts = F.col("ts").cast("timestamp")
    category = F.lit("Other")
    for event_type, name in EVENT_CATEGORY:
        category = F.when(F.col("event_type") == event_type, F.lit(name)).otherwise(category)
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id"),
        F.col("value").cast(MONEY).alias("amount"),
        category.alias("category"),
        F.when(F.col("event_type") == "signup", F.lit("Income")).otherwise(F.lit("Expense")).alias("type"),
        F.col("event_type").alias("description"),
        ts.alias("ts"),
        ts.cast("date").alias("date"),
    ).withColumn("month", month_of("date"))


def event_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an expense in the category of its type's name."""
    return as_transactions(table(spark, sf_dir, "events")).withColumn("category", F.col("description")) \
        .withColumn("type", F.lit("Expense"))


def event_budgets(effective: DataFrame) -> DataFrame:
    """Each user's budgets for the event stream: a hundredth of the effective ones."""
    return effective.select("user_id", "category", (F.col("monthly_budget") / 100).cast(MONEY).alias("monthly_budget"))


def training_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a labelled training row (text -> description, lang -> category)."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("text").alias("description"), F.col("lang").alias("category"))


def seed_rows(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Labelled seed rows: each part's name with the category of its type."""
    return table(spark, sf_dir, "part").select(*more, F.col("p_name").alias("description"), _category_from_part().alias("category"))


def predict_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document to categorise (whole table, whole texts)."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id"), F.col("text").alias("description"))


# Question templates (slot {m} = month name, {p} = YYYY-MM period).
QUESTION_TEMPLATES: list[str] = [
    "Summarize my {m} spending",
    "Where did I overspend this month?",
    "Compare this month with last month",
    "How can I save more?",
    "Which was my highest spending month?",
    "What was my income in {p}?",
    "How much did I spend in {m} {y}?",
    "Give me a summary",
]
MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July",
               "August", "September", "October", "November", "December"]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per user turn of ``conversations``; template by (conv_id + turn) % 8."""
    conv = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    key = (F.col("conv_id") + F.col("turn")) % 8
    month_no = (F.col("turn") + F.col("conv_id")) % 12 + 1
    year = (F.lit(2000) + F.col("conv_id") % 2).cast("string")
    m_name = F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), month_no.cast("int"))
    period = F.concat(year, F.lit("-"), F.lpad(month_no.cast("string"), 2, "0"))
    text = F.lit("")
    for i, t in enumerate(QUESTION_TEMPLATES):
        parts = []
        rest = t
        while rest:
            j = min([k for k in (rest.find("{m}"), rest.find("{p}"), rest.find("{y}")) if k >= 0],
                    default=-1)
            if j < 0:
                parts.append(F.lit(rest))
                break
            if j > 0:
                parts.append(F.lit(rest[:j]))
            slot = rest[j:j + 3]
            parts.append({"{m}": m_name, "{p}": period, "{y}": year}[slot])
            rest = rest[j + 3:]
        text = F.when(key == i, F.concat(*parts)).otherwise(text)
    return conv.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("question_id"),
        F.col("conv_id").alias("user_id"),
        text.alias("question"),
    )


def llm_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw JSON reply bodies built from assistant turns in six provider shapes."""
    conv = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    key = (F.col("conv_id") + F.col("turn")) % 6
    t = F.col("text")
    body = (
        F.when(key == 0, F.to_json(F.struct(t.alias("text"))))
        .when(key == 1, F.to_json(F.struct(t.alias("response"))))
        .when(key == 2, F.to_json(F.struct(F.array(F.struct(F.struct(t.alias("content")).alias("message"))).alias("choices"))))
        .when(key == 3, F.to_json(F.struct(F.array(F.struct(t.alias("text"))).alias("choices"))))
        .when(key == 4, F.to_json(F.struct(F.col("turn").alias("text"), t.alias("response"))))
        .otherwise(F.to_json(F.array(t)))
    )
    return conv.select((F.col("conv_id") * 100 + F.col("turn")).alias("reply_id"), body.alias("body"))


def raw_budget_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget form per customer: category idx gets account balance x (idx + 1)
    as text; negative balances give negative (invalid) budgets.  Every third category is
    written again, by customers of even keys with another amount, by the rest with an invalid one."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").repartition("c_custkey")   # spread before they multiply
    e = c.select("c_custkey", "c_acctbal", F.explode(_default_entries()).alias("e"))
    first = e.select(
        F.col("c_custkey").alias("user_id"), F.col("e.category").alias("category"),
        (F.col("c_acctbal") * (F.col("e.idx") + 1)).cast(MONEY).cast("string").alias("monthly_budget"),
        F.col("e.idx").cast("long").alias("seq"),
    )
    amount = (F.col("e.idx") + 1) * F.when(F.col("c_custkey") % 2 == 0, 1000).otherwise(-1)
    again = e.filter(F.col("e.idx") % 3 == 0).select(
        F.col("c_custkey").alias("user_id"), F.col("e.category").alias("category"),
        amount.cast(MONEY).cast("string").alias("monthly_budget"), (F.col("e.idx") + 100).cast("long").alias("seq"))
    return first.union(again)


def raw_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups: every customer, plus a second sign-up (id + 10^9, same e-mail in
    upper case with blanks) for customers with a negative balance."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    email = F.concat(F.lower(F.col("c_name")), F.lit("@example.com"))
    first = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), email.alias("email"))
    again = c.filter(F.col("c_acctbal") < 0).select(
        (F.col("c_custkey") + F.lit(1_000_000_000)).alias("id"), F.col("c_name").alias("name"),
        F.concat(F.lit("  "), F.upper(email), F.lit(" ")).alias("email"))
    return first.unionByName(again)


def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits and deletes against ``transactions_orders``.

    Each returned line item (flag 'R') edits its order: the amount drops by
    that item's price and the description notes the line; the highest line
    number is the latest edit.  Pending low-priority orders are deleted.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus",
                                               "o_orderpriority", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R").select(
        "l_orderkey", "l_linenumber", "l_extendedprice")
    upd = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.lit("U").alias("op"),
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
        F.greatest(F.col("o_totalprice") - F.col("l_extendedprice"), F.lit(0.0)).cast(MONEY).cast("string")
        .alias("amount"),
        F.col("o_orderpriority").alias("category"),
        F.when(F.col("o_orderstatus") == "O", F.lit("Income")).otherwise(F.lit("Expense")).alias("type"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" returned line "),
                 F.col("l_linenumber").cast("string")).alias("description"),
        F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd").alias("date"),
    )
    dele = o.filter((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")).select(
        (F.col("o_orderkey") * 10).alias("seq"), F.lit("D").alias("op"), F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"), *[F.lit(None).cast("string").alias(c)
                                               for c in ["amount", "category", "type", "description", "date"]])
    return upd.unionByName(dele)


def report_email_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report e-mail requests: every event is one request at its timestamp
    (``t`` in microseconds since the epoch, read from the zone-less ts)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").alias("request_id"), "user_id",
                     F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("t"))


def report_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report requests derived from orders, by priority: urgent -> the monthly
    report of the order's month; high -> the yearly report of its year (type
    written ' Yearly ' to exercise normalisation); medium -> a yearly report
    with an invalid year (falls back to the as-of year); not specified -> no
    type and a blank month (falls back to the as-of month); low -> an unknown type
    (read as monthly) and an unpadded month, compared with the last month."""
    o = table(spark, sf_dir, "orders")
    p = F.col("o_orderpriority")
    d = F.col("o_orderdate").cast("date")
    return o.select(
        F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("user_id"),
        F.when(p == "1-URGENT", F.lit("monthly")).when(p == "2-HIGH", F.lit("Yearly "))
        .when(p == "3-MEDIUM", F.lit("yearly")).when(p == "5-LOW", F.lit("weekly")).alias("report_type"),
        F.when(p == "1-URGENT", F.date_format(d, "yyyy-MM")).when(p == "4-NOT SPECIFIED", F.lit(""))
        .when(p == "5-LOW", F.concat_ws("-", F.year(d).cast("string"), F.month(d).cast("string"))).alias("month"),
        F.when(p == "2-HIGH", F.year(d).cast("string")).when(p == "3-MEDIUM", F.lit("abcd")).alias("year"),
        F.when(p.isin("1-URGENT", "5-LOW"), F.lit("last_month")).alias("compare_range"),
        F.col("o_orderdate").cast("timestamp").alias("requested_at"),
    )
