"""Cleaning, validation and projections (CLN1-CLN5, VAL1-VAL5, PRJ1, PRJ2).

Row-local expressions only (one pass, whole-stage codegen), plus one
equi-join to ``users`` for the orphan check.  Invalid rows are not dropped
silently: ``validate_transactions`` keeps every row with its error codes so
callers split valid / quarantine frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centwise.functions.columns import MONEY, month_of

# What counts as a number (plain or exponent form) and as a date.
AMOUNT_PATTERN = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
DATE_PATTERN = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"
TYPES = ("Income", "Expense")
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+$"


def parse_amount(c: F.Column) -> F.Column:
    """CLN1 core: text -> DECIMAL(18,2); NULL when not a plain number."""
    return F.when(c.rlike(AMOUNT_PATTERN), F.trim(c).try_cast(MONEY))


def parse_date(c: F.Column) -> F.Column:
    """CLN2: strict YYYY-M-D (1-2 digit month/day); impossible dates -> NULL."""
    return F.when(c.rlike(DATE_PATTERN), F.try_to_date(c, "yyyy-M-d"))


def clean_transactions(raw: DataFrame) -> DataFrame:
    """CLN1-CLN5: amount text -> decimal (bad -> 0), strict date (bad -> row
    dropped), month key, text columns as strings."""
    return (
        raw.select(
            F.col("id").cast("long"), F.col("user_id").cast("long"),
            F.coalesce(parse_amount(F.col("amount").cast("string")), F.lit(0).cast(MONEY)).alias("amount"),
            F.col("category").cast("string"), F.col("type").cast("string"),
            F.col("description").cast("string"),
            parse_date(F.col("date").cast("string")).alias("date"),
        )
        .filter(F.col("date").isNotNull())
        .withColumn("month", month_of("date"))
    )


def _codes(*pairs: tuple[F.Column, str]) -> F.Column:
    return F.filter(F.array(*[F.when(cond, F.lit(code)) for cond, code in pairs]), lambda x: x.isNotNull())


def validate_transactions(raw: DataFrame, users: DataFrame, predicted: DataFrame | None = None) -> DataFrame:
    """VAL1 + VAL3 + VAL5 + PRJ1 over a table of submitted rows.

    Inputs are trimmed; each failed rule adds one code (fixed order).  A blank
    category becomes 'Income' for income rows and the predicted category
    (``predicted``: id, category) for expense rows.
    """
    t = raw.select(
        "id", "user_id",
        F.trim(F.col("amount").cast("string")).alias("amount_txt"),
        F.trim(F.col("category").cast("string")).alias("category"),
        F.trim(F.col("type").cast("string")).alias("type"),
        F.trim(F.col("description").cast("string")).alias("description"),
        F.trim(F.col("date").cast("string")).alias("date_txt"),
    )
    t = t.withColumn("amount", parse_amount(F.col("amount_txt"))).withColumn("date", parse_date(F.col("date_txt")))
    known = users.select(F.col("id").alias("user_id")).distinct().withColumn("known", F.lit(True))
    t = t.join(known, "user_id", "left")
    codes = _codes(
        (F.col("amount").isNull(), "amount_invalid"),
        (F.col("amount") < 0, "amount_negative"),
        (F.coalesce(F.col("description"), F.lit("")) == "", "description_missing"),
        (F.coalesce(F.col("date_txt"), F.lit("")) == "", "date_missing"),
        ((F.coalesce(F.col("date_txt"), F.lit("")) != "") & F.col("date").isNull(), "date_invalid"),
        (~F.coalesce(F.col("type"), F.lit("")).isin(*TYPES), "type_invalid"),
        (F.col("known").isNull(), "user_unknown"),
    )
    blank_cat = F.coalesce(F.col("category"), F.lit("")) == ""
    if predicted is not None:
        t = t.join(predicted.select("id", F.col("category").alias("predicted")), "id", "left")
        fill = F.when(F.col("type") == "Expense", F.col("predicted")).otherwise(F.lit("Income"))
    else:
        fill = F.when(F.col("type") == "Expense", F.lit("Other")).otherwise(F.lit("Income"))
    t = t.withColumn("error_codes", codes)
    return t.select(
        "id", "user_id",
        (F.size("error_codes") == 0).alias("is_valid"),
        F.array_join("error_codes", ",").alias("error_codes"),
        F.col("amount").cast("double").alias("amount"),
        F.when(blank_cat, fill).otherwise(F.col("category")).alias("category"),
        "type", "description",
        F.date_format("date", "yyyy-MM-dd").alias("date"),
    )


def validate_budgets(raw_budgets: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """VAL2: budget text must be a non-negative number.  ``keep`` names columns to carry along."""
    amt = parse_amount(F.col("monthly_budget").cast("string"))
    codes = _codes((amt.isNull(), "budget_invalid"), (amt < 0, "budget_negative"))
    t = raw_budgets.select("user_id", F.trim("category").alias("category"), amt.alias("amt"), codes.alias("codes"), *keep)
    return t.select("user_id", "category", (F.size("codes") == 0).alias("is_valid"),
                    F.array_join("codes", ",").alias("error_codes"),
                    F.col("amt").cast("double").alias("monthly_budget"), *keep)


def validate_users(raw_users: DataFrame) -> DataFrame:
    """VAL4: required name and e-mail, e-mail trimmed and lower-cased, one
    account per e-mail (the lowest id that is valid otherwise wins; other rows of
    that e-mail are duplicates)."""
    t = raw_users.select("id", F.trim("name").alias("name"), F.lower(F.trim("email")).alias("email"))
    stored = (F.col("name") != "") & F.col("email").rlike(EMAIL_PATTERN)
    first = t.filter(stored).groupBy("email").agg(F.min("id").alias("first_id"))
    t = t.join(first, "email", "left")
    codes = _codes(
        (F.coalesce(F.col("name"), F.lit("")) == "", "name_missing"),
        (F.coalesce(F.col("email"), F.lit("")) == "", "email_missing"),
        ((F.coalesce(F.col("email"), F.lit("")) != "") & ~F.col("email").rlike(EMAIL_PATTERN), "email_invalid"),
        (F.col("first_id").isNotNull() & (F.col("first_id") != F.col("id")), "email_duplicate"),
    )
    t = t.withColumn("codes", codes)
    return t.select("id", "name", "email", (F.size("codes") == 0).alias("is_valid"),
                    F.array_join("codes", ",").alias("error_codes"))


def orphans(df: DataFrame, users: DataFrame, key: str = "user_id") -> DataFrame:
    """VAL5: rows whose user does not exist."""
    return df.join(users.select(F.col("id").alias(key)), key, "left_anti")


def violations(tables: dict[str, DataFrame], parents: DataFrame, key: str = "user_id") -> DataFrame:
    """VAL5 over several tables: (table_name, key, n_rows) of the keys that have no row in ``parents``
    (id); a null key is one of them.

    The tables are counted by key before anything is joined, so one pass with a map-side combine
    reduces each to its distinct keys, and a key with very many rows is one row of the check."""
    counted = None
    for name, df in tables.items():
        one = df.groupBy(F.col(key).cast("long").alias(key)).agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), key, "n_rows")
        counted = one if counted is None else counted.unionByName(one)
    return counted.join(parents.select(F.col("id").alias(key)).distinct(), key, "left_anti").select("table_name", key, "n_rows")


def breakdown_category(c: F.Column) -> F.Column:
    """PRJ2: blank category -> 'Other' (breakdown only)."""
    return F.coalesce(F.when(c != "", c), F.lit("Other"))


__all__ = ["clean_transactions", "validate_transactions", "validate_budgets", "validate_users", "orphans", "violations",
           "parse_amount", "parse_date", "breakdown_category"]
