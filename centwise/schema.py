"""Declared schemas and fixed values.  Never infer a schema."""

from __future__ import annotations

from pyspark.sql import types as T

# The default monthly budget per category, in this order.
DEFAULT_BUDGETS: list[tuple[str, float]] = [
    ("Food", 12000.0),
    ("Transport", 6000.0),
    ("Bills", 9000.0),
    ("Entertainment", 5000.0),
    ("Health", 7000.0),
    ("Shopping", 8000.0),
    ("Other", 4000.0),
]

# Budget alert thresholds (percent) and the usage-alert ratio.
CROSSING_THRESHOLDS: tuple[int, ...] = (85, 100)
USAGE_ALERT_RATIO = 0.85

# Report e-mail cool-down in seconds.
REPORT_COOLDOWN_SECONDS = 10

USERS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("name", T.StringType(), True),
    T.StructField("email", T.StringType(), True),
])

RAW_TRANSACTIONS = T.StructType([
    T.StructField("id", T.LongType(), True),
    T.StructField("user_id", T.LongType(), True),
    T.StructField("amount", T.StringType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("type", T.StringType(), True),
    T.StructField("description", T.StringType(), True),
    T.StructField("date", T.StringType(), True),
])

TRANSACTIONS = T.StructType([
    T.StructField("id", T.LongType(), True),
    T.StructField("user_id", T.LongType(), True),
    T.StructField("amount", T.DecimalType(18, 2), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("type", T.StringType(), True),
    T.StructField("description", T.StringType(), True),
    T.StructField("date", T.DateType(), True),
])

BUDGETS = T.StructType([
    T.StructField("user_id", T.LongType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("monthly_budget", T.DecimalType(18, 2), True),
])

RAW_BUDGETS = T.StructType([
    T.StructField("user_id", T.LongType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("monthly_budget", T.StringType(), True),
])

ALERT_EVENTS = T.StructType([
    T.StructField("user_id", T.LongType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("month", T.StringType(), False),
    T.StructField("threshold_percent", T.IntegerType(), False),
    T.StructField("usage_percent", T.DoubleType(), True),
    T.StructField("created_at", T.TimestampType(), True),
])

TRAINING = T.StructType([
    T.StructField("description", T.StringType(), True),
    T.StructField("category", T.StringType(), True),
])

REPORT_REQUESTS = T.StructType([
    T.StructField("request_id", T.LongType(), False),
    T.StructField("user_id", T.LongType(), False),
    T.StructField("report_type", T.StringType(), True),
    T.StructField("month", T.StringType(), True),
    T.StructField("year", T.StringType(), True),
    T.StructField("compare_range", T.StringType(), True),
    T.StructField("requested_at", T.TimestampType(), True),
])

QUESTIONS = T.StructType([
    T.StructField("question_id", T.LongType(), False),
    T.StructField("user_id", T.LongType(), False),
    T.StructField("question", T.StringType(), True),
])
