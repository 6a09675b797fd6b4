"""Column expressions shared by every operator.

Rules (see README "Numbers"):
* money is DECIMAL(18,2); sums stay decimal, so they are exact and independent
  of partitioning;
* a ratio is one double division of two exact decimals;
* a rounded output is ``round(cast(x as decimal(38,6)), n)`` (half-up), then
  double -- the same steps the SQL oracle takes;
* message numbers are rendered from a rounded decimal, never ``format_string``
  on a double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"

# The two transaction types.
INCOME = "Income"
EXPENSE = "Expense"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(c) -> Column:
    return col(c).cast("double")


def rnd(c, digits: int = 2) -> Column:
    """Half-up rounding of a double or decimal, returned as double."""
    return F.round(col(c).cast("decimal(38,6)"), digits).cast("double")


def fmt(c, digits: int) -> Column:
    """Text of a number with a fixed number of decimals (like ``f"{x:.Nf}"``)."""
    return (
        F.round(col(c).cast("decimal(38,6)"), digits)
        .cast(f"decimal(38,{digits})")
        .cast("string")
    )


def div(num, den) -> Column:
    """num / den as double; NULL when den == 0 (safe under ANSI mode in any
    evaluation order, e.g. inside a filter next to its own guard)."""
    return F.try_divide(dbl(num), dbl(den))


def pct(num, den) -> Column:
    return F.when(col(den) > 0, div(num, den) * 100.0).otherwise(F.lit(0.0))


def month_label(c) -> Column:
    """DATE (first of month) -> 'yyyy-MM'."""
    return F.date_format(col(c), "yyyy-MM")


def month_of(c) -> Column:
    return F.trunc(col(c), "MM")
