"""Numeric column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRADING_DAYS = 252  # fixed value: trading days per year used for annualising


def r6(c: Column | str) -> Column:
    """Round a double to 6 places (stable across engines for values of normal size)."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def sig9(c: Column | str) -> Column:
    """Round a double to 9 significant digits (for values whose size is unbounded).

    Formats in scientific notation and parses back, so the result is the same
    nearest double in any engine that prints ``%.8e`` the same way.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.format_string("%.8e", c).cast("double")


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def log_return(p0: Column, p1: Column) -> Column:
    """ln(p1/p0); NULL when either side is missing or not positive."""
    return F.when((p0 > 0) & (p1 > 0), F.ln(p1 / p0))
