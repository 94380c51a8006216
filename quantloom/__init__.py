"""quantloom: a PySpark-native engine for financial text, price and memory data.

Every operator is a function ``DataFrame -> DataFrame`` built from Spark SQL
expressions, windows and joins; ``symbol`` is always a column, so one job
covers all symbols at once.
"""

from quantloom.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
