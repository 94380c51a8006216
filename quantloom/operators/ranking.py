"""Distributed positions: the place of every row in a total order, without a window over a whole group.

Rows are range-partitioned and sorted by the order's columns, so a group of any size is spread over as
many partitions as its rows need.  Rows are numbered inside their partition; prefix sums of the
partitions' row counts (one number per partition, all that the driver sees) turn these numbers
into positions.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.session import cut_lineage

_PLACE_BITS = 33     # monotonically_increasing_id: partition number above, row number below


def global_positions(df: DataFrame, order: list[str], out: str = "position", partitions: int | None = None) -> DataFrame:
    """``df`` with ``out``: 1, 2, 3... in the rising order of the columns (nulls first); ties in any order."""
    spread = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    numbered = cut_lineage(spread.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()),
                           "positions")
    part = F.shiftright("_at", _PLACE_BITS)
    counts = sorted((r["part"], r["count"]) for r in numbered.groupBy(part.alias("part")).count().collect())
    before = accumulate((n for _, n in counts), initial=0)
    rows = [(p, b) for (p, _), b in zip(counts, before)] or [(0, 0)]
    offsets = df.sparkSession.createDataFrame(rows, "_part long, _before long")      # a row per partition
    placed = numbered.join(F.broadcast(offsets), part == F.col("_part"))
    return placed.withColumn(out, F.col("_before") + F.col("_at").bitwiseAND((1 << _PLACE_BITS) - 1) + 1).select(
        *df.columns, out)


def positions_in_groups(df: DataFrame, group: list[str], order: list[str], out: str = "position") -> DataFrame:
    """``df`` with ``out``: the position inside its group in the order of the columns.

    The group's first position (a partial aggregate, one row per group) is taken off the global one.
    """
    placed = cut_lineage(global_positions(df, [*group, *order], "_global"), "positions")
    first = placed.groupBy(*[F.col(c).alias(f"_g_{c}") for c in group]).agg(F.min("_global").alias("_first"))
    same = [placed[c].eqNullSafe(first[f"_g_{c}"]) for c in group]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return placed.join(first, cond).withColumn(out, F.col("_global") - F.col("_first") + 1).select(*df.columns, out)
