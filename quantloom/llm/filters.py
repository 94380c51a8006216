"""A filter of fixed size in front of a join: rows whose key is probably among the wanted ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 1 << 22     # 512 KB


def probably_among(rows: DataFrame, key: str, wanted: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Rows whose ``key`` (SQL list of columns of both sides) may be in ``wanted``; an exact join has to follow.

    A bit per hash of a key: ``bits`` bits are broadcast, however many keys are wanted.
    """
    spot = f"cast(pmod(xxhash64({key}), {bits}) as bigint)"
    marks = (wanted.select(F.expr(f"{spot} div 32768").alias("_slot"), F.expr(f"{spot} % 32768").alias("_bit"))
             .groupBy("_slot").agg(F.bitmap_construct_agg("_bit").alias("_marks")))
    hit = ("(cast(conv(hex(substring(_marks, cast((_h % 32768) div 8 + 1 as int), 1)), 16, 10) as int) "
           ">> cast(_h % 8 as int)) & 1 = 1")
    return (rows.withColumn("_h", F.expr(spot)).join(F.broadcast(marks), F.expr("_h div 32768 = _slot"))
            .where(hit).drop("_h", "_slot", "_marks"))
