"""New memory records from texts (I1 with K1): embed, normalise, number, route, score.

One item holds one text or a list of texts; every text becomes a record.  Ids follow the order of
(date, symbol, key, place in the list), numbered by range partitions and prefix sums, so numbering
needs no task that sees all records and gives the same ids on every run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from quantloom.functions.embed import Model, embed_texts, of_length
from quantloom.functions.vectors import DEFAULT_CHUNK_TOKENS, DEFAULT_DIM, l2_normalize
from quantloom.operators import memory as MM
from quantloom.operators.ranking import global_positions

RECORD = ("symbol", "layer", "id", "date", "text", "importance", "recency", "delta", "compound", "access_counter",
          "seq", "embedding")


def add_memory(items: DataFrame, model: Callable[[], Model] | None = None, dim: int = DEFAULT_DIM,
               first_id: int = 0, seed: str = "42", importance: str = "sample",
               chunk_tokens: int = DEFAULT_CHUNK_TOKENS) -> DataFrame:
    """Records (``RECORD``) of items (symbol, date, key, text, and layer or source_type).

    ``text`` is a string or an array of strings.  A null string is an empty text, whose vector stays zero; a null
    or empty array adds nothing; an item whose source type has no layer stops the job.  Vectors have
    ``dim`` values (checked) and unit length.
    """
    rows = items
    if "layer" not in rows.columns:
        rows = rows.withColumn("layer", MM.route_layer(F.col("source_type")))
    text = rows.schema["text"].dataType
    listed = F.col("text") if isinstance(text, ArrayType) else F.array("text")
    rows = rows.select("symbol", "date", "key", "layer", F.posexplode(listed).alias("_place", "text"))
    numbered = global_positions(rows, ["date", "symbol", "key", "_place"], "_n")
    numbered = numbered.withColumn("id", F.col("_n") + F.lit(first_id - 1))
    embedded = embed_texts(numbered.select("symbol", "date", "layer", "id", "text"), "text", model, dim, chunk_tokens)
    vectors = embedded.withColumn("embedding", l2_normalize(of_length(F.col("embedding"), dim)))
    draw = MM.importance_init(importance)(F.col("id"), F.col("layer"), seed)
    scored = vectors.withColumns({"importance": draw, "recency": F.lit(MM.RECENCY_INIT), "delta": F.lit(0),
                                  "access_counter": F.lit(0), "seq": F.col("id")})
    return MM.with_compound(scored).select(*RECORD)
