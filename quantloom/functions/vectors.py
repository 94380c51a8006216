"""Vector helpers (H26, H27) and the default relational text embedder.

The default embedder is feature hashing written as relational steps: each
whitespace token adds +-1 to one of ``dim`` buckets chosen from its md5, a
chunk vector is L2-normalised, and a text's vector is the mean of its chunk
vectors.  Tokens are exploded and summed by ``groupBy`` (partial
aggregation), so long texts are processed whole and never land in one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_DIM = 64          # matches the shared ``embeddings`` table
DEFAULT_CHUNK_TOKENS = 256
PART_CHARS = 8 << 20      # characters of text dealt to one task, so its tokens' sums stay in memory


def l2_normalize(v: Column) -> Column:
    """V / ||v|| (unchanged when the norm is 0)."""
    def scaled(w, norm):
        return F.when(norm > 0, F.transform(w, lambda x: x.cast("double") / norm)).otherwise(
            F.transform(w, lambda x: x.cast("double")))

    # vector and norm are bound as lambda variables: an expression in the inner lambda would run again for every element
    def bound(w):
        norm = F.sqrt(F.aggregate(w, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
        return F.transform(F.array(norm), lambda n: scaled(w, n))[0]
    return F.transform(F.array(v), bound)[0]


def inner_product(a: Column, b: Column) -> Column:
    """sum(a_i * b_i) in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def tokens(text: Column) -> Column:
    """K6 default tokeniser: lower-case whitespace tokens, empty ones dropped."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda t: t != "")


def hash_embed_long(df: DataFrame, key: str, text_col: str = "text", dim: int = DEFAULT_DIM,
                    chunk_tokens: int = DEFAULT_CHUNK_TOKENS) -> DataFrame:
    """K1 + D21: (key, dim_idx, value) of the mean-pooled, chunk-normalised hashed vectors.

    Only non-zero buckets are emitted; ``to_vector`` rebuilds dense arrays.  The texts are dealt
    by ``key`` once; the sums, norms and chunk counts below all stay inside that distribution,
    so the tokens are read once and never shuffled.  The texts' lengths, summed first, give the number of
    parts: a task's share does not grow with the input.
    """
    rows = df.where(F.col(key).isNotNull()).select(key, text_col)
    chars = rows.agg(F.sum(F.length(text_col))).first()[0] or 0
    t = (rows.repartition(chars // PART_CHARS + 2, key)
         .select(key, F.posexplode(tokens(F.col(text_col))).alias("pos", "tok")))
    h = F.md5(F.col("tok"))
    bucket = (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % dim).cast("int")
    sign = F.when(F.conv(F.substring(h, 9, 1), 16, 10).cast("int") % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    t = t.select(key, (F.col("pos") / chunk_tokens).cast("int").alias("chunk"),
                 bucket.alias("dim_idx"), sign.alias("s"))
    cv = t.groupBy(key, "chunk", "dim_idx").agg(F.sum("s").alias("v"))
    # chunks are numbered 0..k-1 without gaps, so their number is max + 1 (no distinct needed)
    cv = (cv.withColumn("norm", F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key, "chunk"))))
          .withColumn("n_chunks", F.max("chunk").over(Window.partitionBy(key)) + 1))
    pooled = cv.where(F.col("norm") > 0).groupBy(key, "dim_idx").agg(
        F.sum(F.col("v") / F.col("norm")).alias("_sum"), F.max("n_chunks").alias("n_chunks"))
    return (pooled.select(key, "dim_idx", (F.col("_sum") / F.col("n_chunks")).alias("value"))
            .where(F.col("value") != 0))


def to_vector(long_df: DataFrame, key: str, dim: int = DEFAULT_DIM) -> DataFrame:
    """Dense ``array<double>`` per key from (key, dim_idx, value) rows (bounded by ``dim``)."""
    g = long_df.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("dim_idx", "value"))).alias("_m"))
    return g.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                                     lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0))).alias("embedding"))
