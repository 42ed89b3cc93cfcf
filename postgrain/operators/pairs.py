"""Difference vectors of text pairs and their normal form."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postgrain.functions.vectors import l2_norm, negate, scale, subtract


def join_sides(pairs: DataFrame, originals: DataFrame, rewrites: DataFrame) -> DataFrame:
    """Attach ``orig`` and ``rew`` vectors to pairs by ``pair_id``; both inputs are ``(pair_id, embedding)``."""
    return pairs.join(originals.withColumnRenamed("embedding", "orig"), "pair_id").join(
        rewrites.withColumnRenamed("embedding", "rew"), "pair_id"
    )


def diff_vectors(df: DataFrame) -> DataFrame:
    """Replace ``orig`` and ``rew`` by ``diff`` = rewrite minus original, and its length ``norm``."""
    return df.withColumn("diff", subtract(F.col("rew"), F.col("orig"))).drop("orig", "rew").withColumn(
        "norm", l2_norm(F.col("diff"))
    )


def sign_normalize(df: DataFrame) -> DataFrame:
    """Flip vectors of direction ``down`` so that all point towards more of their axis."""
    return df.withColumn("diff", F.when(F.col("direction") == "down", negate(F.col("diff"))).otherwise(F.col("diff")))


def l2_normalize(df: DataFrame, col: str = "diff", floor: float = 1e-8) -> DataFrame:
    norm = F.col("norm") if "norm" in df.columns else l2_norm(F.col(col))
    return df.withColumn(col, scale(F.col(col), F.lit(1.0) / F.greatest(norm, F.lit(floor))))


def normal_diffs(df: DataFrame, floor: float = 1e-8) -> DataFrame:
    """All three steps: difference, sign and unit length. The vector is rewritten once."""
    flipped = F.when(F.col("direction") == "down", -1.0).otherwise(1.0)
    diffs = diff_vectors(df)
    return diffs.withColumn("diff", scale(F.col("diff"), flipped / F.greatest("norm", F.lit(floor))))


def pair_stats(diffs: DataFrame) -> DataFrame:
    """Pairs, flipped pairs, width and mean length before normalisation (floored like the division)."""
    return diffs.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(F.col("direction") == "down").alias("flipped"),
        F.max(F.size("diff")).alias("dims"),
        F.avg("norm").alias("mean_norm"),
        F.avg(F.greatest("norm", F.lit(1e-8))).alias("mean_floored_norm"),
    )


def axis_distribution(diffs: DataFrame) -> DataFrame:
    return diffs.groupBy("axis").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("direction") == "down").alias("flipped")
    )


def mean_pool(tokens: DataFrame, key: str = "text_id") -> DataFrame:
    """Mean of the unmasked token vectors of each text: ``(key, embedding)``.

    ``tokens`` has ``mask`` (0/1) and ``vec``. Vectors are summed per map task before the shuffle, one vector per text,
    so one very long text is no hot group. A text without unmasked tokens gives zeros.
    """
    used = F.col("mask") == 1
    vec = F.when(used, F.col("vec")).otherwise(F.transform("vec", lambda x: F.lit(0).cast("float")))
    sums = tokens.groupBy(key).agg(
        vector_to_array(Summarizer.sum(array_to_vector(vec))).alias("_sum"), F.count_if(used).alias("_n")
    )
    mean = F.transform("_sum", lambda x: x / F.greatest("_n", F.lit(1)))
    return sums.select(key, mean.alias("embedding"))
