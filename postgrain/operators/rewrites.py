"""Rewrites between their nested form (one post, a map of axes) and the long form (one row per post and axis)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postgrain.operators.filters import complete_sets

NESTED_SCHEMA = "post_id string, original string, rewrites map<string,struct<direction:string,rewrite:string>>"


def explode_rewrites(nested: DataFrame) -> DataFrame:
    """Long rows ``(post_id, axis, direction, original, rewrite)`` from nested posts."""
    entries = nested.select("post_id", "original", F.explode("rewrites").alias("axis", "r"))
    return entries.select("post_id", "axis", "r.direction", "original", "r.rewrite")


def nest_rewrites(long: DataFrame, axes: Sequence[str]) -> DataFrame:
    """One row per post with its map of rewrites of the configured axes.

    One conditional aggregate per axis, combined before the shuffle: a post's state never grows, however many copies
    of a rewrite arrive (of several, the greatest text stays).
    """
    entry = F.struct("direction", "rewrite")
    per_axis = [F.max(F.when(F.col("axis") == a, entry)).alias(f"_{i}") for i, a in enumerate(axes)]
    known = long.filter(F.col("axis").isin(list(axes)))
    posts = known.groupBy("post_id").agg(F.min("original").alias("original"), *per_axis)
    entries = F.array(*(F.struct(F.lit(a).alias("axis"), F.col(f"_{i}").alias("r")) for i, a in enumerate(axes)))
    present = F.filter(entries, lambda e: e["r"].isNotNull())
    return posts.select("post_id", "original", F.map_from_entries(present).alias("rewrites"))


def explode_pairs(long: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Pairs of complete posts, one per axis in configured order (``ord``)."""
    order = F.array_position(F.array(*(F.lit(a) for a in axes)), F.col("axis")) - 1
    return complete_sets(long, list(axes)).withColumn("ord", order.cast("int"))


def restore_context(rewrites: DataFrame, posts: DataFrame) -> DataFrame:
    """Original text and direction of cached rewrites ``(post_id, axis, rewrite)``.

    ``posts`` is long: ``(post_id, axis, text, score)``, one row per post and axis. An unknown post gets an empty
    original and direction ``up``.
    """
    known = posts.select("post_id", "axis", "text", "score").withColumn("_known", F.lit(True))
    joined = rewrites.join(known, ["post_id", "axis"], "left")
    down = F.col("_known") & ~F.coalesce(F.col("score") < 0.5, F.lit(False))
    return joined.select(
        "post_id",
        "axis",
        F.when(down, "down").otherwise("up").alias("direction"),
        F.coalesce("text", F.lit("")).alias("original"),
        "rewrite",
    )
