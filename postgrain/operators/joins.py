"""Key joins that replace dictionary look-ups, with the counters kept next to them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postgrain.operators.topn import dedupe
from postgrain.session import broadcast_bounded, stage

# Fixed value: price in dollars of one rewrite request.
REWRITE_COST = 0.00062


def attach(df: DataFrame, other: DataFrame, on: Sequence[str], defaults: Mapping[str, Any]) -> DataFrame:
    """Left join that fills the listed columns of ``other`` where nothing matched."""
    joined = df.join(other, list(on), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def fetch_selected(
    selected: DataFrame,
    posts: DataFrame,
    rows: int | None,
    defaults: Mapping[str, Any],
    on: Sequence[str] = ("post_id",),
    one: bool = False,
) -> DataFrame:
    """Bring wide post columns to a selection of at most ``rows`` rows (None: as many as are counted).

    The selection is sent to the posts, not the reverse: while the bound is small, the post table is filtered where it
    is read and its text is never shuffled. The selection is used twice and therefore written once. With ``one``, a key
    of several posts takes the greatest of their values, so that no selected row is multiplied.
    """
    selected = stage(selected)
    rows = selected.count() if rows is None else rows
    keys = broadcast_bounded(selected.select(*on).distinct(), rows)
    wanted = posts.select(*on, *defaults).join(keys, list(on), "left_semi")
    if one:
        greatest = F.max(F.struct(*defaults)).alias("_v")
        wanted = wanted.groupBy(*on).agg(greatest).select(*on, *(F.col(f"_v.{c}") for c in defaults))
    return attach(selected, wanted, on, defaults)


def keep_ids(df: DataFrame, ids: DataFrame, key: str = "post_id") -> DataFrame:
    """Rows whose key occurs in ``ids``."""
    return df.join(ids.select(key), key, "left_semi")


def common_ids(a: DataFrame, b: DataFrame, key: str = "post_id") -> DataFrame:
    """Distinct keys present on both sides."""
    return a.select(key).join(b.select(key), key, "left_semi").distinct()


def pending(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work rows whose key has no finished row."""
    return work.join(done.select(*keys), list(keys), "left_anti")


def override(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union in which a key's newest row wins; keys are unique within each input."""
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    return dedupe(both, keys, ["_age"]).drop("_age")


def lookup_checked(df: DataFrame, dim: DataFrame, on: str, dim_rows: int) -> DataFrame:
    """Inner look-up in a small dimension that fails on an unknown id instead of dropping the row."""
    joined = df.join(broadcast_bounded(dim.withColumn("_known", F.lit(True)), dim_rows), on, "left")
    message = F.concat(F.lit(f"unknown {on}: "), F.coalesce(F.col(on).cast("string"), F.lit("null")))
    known = F.when(F.col("_known"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return joined.filter(known).drop("_known")


def label_counts(labels: DataFrame) -> DataFrame:
    return labels.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("label") == 1).alias("pos"),
        F.count_if(F.col("label") == 0).alias("neg"),
    )


def missing_counts(df: DataFrame, other: DataFrame, on: str) -> DataFrame:
    """How many keys of ``df`` find a row in ``other``.

    ``other`` is reduced to the keys of ``df`` first; when those are few, Spark broadcasts them by their measured size
    and a large ``other`` is never shuffled.
    """
    wanted = df.select(on).distinct()
    known = other.select(on).join(wanted, on).distinct().withColumn("_known", F.lit(True))
    return df.join(known, on, "left").agg(
        F.count(F.lit(1)).alias("total"),
        F.count("_known").alias("matched"),
        F.count_if(F.col("_known").isNull()).alias("missing"),
    )


def progress(work: DataFrame, done: DataFrame, keys: Sequence[str], cost: float = REWRITE_COST) -> DataFrame:
    """Needed, finished and remaining items of a work list, with the price of the rest."""
    marks = done.select(*keys).distinct().withColumn("_done", F.lit(True))
    counts = work.join(marks, list(keys), "left").agg(
        F.count(F.lit(1)).alias("needed"),
        F.count("_done").alias("done"),
        F.count_if(F.col("_done").isNull()).alias("todo"),
    )
    return counts.withColumn("cost", F.round(F.col("todo") * F.lit(cost), 2))
