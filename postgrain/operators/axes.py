"""Style-axis scores: parsing, wide and long form, mid-range counts, direction and target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postgrain.functions.text import is_object, unwrapped
from postgrain.operators.filters import in_range


def _axis_value(entries: Column, axis: str) -> Column:
    raw = F.try_element_at(entries, F.lit(axis))
    number = F.when(is_object(raw), F.get_json_object(raw, "$.score")).otherwise(raw)
    value = number.try_cast("double")
    return F.when(~F.isnan(value), value)


def parse_axes(df: DataFrame, axes: Sequence[str], raw: str = "axes_json") -> DataFrame:
    """One double column per axis from ``{axis: {"score": x}}`` or ``{axis: x}``.

    The value may be an object's JSON text or a JSON string that holds that text. Missing scores are null, never NaN.
    """
    entries = F.from_json(unwrapped(F.col(raw)), "map<string,string>")
    parsed = df.withColumn("_entries", entries)
    return parsed.withColumns({a: _axis_value(F.col("_entries"), a) for a in axes}).drop("_entries")


def axes_long(df: DataFrame, axes: Sequence[str], keep: Sequence[str] = ("post_id",)) -> DataFrame:
    """Rows ``(keep..., ord, axis, score)``, one per post and axis, axes in configured order."""
    pairs = F.array(
        *(
            F.struct(F.lit(i).alias("ord"), F.lit(a).alias("axis"), F.col(a).cast("double").alias("score"))
            for i, a in enumerate(axes)
        )
    )
    return df.select(*keep, F.inline(pairs))


def axes_wide(long: DataFrame, axes: Sequence[str], key: str = "post_id") -> DataFrame:
    """One column per axis again; conditional aggregates over the known axes, combined before the shuffle."""
    return long.groupBy(key).agg(*(F.max(F.when(F.col("axis") == a, F.col("score"))).alias(a) for a in axes))


def midrange_count(df: DataFrame, axes: Sequence[str], low: float = 0.2, high: float = 0.8) -> DataFrame:
    count = sum((in_range(F.col(a), low, high).cast("int") for a in axes), F.lit(0))
    return df.withColumn("mid_count", count)


def direction_target(df: DataFrame, step: float = 0.4) -> DataFrame:
    """Scores below one half go ``up`` by ``step``, all others ``down``, within [0, 1].

    A missing score goes ``down`` and its target stays missing.
    """
    score = F.col("score")
    up = score < 0.5
    target = F.when(up, F.least(score + step, F.lit(1.0))).otherwise(F.greatest(score - step, F.lit(0.0)))
    return df.withColumn("direction", F.when(up, "up").otherwise("down")).withColumn(
        "target", F.when(score.isNotNull(), target)
    )


def rewrite_worklist(selected: DataFrame, axes: Sequence[str], text: str = "text") -> DataFrame:
    """Every selected post times every axis with current score, direction and target.

    The axes are literals of the plan, so the product is a projection and needs no join.
    """
    long = axes_long(selected, axes, ("post_id", F.col(text).alias("original")))
    return direction_target(long)
