"""Feature statistics over sparse activations: density, lift per axis, categories, coverage and examples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postgrain.operators.joins import fetch_selected
from postgrain.operators.topn import topn

# Thresholds and category names with their report order.
DEAD_DENSITY = 0.01
CONFIRM_LIFT = 0.30
PARTIAL_LIFT = 0.15
CATEGORIES = ("confirms_axis", "partial_overlap", "novel_candidate", "dead")


def activations_long(acts: DataFrame, col: str = "activations") -> DataFrame:
    """One row per vector and feature: the other columns, ``feature`` and ``value``."""
    rest = [c for c in acts.columns if c != col]
    return acts.select(*rest, F.posexplode(col).alias("feature", "value"))


def axis_activity(acts: DataFrame) -> DataFrame:
    """The only pass over the vectors: ``(feature, axis, n, active, peak)``, features times axes rows.

    All other statistics of this module derive from this small table.
    """
    return activations_long(acts.select("axis", "activations")).groupBy("feature", "axis").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("value") > 0).alias("active"),
        F.max("value").alias("peak"),
    )


def feature_density(activity: DataFrame) -> DataFrame:
    """Share of vectors each feature is active on, and whether it never is."""
    return activity.groupBy("feature").agg(
        (F.sum("active") / F.sum("n")).alias("density"), (F.max("peak") <= 0).alias("never_active")
    )


def overall_density(activity: DataFrame) -> DataFrame:
    return activity.agg((F.sum("active") / F.sum("n")).alias("density"))


def lift_matrix(activity: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Rows ``(feature, axis, ord, density, lift)`` for every feature and axis.

    Lift is the active share inside the axis minus the active share outside it; an empty side counts as 0. Features
    below the dead threshold get lift 0.
    """
    counts = F.struct("axis", F.struct("n", "active"))
    whole = activity.groupBy("feature").agg(
        F.sum("n").alias("n_all"),
        F.sum("active").alias("active_all"),
        F.map_from_entries(F.collect_list(F.when(F.col("axis").isin(list(axes)), counts))).alias("by_axis"),
    )
    grid = whole.select("*", F.posexplode(F.array(*(F.lit(a) for a in axes))).alias("ord", "axis"))
    side = F.try_element_at("by_axis", F.col("axis"))
    n, a = F.coalesce(side["n"], F.lit(0)), F.coalesce(side["active"], F.lit(0))

    def share(part: Column, of: Column) -> Column:
        return F.when(of > 0, part / F.when(of > 0, of)).otherwise(0.0)

    density = F.col("active_all") / F.col("n_all")
    lift = share(a, n) - share(F.col("active_all") - a, F.col("n_all") - n)
    return grid.select(
        "feature",
        "axis",
        "ord",
        density.alias("density"),
        F.when(density < DEAD_DENSITY, 0.0).otherwise(lift).alias("lift"),
    )


def feature_categories(
    lift: DataFrame, confirm: float = CONFIRM_LIFT, partial: float = PARTIAL_LIFT, dead: float = DEAD_DENSITY
) -> DataFrame:
    """One row per feature: ``(feature, density, category, best_axis, best_lift)``.

    The best axis has the largest absolute lift after rounding to four decimals, the first axis on ties. The input is
    the small lift table.
    """
    rounded = lift.withColumn("lift", F.round("lift", 4))
    best = rounded.groupBy("feature").agg(
        F.max("density").alias("density"),
        F.max_by(F.struct("axis", "lift"), F.struct(F.abs("lift"), -F.col("ord"))).alias("b"),
    )
    size = F.abs("b.lift")
    category = (
        F.when(F.col("density") < dead, CATEGORIES[3])
        .when(size >= confirm, CATEGORIES[0])
        .when(size >= partial, CATEGORIES[1])
        .otherwise(CATEGORIES[2])
    )
    is_dead = F.col("density") < dead
    return best.select(
        "feature",
        F.round("density", 4).alias("density"),
        category.alias("category"),
        F.when(~is_dead, F.col("b.axis")).alias("best_axis"),
        F.when(is_dead, 0.0).otherwise(F.col("b.lift")).alias("best_lift"),
    )


def category_counts(cats: DataFrame) -> DataFrame:
    counts = cats.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.select("category", "n", F.round(100 * share, 1).alias("percent"))


def axis_coverage(cats: DataFrame, axes: DataFrame) -> DataFrame:
    """Per axis: features that confirm or partly overlap it, by category, and whether there is any."""
    hits = cats.filter(F.col("category").isin(*CATEGORIES[:2])).groupBy("best_axis").agg(
        F.count_if(F.col("category") == CATEGORIES[0]).alias("confirms"),
        F.count_if(F.col("category") == CATEGORIES[1]).alias("partial"),
        F.array_sort(F.collect_list(F.struct("feature", "best_lift"))).alias("features"),
    )
    covered = axes.select("ord", "axis").join(hits, F.col("axis") == F.col("best_axis"), "left")
    return covered.select(
        "ord",
        "axis",
        F.coalesce("confirms", F.lit(0)).alias("confirms"),
        F.coalesce("partial", F.lit(0)).alias("partial"),
        F.coalesce("features", F.array().cast("array<struct<feature:int,best_lift:double>>")).alias("features"),
        F.when(F.col("best_axis").isNotNull(), "✓").otherwise("✗").alias("covered"),
    )


def axis_best_feature(lift: DataFrame, dead: float = DEAD_DENSITY) -> DataFrame:
    """Per axis: the live feature with the largest absolute lift (lowest number on ties) and the axis' category.

    An axis without any non-zero lift has feature -1.
    """
    usable = (F.col("density") >= dead) & (F.col("lift") != 0)
    key = F.when(usable, F.struct(F.abs("lift"), -F.col("feature")))
    best = lift.groupBy("ord", "axis").agg(F.max_by(F.struct("feature", "lift"), key).alias("b"), F.max(key).alias("k"))
    value = F.when(F.col("k").isNotNull(), F.col("b.lift")).otherwise(0.0)
    return best.select(
        "ord",
        "axis",
        F.when(F.col("k").isNotNull(), F.col("b.feature")).otherwise(-1).alias("feature"),
        value.alias("lift"),
        F.when(F.abs(value) >= CONFIRM_LIFT, CATEGORIES[0])
        .when(F.abs(value) >= PARTIAL_LIFT, CATEGORIES[1])
        .otherwise(CATEGORIES[2])
        .alias("category"),
    )


def top_features(cats: DataFrame, n: int = 20, nonzero: bool = False) -> DataFrame:
    rows = cats.filter(F.col("best_lift") != 0) if nonzero else cats
    return rows.orderBy(F.abs("best_lift").desc(), "feature").limit(n)


def category_order(col: str = "category") -> Column:
    return F.array_position(F.array(*(F.lit(c) for c in CATEGORIES)), F.col(col))


def heatmap_order(lift: DataFrame, floor: float = 0.10) -> DataFrame:
    """Features by their largest absolute lift, with the symmetric colour scale shared by all."""
    sizes = lift.groupBy("feature").agg(F.max(F.abs("lift")).alias("max_lift"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("max_lift").desc(), "feature"))
    scale = F.greatest(F.max("max_lift").over(Window.partitionBy(F.lit(0))), F.lit(floor))
    return sizes.select("feature", "max_lift", place.alias("place"), scale.alias("scale"))


def density_hist(density: DataFrame, bins: int = 15) -> DataFrame:
    """Equal-width histogram of feature densities from their minimum to their maximum, empty bins included.

    When all densities are equal the range is widened by one half on both sides.
    """
    whole = Window.partitionBy(F.lit(0))  # one row per feature
    low, high = F.min("density").over(whole), F.max("density").over(whole)
    spans = density.select(
        "density",
        F.when(low == high, low - 0.5).otherwise(low).alias("lo"),
        F.when(low == high, high + 0.5).otherwise(high).alias("hi"),
        F.avg("density").over(whole).alias("mean"),
    )
    bucket = F.least(F.width_bucket("density", "lo", "hi", F.lit(bins)), F.lit(bins)).cast("int")
    counts = spans.groupBy("lo", "hi", "mean", bucket.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    filled = counts.groupBy("lo", "hi", "mean").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", F.col("n")))).alias("found")
    )
    width = (F.col("hi") - F.col("lo")) / bins
    return filled.select("*", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin")).select(
        "bin",
        (F.col("lo") + (F.col("bin") - 1) * width).alias("low"),
        (F.col("lo") + F.col("bin") * width).alias("high"),
        F.coalesce(F.try_element_at("found", "bin"), F.lit(0)).alias("n"),
        "mean",
    )


def feature_examples(acts: DataFrame, rewrites: DataFrame | None = None, n: int = 10) -> DataFrame:
    """The ``n`` strongest active vectors of every feature, with their texts.

    Ranking carries keys only. The ranked keys, at most ``n`` a feature, are then sent to the rewrites, so that their
    texts are read where they lie; a post and axis of several rewrites shows the greatest, one of none the empty string.
    """
    long = activations_long(acts.select("pair_id", "post_id", "axis", "direction", "activations"))
    top = topn(long.filter("value > 0"), ["feature"], [F.col("value").desc(), F.col("pair_id")], n)
    if rewrites is None:
        return top
    return fetch_selected(top, rewrites, None, {"original": "", "rewrite": ""}, on=["post_id", "axis"], one=True)


def feature_report(cats: DataFrame, lift: DataFrame, examples: DataFrame) -> DataFrame:
    """One nested record per feature in report order: category, then size of the lift, then number."""
    lifts = lift.groupBy("feature").agg(
        F.map_from_entries(
            F.transform(
                F.array_sort(F.collect_list(F.struct("ord", "axis", F.round("lift", 4).alias("lift")))),
                lambda e: F.struct(e["axis"], e["lift"]),
            )
        ).alias("lifts")
    )
    example = F.struct(
        "rn",
        F.col("post_id").alias("pid"),
        "axis",
        "direction",
        F.round("value", 4).alias("activation"),
        "original",
        "rewrite",
    )
    shown = examples.groupBy("feature").agg(F.array_sort(F.collect_list(example)).alias("examples"))
    shown = shown.withColumn("examples", F.transform("examples", lambda e: e.dropFields("rn")))
    joined = cats.join(lifts, "feature", "left").join(shown, "feature", "left")
    kept = F.when(F.col("category") != "dead", F.col("examples"))
    return joined.select(
        F.col("feature").alias("f"),
        "density",
        "category",
        "lifts",
        "best_axis",
        "best_lift",
        F.coalesce(kept, F.array().cast(shown.schema["examples"].dataType)).alias("examples"),
    ).orderBy(category_order(), F.abs("best_lift").desc(), "f")
