"""From text-pair vectors to the feature report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from postgrain.operators.lift import (
    axis_activity,
    feature_categories,
    feature_examples,
    feature_report,
    lift_matrix,
)
from postgrain.operators.pairs import join_sides, normal_diffs
from postgrain.operators.sae import Sae, sae_encode, sae_fit
from postgrain.session import stage


def pair_diffs(pairs: DataFrame, originals: DataFrame, rewrites: DataFrame) -> DataFrame:
    """Normalised difference vectors ``(pair_id, post_id, axis, direction, diff, norm)``."""
    return normal_diffs(join_sides(pairs, originals, rewrites))


def lift_tables(encoded: DataFrame, axes: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Activity, lift and category tables of encoded pairs; the pairs are read once."""
    activity = stage(axis_activity(encoded))
    lift = lift_matrix(activity, axes)
    return activity, lift, feature_categories(lift)


def report(encoded: DataFrame, rewrites: DataFrame, axes: Sequence[str], examples: int = 10) -> DataFrame:
    """The nested feature report: density, category, lifts and top examples with their texts.

    The activations are stored once, without the wide vectors they come from, and read for both halves.
    """
    encoded = stage(encoded.select("pair_id", "post_id", "axis", "direction", "activations"))
    _, lift, cats = lift_tables(encoded, axes)
    return feature_report(cats, lift, feature_examples(encoded, rewrites, examples))


def fit_and_report(
    diffs: DataFrame, rewrites: DataFrame, axes: Sequence[str], **fit
) -> tuple[Sae, DataFrame, DataFrame]:
    """Train the autoencoder on the difference vectors and report on it: ``(weights, history, report)``."""
    diffs = stage(diffs)
    sae, history = sae_fit(diffs, **fit)
    return sae, history, report(sae_encode(diffs, sae), rewrites, axes)
