"""Row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postgrain.functions.text import unwrapped
from postgrain.session import broadcast_bounded

# What counts as a link, a word and a hashtag.
URL_PATTERN = r"(?i)(https?://|www\.)\S+"
WORD = r"\S++"
HASHTAG = r"#\w++"


def at_least_words(text: Column, n: int) -> Column:
    """Anchored and without backtracking, so it reads no further than the ``n``-th word."""
    return text.rlike(rf"(?U)\A\s*+(?:{WORD}\s++){{{n - 1}}}\S") if n > 0 else F.lit(True)


def more_hashtags_than(text: Column, n: int) -> Column:
    return text.rlike(rf"(?s)\A(?>.*?{HASHTAG}){{{n + 1}}}")


def with_keys(df: DataFrame, *cols: str) -> DataFrame:
    """Rows where every key is present (non-null)."""
    return df.dropna(subset=list(cols))


def corpus_prefilter(
    df: DataFrame,
    min_engagement: int = 10,
    min_chars: int = 100,
    min_words: int = 18,
    max_hashtags: int = 3,
    lang: str | None = "en",
) -> DataFrame:
    """Original posts in one language, long enough, engaging enough, without links and with few hashtags.

    Reads ``text`` and, where the table has them, ``engagement``, ``lang``, ``is_reply``, ``is_repost``, ``is_quote``.
    The cheap column tests come first; everything is a built-in expression, so it also runs on a stream.
    """
    text = F.col("text")
    tests: list[Column] = []
    if "engagement" in df.columns:
        tests.append(F.coalesce("engagement", F.lit(0)) >= min_engagement)
    if lang is not None and "lang" in df.columns:
        tests.append(F.col("lang") == lang)
    tests += [~F.coalesce(c, F.lit(False)) for c in ("is_reply", "is_repost", "is_quote") if c in df.columns]
    tests += [
        F.length(text) >= min_chars,
        ~text.startswith("@"),
        at_least_words(text, min_words),
        ~text.rlike(URL_PATTERN),
        ~more_hashtags_than(text, max_hashtags),
    ]
    for test in tests:
        df = df.filter(test)
    return df


def in_topics(df: DataFrame, topics: DataFrame, n_topics: int) -> DataFrame:
    """Rows of the chosen clusters, with their ``topic_name``; ``topics`` is the dimension of ``n_topics`` rows.

    A cluster listed twice counts once, with the greatest of its names.
    """
    dim = topics.groupBy(F.col("cluster_id").alias("topic")).agg(F.max("topic_name").alias("topic_name"))
    return df.join(broadcast_bounded(dim, n_topics), "topic").withColumnRenamed("topic", "cluster_id")


def not_noise(df: DataFrame) -> DataFrame:
    return df.filter(F.col("topic") != -1)


def complete_sets(rewrites: DataFrame, axes: list[str]) -> DataFrame:
    """Rewrites of posts that have one for every configured axis; rows of other axes are dropped.

    Counts first (one row per post after the map-side combine) and then joins, so no post's rows are sorted together.
    """
    known = rewrites.filter(F.col("axis").isin(axes))
    full = known.groupBy("post_id").agg(F.count_distinct("axis").alias("_n")).filter(F.col("_n") == len(axes))
    return known.join(full.select("post_id"), "post_id", "left_semi")


def is_labelled(raw: Column) -> Column:
    """True when an axes value is present and not empty, whether stored as an object or as JSON text of one."""
    entries = F.from_json(unwrapped(raw), "map<string,string>")
    return F.coalesce(F.size(entries) > 0, F.lit(False))


def in_range(score: Column, low: float = 0.2, high: float = 0.8) -> Column:
    """Inclusive range test in which a missing score (null or NaN) is outside."""
    return F.coalesce(score.between(low, high) & ~F.isnan(score), F.lit(False))
