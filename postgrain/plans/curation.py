"""From posts, vectors, topics and a few labels to the chosen and annotated dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postgrain.operators.filters import in_topics, is_labelled
from postgrain.operators.joins import fetch_selected
from postgrain.operators.quality import LinearModel, fit_quality, score_quality, training_rows
from postgrain.operators.topn import rank_all, topn_agent, topn_pool
from postgrain.sources.tables import latest_version, read_latest, replace_dataset

POST_DEFAULTS = {"text": "", "engagement": 0}


def score_table(model: LinearModel, vectors: DataFrame, topics: DataFrame, dim: DataFrame, n_topics: int) -> DataFrame:
    """``(post_id, topic_name, cluster_id, score)`` of posts in chosen topics that have a vector.

    Vectors are reduced to a score where they are read; only ids and scores are shuffled for the join with topics.
    """
    scores = score_quality(model, vectors).select("post_id", "score")
    chosen = in_topics(topics, dim, n_topics)
    return chosen.join(scores, "post_id").select("post_id", "topic_name", "cluster_id", "score")


def candidate_pool(
    scored: DataFrame, posts: DataFrame, n_topics: int, n: int = 1000, rounded: bool = False
) -> DataFrame:
    """Best ``n`` posts per topic with text and engagement; missing posts get empty text and 0."""
    top = topn_pool(scored, n, rounded)
    full = fetch_selected(top, posts, n * n_topics, POST_DEFAULTS)
    return full.select(
        "post_id",
        "topic_name",
        "cluster_id",
        "text",
        "engagement",
        F.round("score", 4).alias("lr_score"),
        "pool_rn",
    )


def quality_pool(
    labels: DataFrame,
    vectors: DataFrame,
    topics: DataFrame,
    posts: DataFrame,
    dim: DataFrame,
    n_topics: int,
    n: int = 1000,
    **fit,
) -> DataFrame:
    """Train on the labels, score the chosen topics, keep the best ``n`` posts of each."""
    model = fit_quality(training_rows(labels, vectors), **fit)
    return candidate_pool(score_table(model, vectors, topics, dim, n_topics), posts, n_topics, n)


def with_agent_scores(pool: DataFrame, scores: DataFrame) -> DataFrame:
    """Pool rows with their agent score; null where none was stored."""
    return pool.join(scores.select("post_id", F.col("score").alias("agent_score")), "post_id", "left")


def rankings(pool: DataFrame) -> DataFrame:
    """All posts in agent-score order with the stored columns."""
    columns = ["post_id", "topic_name", "agent_score", "lr_score", "engagement", "text"]
    return rank_all(pool).select(*columns)


def final_dataset(pool: DataFrame, n: int = 150) -> DataFrame:
    """The chosen posts, topics in name order and best first; a missing agent score is stored as 0."""
    chosen = topn_agent(pool, n).withColumn("agent_score", F.coalesce("agent_score", F.lit(0.0)))
    columns = ["post_id", "topic_name", "text", "engagement", "lr_score", "agent_score"]
    return chosen.orderBy("topic_name", "rn").select(*columns)


def annotate(dataset: DataFrame, axes: DataFrame) -> DataFrame:
    """Dataset with ``axes_json`` from the labelling table; a post's earlier value is kept where it has no new one."""
    new = axes.select("post_id", F.col("axes_json").alias("_new"))
    joined = dataset.join(new, "post_id", "left")
    old = F.col("axes_json") if "axes_json" in dataset.columns else F.lit(None).cast("string")
    return joined.withColumn("axes_json", F.coalesce("_new", old)).drop("_new")


def update_dataset(spark: SparkSession, base: str, axes: DataFrame) -> DataFrame:
    """The newest version with the axes of the labelling table, written as the next one when that labels more posts.

    So answers that arrive in a later run reach the dataset, and a run without new ones writes nothing.
    """
    newest = latest_version(spark, base)
    held = read_latest(spark, base).drop("version")
    made = annotate(held, axes)
    labelled = F.count_if(is_labelled(F.col("axes_json")))
    before = held.agg(labelled).first()[0] if "axes_json" in held.columns else -1
    if made.agg(labelled).first()[0] > before:
        replace_dataset(made, base, newest + 1)
    return read_latest(spark, base)


def dataset_summary(dataset: DataFrame) -> DataFrame:
    return dataset.agg(
        F.count(F.lit(1)).alias("posts"),
        F.count_distinct("topic_name").alias("topics"),
        F.count_if(is_labelled(F.col("axes_json"))).alias("labelled"),
        F.count_if(~is_labelled(F.col("axes_json"))).alias("missing"),
    )

