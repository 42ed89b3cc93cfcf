"""Both jobs from stored inputs to stored results. Every stage is skipped when its completed table exists.

A *family* is run by calling its function: ``run_dataset`` for the corpus, ``run_features`` for the feature analysis, or
one after the other. Folders below ``base``:

    posts, labels.csv            inputs of the corpus job
    vectors, topics, topic_info  text vectors, cluster of every post, table of clusters
    quality_model, scores, pool  classifier, score of every chosen-topic post, best posts per topic
    agent_scores, rankings       checkpoint of the scoring plug-in, all posts in its order
    dataset/version=N            chosen posts; from version 2 with style axes, a version more when labels arrive later
    axes, rewrites               checkpoints of the labelling and rewriting plug-ins
    diffs/run_n=N                difference vectors of N pairs
    sae-N, history-N, report-N   weights, training course and report for these N pairs
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postgrain.config import Config, axis_dim, require_valid, topic_dim
from postgrain.operators import axes as ax
from postgrain.operators import cluster as cl
from postgrain.operators import infer, numbering, rewrites, sae, terms, topn
from postgrain.operators.filters import not_noise
from postgrain.operators.quality import LinearModel, fit_quality, training_rows
from postgrain.plans import curation, features
from postgrain.session import stage
from postgrain.sources import tables as tb

Answer = Callable[[infer.Request], str | None]
Encoder = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Settings:
    """Sizes and thresholds of both jobs. ``eps`` is the neighbour distance in the reduced space."""

    sample: int = 500_000
    dims: int = 5
    eps: float = 0.05
    min_samples: int = 25
    min_cluster_size: int = 250
    min_df: int = 50
    max_df: float = 0.9
    pool: int = 1000
    final: int = 150
    rewrite_posts: int = 70
    slices: int = 8
    calls: int = infer.CALLS
    base_delay: float = 2.0


def discover(vectors: DataFrame, s: Settings) -> DataFrame:
    """Topic of every post: reduction and clusters from an exact sample, nearest core point for the rest."""
    axes = cl.fit_reduction(numbering.sample_exact(vectors, "post_id", s.sample), s.dims)
    points = stage(cl.reduce_dim(vectors, axes).select("post_id", "point"))
    chosen = stage(numbering.sample_exact(points, "post_id", s.sample))
    rest = numbering.rest_of(points, chosen, "post_id", s.sample)
    core = cl.cluster_core(chosen, s.eps, s.min_samples, s.min_cluster_size, s.dims)
    return cl.label_points(chosen, core).unionByName(cl.assign_topics(rest, core, s.eps, s.dims))


def topic_table(posts: DataFrame, topics: DataFrame, s: Settings) -> DataFrame:
    """Size, name and best terms of every topic."""
    texts = posts.select("post_id", "text").join(topics, "post_id").select("topic", "text")
    counts = terms.ngram_counts(texts, min_df=s.min_df, max_df=s.max_df)
    return terms.topic_info(topics, terms.class_tfidf(counts))


def run_dataset(
    spark: SparkSession,
    base: str,
    cfg: Config,
    score: Answer,
    label: Answer,
    encode: Encoder = terms.hash_embed,
    settings: Settings = Settings(),
) -> DataFrame:
    """Corpus job; returns its one-row summary. ``score`` and ``label`` answer prompts, ``encode`` adds ``embedding``."""
    s = settings
    dim = topic_dim(spark, cfg)
    require_valid(dim, axis_dim(spark, cfg))
    posts = tb.read_posts(spark, f"{base}/posts")

    def stored(name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return tb.reuse_or_build(spark, f"{base}/{name}", build)

    vectors = stored(
        "vectors",
        lambda: encode(posts.select("post_id", "text")).select("post_id", F.col("embedding").cast("array<float>")),
    )
    topics = stored("topics", lambda: discover(vectors, s))
    stored("topic_info", lambda: topic_table(posts, topics, s))

    def build_scores() -> DataFrame:
        def train() -> DataFrame:
            return fit_quality(training_rows(tb.read_labels(spark, f"{base}/labels.csv"), vectors)).to_frame(spark)

        model = LinearModel.from_frame(stored("quality_model", train))
        scored = curation.score_table(model, vectors, not_noise(topics), dim, len(cfg.topics))
        return scored.withColumn("probability_score", F.round("score", 4))

    scores = stored("scores", build_scores)
    pool = stored("pool", lambda: curation.candidate_pool(scores, posts, len(cfg.topics), s.pool))
    agent = infer.score_posts(pool, score, f"{base}/agent_scores", slices=s.slices, calls=s.calls, base_delay=s.base_delay)
    ranked = curation.with_agent_scores(pool, agent)
    stored("rankings", lambda: curation.rankings(ranked))
    chosen = stored("dataset/version=1", lambda: curation.final_dataset(ranked, s.final))
    axes = infer.label_posts(chosen, label, f"{base}/axes", cfg, slices=s.slices, calls=s.calls, base_delay=s.base_delay)
    return curation.dataset_summary(curation.update_dataset(spark, f"{base}/dataset", axes))


def run_features(
    spark: SparkSession,
    base: str,
    cfg: Config,
    rewrite: Answer,
    encode: Encoder = terms.hash_embed,
    settings: Settings = Settings(),
    **fit,
) -> DataFrame:
    """Feature job on the newest dataset; returns the feature report. ``fit`` goes to the autoencoder's training."""
    s = settings
    names = cfg.axis_names
    dataset = tb.read_latest(spark, f"{base}/dataset")
    scored = ax.midrange_count(ax.parse_axes(dataset, names), names)
    picked = topn.select_midrange(scored.select("post_id", "topic_name", "mid_count"), s.rewrite_posts)
    chosen = scored.join(picked.select("post_id"), "post_id", "left_semi")
    work = ax.rewrite_worklist(chosen, names)
    done = infer.generate_rewrites(
        work, axis_dim(spark, cfg), len(names), rewrite, f"{base}/rewrites", s.slices, calls=s.calls, base_delay=s.base_delay
    )
    keyed = rewrites.explode_pairs(done, names).withColumn("_key", F.concat_ws("/", "post_id", "axis"))
    pairs = stage(numbering.numbered(keyed, "_key", name="pair_id").drop("_key"))
    n_pairs = pairs.count()

    def build_diffs() -> DataFrame:
        # Both sides go through one encoder call, so that they share its vocabulary.
        sides = F.posexplode(F.array("original", "rewrite")).alias("side", "text")
        texts = pairs.select("pair_id", sides)
        vectors = stage(encode(texts).select("pair_id", "side", "embedding"))
        halves = [vectors.filter(F.col("side") == i).select("pair_id", "embedding") for i in (0, 1)]
        return features.pair_diffs(pairs.select("pair_id", "post_id", "axis", "direction"), *halves)

    diffs = tb.reuse_or_build(spark, f"{base}/diffs/run_n={n_pairs}", build_diffs)
    if not tb.exists(spark, f"{base}/sae-{n_pairs}/_SUCCESS"):
        model, history = sae.sae_fit(diffs, **fit)
        tb.reuse_or_build(spark, f"{base}/history-{n_pairs}", lambda: history)
        tb.reuse_or_build(spark, f"{base}/sae-{n_pairs}", lambda: model.to_frame(spark))
    model = sae.Sae.from_frame(tb.load_weights(spark, f"{base}/sae-{n_pairs}"))
    return tb.reuse_or_build(
        spark, f"{base}/report-{n_pairs}", lambda: features.report(sae.sae_encode(diffs, model), done, names)
    )
