"""The library's tables derived from the shared test tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postgrain.config import load_config
from postgrain.operators.quality import LinearModel
from postgrain.operators.sae import Sae
from postgrain.session import spread

CONFIG = load_config()
AXES = CONFIG.axis_names
DIM = 64
N_TOPICS = 10

# A model with fixed weights, so that scores have a SQL form.
FIXED_WEIGHTS = [((j % 7) - 3) / 10.0 for j in range(DIM)]
FIXED_BIAS = 0.1
FIXED_MODEL = LinearModel(np.array(FIXED_WEIGHTS), FIXED_BIAS)

# An autoencoder feature for each coordinate.
FIXED_FEATURES = DIM
ENCODER_BIAS = -0.1


def fixed_sae() -> Sae:
    eye = np.eye(FIXED_FEATURES, DIM)
    bias = np.full((1, FIXED_FEATURES), ENCODER_BIAS)
    return Sae({"W_enc": eye, "b_enc": bias, "W_dec": eye.copy(), "b_dec": np.zeros((1, DIM))})


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_id(col: str):
    return F.col(col).cast("string").alias("post_id")


def posts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as posts; engagement is the number of events of the user with the document's number.

    The test file is a single row group: its texts are spread over the cores (no-op for a table of many splits).
    """
    events = table(spark, sf, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    docs = spread(table(spark, sf, "documents")).join(events, "doc_id", "left")
    engagement = F.coalesce("n", F.lit(0)).alias("engagement")
    return docs.select(text_id("doc_id"), "doc_id", "text", F.col("source").alias("topic_name"), "lang", engagement)


POSTS = """posts as (
  select cast(doc_id as varchar) as post_id, doc_id, text, source as topic_name, lang, coalesce(n, 0) as engagement
  from documents left join (select user_id, count(*) as n from events group by user_id) on user_id = doc_id)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(text_id("vec_id"), "embedding")


def topics(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(text_id("vec_id"), F.col("label").alias("topic"))


def topic_names(spark: SparkSession, sf: str) -> DataFrame:
    """The chosen clusters are those of at least mean size; their dimension comes from the table."""
    emb = table(spark, sf, "embeddings")
    mean = emb.agg(F.count(F.lit(1)) / F.count_distinct("label")).scalar()
    sizes = emb.groupBy(F.col("label").alias("cluster_id")).agg(F.count(F.lit(1)).alias("n"))
    name = F.concat(F.lit("topic "), F.col("cluster_id").cast("string")).alias("topic_name")
    return sizes.filter(F.col("n") >= mean).select("cluster_id", name)


CHOSEN_TOPICS = """(select label from embeddings group by label
   having count(*) >= (select count(*) / count(distinct label) from embeddings))"""


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select(text_id("doc_id"), F.col("quality").alias("label"))


def derived_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Posts of all topics with a repeatable score; many scores are equal after rounding to four decimals."""
    key = F.col("vec_id").cast("double")
    return (
        table(spark, sf, "embeddings").select(
            text_id("vec_id"),
            F.concat(F.lit("topic "), F.col("label").cast("string")).alias("topic_name"),
            F.col("label").alias("cluster_id"),
            ((key * 7919 % 10007) / 100070.0).alias("score"),
        )
    )


DERIVED_SCORES = """scored as (
  select cast(vec_id as varchar) as post_id, 'topic ' || label as topic_name, label as cluster_id,
         (vec_id::double * 7919 % 10007) / 100070.0 as score
  from embeddings)"""


def agent_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as a ranked pool with agent scores that have ties and gaps."""
    docs = posts(spark, sf)
    n = F.col("doc_id")
    agent = F.when(n % 17 != 0, (n * 13 % 21).cast("double") / 20.0)
    lr = F.round((n.cast("double") * 7919 % 10007) / 10007.0, 4)
    return docs.select(
        "post_id",
        "topic_name",
        agent.alias("agent_score"),
        lr.alias("lr_score"),
        "engagement",
        "text",
        (n * 31 % 1009 + 1).alias("pool_rn"),
    )


AGENT_POOL = (
    POSTS
    + """, pool as (
  select post_id, topic_name,
         case when doc_id % 17 <> 0 then (doc_id * 13 % 21)::double / 20.0 end as agent_score,
         round((doc_id::double * 7919 % 10007) / 10007.0, 4) as lr_score, engagement, text,
         doc_id * 31 % 1009 + 1 as pool_rn
  from posts)"""
)


def axis_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Posts with one score per axis; every 19th value is missing."""
    docs = posts(spark, sf)
    n = F.col("doc_id")
    scores = {
        a: F.when((n + i) % 19 != 0, (n * (i + 3) * 37 % 101).cast("double") / 100.0) for i, a in enumerate(AXES)
    }
    return docs.select("post_id", "doc_id", "topic_name", "text", *(c.alias(a) for a, c in scores.items()))


AXIS_LIST = ", ".join(f"({i}, '{a}')" for i, a in enumerate(AXES))
AXIS_SCORES = (
    POSTS
    + f""", axes(ord, axis) as (values {AXIS_LIST}), axis_scores as (
  select post_id, doc_id, topic_name, text, ord, axis,
         case when (doc_id + ord) % 19 <> 0 then (doc_id * (ord + 3) * 37 % 101)::double / 100.0 end as score
  from posts cross join axes)"""
)


def pair_table(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs, original vectors and rewrite vectors: vector i is rewritten into vector i + 1, the last into the first."""
    emb = table(spark, sf, "embeddings")
    n = emb.agg(F.count(F.lit(1))).scalar()
    axis = F.element_at(F.array(*(F.lit(a) for a in AXES)), (F.col("vec_id") % len(AXES) + 1).cast("int"))
    pairs = emb.select(
        F.col("vec_id").alias("pair_id"),
        text_id("vec_id"),
        axis.alias("axis"),
        F.when(F.col("vec_id") % 2 == 0, "up").otherwise("down").alias("direction"),
    )
    originals = emb.select(F.col("vec_id").alias("pair_id"), "embedding")
    rewrites = emb.select(F.pmod(F.col("vec_id") - 1, n).alias("pair_id"), "embedding")
    return pairs, originals, rewrites


_AXIS_CASE = "list_extract([" + ", ".join(f"'{a}'" for a in AXES) + "], (a.vec_id % 7 + 1)::int)"
PAIRS = f"""raw_pairs as (
  select a.vec_id as pair_id, cast(a.vec_id as varchar) as post_id, {_AXIS_CASE} as axis,
         case when a.vec_id % 2 = 0 then 'up' else 'down' end as direction,
         list_transform(range(1, 65), lambda i: b.embedding[i]::double - a.embedding[i]::double) as raw
  from embeddings a join embeddings b
    on b.vec_id = (a.vec_id + 1) % (select count(*) from embeddings)),
pairs as (
  select pair_id, post_id, axis, direction, sqrt(list_inner_product(raw, raw)) as norm,
         list_transform(raw, lambda v: v * (case when direction = 'down' then -1.0 else 1.0 end)
           / greatest(sqrt(list_inner_product(raw, raw)), 1e-8)) as diff
  from raw_pairs)"""
ACTIVATIONS = (
    PAIRS
    + f""", acts as (
  select pair_id, post_id, axis, direction, norm, i - 1 as feature,
         greatest(diff[i] + ({ENCODER_BIAS}), 0.0) as value
  from pairs cross join range(1, {FIXED_FEATURES + 1}) r(i))"""
)
