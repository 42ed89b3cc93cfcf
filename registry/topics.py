"""Terms per topic, topic tables, text vectors and density clustering."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from postgrain.functions.vectors import affine
from postgrain.operators import cluster as cl
from postgrain.operators import numbering, terms
from registry import fixtures as fx
from registry import query

SIX = 6

# A short stop list, so that the SQL form can name it.
STOP = ["the", "of", "and", "to", "in", "de", "la", "le", "der", "die", "und", "el", "que", "les"]
STOP_SQL = ", ".join(f"'{w}'" for w in STOP)

TERMS_SQL = f"""tokens as (
  select source as topic, doc_id,
         list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w not in ({STOP_SQL})) as ws
  from documents),
grams as (
  select topic, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) as term
  from tokens),
all_counts as (select topic, term, count(*) as tf from grams group by topic, term),
vocabulary as (
  select term from all_counts group by term
  having count(*) >= 3 and count(*) <= 0.9 * (select count(distinct source) from documents)
  order by sum(tf) desc, term limit 3000),
counts as (select topic, term, tf from all_counts where term in (select term from vocabulary)),
weighted as (
  select topic, term, tf,
         tf / sum(tf) over (partition by topic)
         * ln(1 + (select floor(sum(tf) / count(distinct topic)) from counts) / sum(tf) over (partition by term)) as weight
  from counts),
best as (
  select *, row_number() over (partition by topic order by round(weight, 12) desc, term) as rn from weighted
  qualify rn <= 10)"""


def _counts(spark, sf):
    docs = fx.table(spark, sf, "documents").withColumnRenamed("source", "topic")
    return terms.ngram_counts(docs, min_df=3, max_features=3000, stop_words=STOP)


@query("ngram_counts", f"with {TERMS_SQL} select topic, term, tf from counts")
def ngram_counts(spark, sf):
    return _counts(spark, sf)


@query(
    "class_tfidf",
    f"with {TERMS_SQL} select topic, term, tf, round(weight, 6) as weight, rn::int as rn from best",
)
def class_tfidf(spark, sf):
    return terms.class_tfidf(_counts(spark, sf)).withColumn("weight", F.round("weight", SIX))


@query(
    "topic_info",
    f"""with {TERMS_SQL}
select source as topic, count(*) as n,
  source || '_' || (select string_agg(term, '_' order by rn) from best b where b.topic = source and rn <= 4) as name,
  (select string_agg(term, ' ' order by rn) from best b where b.topic = source) as terms
from documents group by source order by source limit 20""",
)
def topic_info(spark, sf):
    docs = fx.table(spark, sf, "documents").select(F.col("source").alias("topic"))
    info = terms.topic_info(docs, terms.class_tfidf(_counts(spark, sf)))
    named = F.array_join(F.transform("terms", lambda t: t["term"]), " ")
    return info.withColumn("terms", named).orderBy("topic").limit(20)


# Clusters with noise: label 9 stands for it.
NOISY_SQL = "noisy as (select vec_id, case when label = 9 then -1 else label end as topic from embeddings)"


def _noisy(spark, sf):
    topic = F.when(F.col("label") == 9, -1).otherwise(F.col("label"))
    return fx.table(spark, sf, "embeddings").select("vec_id", topic.alias("topic"))


@query(
    "topic_sizes",
    f"with {NOISY_SQL} select topic, count(*) as n, round(count(*) / (select count(*) from noisy), 6) as share from noisy group by topic",
)
def topic_sizes(spark, sf):
    return terms.topic_sizes(_noisy(spark, sf)).withColumn("share", F.round("share", SIX))


@query(
    "topic_totals",
    f"""with {NOISY_SQL} select count(*) as posts, count(distinct topic) filter (topic <> -1) as topics,
  count(*) filter (topic = -1) as noise, round(count(*) filter (topic = -1) / count(*), 6) as noise_share from noisy""",
)
def topic_totals(spark, sf):
    return terms.topic_totals(_noisy(spark, sf)).withColumn("noise_share", F.round("noise_share", SIX))


@query(
    "topic_renumber",
    f"""with {NOISY_SQL}, sizes as (
  select topic, row_number() over (order by count(*) desc, min(vec_id)) - 1 as place from noisy where topic <> -1 group by topic)
select vec_id, coalesce(place, -1)::int as topic from noisy n left join sizes s on s.topic = n.topic""",
)
def topic_renumber(spark, sf):
    return terms.renumber(_noisy(spark, sf), key="vec_id")


EPS, MIN_SAMPLES, MIN_SIZE, DIMS = 0.12, 5, 5, 5

# Points are the vectors along five orthogonal directions, each of which weighs all coordinates by 1/8 or -1/8: the sign
# is the parity of the bits that the coordinate's number shares with a mask. Eighths keep the sums free of rounding.
MASKS = [11, 22, 37, 42, 63]
DIRECTIONS = np.array([[(-1.0) ** (j & m).bit_count() / 8 for j in range(fx.DIM)] for m in MASKS])
POINT_SQL = (
    "["
    + ", ".join(f"list_dot_product(embedding::double[], {row.tolist()}::double[])" for row in DIRECTIONS)
    + "]"
)


def _cluster_sql(points: str) -> str:
    """All-pairs form of the flat density cut over the rows of ``points``."""
    return f"""pts as (select vec_id, {POINT_SQL} as x from {points}),
near as (
  select a.vec_id as a, b.vec_id as b from pts a cross join pts b
  where list_sum(list_transform(range(1, {DIMS + 1}), lambda i: (a.x[i] - b.x[i]) * (a.x[i] - b.x[i]))) <= {EPS}::double * {EPS}::double),
core as (select a from near group by a having count(*) >= {MIN_SAMPLES}),
links as (select a, b from near where a in (select a from core) and b in (select a from core)),
reach(v, root) as (select a, a from core union select l.b, r.root from reach r join links l on l.a = r.v),
comps as (select v, min(root) as root from reach group by v),
sized as (select root, count(*) as n from comps group by root having count(*) >= {MIN_SIZE}),
placed as (select root, row_number() over (order by n desc, root) - 1 as topic from sized),
clustered as (select v, topic from comps c join placed p on p.root = c.root)"""


def _points(df):
    return df.select("vec_id", affine(F.col("embedding"), DIRECTIONS, np.zeros(DIMS)).alias("point"))


@query(
    "density_clusters",
    f"""with recursive {_cluster_sql('embeddings')}
select vec_id, coalesce(topic, -1)::int as topic from pts left join clustered on v = vec_id""",
)
def density_clusters(spark, sf):
    points = _points(fx.table(spark, sf, "embeddings"))
    return cl.density_cluster(points, EPS, MIN_SAMPLES, MIN_SIZE, DIMS, key="vec_id")


SAMPLE = 400


@query(
    "assign_rest",
    f"""with recursive ranked as (
  select *, row_number() over (order by md5('42:' || vec_id::varchar), vec_id) as pos from embeddings),
sample as (select * from ranked where pos <= {SAMPLE}),
{_cluster_sql('sample')},
rest as (
  select vec_id, {POINT_SQL} as x from ranked where pos > {SAMPLE}),
dist as (
  select r.vec_id, c.topic,
         list_sum(list_transform(range(1, {DIMS + 1}), lambda i: (r.x[i] - p.x[i]) * (r.x[i] - p.x[i]))) as d
  from rest r cross join clustered c join pts p on p.vec_id = c.v),
nearest as (
  select vec_id, topic from dist where d <= {EPS}::double * {EPS}::double
  qualify row_number() over (partition by vec_id order by d, topic) = 1)
select r.vec_id, coalesce(topic, -1)::int as topic from rest r left join nearest n on n.vec_id = r.vec_id
union all
select p.vec_id, coalesce(topic, -1)::int from pts p left join clustered on v = p.vec_id""",
)
def assign_rest(spark, sf):
    """Cluster an exact sample, then give every other point the topic of its nearest clustered core point."""
    emb = fx.table(spark, sf, "embeddings")
    sample = numbering.sample_exact(emb, "vec_id", SAMPLE)
    rest = _points(numbering.rest_of(emb, sample, "vec_id", SAMPLE))
    points = _points(sample)
    core = cl.cluster_core(points, EPS, MIN_SAMPLES, MIN_SIZE, DIMS, key="vec_id")
    return cl.label_points(points, core, key="vec_id").unionByName(
        cl.assign_topics(rest, core, EPS, DIMS, key="vec_id")
    )


@query("discover_topics")
def discover_topics(spark, sf):
    """Text vectors, reduction fitted on a sample, clustering of the sample, assignment of the rest."""
    docs = fx.posts(spark, sf).select("post_id", "text")
    vectors = cl.stage(terms.hash_embed(docs).select("post_id", "embedding"))
    sample = numbering.sample_exact(vectors, "post_id", 600)
    axes = cl.fit_reduction(sample, DIMS)
    points = cl.stage(cl.reduce_dim(vectors, axes).select("post_id", "point"))
    chosen = numbering.sample_exact(points, "post_id", 600)
    core = cl.cluster_core(chosen, 0.08, 5, 10, DIMS)
    rest = numbering.rest_of(points, chosen, "post_id", 600)
    return cl.label_points(chosen, core).unionByName(cl.assign_topics(rest, core, 0.08, DIMS))


@query(
    "hash_embed",
    f"""with {fx.POSTS},
tokens as (select post_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') as ws from posts),
hashed as (
  select post_id, ('0x' || substr(md5(w), 1, 8))::bigint % 65536 as h, count(*) as n
  from (select post_id, unnest(ws) as w from tokens) group by all),
idf as (
  select h, ln(((select count(text) from posts) + 1.0) / (count(*) + 1.0)) as idf, md5('42:' || h) as digits
  from hashed group by h),
fans as (
  select h, idf, ('0x' || substr(digits, 4 * f + 1, 3))::bigint % {fx.DIM} as dim,
    case when ('0x' || substr(digits, 4 * f + 4, 1))::int % 2 = 1 then -idf else idf end as part
  from idf cross join range(4) r(f)),
sums as (select post_id, dim, sum(n * part) as x from hashed join fans using (h) group by post_id, dim),
norms as (select post_id, greatest(sqrt(sum(x * x)), 1e-12) as norm from sums group by post_id)
select post_id, dim::int as dim, round(x / norm, 6) + 0.0 as x from sums join norms using (post_id)
where round(x / norm, 6) <> 0""",
)
def hash_embed(spark, sf):
    """The entries of the text vectors that are not zero."""
    docs = fx.posts(spark, sf).select("post_id", "text")
    vectors = terms.hash_embed(docs).select("post_id", F.posexplode("embedding").alias("dim", "x"))
    return vectors.withColumn("x", F.round("x", SIX) + F.lit(0.0)).filter("x <> 0")
