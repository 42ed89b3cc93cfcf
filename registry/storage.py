"""Round trips through every stored form, versions, and the streaming jobs."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from postgrain.operators import rewrites as rw
from postgrain.operators import terms, topn
from postgrain.operators.axes import axes_long
from postgrain.plans import curation as plan
from postgrain.plans import features
from postgrain.session import shared_folder
from postgrain.sources import tables as tb
from postgrain.streaming import posts as st
from registry import fixtures as fx
from registry import query
from registry.curation import SCORE_SQL
from registry.features import LIFT_SQL, _encoded
from registry.features import _rewrites as pair_texts
from registry.topics import TERMS_SQL, _counts

SIX = 6


def _fresh(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("json_roundtrip", f"with {fx.POSTS} select post_id, text, engagement from posts")
def json_roundtrip(spark, sf):
    path = _fresh(spark, "posts")
    tb.write_json(fx.posts(spark, sf).select("post_id", "text", "engagement"), path)
    return tb.read_posts(spark, path)


@query("gzip_roundtrip", f"with {fx.POSTS} select post_id, text, engagement from posts")
def gzip_roundtrip(spark, sf):
    path = _fresh(spark, "posts-gz")
    posts = fx.posts(spark, sf).select("post_id", "text", "engagement")
    posts.write.option("compression", "gzip").json(path)
    return tb.read_posts(spark, path, partitions=8)


@query(
    "labels_last",
    "select cast(doc_id as varchar) as post_id, 1 - quality as label from labels where doc_id % 3 = 0 "
    "union all select cast(doc_id as varchar), quality from labels where doc_id % 3 <> 0",
)
def labels_last(spark, sf):
    """A label file with other columns in another order, a third of whose posts are labelled anew further down."""
    path = _fresh(spark, "labels-anew")
    labels = fx.labels(spark, sf).select("label", F.lit("by hand").alias("note"), "post_id", F.lit(0).alias("turn"))
    anew = labels.filter(F.col("post_id").cast("bigint") % 3 == 0).withColumns(
        {"label": 1 - F.col("label"), "turn": F.lit(1)}
    )
    rows = labels.unionByName(anew).orderBy("turn").drop("turn")
    rows.write.csv(path, header=True)
    return tb.read_labels(spark, path)


@query("csv_roundtrip", "select cast(doc_id as varchar) as post_id, quality as label from labels")
def csv_roundtrip(spark, sf):
    path = _fresh(spark, "labels")
    fx.labels(spark, sf).write.csv(path, header=True)
    return tb.read_labels(spark, path)


@query(
    "vector_roundtrip",
    """select cast(vec_id as varchar) as post_id, len(embedding)::int as dims,
  round(list_sum(embedding::double[]), 6) as total from embeddings""",
)
def vector_roundtrip(spark, sf):
    path = _fresh(spark, "vectors")
    tb.write_vectors(fx.vectors(spark, sf), path)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return tb.read_vectors(spark, path).select(
        "post_id", F.size("embedding").alias("dims"), F.round(total, SIX).alias("total")
    )


@query("topic_roundtrip", "select cast(vec_id as varchar) as post_id, label as topic from embeddings")
def topic_roundtrip(spark, sf):
    path = _fresh(spark, "topics")
    tb.write_json(fx.topics(spark, sf), path)
    return tb.read_topics(spark, path)


@query(
    "score_roundtrip",
    f"with {fx.DERIVED_SCORES} select post_id, topic_name, cluster_id, round(score, 4) as probability_score from scored",
)
def score_roundtrip(spark, sf):
    path = _fresh(spark, "scores")
    tb.write_scores(fx.derived_scores(spark, sf), path)
    return tb.read_scores(spark, path)


@query(
    "pool_from_stored_scores",
    f"""with {fx.DERIVED_SCORES}, {fx.POSTS}, ranked as (
  select *, row_number() over (partition by topic_name order by round(score, 4) desc, post_id) as pool_rn from scored)
select r.post_id, r.topic_name, cluster_id, coalesce(p.text, '') as text, coalesce(p.engagement, 0) as engagement,
       round(score, 4) as lr_score
from ranked r left join posts p on p.post_id = r.post_id where pool_rn <= 25""",
)
def pool_from_stored_scores(spark, sf):
    """Scores are built once, reused from the stored table, and the pool goes through its own file."""
    stored = _fresh(spark, "reuse")
    for _ in range(2):
        scores = tb.reuse_or_build(spark, stored, lambda: fx.derived_scores(spark, sf))
    pool = plan.candidate_pool(scores, fx.posts(spark, sf), fx.N_TOPICS, 25, rounded=True).drop("pool_rn")
    path = _fresh(spark, "pool")
    tb.write_json(pool, path)
    return tb.read_pool(spark, path)


@query(
    "dataset_by_topic",
    f"""with {fx.AGENT_POOL} select post_id, topic_name, text, engagement, lr_score, coalesce(agent_score, 0) as agent_score
from pool qualify row_number() over (
  partition by topic_name order by coalesce(agent_score, 0) desc, pool_rn, post_id) <= 15""",
)
def dataset_by_topic(spark, sf):
    path = _fresh(spark, "dataset")
    tb.write_by_topic(plan.final_dataset(fx.agent_pool(spark, sf), 15), path)
    columns = ["post_id", "topic_name", "text", "engagement", "lr_score", "agent_score"]
    return tb.read_dataset(spark, path).select(*columns)


@query(
    "dataset_update",
    """select cast(d.doc_id as varchar) as post_id, source as topic_name,
  case when l.doc_id is not null then '{"tone":' || quality || '}' when d.doc_id % 2 = 0 then '{"tone":0.5}' end as axes_json
from documents d left join labels l on l.doc_id = d.doc_id""",
)
def dataset_update(spark, sf):
    """A second version adds axes; the reader sees the newest version only."""
    base = _fresh(spark, "versions")
    old = F.when(F.col("doc_id") % 2 == 0, F.lit('{"tone":0.5}'))
    first = fx.posts(spark, sf).select("post_id", "topic_name", old.alias("axes_json"))
    tb.replace_dataset(first, base, 9)
    axes = fx.labels(spark, sf).select(
        "post_id", F.concat(F.lit('{"tone":'), F.col("label").cast("string"), F.lit("}")).alias("axes_json")
    )
    current = tb.read_latest(spark, base).drop("version")
    tb.replace_dataset(plan.annotate(current, axes), base, 10)
    return tb.read_latest(spark, base).select("post_id", "topic_name", "axes_json")


@query(
    "latest_version",
    "select 'diff_vectors_' || max(doc_id) as name, max(doc_id)::int as run_n from documents",
)
def latest_version(spark, sf):
    names = fx.table(spark, sf, "documents").select(
        F.concat(F.lit("diff_vectors_"), F.col("doc_id").cast("string")).alias("name")
    )
    return tb.latest_run(names)


@query(
    "topic_info_csv",
    f"""with {TERMS_SQL}
select source as topic, count(*) as n,
  source || '_' || (select string_agg(term, '_' order by rn) from best b where b.topic = source and rn <= 4) as name,
  (select string_agg(term, ' ' order by rn) from best b where b.topic = source) as terms
from documents group by source""",
)
def topic_info_csv(spark, sf):
    docs = fx.table(spark, sf, "documents").select(F.col("source").alias("topic"))
    path = _fresh(spark, "topic-info")
    tb.write_topic_info(terms.topic_info(docs, terms.class_tfidf(_counts(spark, sf))), path)
    return spark.read.csv(path, header=True, schema="topic string, n bigint, name string, terms string")


@query("report_roundtrip", f"with {LIFT_SQL} select feature as f, density, category, best_axis, best_lift from cats")
def report_roundtrip(spark, sf):
    path = _fresh(spark, "report")
    tb.write_report(features.report(_encoded(spark, sf), pair_texts(spark, sf), fx.AXES), path)
    return spark.read.json(path, schema="f int, density double, category string, best_axis string, best_lift double")


_AXIS_ARRAY = "[" + ", ".join(f"'{a}'" for a in fx.AXES) + "]"
_REWRITES_SQL = f"""rewrites as (
  select case when turn < {len(fx.AXES)} then cast(conv_id as varchar) else conv_id || ':' || (turn // {len(fx.AXES)}) end as post_id,
    list_extract({_AXIS_ARRAY}, (turn % {len(fx.AXES)})::int + 1) as axis,
    case when role = 'user' then 'up' else 'down' end as direction, text as rewrite,
    first_value(text) over (partition by conv_id order by turn) as original
  from conversations)"""


def _rewrites(spark, sf):
    """Turns of a conversation as rewrites of its first turn, an axis each; every seven turns are one post."""
    turns = fx.table(spark, sf, "conversations")
    first = topn.dedupe(turns, ["conv_id"], ["turn"], keep="first").select("conv_id", F.col("text").alias("original"))
    n = F.lit(len(fx.AXES))
    axis = F.element_at(F.array(*(F.lit(a) for a in fx.AXES)), (F.col("turn") % n + 1).cast("int"))
    block = F.floor(F.col("turn") / n).cast("string")
    conv = F.col("conv_id").cast("string")
    return turns.join(first, "conv_id").select(
        F.when(F.col("turn") < n, conv).otherwise(F.concat_ws(":", conv, block)).alias("post_id"),
        axis.alias("axis"),
        F.when(F.col("role") == "user", "up").otherwise("down").alias("direction"),
        "original",
        F.col("text").alias("rewrite"),
    )


@query(
    "rewrite_sets",
    f"""with {_REWRITES_SQL}
select post_id, axis, direction, original, rewrite,
  (list_position({_AXIS_ARRAY}, axis) - 1)::int as ord
from rewrites
qualify count(*) over (partition by post_id) = {len(fx.AXES)}""",
)
def rewrite_sets(spark, sf):
    """Nest per post, store, read back, and keep the pairs of posts with every axis."""
    path = _fresh(spark, "rewrites")
    tb.write_rewrites(rw.nest_rewrites(_rewrites(spark, sf), fx.AXES), path)
    return rw.explode_pairs(tb.read_rewrites(spark, path, "lines"), fx.AXES)


# Rewrites with a null post have no key in a document and are not nested.
_LONG_SQL = f"with {_REWRITES_SQL} select post_id, axis, direction, original, rewrite from rewrites"
_LONG = ("post_id", "axis", "direction", "original", "rewrite")


def _layout(spark, sf, layout: str):
    path = _fresh(spark, f"rewrites-{layout}")
    nested = rw.nest_rewrites(_rewrites(spark, sf), fx.AXES)
    tb.write_rewrites(nested, path, fx.AXES, layout, posts_per_file=500)
    return path, tb.read_rewrites(spark, path, layout).select(*_LONG)


@query("rewrites_wrapped", _LONG_SQL)
def rewrites_wrapped(spark, sf):
    """All rewrites, written and read back as documents that wrap a list of posts."""
    return _layout(spark, sf, "wrapped")[1]


@query("rewrites_list", _LONG_SQL)
def rewrites_list(spark, sf):
    """All rewrites, written and read back as bare lists of posts."""
    return _layout(spark, sf, "list")[1]


@query("rewrites_flat", _LONG_SQL)
def rewrites_flat(spark, sf):
    """All rewrites, written and read back as flat documents, an entry per post and axis."""
    return _layout(spark, sf, "flat")[1]


@query(
    "rewrite_axes",
    f"""with {_REWRITES_SQL}, names(ord, axis) as (values {fx.AXIS_LIST})
select layout, n.ord::int as ord, n.axis, (select count(*) from rewrites r where r.axis = n.axis) as n
from names n cross join (values ('lines'), ('wrapped')) l(layout)""",
)
def rewrite_axes(spark, sf):
    """The axis names stored with two layouts, with the number of rewrites of each."""
    parts = []
    for layout in ("lines", "wrapped"):
        path, long = _layout(spark, sf, layout)
        counts = long.groupBy("axis").agg(F.count(F.lit(1)).alias("n"))
        names = tb.read_axis_names(spark, path, layout).join(counts, "axis", "left")
        parts.append(names.select(F.lit(layout).alias("layout"), "ord", "axis", F.coalesce("n", F.lit(0)).alias("n")))
    return parts[0].unionByName(parts[1])


@query(
    "restore_rewrites",
    f"""with {_REWRITES_SQL}, {fx.AXIS_SCORES}
select r.post_id, r.axis, case when s.post_id is not null and not coalesce(score < 0.5, false) then 'down' else 'up' end as direction,
  coalesce(s.text, '') as original, rewrite
from rewrites r left join axis_scores s on s.post_id = r.post_id and s.axis = r.axis""",
)
def restore_rewrites(spark, sf):
    cached = _rewrites(spark, sf).select("post_id", "axis", "rewrite")
    return rw.restore_context(cached, axes_long(fx.axis_scores(spark, sf), fx.AXES, ("post_id", "text")))


@query(
    "stream_prefilter",
    f"""with {fx.POSTS}
select post_id, lang, engagement from posts
where engagement >= 10 and lang = 'en' and length(text) >= 100 and not starts_with(text, '@')
  and len(regexp_split_to_array(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', ''), '\\s+')) >= 18
  and not regexp_matches(text, '(?i)(https?://|www\\.)\\S+')
  and len(regexp_extract_all(text, '#\\w+')) <= 3""",
)
def stream_prefilter(spark, sf):
    arrived, out, state = (_fresh(spark, n) for n in ("arrived", "kept", "state"))
    posts = fx.posts(spark, sf).select("post_id", "text", "lang", "engagement")
    # Two arrivals at every size, in files that a task can write: as many as the posts are read in, four at least.
    files = max(4, fx.table(spark, sf, "documents").rdd.getNumPartitions())
    posts.repartition(files, "post_id").write.parquet(arrived)
    schema = "post_id string, text string, lang string, engagement bigint"
    stream = st.stream_prefilter(st.stream_table(spark, arrived, schema, files_per_batch=math.ceil(files / 2)))
    st.append_available(stream.select("post_id", "lang", "engagement"), out, state).awaitTermination()
    return spark.read.parquet(out)


@query("stream_score", f"with {SCORE_SQL} select post_id, round(score, 6) as score from scored")
def stream_score(spark, sf):
    """Two arrivals, two runs: the second run scores only what the first has not seen."""
    arrived, out, state = (_fresh(spark, n) for n in ("arrived", "scored", "state"))
    vectors = fx.vectors(spark, sf)
    half = F.pmod(F.xxhash64("post_id"), F.lit(2))
    for part in (0, 1):
        vectors.filter(half == part).write.mode("append").parquet(arrived)
        stream = st.stream_table(spark, arrived, tb.VECTOR_SCHEMA)
        st.stream_score(stream, fx.FIXED_MODEL, out, state).awaitTermination()
    return spark.read.parquet(out).select("post_id", F.round("score", SIX).alias("score"))
