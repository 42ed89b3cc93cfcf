"""Selection, scoring, joins and de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from postgrain.config import AXIS_FIELDS, config_violations
from postgrain.operators import axes as ax
from postgrain.operators import filters, joins, numbering, quality, topn
from postgrain.plans import curation as plan
from registry import fixtures as fx
from registry import query

SIX = 6
SCORE_SQL = f"""scored as (
  select vec_id, cast(vec_id as varchar) as post_id, label as topic,
         1.0 / (1.0 + exp(-(list_inner_product(embedding::double[], {fx.FIXED_WEIGHTS}::double[]) + {fx.FIXED_BIAS}))) as score
  from embeddings)"""


@query(
    "prefilter",
    f"""with {fx.POSTS}
select post_id, lang, engagement, length(text) as n_chars from posts
where engagement >= 10 and lang = 'en' and length(text) >= 100 and not starts_with(text, '@')
  and len(regexp_split_to_array(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', ''), '\\s+')) >= 18
  and not regexp_matches(text, '(?i)(https?://|www\\.)\\S+')
  and len(regexp_extract_all(text, '#\\w+')) <= 3""",
)
def prefilter(spark, sf):
    kept = filters.corpus_prefilter(filters.with_keys(fx.posts(spark, sf), "post_id", "text"))
    return kept.select("post_id", "lang", "engagement", F.length("text").cast("bigint").alias("n_chars"))


@query(
    "prefilter_pages",
    """select page_id, url from pages
where length(html) >= 100 and not starts_with(html, '@')
  and len(regexp_split_to_array(regexp_replace(regexp_replace(html, '^\\s+', ''), '\\s+$', ''), '\\s+')) >= 18
  and not regexp_matches(html, '(?i)(https?://|www\\.)\\S+')
  and len(regexp_extract_all(html, '#\\w+')) <= 3""",
)
def prefilter_pages(spark, sf):
    pages = fx.table(spark, sf, "pages").withColumnRenamed("html", "text")
    return filters.corpus_prefilter(pages).select("page_id", "url")


@query(
    "config_checks",
    """select 'topic' as kind, coalesce(cast(c_custkey as varchar), '?') as item, 'name' as field
from customer where c_mktsegment = 'BUILDING'
union all
select 'axis', coalesce(p_name, '?'), f from (
  select p_name, unnest(list_filter([case when p_brand = 'Brand#17' then 'short' end,
                                     case when p_size < 3 then 'color' end,
                                     case when p_type = 'SMALL' then 'rewrite_up' end], lambda x: x is not null)) as f
  from part)
union all
select 'axis', p_name, 'defined twice' from part where p_name is not null group by p_name having count(*) > 1""",
)
def config_checks(spark, sf):
    topics = fx.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("cluster_id"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("topic_name"),
    )
    part = fx.table(spark, sf, "part")
    fields = dict.fromkeys(AXIS_FIELDS[1:], F.col("p_name"))
    fields["short"] = F.when(F.col("p_brand") != "Brand#17", F.col("p_brand"))
    fields["color"] = F.when(F.col("p_size") >= 3, F.lit("#000000"))
    fields["rewrite_up"] = F.when(F.col("p_type") != "SMALL", F.col("p_type"))
    axes = part.select(F.col("p_name").alias("axis"), *(c.alias(f) for f, c in fields.items()))
    return config_violations(topics, axes)


@query(
    "label_counts",
    """select count(*) as total, count(*) filter (quality = 1) as pos, count(*) filter (quality = 0) as neg
from labels""",
)
def label_counts(spark, sf):
    return joins.label_counts(fx.labels(spark, sf))


@query(
    "label_missing",
    """select count(*) as total, count(vec_id) as matched, count(*) filter (vec_id is null) as missing
from labels left join embeddings on vec_id = doc_id""",
)
def label_missing(spark, sf):
    return joins.missing_counts(fx.labels(spark, sf), fx.vectors(spark, sf), "post_id")


@query(
    "scaler_stats",
    """select cast(i - 1 as int) as dim, round(avg(embedding[i]::double), 6) as mean,
  round(stddev_pop(embedding[i]::double), 6) as std
from embeddings cross join range(1, 65) r(i) group by i""",
)
def scaler_stats(spark, sf):
    stats = quality.scaler_stats(fx.vectors(spark, sf))
    return stats.select("dim", F.round("mean", SIX).alias("mean"), F.round("std", SIX).alias("std"))


@query(
    "class_weights",
    """select quality as label, count(*) as n,
  round((select count(*) from labels) / (2.0 * count(*)), 6) as weight from labels group by quality""",
)
def class_weights(spark, sf):
    weights = quality.class_weights(fx.labels(spark, sf))
    return weights.withColumn("weight", F.round("weight", SIX))


@query("score_fixed_model", f"with {SCORE_SQL} select post_id, topic, round(score, 6) as score from scored")
def score_fixed_model(spark, sf):
    rows = fx.table(spark, sf, "embeddings").select(fx.text_id("vec_id"), F.col("label").alias("topic"), "embedding")
    scored = quality.score_quality(fx.FIXED_MODEL, rows)
    return scored.select("post_id", "topic", F.round("score", SIX).alias("score"))


@query(
    "score_table",
    f"""with {SCORE_SQL}
select post_id, 'topic ' || topic as topic_name, topic as cluster_id, round(score, 6) as score
from scored where topic in {fx.CHOSEN_TOPICS}""",
)
def score_table(spark, sf):
    dim = fx.topic_names(spark, sf)
    scored = plan.score_table(fx.FIXED_MODEL, fx.vectors(spark, sf), fx.topics(spark, sf), dim, fx.N_TOPICS)
    return scored.withColumn("score", F.round("score", SIX))


@query("quality_pool")
def quality_pool(spark, sf):
    return plan.quality_pool(
        fx.labels(spark, sf),
        fx.vectors(spark, sf),
        fx.topics(spark, sf),
        fx.posts(spark, sf),
        fx.topic_names(spark, sf),
        fx.N_TOPICS,
        n=20,
        tol=1e-6,
    )


@query(
    "class_report",
    f"""with {SCORE_SQL}, cells as (
  select count(*) filter (quality = 0 and score <= 0.5) as n00, count(*) filter (quality = 0 and score > 0.5) as n01,
         count(*) filter (quality = 1 and score <= 0.5) as n10, count(*) filter (quality = 1 and score > 0.5) as n11
  from labels join scored on vec_id = doc_id),
per as (
  select 'low quality' as row, coalesce(n00 / nullif(n00 + n10, 0), 0) as p, coalesce(n00 / nullif(n00 + n01, 0), 0) as r,
         n00 + n01 as s from cells
  union all
  select 'high quality', coalesce(n11 / nullif(n11 + n01, 0), 0), coalesce(n11 / nullif(n11 + n10, 0), 0), n11 + n10
  from cells),
f as (select row, p, r, coalesce(2 * p * r / nullif(p + r, 0), 0) as f, s from per)
select row, round(p, 6) as precision, round(r, 6) as recall, round(f, 6) as f1, s as support from f
union all
select 'accuracy', null, null, round((n00 + n11) / (n00 + n01 + n10 + n11), 6), n00 + n01 + n10 + n11 from cells
union all
select 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), sum(s)::bigint from f
union all
select 'weighted avg', round(sum(p * s) / sum(s), 6), round(sum(r * s) / sum(s), 6), round(sum(f * s) / sum(s), 6),
       sum(s)::bigint from f""",
)
def class_report(spark, sf):
    rows = quality.training_rows(fx.labels(spark, sf), fx.vectors(spark, sf))
    report = quality.class_report(quality.predict(quality.score_quality(fx.FIXED_MODEL, rows)))
    return report.select(
        "row", *(F.round(c, SIX).alias(c) for c in ("precision", "recall", "f1")), F.col("support")
    )


def _pool_sql(score: str) -> str:
    return f"""with {fx.DERIVED_SCORES}, {fx.POSTS}, ranked as (
  select *, row_number() over (partition by topic_name order by {score} desc, post_id) as pool_rn from scored)
select r.post_id, r.topic_name, cluster_id, coalesce(p.text, '') as text, coalesce(p.engagement, 0) as engagement,
       round(score, 4) as lr_score, pool_rn::int as pool_rn
from ranked r left join posts p on p.post_id = r.post_id where pool_rn <= 25"""


@query("pool_topn", _pool_sql("score"))
def pool_topn(spark, sf):
    return plan.candidate_pool(fx.derived_scores(spark, sf), fx.posts(spark, sf), fx.N_TOPICS, 25)


@query("pool_topn_rounded", _pool_sql("round(score, 4)"))
def pool_topn_rounded(spark, sf):
    return plan.candidate_pool(fx.derived_scores(spark, sf), fx.posts(spark, sf), fx.N_TOPICS, 25, rounded=True)


@query(
    "dedupe_last",
    """select conv_id, turn, role, text from conversations
qualify row_number() over (partition by conv_id order by turn desc) = 1""",
)
def dedupe_last(spark, sf):
    return topn.dedupe(fx.table(spark, sf, "conversations"), ["conv_id"], ["turn"])


@query(
    "dedupe_first",
    """select conv_id, turn, role, text from conversations
qualify row_number() over (partition by conv_id order by turn) = 1""",
)
def dedupe_first(spark, sf):
    return topn.dedupe(fx.table(spark, sf, "conversations"), ["conv_id"], ["turn"], keep="first")


@query(
    "agent_rankings",
    f"with {fx.AGENT_POOL} select post_id, topic_name, agent_score, lr_score, engagement, text from pool",
)
def agent_rankings(spark, sf):
    return plan.rankings(fx.agent_pool(spark, sf))


CHOSEN_SQL = f"""{fx.AGENT_POOL}, chosen as (
  select post_id, topic_name, text, engagement, lr_score, coalesce(agent_score, 0) as agent_score from pool
  qualify row_number() over (
    partition by topic_name order by coalesce(agent_score, 0) desc, pool_rn, post_id) <= 15)"""


@query("agent_topn", f"with {CHOSEN_SQL} select * from chosen")
def agent_topn(spark, sf):
    return plan.final_dataset(fx.agent_pool(spark, sf), 15)


@query(
    "topic_cutoffs",
    f"""with {CHOSEN_SQL} select topic_name, count(*) as n, max(agent_score) as top, min(agent_score) as cutoff
from chosen group by topic_name""",
)
def topic_cutoffs(spark, sf):
    return topn.topic_cutoffs(topn.topn_agent(fx.agent_pool(spark, sf), 15))


@query(
    "topic_counts",
    f"with {CHOSEN_SQL} select topic_name, count(*) as n from chosen group by rollup (topic_name)",
)
def topic_counts(spark, sf):
    return topn.topic_counts(topn.topn_agent(fx.agent_pool(spark, sf), 15))


@query("distinct_topics", "select count(distinct source) as n_topics from documents")
def distinct_topics(spark, sf):
    return topn.distinct_topics(fx.posts(spark, sf))


@query(
    "resume_todo",
    """select cast(doc_id as varchar) as post_id, source as topic_name from documents
where doc_id not in (select doc_id from labels)""",
)
def resume_todo(spark, sf):
    work = fx.table(spark, sf, "documents").select(fx.text_id("doc_id"), F.col("source").alias("topic_name"))
    return joins.pending(work, fx.labels(spark, sf), ["post_id"])


_REWRITE_WORK = f"""axes(ord, axis) as (values {fx.AXIS_LIST}),
work as (select cast(doc_id as varchar) as post_id, axis from documents cross join axes),
finished as (
  select cast(doc_id as varchar) as post_id, axis from labels join axes on ord = (doc_id + quality) % 7)"""


def _rewrite_work(spark, sf):
    axes = F.array(*(F.lit(a) for a in fx.AXES))
    work = fx.table(spark, sf, "documents").select(fx.text_id("doc_id"), F.explode(axes).alias("axis"))
    place = ((F.col("doc_id") + F.col("quality")) % 7 + 1).cast("int")
    done = fx.table(spark, sf, "labels").select(fx.text_id("doc_id"), F.element_at(axes, place).alias("axis"))
    return work, done


@query("resume_todo_axes", f"with {_REWRITE_WORK} select * from work except select * from finished")
def resume_todo_axes(spark, sf):
    return joins.pending(*_rewrite_work(spark, sf), ["post_id", "axis"])


@query(
    "work_progress",
    f"""with {_REWRITE_WORK}, m as (select w.*, f.post_id is not null as hit from work w
  left join (select distinct * from finished) f on f.post_id = w.post_id and f.axis = w.axis)
select count(*) as needed, count(*) filter (hit) as done, count(*) filter (not hit) as todo,
  round(count(*) filter (not hit) * 0.00062::double, 2) as cost from m""",
)
def work_progress(spark, sf):
    return joins.progress(*_rewrite_work(spark, sf), ["post_id", "axis"])


@query(
    "topic_lookup",
    """select cast(vec_id as varchar) as post_id, label as cluster_id, 'name ' || label as topic_name
from embeddings""",
)
def topic_lookup(spark, sf):
    rows = fx.topics(spark, sf).withColumnRenamed("topic", "cluster_id")
    ids = rows.select("cluster_id").distinct()
    dim = ids.withColumn("topic_name", F.concat(F.lit("name "), F.col("cluster_id").cast("string")))
    return joins.lookup_checked(rows, dim, "cluster_id", fx.N_TOPICS)


@query(
    "chosen_topics",
    f"""select cast(vec_id as varchar) as post_id, label as cluster_id, 'topic ' || label as topic_name
from embeddings where label in {fx.CHOSEN_TOPICS}""",
)
def chosen_topics(spark, sf):
    return filters.in_topics(fx.topics(spark, sf), fx.topic_names(spark, sf), fx.N_TOPICS)


@query("keep_ids", "select cast(doc_id as varchar) as post_id, lang from documents where doc_id in (select doc_id from labels)")
def keep_ids(spark, sf):
    docs = fx.table(spark, sf, "documents").select(fx.text_id("doc_id"), "lang")
    return joins.keep_ids(docs, fx.labels(spark, sf))


@query(
    "common_ids",
    "select cast(doc_id as varchar) as post_id from labels intersect select cast(vec_id as varchar) from embeddings",
)
def common_ids(spark, sf):
    return joins.common_ids(fx.labels(spark, sf), fx.vectors(spark, sf))


@query(
    "override_scores",
    """select cast(coalesce(d.doc_id, l.doc_id) as varchar) as post_id,
  coalesce(l.quality::double, (d.doc_id % 7)::double / 10.0) as score
from documents d full join labels l on l.doc_id = d.doc_id""",
)
def override_scores(spark, sf):
    old = fx.table(spark, sf, "documents").select(
        fx.text_id("doc_id"), ((F.col("doc_id") % 7).cast("double") / 10.0).alias("score")
    )
    new = fx.labels(spark, sf).select("post_id", F.col("label").cast("double").alias("score"))
    return joins.override(old, new, ["post_id"])


@query(
    "attach_defaults",
    f"""with {fx.POSTS} select cast(vec_id as varchar) as post_id, coalesce(text, '') as text,
  coalesce(engagement, 0) as engagement
from embeddings left join posts on doc_id = vec_id""",
)
def attach_defaults(spark, sf):
    other = fx.posts(spark, sf).select("post_id", "text", "engagement")
    return joins.attach(fx.vectors(spark, sf).select("post_id"), other, ["post_id"], plan.POST_DEFAULTS)


# Raw axes in every stored shape, chosen by document number.
_SHAPES = """select doc_id, doc_id % 7 as shape, (doc_id * 37 % 101)::double / 100.0 as a,
  (doc_id * 53 % 101)::double / 100.0 as b from documents"""
_ENTRIES = """case shape when 0 then a when 1 then a when 2 then a when 3 then a end as tone,
  case shape when 0 then b when 1 then b when 2 then b end as humor"""


def _raw_axes(spark, sf):
    n = F.col("doc_id")
    a = ((n * 37 % 101).cast("double") / 100.0).cast("string")
    b = ((n * 53 % 101).cast("double") / 100.0).cast("string")
    nested = F.concat(F.lit('{"tone": {"score": '), a, F.lit('}, "humor": {"score": '), b, F.lit("}}"))
    flat = F.concat(F.lit('{"tone": '), a, F.lit(', "humor": '), b, F.lit("}"))
    quoted = F.concat(F.lit('"'), F.replace(nested, F.lit('"'), F.lit('\\"')), F.lit('"'))
    partial = F.concat(F.lit('{"tone": '), a, F.lit(', "humor": null}'))
    shape = n % 7
    raw = (
        F.when(shape == 0, nested)
        .when(shape == 1, flat)
        .when(shape == 2, quoted)
        .when(shape == 3, partial)
        .when(shape == 4, F.lit("{}"))
        .when(shape == 5, F.lit("not json"))
    )
    return fx.table(spark, sf, "documents").select(
        fx.text_id("doc_id"), F.col("source").alias("topic_name"), raw.alias("axes_json")
    )


@query(
    "axes_parse",
    f"""select cast(doc_id as varchar) as post_id, {_ENTRIES}, shape in (0, 1, 2, 3) as labelled from ({_SHAPES})""",
)
def axes_parse(spark, sf):
    parsed = ax.parse_axes(_raw_axes(spark, sf), ["tone", "humor"])
    return parsed.select("post_id", "tone", "humor", filters.is_labelled(F.col("axes_json")).alias("labelled"))


@query(
    "dataset_summary",
    f"""select count(*) as posts, (select count(distinct source) from documents) as topics,
  count(*) filter (shape in (0, 1, 2, 3)) as labelled, count(*) filter (shape not in (0, 1, 2, 3)) as missing
from ({_SHAPES})""",
)
def dataset_summary(spark, sf):
    return plan.dataset_summary(_raw_axes(spark, sf))


@query("axes_long", f"with {fx.AXIS_SCORES} select post_id, ord, axis, score from axis_scores")
def axes_long(spark, sf):
    return ax.axes_long(fx.axis_scores(spark, sf), fx.AXES)


_WIDE = ", ".join(f"max(score) filter (axis = '{a}') as {a}" for a in fx.AXES)


@query("axes_wide", f"with {fx.AXIS_SCORES} select post_id, {_WIDE} from axis_scores group by post_id")
def axes_wide(spark, sf):
    return ax.axes_wide(ax.axes_long(fx.axis_scores(spark, sf), fx.AXES), fx.AXES)


@query(
    "midrange_select",
    f"""with {fx.AXIS_SCORES}, m as (
  select post_id, topic_name, (count(*) filter (score between 0.2 and 0.8))::int as mid_count
  from axis_scores group by post_id, topic_name)
select post_id, topic_name, mid_count,
  (row_number() over (partition by topic_name order by mid_count desc, post_id))::int as rn
from m qualify rn <= 12""",
)
def midrange_select(spark, sf):
    counted = ax.midrange_count(fx.axis_scores(spark, sf), fx.AXES)
    return topn.select_midrange(counted.select("post_id", "topic_name", "mid_count"), 12)


@query(
    "rewrite_worklist",
    f"""with {fx.AXIS_SCORES}
select post_id, ord, axis, score, case when score < 0.5 then 'up' else 'down' end as direction,
  round(case when score is null then null when score < 0.5 then least(score + 0.4, 1.0)
    else greatest(score - 0.4, 0.0) end, 6) as target, length(text) as n_chars
from axis_scores""",
)
def rewrite_worklist(spark, sf):
    work = ax.rewrite_worklist(fx.axis_scores(spark, sf), fx.AXES)
    return work.select(
        "post_id",
        "ord",
        "axis",
        "score",
        "direction",
        F.round("target", SIX).alias("target"),
        F.length("original").cast("bigint").alias("n_chars"),
    )


def _hash(key: str, seed: int = 42) -> str:
    return f"md5('{seed}:' || {key}::varchar)"


@query(
    "sample_exact",
    f"""select doc_id, lang, source from documents
qualify row_number() over (order by {_hash('doc_id')}, doc_id) <= 150""",
)
def sample_exact(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "lang", "source")
    return numbering.sample_exact(docs, "doc_id", 150)


@query(
    "sample_rest",
    f"""select doc_id, lang, source from documents
qualify row_number() over (order by {_hash('doc_id')}, doc_id) > 150""",
)
def sample_rest(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "lang", "source")
    return numbering.rest_of(docs, numbering.sample_exact(docs, "doc_id", 150), "doc_id", 150)


@query(
    "batch_slots",
    f"""select o_orderkey, ((pos - 1) // 10)::bigint as batch_id, ((pos - 1) % 10 + 1)::int as slot from (
  select o_orderkey, row_number() over (order by {_hash('o_orderkey')}, o_orderkey) as pos from orders)""",
)
def batch_slots(spark, sf):
    return numbering.batch_slots(fx.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 10)


@query(
    "lineitem_topn",
    """select l_returnflag, l_orderkey, l_linenumber, l_extendedprice,
  (row_number() over (partition by l_returnflag order by l_extendedprice desc, l_orderkey, l_linenumber))::int as rn
from lineitem qualify rn <= 100""",
)
def lineitem_topn(spark, sf):
    items = fx.table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    order = [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")]
    return topn.topn(items, ["l_returnflag"], order, 100)


@query(
    "lineitem_dedupe",
    """select l_orderkey, l_linenumber, l_quantity, l_shipdate from lineitem
qualify row_number() over (partition by l_orderkey order by l_shipdate desc, l_linenumber desc, l_partkey desc, l_extendedprice desc) = 1""",
)
def lineitem_dedupe(spark, sf):
    order = ["l_shipdate", "l_linenumber", "l_partkey", "l_extendedprice"]
    items = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", *order)
    return topn.dedupe(items, ["l_orderkey"], order).select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
