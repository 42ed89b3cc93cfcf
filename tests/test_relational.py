"""Selection, joins, axes and configuration on hand-made rows with the awkward cases."""

from __future__ import annotations

import json
import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import Window
from pyspark.sql import functions as F

from postgrain.config import Config, axis_dim, config_violations, load_config, require_valid, topic_dim
from postgrain.operators import axes as ax
from postgrain.operators import filters, joins, numbering, topn
from postgrain.plans import curation as plan
from postgrain.session import shared_folder


def values(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_default_config(spark):
    cfg = load_config()
    assert len(cfg.topics) == 17 and len(cfg.axes) == 7
    assert cfg.topics[0].keys() >= {"cluster_id", "name"} and cfg.axis_names[0] == "reading_level"
    require_valid(topic_dim(spark, cfg), axis_dim(spark, cfg))


def test_config_violations(spark):
    cfg = Config(({"cluster_id": 1, "name": "a"}, {"cluster_id": 2}), ({"name": "x", "short": "x"},))
    found = values(config_violations(topic_dim(spark, cfg), axis_dim(spark, cfg)), "kind", "item", "field")
    assert ("topic", "2", "name") in found and ("axis", "x", "color") in found and len(found) == 5
    none = Config((), ())
    empty = values(config_violations(topic_dim(spark, none), axis_dim(spark, none)), "kind", "field")
    assert empty == [("axis", "none defined"), ("topic", "none defined")]
    with pytest.raises(ValueError, match="topic 2: name"):
        require_valid(topic_dim(spark, cfg), axis_dim(spark, cfg))


def test_prefilter_edges(spark):
    words = "word " * 17
    base = dict(engagement=10, lang="en", is_reply=False, is_repost=False, is_quote=False)
    text = (words + "x" * 15)  # exactly 100 characters and 18 words
    assert len(text) == 100 and len(text.split()) == 18
    cases = {
        "kept": {},
        "three_tags": {"text": text + " #a #b #c"},
        "no_flags": {"is_reply": None, "is_repost": None, "is_quote": None},
        "four_tags": {"text": text + " #a #b #c #d"},
        "short": {"text": text[:-1]},
        "few_words": {"text": "word " * 16 + "x" * 30},
        "link": {"text": text + " see https://a.b/c"},
        "at": {"text": "@" + text},
        "low": {"engagement": 9},
        "french": {"lang": "fr"},
        "reply": {"is_reply": True},
        "repost": {"is_repost": True},
        "quote": {"is_quote": True},
        "no_engagement": {"engagement": None},
    }
    rows = [{"post_id": k, "text": text, **base, **v} for k, v in cases.items()]
    schema = "post_id string, text string, engagement bigint, lang string, is_reply boolean, is_repost boolean, is_quote boolean"
    kept = filters.corpus_prefilter(spark.createDataFrame(rows, schema))
    assert {r.post_id for r in kept.collect()} == {"kept", "three_tags", "no_flags"}


def test_with_keys(spark):
    df = spark.createDataFrame([("1", "a"), (None, "b"), ("2", None)], "post_id string, text string")
    assert values(filters.with_keys(df, "post_id", "text"), "post_id") == [("1",)]


def test_missing_scores_are_outside_the_range(spark):
    df = spark.createDataFrame([(0.2,), (0.8,), (0.19,), (None,), (float("nan"),)], "s double")
    assert [r[0] for r in df.select(filters.in_range(F.col("s"))).collect()] == [True, True, False, False, False]


def test_parse_axes_shapes(spark):
    nested = {"tone": {"score": 0.25}, "humor": {"score": 1}}
    rows = {
        "object": json.dumps(nested),
        "string": json.dumps(json.dumps(nested)),
        "flat": json.dumps({"tone": 0.25, "humor": 1}),
        "missing": json.dumps({"tone": 0.25}),
        "null": None,
        "empty": "{}",
        "broken": "{nope",
        "text": json.dumps({"tone": "high"}),
    }
    df = spark.createDataFrame(list(rows.items()), "post_id string, axes_json string")
    parsed = {r.post_id: (r.tone, r.humor) for r in ax.parse_axes(df, ["tone", "humor"]).collect()}
    full, none = (0.25, 1.0), (None, None)
    assert parsed == {
        "object": full, "string": full, "flat": full, "missing": (0.25, None),
        "null": none, "empty": none, "broken": none, "text": none,
    }
    counted = ax.midrange_count(ax.parse_axes(df, ["tone", "humor"]), ["tone", "humor"])
    assert {r.post_id: r.mid_count for r in counted.collect()}["null"] == 0
    labelled = {r[0]: r[1] for r in df.select("post_id", filters.is_labelled(F.col("axes_json"))).collect()}
    assert labelled["object"] and labelled["flat"] and labelled["string"] and not labelled["null"] and not labelled["empty"]


def test_direction_and_target(spark):
    df = spark.createDataFrame([(0.49,), (0.5,), (0.0,), (1.0,), (0.3,), (None,)], "score double")
    got = [(r.direction, None if r.target is None else round(r.target, 6)) for r in ax.direction_target(df).collect()]
    assert got == [("up", 0.89), ("down", 0.1), ("up", 0.4), ("down", 0.6), ("up", 0.7), ("down", None)]


def test_rank_rules(spark):
    rows = [("a", "t", 0.12344), ("b", "t", 0.12346), ("c", "t", 0.12343), ("d", "u", 0.1)]
    scored = spark.createDataFrame(rows, "post_id string, topic_name string, score double")
    exact = topn.topn_pool(scored, 2)
    assert values(exact, "topic_name", "pool_rn", "post_id") == [("t", 1, "b"), ("t", 2, "a"), ("u", 1, "d")]
    equal = spark.createDataFrame([("b", "t", 0.12341), ("a", "t", 0.1234)], scored.schema)
    assert values(topn.topn_pool(equal, 1, rounded=True), "post_id") == [("a",)]
    assert values(topn.topn_pool(equal, 1), "post_id") == [("b",)]


def test_agent_ties_keep_pool_order_and_missing_is_zero(spark):
    rows = [("a", "t", 0.5, 2), ("b", "t", 0.5, 1), ("c", "t", None, 3), ("d", "t", 0.0, 4)]
    pool = spark.createDataFrame(rows, "post_id string, topic_name string, agent_score double, pool_rn int")
    ranked = [r.post_id for r in topn.rank_all(pool).collect()]
    assert ranked == ["b", "a", "c", "d"]
    assert [r.post_id for r in topn.topn_agent(pool, 3).orderBy("rn").collect()] == ["b", "a", "c"]
    cut = topn.topic_cutoffs(topn.topn_agent(pool, 3)).first()
    assert (cut.n, cut.top, cut.cutoff) == (3, 0.5, 0.0)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.sampled_from("ttttttttuv"), st.integers(0, 5)), min_size=1, max_size=60),
    st.integers(1, 7),
    st.integers(1, 6),
)
def test_topn_equals_sorting(spark, rows, n, parts):
    data = [(g, s, i) for i, (g, s) in enumerate(rows)]
    df = spark.createDataFrame(data, "g string, s int, id int").repartition(parts)
    got = values(topn.topn(df, ["g"], [F.col("s").desc(), F.col("id")], n), "g", "rn", "id")
    want = []
    for g in {r[0] for r in data}:
        best = sorted((r for r in data if r[0] == g), key=lambda r: (-r[1], r[2]))[:n]
        want += [(g, i + 1, r[2]) for i, r in enumerate(best)]
    assert got == sorted(want)


def test_topn_limits_before_the_shuffle(spark, capsys):
    df = spark.range(1000).selectExpr("id % 3 as g", "id", "rand(1) as s")
    topn.topn(df, ["g"], [F.col("s").desc(), F.col("id")], 5).explain()
    plan_text = capsys.readouterr().out
    assert plan_text.count("Partial") >= 2 and plan_text.count("WindowGroupLimit") >= 4


def test_dedupe(spark):
    rows = [("k", 1, "a"), ("k", 3, "c"), ("k", 2, "b"), ("j", 1, "z")]
    df = spark.createDataFrame(rows, "k string, pos int, v string").repartition(3)
    assert values(topn.dedupe(df, ["k"], ["pos"]), "k", "v") == [("j", "z"), ("k", "c")]
    assert values(topn.dedupe(df, ["k"], ["pos"], keep="first"), "k", "v") == [("j", "z"), ("k", "a")]


@pytest.mark.parametrize("n", [1, 50, 1001, 30_000])
def test_topn_by_threshold(spark, n):
    """The histogram keeps what sorting would, and little more, without Spark's limit before the shuffle."""
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        odd = F.when(F.col("id") % 97 == 0, None).when(F.col("id") % 101 == 0, float("nan")).when(F.col("id") % 103 == 0, float("inf")).when(F.col("id") % 107 == 0, -float("inf"))
        df = spark.range(40_000).select("id", F.when(F.col("id") % 5 > 0, "hot").when(F.col("id") % 2 > 0, "ties").alias("g"), odd.alias("o"))
        df = df.select("id", "g", F.when(F.col("g") == "ties", 1.0).otherwise(F.coalesce("o", F.when(F.col("id") % 97 > 0, F.rand(3)))).alias("s"))
        df.write.parquet(path := f"{shared_folder(spark)}/threshold-{n}-{uuid.uuid4().hex}")
        df = spark.read.parquet(path)
        for by in (["g"], []):
            order = [F.col("s").desc(), F.col("id")]
            want = df.withColumn("rn", F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order))).filter(F.col("rn") <= n)
            got = topn.topn(df, by, order, n, value=F.col("s"))
            assert {(r.id, r.rn) for r in got.collect()} == {(r.id, r.rn) for r in want.collect()}
            kept = topn.reaching(df, by, F.col("s"), n).filter("g = 'hot'").count()
            assert kept <= n + 40_000 // 50
    finally:
        spark.conf.set(key, before)
    for by in (["g"], []):
        assert topn.topn(df.limit(0), by, [F.col("s").desc(), F.col("id")], n, value=F.col("s")).count() == 0


def test_buckets_follow_the_rows(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    want = {r.k: r.pos for r in numbering.numbered(df, "k").collect()}
    monkeypatch.setattr(numbering, "BUCKET_ROWS", 0.05)
    digits = numbering._digits(df, None)
    assert digits == 4
    sizes = numbering._hashed(df, "k", 42, digits).groupBy("_bucket").count().agg(F.max("count")).first()[0]
    assert sizes <= 4 and {r.k: r.pos for r in numbering.numbered(df, "k").collect()} == want


@pytest.mark.parametrize("digits", [1, 2, 3])
def test_positions_do_not_depend_on_buckets_or_partitions(spark, digits):
    df = spark.range(500).select(F.col("id").cast("string").alias("post_id"))
    want = values(numbering.numbered(df, "post_id", digits=2), "post_id", "pos")
    got = values(numbering.numbered(df.repartition(5), "post_id", digits=digits), "post_id", "pos")
    assert got == want and sorted(p for _, p in got) == list(range(1, 501))


def test_batches_are_full(spark):
    df = spark.range(123).select(F.col("id").cast("string").alias("post_id"))
    sizes = {r.batch_id: (r.n, r.top) for r in numbering.batch_slots(df, "post_id", 10).groupBy("batch_id").agg(
        F.count("*").alias("n"), F.max("slot").alias("top")).collect()}
    assert len(sizes) == 13 and all(sizes[b] == (10, 10) for b in range(12)) and sizes[12] == (3, 3)


def test_sample_is_exact_and_splits_the_ids(spark):
    df = spark.range(1000)
    for n in (0, 1, 250, 1000, 2000):
        sample = numbering.sample_exact(df, "id", n)
        rest = numbering.rest_of(df, sample, "id", n)
        a, b = {r.id for r in sample.collect()}, {r.id for r in rest.collect()}
        assert len(a) == min(n, 1000) and not a & b and len(a | b) == 1000
    other = {r.id for r in numbering.sample_exact(df, "id", 250, seed=7).collect()}
    assert other != {r.id for r in numbering.sample_exact(df, "id", 250).collect()}


def test_lookup_fails_on_an_unknown_id(spark):
    df = spark.createDataFrame([("a", 1), ("b", 9)], "post_id string, cluster_id int")
    dim = spark.createDataFrame([(1, "one")], "cluster_id int, topic_name string")
    with pytest.raises(PySparkException, match="unknown cluster_id: 9"):
        joins.lookup_checked(df, dim, "cluster_id", 1).collect()


def test_fetch_selected_defaults(spark):
    selected = spark.createDataFrame([("a",), ("z",)], "post_id string")
    posts = spark.createDataFrame([("a", "hi", 3), ("b", "no", 1)], "post_id string, text string, engagement bigint")
    got = joins.fetch_selected(selected, posts, 2, plan.POST_DEFAULTS)
    assert values(got, "post_id", "text", "engagement") == [("a", "hi", 3), ("z", "", 0)]
    wide = joins.fetch_selected(selected, posts, 10**9, plan.POST_DEFAULTS)  # no broadcast hint beyond the bound
    assert values(wide, "post_id", "text", "engagement") == [("a", "hi", 3), ("z", "", 0)]


def test_override_and_pending(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert values(joins.override(old, new, ["k"]), "k", "v") == [("a", 1), ("b", 3), ("c", 4)]
    assert values(joins.pending(old, new, ["k"]), "k") == [("a",)]


def test_annotate_keeps_earlier_axes(spark):
    dataset = spark.createDataFrame([("a", "{1}"), ("b", None), ("c", "{3}")], "post_id string, axes_json string")
    axes = spark.createDataFrame([("a", "{9}")], "post_id string, axes_json string")
    assert {r.post_id: r.axes_json for r in plan.annotate(dataset, axes).collect()} == {"a": "{9}", "b": None, "c": "{3}"}


def test_topics_listed_twice(spark):
    posts = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", None)], "post_id string, topic int")
    dim = spark.createDataFrame([(1, "one"), (1, "uno"), (2, "two"), (None, "none")], "cluster_id int, topic_name string")
    got = filters.in_topics(posts, dim, 4).select("post_id", "cluster_id", "topic_name").collect()
    assert sorted(map(tuple, got)) == [("a", 1, "uno"), ("b", 2, "two")]
    assert filters.in_topics(posts, dim.limit(0), 0).count() == 0
