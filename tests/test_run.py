"""Both jobs end to end on the smallest tables with deterministic plug-ins, and again to see every stage reused."""

from __future__ import annotations

import json
import re
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from postgrain.config import Config, load_config
from postgrain.plans import run
from postgrain.sources import tables as tb
from registry import fixtures as fx

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SF = "/root/testdata/sf0.01"
AXES = load_config().axis_names


def score(prompt):
    sizes = [len(p) for p in re.split(r"\n\n\[\d+\] ", prompt)[1:]]
    n = int(re.match(r"Score these (\d+)", prompt)[1])
    return json.dumps([(sizes[0] + i) % 11 / 10 for i in range(n)])


def label(prompt):
    n = int(re.match(r"Score these (\d+)", prompt)[1])
    return "```json\n" + json.dumps([{a: {"score": (len(prompt) + i + j) % 10 / 10} for j, a in enumerate(AXES)} for i in range(n)]) + "\n```"


def rewrite(prompt):
    text = prompt.split("ORIGINAL POST:\n", 1)[1]
    axis = re.search(r"Current (\w+) score", prompt)[1]
    return f"{text[:200]} {axis} {axis} {axis}"


def moody(prompt):
    """No answer for batches that are not full; every configured axis must be in the instruction text."""
    assert all(f"- {a}: " in prompt.system for a in AXES)
    if not prompt.startswith("Score these 5 "):
        raise RuntimeError("no answer today")
    return label(prompt)


def broken(prompt):
    raise RuntimeError("must not be called")


def test_both_jobs(spark, tmp_path):
    base = str(tmp_path)
    posts = fx.posts(spark, SF).select("post_id", "text", "engagement")
    posts.write.json(f"{base}/posts")
    fx.labels(spark, SF).coalesce(1).write.csv(f"{base}/labels.csv", header=True)
    cfg = load_config()
    cfg = Config(({"cluster_id": 0, "name": "first"}, {"cluster_id": 1, "name": "second"}), cfg.axes)
    settings = run.Settings(
        sample=950, dims=3, eps=0.05, min_samples=5, min_cluster_size=8, min_df=1, pool=30, final=12,
        rewrite_posts=4, slices=2, base_delay=0.01,
    )
    early = run.run_dataset(spark, base, cfg, score, moody, settings=settings).first()
    first = spark.read.parquet(f"{base}/dataset/version=2")
    assert early.missing > 0 and early.labelled + early.missing == early.posts == first.count()
    summary = run.run_dataset(spark, base, cfg, broken, label, settings=settings).first()  # late answers: a version more
    assert tb.latest_version(spark, f"{base}/dataset") == 3 and first.count() == summary.posts
    assert summary.topics == 2 and 12 < summary.posts <= 24 and summary.labelled == summary.posts
    topics = spark.read.parquet(f"{base}/topics")
    assert topics.count() == 1000 and topics.filter("topic = -1").count() < 1000
    assert {0, 1} <= {r.topic for r in spark.read.parquet(f"{base}/topic_info").collect()}
    pool = spark.read.parquet(f"{base}/pool")
    assert pool.groupBy("topic_name").count().agg(F.max("count")).first()[0] <= 30
    assert spark.read.parquet(f"{base}/rankings").count() == pool.count()

    report = run.run_features(spark, base, cfg, rewrite, settings=settings, features=8, epochs=20)
    rows = report.collect()
    assert len(rows) == 8 and {r.category for r in rows} & {"confirms_axis", "partial_overlap"}
    assert spark.read.parquet(f"{base}/rewrites").count() == 8 * 7

    again = run.run_dataset(spark, base, cfg, broken, broken, settings=settings).first()
    assert again == summary and tb.latest_version(spark, f"{base}/dataset") == 3
    assert run.run_features(spark, base, cfg, broken, settings=settings).count() == 8
