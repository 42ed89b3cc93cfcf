"""Batch inference with failures and resuming, stored layouts, versions, and streams."""

from __future__ import annotations

import gzip
import json
import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from postgrain.config import axis_dim, load_config
from postgrain.functions import text as tx
from postgrain.operators import infer, rewrites as rw
from postgrain.operators.quality import LinearModel
from postgrain.session import shared_folder, stage
from postgrain.sources import tables as tb
from postgrain.streaming import posts as st


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # plug-ins below run in worker processes


AXES = list(load_config().axis_names)


def posts_frame(spark, n):
    return spark.createDataFrame([(str(i), f"post {i}") for i in range(n)], "post_id string, text string")


def counted(spark, fn):
    """``fn`` that also counts its calls over all tasks."""
    calls = spark.sparkContext.accumulator(0)

    def wrapped(prompt):
        calls.add(1)
        return fn(prompt)

    return wrapped, calls


def n_posts(prompt):
    return int(prompt.split("Score these ")[1].split(" ")[0])


# -- text ----------------------------------------------------------------------------------------------------------


def test_text_expressions(spark):
    rows = [("\t a \n",), ("```json\n[1]\n```",), ("```\n[2]```x",), ("  [3] ",), ("```",), (None,)]
    df = spark.createDataFrame(rows, "s string")
    assert df.select(tx.strip_space(F.col("s"))).first()[0] == "a"
    fenced = [r[0] for r in df.select(tx.strip_fence(F.col("s"))).collect()]
    assert fenced[1:] == ["[1]", "[2]", "[3]", "", None]
    one = spark.createDataFrame([("a_b_12", "<a href=\"x\">'&'</a>", "héé😀x")], "n string, h string, t string")
    got = one.select(
        tx.spaced(F.col("n")), tx.run_number(F.col("n")), tx.escape_html(F.col("h")), tx.truncate(F.col("t"), 4)
    ).first()
    assert tuple(got) == ("a b 12", 12, "&lt;a href=&quot;x&quot;&gt;&#39;&amp;&#39;&lt;/a&gt;", "héé😀")


# -- prompts and responses -----------------------------------------------------------------------------------------


def test_label_system_lists_every_axis():
    cfg = load_config()
    text = infer.label_system(cfg)
    assert "score 7 style dimensions" in text and text.count('{"score": 0.0-1.0},') == 7
    assert all(f"- {a['name']}: {a['label_description']}" in text for a in cfg.axes)


def axes_seen(request):
    return json.dumps([{"seen": [a for a in AXES if f"- {a}: " in request.system]}] * int(request.split()[2]))


def rater_seen(request):
    return json.dumps([float(request.system == infer.SCORE_SYSTEM)] * int(request.split()[2]))


def test_instructions_reach_the_model(spark, tmp_path):
    posts = posts_frame(spark, 12)
    axes = infer.label_posts(posts, axes_seen, str(tmp_path / "axes"), load_config()).collect()
    assert len(axes) == 12 and all(json.loads(r.axes_json)["seen"] == AXES for r in axes)
    scores = infer.score_posts(posts, rater_seen, str(tmp_path / "scores")).collect()
    assert {r.score for r in scores} == {1.0} and len(scores) == 12


def test_calls_in_flight(spark):
    """Requests are dealt out to as many tasks as calls may be in flight, also from a single partition."""
    prompts = infer.score_prompts(posts_frame(spark, 200)).coalesce(1)
    for calls in (infer.CALLS, 3):
        plan = infer.infer_batches(prompts, rater_seen, calls)._jdf.queryExecution().executedPlan().toString()
        assert re.search(rf"hashpartitioning\(xxhash64\(batch_id#.*\), {calls}\), REPARTITION_BY_NUM", plan)
    tasks = infer.infer_batches(prompts, rater_seen).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > infer.CALLS // 2


def test_work_is_read_once(spark, tmp_path):
    """Slices read what is open from their own folders; the work list is not read again for each."""
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(len(batch))
            yield batch

    posts = posts_frame(spark, 40).mapInPandas(counted, "post_id string, text string")
    done = infer.run_resumable(posts, lambda todo: todo.withColumn("score", F.lit(1.0)), str(tmp_path / "c"), ["post_id"], "post_id string, score double", 5)
    assert done.count() == 40 and reads.value == 40


def test_prompt_has_every_slot_once(spark):
    prompts = infer.score_prompts(posts_frame(spark, 23)).collect()
    assert sorted(r.n for r in prompts) == [3, 10, 10]
    for r in prompts:
        body = r.prompt.split("\n\n", 1)[1].split("\n\n")
        assert body == [f"[{i + 1}] post {p}" for i, p in enumerate(r.ids)]


def test_rewrite_prompt_text(spark):
    cfg = load_config()
    work = spark.createDataFrame(
        [("a", "tone", 0.25, "up", 0.65, "Hello {x}")],
        "post_id string, axis string, score double, direction string, target double, original string",
    )
    prompt = infer.rewrite_prompts(work, axis_dim(spark, cfg), 7).first().prompt
    assert "so that it is more emotionally charged and urgent." in prompt
    assert "Current tone score: 0.25/1.0\nTarget  tone score: 0.65/1.0  (shift of 0.40)" in prompt
    assert prompt.endswith("ORIGINAL POST:\nHello {x}")


@pytest.mark.parametrize(
    "response, want",
    [
        ("[0.1, 1, 0]", [0.1, 1.0, 0.0]),
        ("\n [0.1, 1, 0]\n", [0.1, 1.0, 0.0]),
        ("[0.1, 1]", None),
        ("[0.1, 1, 0, 0]", None),
        ("[0.1, 1, 1.01]", None),
        ("[0.1, 1, -0.1]", None),
        ('[0.1, "x", 0]', None),
        ("[0.1, null, 0]", None),
        ("[0.1, true, 0]", None),
        ("[0.1, 1, 0] ok", None),
        ("[0.1, 1,", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_scores(spark, response, want):
    df = spark.createDataFrame([(1, 3, response)], "batch_id bigint, n int, response string")
    got = [r.score for r in infer.parse_scores(df).orderBy("slot").collect()]
    assert got == (want or [0.5, 0.5, 0.5])


@pytest.mark.parametrize(
    "response, want",
    [
        ('[{"a": 1}, {"a": {"score": 0.5}}]', ['{"a":1}', '{"a":{"score":0.5}}']),
        ('```json\n[{"a": 1}, null]\n```', ['{"a":1}', None]),
        ('```[{"a": 1}, {}]```', ['{"a":1}', "{}"]),
        ('[{"a": 1}]', [None, None]),
        ('{"a": 1}', [None, None]),
        ("sorry", [None, None]),
        (None, [None, None]),
    ],
)
def test_parse_label_response(spark, response, want):
    df = spark.createDataFrame([(1, 2, response)], "batch_id bigint, n int, response string")
    got = [r.axes_json for r in infer.parse_label_response(df).orderBy("slot").collect()]
    assert [None if v is None else json.loads(v) for v in got] == [None if v is None else json.loads(v) for v in want]


@pytest.mark.parametrize(
    "answer, expect, calls, response",
    [
        ("raise", "text", 3, None),
        ("not json", "text", 1, "not json"),
        ("not json", "json", 3, None),
        ("[1, 2]", "json", 1, "[1, 2]"),  # a wrong length is no reason to ask again
        ("```json\n[1]\n```", "json", 3, None),
        ("```json\n[1]\n```", "fenced json", 1, "```json\n[1]\n```"),
    ],
)
def test_retries(spark, answer, expect, calls, response):
    def plug_in(prompt):
        if answer == "raise":
            raise RuntimeError("busy")
        return answer

    fn, count = counted(spark, plug_in)
    df = spark.createDataFrame([(1, "p")], "batch_id bigint, prompt string")
    got = infer.infer_batches(df, fn, expect=expect, base_delay=0.01).collect()
    assert got[0].response == response and count.value == calls


def test_scores_resume_and_store_the_fallback(spark, tmp_path):
    path = str(tmp_path / "scores")
    posts = posts_frame(spark, 35)
    bad, _ = counted(spark, lambda p: "[2]" if n_posts(p) == 10 else str([0.9] * n_posts(p)))
    stored = infer.score_posts(posts, bad, path, base_delay=0.01)
    assert sorted({r.score for r in stored.collect()}) == [0.5, 0.9] and stored.count() == 35
    good, calls = counted(spark, lambda p: str([0.1] * n_posts(p)))
    more = infer.score_posts(posts_frame(spark, 40), good, path, base_delay=0.01)
    scores = {r.post_id: r.score for r in more.collect()}
    assert len(scores) == 40 and calls.value == 1 and all(scores[str(i)] == 0.1 for i in range(35, 40))


def test_failed_labels_are_tried_again(spark, tmp_path):
    path = str(tmp_path / "labels")
    posts = posts_frame(spark, 12)
    first, _ = counted(spark, lambda p: None if "post 3\n" in p + "\n" else json.dumps([{"tone": 0.2}] * n_posts(p)))
    stored = infer.label_posts(posts, first, path, load_config(), base_delay=0.01)
    done = stored.count()
    assert 0 < done < 12
    second, calls = counted(spark, lambda p: "```json\n" + json.dumps([{"tone": 0.7}] * n_posts(p)) + "\n```")
    stored = infer.label_posts(posts, second, path, load_config(), base_delay=0.01)
    values = [json.loads(r.axes_json)["tone"] for r in stored.collect()]
    assert len(values) == 12 and values.count(0.7) == 12 - done and calls.value == -(-(12 - done) // 5)


def test_a_stopped_run_keeps_its_finished_slices(spark, tmp_path):
    """The second of four slices breaks the job; the next run does only what is missing."""
    path = str(tmp_path / "slices")
    posts = posts_frame(spark, 40)
    seen = []

    def infer_once(fail_at):
        def run(todo):
            seen.append(todo.count())
            if len(seen) == fail_at:
                raise RuntimeError("stopped")
            return todo.select("post_id", F.lit(0.3).alias("score"))

        return run

    schema = "post_id string, score double"
    with pytest.raises(RuntimeError):
        infer.run_resumable(posts, infer_once(2), path, ["post_id"], schema, slices=4)
    assert tb.read_checkpoint(spark, path, schema).count() == seen[0]
    done = infer.run_resumable(posts, infer_once(0), path, ["post_id"], schema, slices=4)
    assert done.count() == 40 and done.select("post_id").distinct().count() == 40
    assert seen[2] == 0 and sum(seen[2:]) == 40 - seen[0]


def test_rewrites_resume(spark, tmp_path):
    cfg = load_config()
    path = str(tmp_path / "rewrites")
    rows = [(str(i), "tone", 0.3, "up", 0.7, f"text {i}") for i in range(6)]
    work = spark.createDataFrame(
        rows, "post_id string, axis string, score double, direction string, target double, original string"
    )
    first, _ = counted(spark, lambda p: "  " if p.endswith("text 2") else " new\n")
    args = (axis_dim(spark, cfg), 7)
    assert infer.generate_rewrites(work, *args, first, path).count() == 5
    second, calls = counted(spark, lambda p: "late")
    done = {r.post_id: r.rewrite for r in infer.generate_rewrites(work, *args, second, path).collect()}
    assert calls.value == 1 and done["2"] == "late" and done["0"] == "new"


# -- storage -------------------------------------------------------------------------------------------------------


def test_posts_plain_and_gzip(spark, tmp_path):
    lines = [{"post_id": "1", "text": "a😀", "engagement": 3}, {"post_id": "2"}, {"text": "x"}, {"post_id": 4, "text": "d"}]
    body = "\n".join(json.dumps(line, ensure_ascii=False) for line in lines)
    (tmp_path / "p.jsonl").write_text(body, encoding="utf-8")
    with gzip.open(tmp_path / "p.jsonl.gz", "wt", encoding="utf-8") as f:
        f.write(body)
    for name in ("p.jsonl", "p.jsonl.gz"):
        rows = sorted(tuple(r) for r in tb.read_posts(spark, str(tmp_path / name), partitions=3).collect())
        assert rows == [("1", "a😀", 3), ("4", "d", None)]


def test_malformed_input_stops(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"post_id": "1", "text": "a"}\n{oops\n')
    (tmp_path / "bad.csv").write_text("post_id,label\n1,1\n2,x\n")
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        tb.read_posts(spark, str(tmp_path / "bad.jsonl")).collect()
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        tb.read_labels(spark, str(tmp_path / "bad.csv")).collect()


def test_rewrite_layouts(spark, tmp_path):
    nested = [
        {"post_id": "1", "original": "o1", "rewrites": {"x": {"direction": "up", "rewrite": "r1x"},
                                                         "y": {"direction": "down", "rewrite": "r1y"}}},
        {"post_id": "2", "original": "o2", "rewrites": {"x": {"direction": "up", "rewrite": "r2x"},
                                                         "z": {"direction": "up", "rewrite": "r2z"}}},
    ]
    flat = {
        f"{p['post_id']}|{a}": {"post_id": p["post_id"], "axis": a, "original": p["original"], **r}
        for p in nested
        for a, r in p["rewrites"].items()
    }
    files = {
        "wrapped": json.dumps({"__axis_names__": ["x", "y"], "posts": nested}, indent=2),
        "list": json.dumps(nested, indent=2),
        "flat": json.dumps(flat, indent=2),
        "lines": "\n".join(json.dumps(p) for p in nested),
    }
    for layout, body in files.items():
        path = tmp_path / f"{layout}.json"
        path.write_text(body)
        long = tb.read_rewrites(spark, str(path), layout)
        rows = sorted(tuple(r) for r in long.select("post_id", "axis", "direction", "original", "rewrite").collect())
        assert rows[0] == ("1", "x", "up", "o1", "r1x") and len(rows) == 4, layout
        pairs = rw.explode_pairs(long, ["x", "y"]).orderBy("ord").collect()
        assert [(p.post_id, p.axis, p.ord) for p in pairs] == [("1", "x", 0), ("1", "y", 1)]
    with pytest.raises(ValueError):
        tb.read_rewrites(spark, str(path), "other")
    out = str(tmp_path / "out")
    tb.write_rewrites(rw.nest_rewrites(long, ["x", "y", "z"]), out)
    again = tb.read_rewrites(spark, out, "lines")
    assert again.count() == 4 and tb.read_axis_names(spark, out).count() == 0


@pytest.mark.parametrize("layout", ["lines", "wrapped", "list", "flat"])
def test_rewrites_written_and_read(spark, tmp_path, layout):
    posts = [(f"p{i}", f'o"{i}', {a: ("up", f"r{i}{a}\n") for a in "xy"[: 1 + i % 2]}) for i in range(25)]
    nested = spark.createDataFrame(posts, rw.NESTED_SCHEMA)
    path = str(tmp_path / layout)
    tb.write_rewrites(nested, path, ["y", "x", "z"], layout, posts_per_file=4)
    names = {r.ord: r.axis for r in tb.read_axis_names(spark, path, layout).collect()}
    assert names == {0: "y", 1: "x", 2: "z"}
    long = tb.read_rewrites(spark, path, layout).select("post_id", "axis", "direction", "original", "rewrite")
    assert sorted(map(tuple, long.collect())) == sorted(
        (p, a, d, o, r) for p, o, m in posts for a, (d, r) in m.items()
    )
    empty = str(tmp_path / "empty")
    tb.write_rewrites(nested.limit(0), empty, ["x"], layout)
    assert tb.read_rewrites(spark, empty, layout).count() == 0
    with pytest.raises(ValueError):
        tb.write_rewrites(nested, str(tmp_path / "none"), ["x"], "other")


def test_last_label_of_a_post_counts(spark, tmp_path):
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels" / "a.csv").write_text("note,label,post_id\nx,1,p\ny,0,q\nz,0,p\n")
    (tmp_path / "labels" / "b.csv").write_text("note,label,post_id\n,1,q\n")
    got = sorted(map(tuple, tb.read_labels(spark, str(tmp_path / "labels")).collect()))
    assert got == [("p", 0), ("q", 1)]


def test_versions_are_numeric(spark, tmp_path):
    base = str(tmp_path / "runs")
    for run in (4900, 15000):
        spark.range(1).select(F.lit(str(run)).alias("v")).write.parquet(f"{base}/run_n={run}")
    assert [r.v for r in tb.read_latest(spark, base, "run_n").collect()] == ["15000"]
    spark.range(1).select(F.lit("x").alias("other")).write.parquet(f"{base}/run_n=16000")
    assert tb.read_latest(spark, base, "run_n").columns == ["other", "run_n"]
    (tmp_path / "runs" / "run_n=16000" / "_SUCCESS").unlink()  # an unfinished version is not current
    assert [r.v for r in tb.read_latest(spark, base, "run_n").collect()] == ["15000"]
    names = spark.createDataFrame([("diff_vectors_4900",), ("diff_vectors_15000",), ("diff_vectors_x",)], "name string")
    assert tuple(tb.latest_run(names).first()) == ("diff_vectors_15000", 15000)


def test_reuse_or_build(spark, tmp_path):
    path, builds = str(tmp_path / "stage"), []

    def build():
        builds.append(1)
        return spark.range(3)

    for _ in range(2):
        assert tb.reuse_or_build(spark, path, build).count() == 3
    assert len(builds) == 1
    (tmp_path / "stage" / "_SUCCESS").unlink()  # an unfinished write is built again
    assert tb.reuse_or_build(spark, path, build).count() == 3 and len(builds) == 2


def test_weights_round_trip(spark, tmp_path):
    import numpy as np

    model = LinearModel(np.array([0.5, -1.0]), 2.0)
    tb.save_weights(model.to_frame(spark), str(tmp_path / "w"))
    again = LinearModel.from_frame(tb.load_weights(spark, str(tmp_path / "w")))
    assert again.weights.tolist() == [0.5, -1.0] and again.bias == 2.0


def test_report_file_keeps_order(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "f int, category string").orderBy("f")
    tb.write_report(df, str(tmp_path / "r"))
    lines = [json.loads(line) for p in (tmp_path / "r").glob("*.json") for line in p.read_text().splitlines()]
    assert [r["f"] for r in lines] == [1, 2, 3]


def test_stage_reads_the_folder_of_the_session(spark):
    folder = shared_folder(spark)
    assert spark.sparkContext.getCheckpointDir() == folder
    staged = stage(spark.range(5).withColumn("x", F.array(F.lit(1.0))))
    assert staged.count() == 5
    assert staged.inputFiles()[0].split(":")[-1].lstrip("/").startswith(folder.split(":")[-1].lstrip("/"))


# -- streams -------------------------------------------------------------------------------------------------------


def test_stream_continues_where_it_stopped(spark, tmp_path):
    import numpy as np

    arrived, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    model = LinearModel(np.array([1.0, 0.0]), 0.0)

    def arrive(ids):
        rows = [(str(i), [float(i), 0.0]) for i in ids]
        spark.createDataFrame(rows, tb.VECTOR_SCHEMA).write.mode("append").parquet(arrived)

    for ids in ([0, 1], [2, 3], []):
        if ids:
            arrive(ids)
        st.stream_score(st.stream_table(spark, arrived, tb.VECTOR_SCHEMA), model, out, state).awaitTermination()
    rows = {r.post_id: round(r.score, 4) for r in spark.read.parquet(out).collect()}
    assert rows == {"0": 0.5, "1": 0.7311, "2": 0.8808, "3": 0.9526} and spark.read.parquet(out).count() == 4


def test_posts_are_packed_and_dealt_out_once(spark, tmp_path):
    """Neighbouring axes of a post share its text until the calls are made; the rewrites are those of the long work list."""
    cfg, schema = load_config(), "post_id string, axis string, score double, direction string, target double, original string"
    axes = [a["name"] for a in cfg.axes][:3]
    rows = [(str(i) if i % 9 else None, a, 0.3, "up", 0.7, f"text {i // 2}") for i in range(200) for a in axes]
    work = spark.createDataFrame(rows, schema).coalesce(1)
    small = infer.packed(work, ("post_id", "original"))
    assert small.count() == 200
    again = small.select("post_id", "original", F.inline("rows")).select(*work.columns)
    assert sorted(map(str, again.collect())) == sorted(map(str, work.collect()))
    for calls in (2, 64):  # whole posts are dealt out, or their axes apart
        path = str(tmp_path / f"rewrites-{calls}")
        done = infer.generate_rewrites(work, axis_dim(spark, cfg), 7, lambda p: p[-3:], path, slices=2, calls=calls)
        want = sorted((r[0] or "", r[1], r[5], r[5][-3:].strip()) for r in rows)
        assert sorted((r.post_id or "", r.axis, r.original, r.rewrite) for r in done.collect()) == want


def test_arrivals_are_written_in_parts_of_bounded_size(spark, tmp_path, monkeypatch):
    """As many files as the posts have splits, still in two arrivals."""
    from registry import storage

    monkeypatch.setattr(storage, "_fresh", lambda spark, name: str(tmp_path / name))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        splits = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").rdd.getNumPartitions()
        storage.stream_prefilter(spark, "/root/testdata/sf0.001").count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert splits > 8 and 4 < len(list((tmp_path / "arrived").glob("part-*"))) <= splits
    assert {p.name for p in (tmp_path / "state" / "commits").glob("[0-9]*")} == {"0", "1"}
