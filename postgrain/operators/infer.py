"""Resumable batch inference: prompts, a plug-in call with retries, response parsing, and the checkpoint loop.

The model call is a function from a request to response text supplied by the user; everything around it is table work.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postgrain.config import Config
from postgrain.functions.text import FENCE, strip_fence, strip_space, truncate, two_decimals
from postgrain.operators.joins import pending
from postgrain.operators.numbering import batch_slots
from postgrain.sources.tables import append_checkpoint, exists, read_checkpoint
from postgrain.session import broadcast_bounded, stage

# The instruction texts and request formats that a model's answers depend on.
SCORE_SYSTEM = """You are a content quality rater. Score each post from 0.0 to 1.0.

A HIGH QUALITY post (score 0.7–1.0) shares specific knowledge, insight, or a well-reasoned opinion, gives the reader something to think about, and uses concrete facts, examples, or observations in English.

A LOW QUALITY post (score 0.0–0.3) is personal feelings or reactions with no substance, a list, not in English, or low-effort commentary.

Scores between 0.3 and 0.7 are for posts that partially meet the criteria.

For each numbered post, reply with ONLY a JSON array of decimal scores between 0.0 and 1.0.
Example for 3 posts: [0.9, 0.4, 0.1]"""
LABEL_SYSTEM = """You are a writing style analyst. For each numbered post, score {count} style dimensions and return ONLY a JSON array.

Each element must be an object with exactly these keys:
{{
{keys}
}}

Dimension guidelines:
{guidelines}

Reply ONLY with a valid JSON array of objects, one per post."""
LABEL_KEY = '  "{name}": {{"score": 0.0-1.0}},'
LABEL_GUIDELINE = "- {name}: {description}"
BATCH_REQUEST = "Score these {count} posts:\n\n{posts}"
REWRITE_REQUEST = """Rewrite this social media post so that it is {goal}.

Current {axis} score: {current}/1.0
Target  {axis} score: {target}/1.0  (shift of {shift})

RULES:
- Keep the EXACT same claim, facts, opinion and stance — do not add or remove information.
- Only change delivery on this one dimension.
- Keep roughly the same length (±20%).
- Return ONLY the rewritten post text, nothing else.

ORIGINAL POST:
{text}"""
SCORE_BATCH, SCORE_CHARS = 10, 600
LABEL_BATCH, LABEL_CHARS = 5, 500
FALLBACK_SCORE = 0.5
CALLS = 8  # calls in flight, unless a job names another number
POSTS_PER_CALL = 32  # posts, for each call in flight, from which whole posts are dealt out


class Request(str):
    """What the plug-in is asked: the user text, with the instruction text (or None) as ``system``."""

    system: str | None = None

    @staticmethod
    def of(user: str, system: str | None) -> Request:
        request = Request(user)
        request.system = system
        return request


def label_system(cfg: Config) -> str:
    """Instruction text for axis labelling, built from the configured axes."""
    return LABEL_SYSTEM.format(
        count=len(cfg.axes),
        keys="\n".join(LABEL_KEY.format(name=a["name"]) for a in cfg.axes),
        guidelines="\n".join(
            LABEL_GUIDELINE.format(name=a["name"], description=a["label_description"]) for a in cfg.axes
        ),
    )


def _fill(template: str, **values: Column) -> Column:
    """``template`` with its named fields replaced by columns."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        text, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        parts += [F.lit(text), values[name]]
    return F.concat(*parts, F.lit(rest))


def batch_prompts(slots: DataFrame, chars: int) -> DataFrame:
    """One row per batch: ``(batch_id, n, ids, prompt)``. ``slots`` has post_id, text, batch_id and slot.

    A group is one batch of a fixed size.
    """
    item = F.struct("slot", "post_id", truncate(F.coalesce("text", F.lit("")), chars).alias("text"))
    items = slots.groupBy("batch_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    numbered = F.transform(
        "items", lambda i: F.concat(F.lit("["), i["slot"].cast("string"), F.lit("] "), i["text"])
    )
    count = F.size("items")
    return items.select(
        "batch_id",
        count.alias("n"),
        F.transform("items", lambda i: i["post_id"]).alias("ids"),
        _fill(BATCH_REQUEST, count=count.cast("string"), posts=F.array_join(numbered, "\n\n")).alias("prompt"),
    )


def score_prompts(df: DataFrame, size: int = SCORE_BATCH, chars: int = SCORE_CHARS) -> DataFrame:
    return batch_prompts(batch_slots(df.select("post_id", "text"), "post_id", size), chars)


def label_prompts(df: DataFrame, size: int = LABEL_BATCH, chars: int = LABEL_CHARS) -> DataFrame:
    return batch_prompts(batch_slots(df.select("post_id", "text"), "post_id", size), chars)


def rewrite_prompts(worklist: DataFrame, axes: DataFrame, n_axes: int) -> DataFrame:
    """Add the rewrite request to work-list rows; ``axes`` is the axis dimension. An axis without a score has no request."""
    goals = broadcast_bounded(axes.select("axis", "rewrite_up", "rewrite_down"), n_axes)
    goal = F.when(F.col("direction") == "up", F.col("rewrite_up")).otherwise(F.col("rewrite_down"))
    prompt = _fill(
        REWRITE_REQUEST,
        goal=goal,
        axis=F.col("axis"),
        current=two_decimals(F.col("score")),
        target=two_decimals(F.col("target")),
        shift=two_decimals(F.abs(F.col("target") - F.col("score"))),
        text=F.col("original"),
    )
    scored = worklist.filter(F.col("score").isNotNull())
    return scored.join(goals, "axis").withColumn("prompt", prompt).drop("rewrite_up", "rewrite_down")


def _require_json(response: str, fenced: bool) -> None:
    body = response.strip()
    if fenced and body.startswith(FENCE):
        body = body.split(FENCE)[1].removeprefix("json")
    if not isinstance(json.loads(body), (list, dict, str)):
        raise ValueError("a number, true, false or null is no answer")


def infer_batches(
    df: DataFrame,
    fn: Callable[[Request], str | None],
    calls: int = CALLS,
    attempts: int = 3,
    expect: str = "text",
    base_delay: float = 2.0,
    key: Sequence[str] = ("batch_id",),
    system: str | None = None,
    dealt: bool = False,
) -> DataFrame:
    """Add ``response``, the plug-in's answer to ``prompt``; null once every attempt has raised.

    Every request carries ``system``. Only exceptions are retried, after ``base_delay ** attempt`` seconds; when ``expect``
    is ``json`` or ``fenced json``, an answer that does not parse counts as one. Requests are dealt out by ``key`` to
    ``calls`` tasks, each with one call at a time, so that a few requests do not wait for each other; ``dealt`` says that
    the rows come from such a repartitioning.
    """
    # By a hash of the key: a repartitioning by the key itself is left out where batches come out of a grouping by it, and
    # that grouping's few rows may then be put into one task.
    spread = df if dealt else df.repartition(calls, F.xxhash64(*key))

    def call(prompt: str) -> str | None:
        for attempt in range(1, attempts + 1):
            try:
                response = fn(Request.of(prompt, system))
                if expect != "text" and response is not None:
                    _require_json(response, fenced=expect == "fenced json")
                return response
            except Exception:
                if attempt < attempts:
                    time.sleep(base_delay**attempt)
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(response=[call(p) for p in batch["prompt"]])

    schema = T.StructType([*df.schema.fields, T.StructField("response", T.StringType())])
    return spread.mapInPandas(run, schema)


def embed_batches(
    df: DataFrame, fn: Callable[[list[str]], np.ndarray], size: int = 512, text: str = "text"
) -> DataFrame:
    """Add ``embedding``, the rows of the plug-in encoder's matrix for lists of up to ``size`` texts."""
    schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), size):
                part = batch.iloc[start : start + size]
                matrix = np.asarray(fn(part[text].fillna("").tolist()), dtype=np.float32)
                yield part.assign(embedding=list(matrix))

    return df.mapInPandas(run, schema)


def _per_slot(df: DataFrame, values: Column, value: str) -> DataFrame:
    slots = df.select("*", F.posexplode_outer(values).alias("_i", value)).withColumn("slot", F.col("_i") + 1)
    if "ids" in df.columns:
        slots = slots.withColumn("post_id", F.get("ids", F.col("_i")))
    return slots.drop("_i", "response", "prompt", "ids")


def parse_scores(df: DataFrame, fallback: float = FALLBACK_SCORE) -> DataFrame:
    """One score per slot from ``response`` of a batch of ``n``.

    The whole batch gets ``fallback`` unless the response is exactly a JSON array of ``n`` numbers in [0, 1].
    """
    raw = strip_space(F.col("response"))
    scores = F.from_json(F.when(raw.rlike(r"(?s)\A\[.*\]\z"), raw), "array<double>")
    usable = (F.size(scores) == F.col("n")) & F.forall(scores, lambda s: F.coalesce(s.between(0.0, 1.0), F.lit(False)))
    values = F.when(F.coalesce(usable, F.lit(False)), scores).otherwise(F.array_repeat(F.lit(fallback), F.col("n")))
    return _per_slot(df, values, "score")


def parse_label_response(df: DataFrame) -> DataFrame:
    """One axes object (JSON text) per slot; null for the whole batch when the array has another length."""
    raw = strip_fence(F.col("response"))
    items = F.from_json(F.when(raw.rlike(r"(?s)\A\[.*\]\z"), raw), "array<string>")
    none = F.array_repeat(F.lit(None).cast("string"), F.col("n"))
    values = F.when(F.coalesce(F.size(items) == F.col("n"), F.lit(False)), items).otherwise(none)
    return _per_slot(df, values, "axes_json")


def rewrite_results(df: DataFrame) -> DataFrame:
    """Rows ``(post_id, axis, direction, original, rewrite)`` of answered requests; an empty rewrite has failed."""
    rewrite = strip_space(F.col("response"))
    done = df.withColumn("rewrite", rewrite).filter(F.col("rewrite") != "")
    return done.select("post_id", "axis", "direction", "original", "rewrite")


def packed(df: DataFrame, shared: Sequence[str]) -> DataFrame:
    """Neighbouring rows that agree in the text columns ``shared`` as one row, the other columns in the array ``rows``."""
    rest = [f for f in df.schema.fields if f.name not in shared]
    inner = T.StructType(rest)
    schema = T.StructType([*(df.schema[c] for c in shared), T.StructField("rows", T.ArrayType(inner, False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                ends = np.unique(np.concatenate([pc.run_end_encode(batch.column(c)).run_ends.to_numpy() for c in shared]))
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                rows = pa.StructArray.from_arrays([batch.column(f.name) for f in rest], [f.name for f in rest])
                first = batch.select(list(shared)).take(offsets[:-1])
                yield pa.RecordBatch.from_arrays([*first.columns, pa.ListArray.from_arrays(offsets, rows)], [*shared, "rows"])

    return df.select(*shared, *(f.name for f in rest)).mapInArrow(run, schema)


def run_resumable(
    work: DataFrame,
    infer: Callable[[DataFrame], DataFrame],
    checkpoint: str,
    keys: Sequence[str],
    schema: str,
    slices: int = 1,
    shared: Sequence[str] = (),
) -> DataFrame:
    """Run ``infer`` on unfinished work and append its non-null results to the checkpoint table; returns the table.

    ``infer`` maps work rows to rows of ``schema``. Rows it leaves out, or whose value is null, stay unfinished and are
    tried again by the next run. Each of the ``slices`` is committed on its own, so a stopped run loses one at most.
    Answers are read back from the table and never asked for twice. With ``shared`` columns, ``infer`` gets ``packed`` rows,
    and a slice holds whole ones.
    """
    spark = work.sparkSession
    value_columns = [c for c in spark.createDataFrame([], schema).columns if c not in keys]
    # Nothing stored: nothing to join the work list with, whose texts would be shuffled for it.
    left = pending(work, read_checkpoint(spark, checkpoint, schema), keys) if exists(spark, checkpoint) else work
    left = packed(left, shared) if shared else left
    part = F.pmod(F.xxhash64(*(shared or keys)), F.lit(slices)).cast("int")
    # The work list is read once; a slice then reads its own folder of what is open.
    left = stage(left.withColumn("_slice", part), ["_slice"])
    for i in range(slices):
        todo = left.filter(F.col("_slice") == i).drop("_slice")
        results = infer(todo).select(*keys, *value_columns).dropna(subset=value_columns, how="any")
        append_checkpoint(results, checkpoint)
    return read_checkpoint(spark, checkpoint, schema)


def score_posts(
    posts: DataFrame,
    fn: Callable[[Request], str | None],
    checkpoint: str,
    size: int = SCORE_BATCH,
    slices: int = 1,
    system: str | None = SCORE_SYSTEM,
    **call,
) -> DataFrame:
    """Agent scores ``(post_id, score)``; the fallback score is stored and so not asked for again."""

    def infer(todo: DataFrame) -> DataFrame:
        return parse_scores(infer_batches(score_prompts(todo, size), fn, expect="json", system=system, **call))

    return run_resumable(posts, infer, checkpoint, ["post_id"], "post_id string, score double", slices)


def label_posts(
    posts: DataFrame,
    fn: Callable[[Request], str | None],
    checkpoint: str,
    cfg: Config,
    size: int = LABEL_BATCH,
    slices: int = 1,
    **call,
) -> DataFrame:
    """Axes objects ``(post_id, axes_json)`` for the configured axes; posts of a failed batch stay unfinished."""
    system = label_system(cfg)

    def infer(todo: DataFrame) -> DataFrame:
        return parse_label_response(infer_batches(label_prompts(todo, size), fn, expect="fenced json", system=system, **call))

    return run_resumable(posts, infer, checkpoint, ["post_id"], "post_id string, axes_json string", slices)


def generate_rewrites(
    worklist: DataFrame,
    axes: DataFrame,
    n_axes: int,
    fn: Callable[[Request], str | None],
    checkpoint: str,
    slices: int = 1,
    calls: int = CALLS,
    **call,
) -> DataFrame:
    """Rewrites ``(post_id, axis, direction, original, rewrite)`` of a work list.

    A post's text is written and dealt out once for its axes, which become rows again where the calls are made. Only
    while there are few posts, so that they may not occupy all calls, the axes of a post are dealt out apart.
    """
    text = ("post_id", "original")

    def infer(todo: DataFrame) -> DataFrame:
        many = todo.count() >= POSTS_PER_CALL * calls
        todo = todo.repartition(calls, F.xxhash64(*text)) if many else todo
        prompts = rewrite_prompts(todo.select(*text, F.inline("rows")), axes, n_axes)
        return rewrite_results(infer_batches(prompts, fn, calls, key=("post_id", "axis"), dealt=many, **call))

    schema = "post_id string, axis string, direction string, original string, rewrite string"
    return run_resumable(worklist, infer, checkpoint, ["post_id", "axis"], schema, slices, text)
