"""Prompts, the plug-in call, response parsing and resuming.

The plug-in of these queries is a pure function of its prompt, so its answers have a SQL form.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import functions as F

from postgrain.config import axis_dim
from postgrain.functions import text as tx
from postgrain.operators import axes as ax
from postgrain.operators import infer
from postgrain.plans import curation
from postgrain.session import shared_folder, spread
from postgrain.sources.tables import append_checkpoint, replace_dataset
from registry import fixtures as fx
from registry import query


def _fresh(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _batch_sql(size: int, chars: int, rows: str = "posts") -> str:
    return f"""slots as (
  select post_id, text, (pos - 1) // {size} as batch_id, (pos - 1) % {size} + 1 as slot from (
    select *, row_number() over (order by md5('42:' || post_id), post_id) as pos from {rows})),
prompts as (
  select batch_id, count(*) as n,
    'Score these ' || count(*) || ' posts:' || chr(10) || chr(10)
    || string_agg('[' || slot || '] ' || substr(text, 1, {chars}), chr(10) || chr(10) order by slot) as prompt
  from slots group by batch_id)"""


@query(
    "score_prompts",
    f"""with {fx.POSTS}, {_batch_sql(10, 600)}
select batch_id::bigint as batch_id, n::int as n, md5(prompt) as prompt_hash, length(prompt) as n_chars from prompts""",
)
def score_prompts(spark, sf):
    prompts = infer.score_prompts(fx.posts(spark, sf))
    return _digest(prompts)


@query(
    "label_prompts",
    f"""with {fx.POSTS}, {_batch_sql(5, 500)}
select batch_id::bigint as batch_id, n::int as n, md5(prompt) as prompt_hash, length(prompt) as n_chars from prompts""",
)
def label_prompts(spark, sf):
    return _digest(infer.label_prompts(fx.posts(spark, sf)))


def _digest(prompts):
    return prompts.select(
        "batch_id",
        "n",
        F.md5(F.col("prompt").cast("binary")).alias("prompt_hash"),
        F.length("prompt").cast("bigint").alias("n_chars"),
    )


def _sql_text(s: str) -> str:
    return s.replace("'", "''")


_UP = "list_extract([" + ", ".join(f"'{_sql_text(a['rewrite_up'])}'" for a in fx.CONFIG.axes) + "], ord + 1)"
_DOWN = "list_extract([" + ", ".join(f"'{_sql_text(a['rewrite_down'])}'" for a in fx.CONFIG.axes) + "], ord + 1)"
_HEAD, _TAIL = infer.REWRITE_REQUEST.split("\n\nRULES:")
_RULES = _sql_text("\n\nRULES:" + _TAIL.replace("{text}", ""))
REQUESTS_SQL = f"""{fx.AXIS_SCORES}, targets as (
  select *, case when score < 0.5 then 'up' else 'down' end as direction,
    case when score < 0.5 then least(score + 0.4, 1.0) else greatest(score - 0.4, 0.0) end as target
  from axis_scores where score is not null),
requests as (
  select post_id, axis, direction, text,
    'Rewrite this social media post so that it is ' || case when direction = 'up' then {_UP} else {_DOWN} end || '.'
    || chr(10) || chr(10) || 'Current ' || axis || ' score: ' || printf('%.2f', score) || '/1.0'
    || chr(10) || 'Target  ' || axis || ' score: ' || printf('%.2f', target) || '/1.0  (shift of '
    || printf('%.2f', abs(target - score)) || ')' || '{_RULES}' || text as prompt
  from targets)"""


def _requests(spark, sf):
    return ax.rewrite_worklist(fx.axis_scores(spark, sf), fx.AXES)


@query(
    "rewrite_prompts",
    f"with {REQUESTS_SQL} select post_id, axis, direction, md5(prompt) as prompt_hash from requests",
)
def rewrite_prompts(spark, sf):
    prompts = infer.rewrite_prompts(_requests(spark, sf), axis_dim(spark, fx.CONFIG), len(fx.AXES))
    return prompts.select(
        "post_id", "axis", "direction", F.md5(F.col("prompt").cast("binary")).alias("prompt_hash")
    )


# Responses of every kind, chosen by document number: three scores expected per batch.
_KINDS = {
    0: "[0.9, 0.4, 0.1]",
    1: " [1, 0, 0.25]\n",
    2: "```[0.1, 0.2, 0.3]```",
    3: "[0.5, 0.6]",
    4: "[0.5, 0.6, 1.2]",
    5: '[0.5, "x", 0.1]',
    6: "[0.5, true, 0.1]",
    7: "[0.1, 0.2, 0.3] done",
    8: "[0.1, 0.2",
    9: '{"a": 1}',
    10: "[0.2, null, 0.3]",
}


def _of_kind(kinds: dict[int, str]):
    """The response of each document number, with the number's own hundredths in the place of ``#``."""
    value = ((F.col("doc_id") * 37 % 101).cast("double") / 100.0).cast("string")
    kind = F.col("doc_id") % len(kinds)
    out = F.lit(None).cast("string")
    for k, text in kinds.items():
        out = F.when(kind == k, F.replace(F.lit(text), F.lit("#"), value)).otherwise(out)
    return out


@query(
    "response_scores",
    """with good as (
  select doc_id, case doc_id % 11 when 0 then [0.9, 0.4, 0.1]::double[] when 1 then [1, 0, 0.25]::double[]
    else [0.5, 0.5, 0.5]::double[] end as s from documents)
select doc_id as batch_id, 3 as n, i::int as slot, s[i] as score from good cross join range(1, 4) r(i)""",
)
def response_scores(spark, sf):
    rows = fx.table(spark, sf, "documents").select(
        F.col("doc_id").alias("batch_id"), F.lit(3).alias("n"), _of_kind(_KINDS).alias("response")
    )
    return infer.parse_scores(rows)


_LABEL_KINDS = {
    0: '[{"tone": {"score": #}}, {"tone": #}]',
    1: '```json\n[{"tone": #}, {"tone": 0.5}]\n```',
    2: '```\n[{"tone": #}, null]\n```',
    3: '[{"tone": #}]',
    4: '{"tone": #}',
    5: "no idea",
    6: '[{"tone": #}, {}]',
}


@query(
    "response_axes",
    """with r as (select doc_id, doc_id % 7 as kind, (doc_id * 37 % 101)::double / 100.0 as v from documents)
select doc_id as batch_id, 2 as n, i::int as slot,
  case when i = 1 and kind in (0, 1, 2, 6) then v when i = 2 and kind = 0 then v when i = 2 and kind = 1 then 0.5 end as tone,
  case when kind in (0, 1, 6) then true when kind = 2 then i = 1 else false end as stored
from r cross join range(1, 3) s(i)""",
)
def response_axes(spark, sf):
    rows = fx.table(spark, sf, "documents").select(
        F.col("doc_id").alias("batch_id"), F.lit(2).alias("n"), _of_kind(_LABEL_KINDS).alias("response")
    )
    parsed = ax.parse_axes(infer.parse_label_response(rows), ["tone"])
    return parsed.select("batch_id", "n", "slot", "tone", F.col("axes_json").isNotNull().alias("stored"))


def echo_scores(prompt: str) -> str:
    """As many equal scores as the prompt has posts: the prompt's length modulo 11, in tenths."""
    count = int(re.match(r"Score these (\d+) posts", prompt)[1])
    return str([len(prompt) % 11 / 10] * count)


_DONE_SQL = f"""{fx.POSTS}, open as (select * from posts where doc_id not in (select doc_id from labels)),
{_batch_sql(10, 600, 'open')},
fresh as (select post_id, (length(prompt) % 11)::double / 10.0 as score from slots join prompts using (batch_id)),
stored as (select cast(doc_id as varchar) as post_id, quality::double as score from labels union all select * from fresh)"""


@query(
    "infer_resume",
    f"""with {_DONE_SQL} select p.post_id, p.topic_name, s.score as agent_score
from posts p left join stored s on s.post_id = p.post_id""",
)
def infer_resume(spark, sf):
    """Labels are the finished part; the rest is scored, appended, and merged back to the posts."""
    checkpoint = _fresh(spark, "scores")
    done = fx.labels(spark, sf).select("post_id", F.col("label").cast("double").alias("score"))
    append_checkpoint(done, checkpoint)
    posts = fx.posts(spark, sf)
    stored = infer.score_posts(posts, echo_scores, checkpoint)
    scores = stored.withColumnRenamed("score", "agent_score")
    return posts.select("post_id", "topic_name").join(scores, "post_id", "left")


def label_lengths(request: infer.Request) -> str:
    """For every post of a batch the lengths of the user and of the instruction text."""
    n = int(re.match(r"Score these (\d+)", request)[1])
    return json.dumps([{"user": len(request), "system": len(request.system)}] * n)


def label_even(request: infer.Request) -> str:
    """As ``label_lengths``, but failing for user texts of odd length."""
    if len(request) % 2:
        raise RuntimeError("no answer today")
    return label_lengths(request)


_LATE_SQL = f"""a as (select * from posts), {_batch_sql(5, 500, 'a')},
early as (select post_id, length(prompt) as n from slots join prompts using (batch_id) where length(prompt) % 2 = 0),
open as (select * from posts where post_id not in (select post_id from early)),
{_batch_sql(5, 500, 'open').replace('slots', 'slots_2').replace('prompts', 'prompts_2')},
late as (select post_id, length(prompt) as n from slots_2 join prompts_2 using (batch_id))"""


@query(
    "late_labels",
    f"""with {fx.POSTS}, {_LATE_SQL}
select post_id, n::int as user_chars, {len(infer.label_system(fx.CONFIG))}::int as system_chars, 3::int as version from early
union all select post_id, n::int, {len(infer.label_system(fx.CONFIG))}::int, 3::int from late""",
)
def late_labels(spark, sf):
    """Labels that fail in a first run and are answered in a second one reach the next version of the dataset."""
    base, checkpoint = _fresh(spark, "dataset"), _fresh(spark, "axes")
    posts = fx.posts(spark, sf)
    replace_dataset(posts.select("post_id", "topic_name", "text"), base, 1)
    for answer in (label_even, label_lengths):
        axes = infer.label_posts(posts, answer, checkpoint, fx.CONFIG, attempts=1)
        newest = curation.update_dataset(spark, base, axes)
    chars = F.from_json("axes_json", "struct<user int, system int>")
    return newest.select("post_id", chars["user"].alias("user_chars"), chars["system"].alias("system_chars"), F.col("version").cast("int").alias("version"))


def echo_rewrite(prompt: str) -> str:
    """The prompt's length as text; empty, and so failed, when it divides by five."""
    return "" if len(prompt) % 5 == 0 else f" rewrite of {len(prompt)} characters\n"


@query(
    "generate_rewrites",
    f"""with {REQUESTS_SQL} select post_id, axis, direction, length(text) as n_chars,
  'rewrite of ' || length(prompt) || ' characters' as rewrite from requests where length(prompt) % 5 <> 0""",
)
def generate_rewrites(spark, sf):
    work = _requests(spark, sf)
    done = infer.generate_rewrites(
        work, axis_dim(spark, fx.CONFIG), len(fx.AXES), echo_rewrite, _fresh(spark, "rewrites"), slices=2
    )
    return done.select(
        "post_id", "axis", "direction", F.length("original").cast("bigint").alias("n_chars"), "rewrite"
    )


@query(
    "text_functions",
    """select doc_id, substr(text, 1, 600) as head, length(substr(text, 1, 600)) as n_head,
  regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') as stripped,
  replace(source || '_' || lang, '_', ' ') as label, (doc_id % 1000)::int as run,
  replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')
    as escaped,
  len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) as n_words
from documents""",
)
def text_functions(spark, sf):
    text = F.col("text")
    name = F.concat_ws("_", F.lit("diff"), "lang", (F.col("doc_id") % 1000).cast("string"))
    return spread(fx.table(spark, sf, "documents")).select(
        "doc_id",
        tx.truncate(text, 600).alias("head"),
        F.length(tx.truncate(text, 600)).cast("bigint").alias("n_head"),
        tx.strip_space(text).alias("stripped"),
        tx.spaced(F.concat_ws("_", "source", "lang")).alias("label"),
        tx.run_number(name).alias("run"),
        tx.escape_html(text).alias("escaped"),
        F.size(tx.words(text)).cast("bigint").alias("n_words"),
    )


def length_vectors(texts: list[str]) -> list[list[float]]:
    return [[len(t), len(t) % 7, 1.0] for t in texts]


@query(
    "embed_plugin",
    """select doc_id, length(text)::double as a, (length(text) % 7)::double as b, 1.0::double as c from documents""",
)
def embed_plugin(spark, sf):
    docs = spread(fx.table(spark, sf, "documents")).select("doc_id", "text")
    vectors = infer.embed_batches(docs, length_vectors)
    return vectors.select("doc_id", *(F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("abc")))
