"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_language")
def op1_language(spark: SparkSession, sf: str) -> DataFrame:
    """The language of every document, learned from the documents that are not held out."""
    from postgrain.llm.language import fit_languages, predict_languages

    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    docs = table(spark, sf, "documents").withColumn("held_out", F.coalesce(held, F.lit(False)))
    model = fit_languages(docs.filter(~F.col("held_out")))
    return predict_languages(docs, model, ["doc_id", "held_out"])


@query("op3_byte_bpe")
def op3_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Byte-level BPE ids of every document, decoded again."""
    import public_tokenizers

    from postgrain.llm.byte_bpe import round_trip

    docs = table(spark, sf, "documents")
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"])


MIX_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    md5(concat('mix|', md5(concat(coalesce(md5(cast(doc_id as varchar)), '-'), '|', coalesce(md5(source), '-'), '|', coalesce(md5(text), '-'))),
      '|', row_number() over (partition by doc_id, source, text) - 1)) as shuffled from documents),
t as (
  select source, sum(size) as source_size, row_number() over (order by source nulls last) - 1 as place from d group by source),
w as (select *, case place % 3 when 0 then 3 when 1 then 1 else 2 end as weight, 2 * source_size as most from t),
f as (
  select *, sum(source_size) over () * 1.5::double as budget, sum(most) over () as all_most,
    sum(most) over (order by most::double / weight, place) - most as full_before,
    sum(weight) over () - sum(weight) over (order by most::double / weight, place) + weight as open_before from w),
s as (
  select source, place, weight, source_size, budget, case when budget >= all_most then most::double
    else least(weight * max((budget - full_before::double) / open_before) over (), most::double) end as target from f),
r as (
  select doc_id, size, shuffled, s.*
  from d join s on d.source is not distinct from s.source),
o as (
  select *, sum(size) over (partition by place order by shuffled, doc_id, size rows unbounded preceding) as upto,
    row_number() over (partition by place order by shuffled, doc_id, size) as turn from r),
c as (
  select o.*, e.epoch, (upto + e.epoch * source_size)::double / weight as due
  from o, (values (0), (1)) e(epoch)),
m as (
  select *, sum(size) over (order by due, place, turn, epoch rows unbounded preceding) <= budget as in_mix from c)
select doc_id, any_value(size)::bigint as size, any_value(source_size)::bigint as source_size, any_value(target) as target,
  (any_value(size) * count(*) filter (in_mix))::bigint as taken, (count(*) filter (in_mix))::int as copies, min(due) as finish
from m group by doc_id, place, turn
"""


@query("op10_fair_mix", MIX_SQL)
def op10_fair_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's part in a mix of the sources to their targets."""
    from postgrain.llm.fair_mix import mix

    return mix(table(spark, sf, "documents"))


@query("op4_shards")
def op4_shards(spark: SparkSession, sf: str) -> DataFrame:
    """The shard of every document, and where it would go if the last shard were taken away."""
    from postgrain.llm.perm_table import fill, place

    shards = {f"shard-{k:03}": 1 for k in range(64)}
    fewer = {name: turns for name, turns in shards.items() if name != "shard-063"}
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return place(docs, "doc_id", {"shard": fill(shards), "shard_if_one_fails": fill(fewer)})


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Token counts of every document; the cache starts empty and lies in the shared folder."""
    import uuid

    import public_tokenizers

    from postgrain.llm.token_cache import count_tokens
    from postgrain.session import shared_folder

    cache = f"{shared_folder(spark)}/token-cache-{uuid.uuid4().hex}"
    counted = count_tokens(table(spark, sf, "documents"), cache, public_tokenizers.path("word_bpe_49k.json"), ["doc_id"])
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


TOP_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as x from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id and len(q.x) = len(c.x))
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from s qualify rank <= 10
"""


@query("op8_top_k", TOP_SQL)
def op8_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best scores of every hundredth vector against all others."""
    from postgrain.llm.va_file import top_k

    return top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, 10)


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and the group of near fingerprints it belongs to."""
    from postgrain.llm.simhash import edit_study, with_near_id
    from postgrain.session import stage

    return with_near_id(stage(edit_study(table(spark, sf, "documents"))))


LINK_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from w),
d as (select s.s as s, min(doc_id) as node, count(*) as copies, len(s.s) as n from (select doc_id, list_sort(s) as s from s) s group by s.s),
t as (select node, n, unnest(s) as t from d),
o as (select a.node as a, b.node as b, any_value(a.n) as n, any_value(b.n) as m, count(*) as common
  from t a join t b on a.t = b.t and a.node < b.node group by a.node, b.node),
l as (select a, b from o where 100 * common >= 75 * (n + m - common)),
e as (select a, b from l union all select b, a from l),
r as (select node, node as goal from d union select r.node, e.b from r join e on r.goal = e.a),
c as (select node, min(goal) as lowest from r group by node)
select s.doc_id, len(s.s)::bigint as n_shingles,
  case when len(s.s) = 0 then s.doc_id else c.lowest end as component_id,
  (case when len(s.s) = 0 then 1 else d.copies end)::bigint as n_copies
from s left join d on list_sort(s.s) = d.s left join c on d.node = c.node
"""


@query("op2_group_join", LINK_SQL)
def op2_group_join(spark: SparkSession, sf: str) -> DataFrame:
    """Components of documents linked by the similarity of their 5-word shingles."""
    from postgrain.llm.group_join import link_documents

    return link_documents(table(spark, sf, "documents"))


@query("op9_pii")
def op9_pii(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data in every document: base spans, and all spans with those that the trees add."""
    from postgrain.llm.pii import KINDS, find, listed, select, train
    from postgrain.session import stage

    found = stage(find(table(spark, sf, "documents").select("doc_id", "text")).drop("text"))
    counts = [F.expr(f"bigint(size(filter(base, s -> s.kind = {k})))").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    digest = F.sha2(listed("base"), 256).alias("base_sha256")
    return select(found, train(found)).select("doc_id", *counts, digest, listed("spans").alias("spans"))


@query("op6_page_text")
def op6_page_text(spark: SparkSession, sf: str) -> DataFrame:
    """The main text of every page."""
    from postgrain.llm.page_tree import extract, train

    pages = table(spark, sf, "pages")
    return extract(pages, train(pages), ["page_id", "url"])


MERKLE_SQL = r"""
with recursive bits as (
  select distinct doc_id, list_transform(range(8 * strlen(cast(doc_id as varchar))),
    lambda i: ((ascii(substr(cast(doc_id as varchar), (i // 8 + 1)::bigint, 1))::bigint) >> (i % 8)::bigint) & 1) as b
  from documents where doc_id is not null),
crc as (
  select doc_id, xor(list_reduce(list_prepend(4294967295::bigint, b),
    lambda c, x: xor(c >> 1, 3988292384::bigint * ((xor(c, x)) & 1))), 4294967295::bigint) as crc from bits),
d as (
  select documents.*, coalesce(crc % 3 = 0, false) as tampered,
    case when crc % 3 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as seen
  from documents left join crc using (doc_id)),
f as (
  select doc_id, lang, coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-') as head, text, seen from d),
l as (
  select doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
    sha256(head || coalesce(strlen(seen) || ':' || seen, '-')) as seen_leaf from f),
p as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n from l),
t as (
  select lang, 0 as level, pos, n, leaf as digest from p
  union all
  select lang, level + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(digest, '' order by pos))
  from t where n > 1 group by lang, level, pos // 8),
s as (
  select lang, digest, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n from t where n = 1),
u as (
  select 0 as level, pos, n, digest from s
  union all
  select level + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(digest, '' order by pos)) from u where n > 1 group by level, pos // 8),
x as (
  select lang, level, pos, n, coalesce(string_agg(digest, '' order by pos) over (partition by lang, level, pos // 8 order by pos rows between unbounded preceding and 1 preceding), '') as l,
    coalesce(string_agg(digest, '' order by pos) over (partition by lang, level, pos // 8 order by pos rows between 1 following and unbounded following), '') as r from t where n > 1),
y as (
  select level, pos, n, coalesce(string_agg(digest, '' order by pos) over (partition by level, pos // 8 order by pos rows between unbounded preceding and 1 preceding), '') as l,
    coalesce(string_agg(digest, '' order by pos) over (partition by level, pos // 8 order by pos rows between 1 following and unbounded following), '') as r from u where n > 1),
g as (
  select doc_id, lang, pos as own, 0 as level, pos, seen_leaf as folded, '' as seen from p
  union all
  select g.doc_id, g.lang, g.own, g.level + 1, g.pos // 8, sha256(x.l || g.folded || x.r), g.seen || x.l || x.r
  from g join x on g.lang is not distinct from x.lang and g.level = x.level and g.pos = x.pos),
h as (
  select doc_id, g.lang, own, 0 as level, s.pos, folded, seen from (select * from g qualify row_number() over (partition by lang, own order by level desc) = 1) g
  join s on g.lang is not distinct from s.lang
  union all
  select h.doc_id, h.lang, h.own, h.level + 1, h.pos // 8, sha256(y.l || h.folded || y.r), h.seen || y.l || y.r
  from h join y on h.level = y.level and h.pos = y.pos),
e as (select * from h qualify row_number() over (partition by lang, own order by level desc) = 1)
select p.doc_id, p.leaf, s.digest as subroot, (select digest from u where n = 1) as root, sha256(e.seen) as proof_sha256,
  e.folded as folded_root, e.folded = (select digest from u where n = 1) as verified
from p join s on p.lang is not distinct from s.lang join e on p.lang is not distinct from e.lang and p.pos = e.own
"""


@query("op11_merkle", MERKLE_SQL)
def op11_merkle(spark: SparkSession, sf: str) -> DataFrame:
    """Every document checked against the manifest of all, a third of them after tampering."""
    from postgrain.llm.merkle import folded, leaf, manifest, proof_digest

    docs = table(spark, sf, "documents")
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    seen = F.when(tampered, leaf([*head, low]))
    made = manifest(docs.select("doc_id", "lang", leaf([*head, F.col("text")]).alias("digest"), seen.alias("seen")), "doc_id", F.col("lang"))
    root = F.lit(made.root).cast("string")
    proved = made.proofs().withColumn("folded_root", folded(F.coalesce("seen", "digest"), F.col("path")))
    return proved.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == root).alias("verified"),
    )


REPEATS_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
u as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from w),
s as (select doc_id, i as start, string_agg(word, ' ') over ahead as words, count(*) over ahead as n from u
  window ahead as (partition by doc_id order by i rows between current row and 19 following)),
h as (select doc_id, start, row_number() over (partition by words order by doc_id, start) as turn from s where n = 20),
g as (select distinct doc_id, start + unnest(range(20)) as gone from h where turn > 1),
k as (select u.doc_id, count(*) as n_words, count(gone) as n_removed, string_agg(word, ' ' order by i) filter (gone is null) as kept
  from u left join g on u.doc_id = g.doc_id and i = gone group by u.doc_id)
select w.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join k on w.doc_id = k.doc_id
"""


@query("op12_repeats", REPEATS_SQL)
def op12_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """Every document without the words of 20-word windows that also start earlier."""
    from postgrain.llm.windows import remove_repeats

    kept = remove_repeats(table(spark, sf, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


NEGATIVES_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as x from embeddings
  where embedding is not null and vec_id is not null and label is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, c.vec_id, c.label = a.label as same, list_sum(list_transform(list_zip(a.x, c.x), lambda p: p[1] * p[2]))::bigint as score
  from v a join v c on a.vec_id % 100 = 0 and c.vec_id <> a.vec_id and len(a.x) = len(c.x)),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank,
  vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10
"""


@query("op13_negatives", NEGATIVES_SQL)
def op13_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Hard negatives for the five positives of every hundredth vector."""
    from postgrain.llm.negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


@query("pipeline")
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """All stages of the corpus pipeline over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)
