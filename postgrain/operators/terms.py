"""Words and word pairs per topic, their class weights, the topic table, and hashed text vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postgrain.functions.text import words
from postgrain.functions.vectors import matrix_list
from postgrain.operators.topn import topn
from postgrain.session import BROADCAST_ROWS, spread, stage

BUCKETS = 1 << 22  # hash buckets of terms, a table of fixed size
WIDE = 32  # buckets whose terms are counted first, for each term of the vocabulary


def english_stop_words() -> list[str]:
    """Spark's own English list; pass another list to the operators to replace it."""
    return StopWordsRemover.loadDefaultStopWords("english")


def grams(tokens: Column, n: int) -> Column:
    """Runs of ``n`` neighbouring tokens joined by a blank, in order."""
    runs = tokens
    for place in range(2, n + 1):
        many = F.greatest(F.size(tokens) - (place - 1), F.lit(0))
        runs = F.zip_with(
            F.slice(runs, F.lit(1), many), F.slice(tokens, F.lit(place), many), lambda a, b: F.concat(a, F.lit(" "), b)
        )
    return runs


def ngram_counts(
    docs: DataFrame,
    group: str = "topic",
    text: str = "text",
    n: tuple[int, int] = (1, 2),
    min_df: int = 50,
    max_df: float = 0.9,
    max_features: int | None = 200_000,
    stop_words: Sequence[str] | None = None,
) -> DataFrame:
    """Term counts ``(group, term, tf)`` of the vocabulary.

    A group's posts are one document: ``min_df`` and ``max_df`` bound the number and the share of groups that have a
    term. Stop words go before terms are formed. ``max_features`` keeps the most frequent terms (alphabetical on ties).
    Terms are formed inside one post. Counts are combined before the shuffle, so a topic with a third of all posts
    sends no more rows than its vocabulary per map task.

    With few ``max_features``, most of the many rare terms are never counted as text: a first pass counts ``BUCKETS``
    hash buckets, whose load no term in them exceeds, and a second one the terms of the most loaded buckets. Unless the
    vocabulary is full with terms more frequent than any other bucket's load, more buckets are counted, all in the end;
    so the result is exact.
    """
    stop = list(english_stop_words() if stop_words is None else stop_words)
    docs = spread(docs.select(group, text))
    tokens = words(F.col(text))
    if stop:
        tokens = F.filter(tokens, lambda w: ~w.isin(stop))
    tokenised = docs.select(group, tokens.alias("_tokens"))
    parts = [grams(F.col("_tokens"), m) for m in range(n[0], n[1] + 1)]
    terms = tokenised.select(group, F.explode(F.concat(*parts) if len(parts) > 1 else parts[0]).alias("term"))
    groups = docs.agg(F.count_distinct(group)).scalar()
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS))
    loads, wide = None, None if max_features is None else max_features * WIDE
    if wide is not None and wide < BUCKETS:
        buckets = terms.select(bucket.alias("_bucket")).groupBy("_bucket").agg(F.count(F.lit(1)).alias("_load"))
        loads = stage(buckets.withColumn("_load", _octave(F.col("_load"))))
        sizes = loads.groupBy("_load").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("_load")).collect()  # some 300 rows
    while True:
        # The load from which the most loaded buckets, ``wide`` or a few more, are counted; None for all.
        least, seen = None, 0
        for row in sizes if loads is not None else []:
            seen += row.n
            if seen >= wide:
                least = row["_load"] if seen <= BROADCAST_ROWS else None
                break
        some = terms
        if least is not None:
            kept = loads.filter(F.col("_load") >= least).select("_bucket")
            some = terms.withColumn("_bucket", bucket).join(F.broadcast(kept), "_bucket", "left_semi")
        # The result comes from the stored counts.
        counts = stage(some.groupBy(group, "term").agg(F.count(F.lit(1)).alias("tf")))
        totals = counts.groupBy("term").agg(F.count(F.lit(1)).alias("_df"), F.sum("tf").alias("_total"))
        vocabulary = totals.filter((F.col("_df") >= min_df) & (F.col("_df") <= F.lit(max_df) * groups))
        if max_features is not None:
            vocabulary = topn(vocabulary, [], [F.col("_total").desc(), F.col("term")], max_features, value=F.col("_total"))
        if least is not None:
            vocabulary = stage(vocabulary)
            found = vocabulary.agg(F.count(F.lit(1)).alias("n"), F.min(_octave(F.col("_total"))).alias("last")).first()
            if found.n < max_features or found.last < least:  # a term of another bucket may belong to them
                wide *= 8
                continue
        return stage(counts.join(vocabulary.select("term"), "term", "left_semi").select(group, "term", "tf"))


def _octave(n: Column) -> Column:
    """An eighth of an octave: a whole number that never falls as ``n`` rises."""
    return F.floor(F.log2(n) * 8).cast("int")


def class_tfidf(counts: DataFrame, group: str = "topic", top: int | None = 10) -> DataFrame:
    """Weight ``tf / sum(tf in group) * ln(1 + A / total of the term)`` and the ``top`` terms per group.

    ``A`` is the whole-number mean of terms per group. Rows ``(group, term, tf, weight, rn)``.
    """
    per_group = counts.groupBy(group).agg(F.sum("tf").alias("_size"))
    per_term = counts.groupBy("term").agg(F.sum("tf").alias("_total"))
    mean = per_group.agg(F.floor(F.avg("_size"))).scalar()
    weight = F.col("tf") / F.col("_size") * F.log(F.lit(1.0) + mean / F.col("_total"))
    weighted = (
        counts.join(per_group, group).join(per_term, "term").select(group, "term", "tf", weight.alias("weight"))
    )
    order = [F.round("weight", 12).desc(), F.col("term")]
    return weighted if top is None else topn(weighted, [group], order, top)


def topic_sizes(topics: DataFrame) -> DataFrame:
    """Posts per topic with their share of all posts, noise included."""
    sizes = topics.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def topic_totals(topics: DataFrame) -> DataFrame:
    """One row: posts, topics without noise, noise posts and their share."""
    noise = F.count_if(F.col("topic") == -1)
    return topics.agg(
        F.count(F.lit(1)).alias("posts"),
        F.count_distinct(F.when(F.col("topic") != -1, F.col("topic"))).alias("topics"),
        noise.alias("noise"),
        (noise / F.count(F.lit(1))).alias("noise_share"),
    )


def renumber(labelled: DataFrame, label: str = "topic", key: str = "post_id") -> DataFrame:
    """Renumber topics by size, 0 the largest (smallest key first on ties); noise stays -1."""
    sizes = labelled.filter(F.col(label) != -1).groupBy(label).agg(
        F.count(F.lit(1)).alias("_n"), F.min(key).alias("_first")
    )
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("_n").desc(), "_first")) - 1
    numbers = sizes.select(label, place.cast("int").alias("_new"))
    return labelled.join(numbers, label, "left").withColumn(label, F.coalesce("_new", F.lit(-1))).drop("_new")


def topic_info(topics: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows ``(topic, n, name, terms)``: size, a name of the id and its four best terms, and all kept terms."""
    entry = F.struct("rn", "term", F.round("weight", 6).alias("weight"))
    best = terms.groupBy("topic").agg(F.array_sort(F.collect_list(entry)).alias("terms"))
    sizes = topics.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    first = F.transform(F.slice("terms", 1, 4), lambda t: t["term"])
    name = F.concat_ws("_", F.col("topic").cast("string"), first)
    return sizes.join(best, "topic", "left").select(
        "topic", "n", name.alias("name"), F.transform("terms", lambda t: t.dropFields("rn")).alias("terms")
    )


def hashed_places(buckets: int, dim: int, seed: int, fan: int) -> tuple[np.ndarray, np.ndarray]:
    """``fan`` places and signs of every bucket: of each four MD5 digits of ``seed:bucket``, three give the place, modulo
    ``dim``, and the last the sign, minus where it is odd."""
    if fan > 8:
        raise ValueError("an MD5 has digits for eight places")
    digests = b"".join(hashlib.md5(f"{seed}:{b}".encode()).digest() for b in range(buckets))
    digits = np.frombuffer(digests, dtype=">u2").reshape(buckets, 8)[:, :fan].astype(np.int64)
    return (digits >> 4) % dim, np.where(digits % 2, -1.0, 1.0)


def hash_embed(
    docs: DataFrame, text: str = "text", dim: int = 64, seed: int = 42, buckets: int = 1 << 16, fan: int = 4
) -> DataFrame:
    """Add ``embedding``: TF-IDF over hashed words, projected to ``dim`` by seeded signs, unit length.

    Stands in for a text encoder. A word's bucket is the number of its first eight MD5 digits, modulo ``buckets``; the
    places and signs of a bucket are digits of the MD5 of seed and bucket, so that any engine with MD5 gives the same
    vectors. The document frequencies of the buckets (a fixed-size table) are counted by Spark; the projection is
    row-local. A text without words has the zero vector; a null text has none and is not counted.
    """
    number = lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("bigint")
    hashes = F.transform(words(F.col(text)), lambda w: (number(w) % buckets).cast("int"))
    hashed = spread(docs).withColumn("_h", hashes)
    every = F.array_append(F.array_distinct("_h"), F.lit(buckets))  # one more entry counts the texts themselves
    found = hashed.select(F.explode(every).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(buckets + 1)
    for row in found.collect():  # a fixed-size table: one row per bucket
        counts[row.h] = row.n
    idf = np.log((counts[buckets] + 1.0) / (counts[:buckets] + 1.0))
    places, signs = hashed_places(buckets, dim, seed, fan)
    signs = signs * idf[:, None]

    @F.arrow_udf("array<double>")
    def project(col: pa.Array) -> pa.Array:
        valid = np.asarray(col.is_valid())
        kept = col.drop_null()
        rows = np.repeat(np.arange(len(kept)), kept.value_lengths().to_numpy(zero_copy_only=False))
        h = kept.flatten().to_numpy(zero_copy_only=False)
        cells = rows[:, None] * dim + places[h]
        flat = np.bincount(cells.ravel(), weights=signs[h].ravel(), minlength=len(kept) * dim)
        matrix = flat.reshape(-1, dim)
        norms = np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
        return matrix_list(matrix / norms, valid)

    return hashed.withColumn("embedding", project("_h")).drop("_h")
