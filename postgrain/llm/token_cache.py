"""Token counts through a cache of digests.

A count is stored under two SHA-256 digests: of the normalised content and of the tokenizer's file. Texts are looked up
by both; only distinct misses are encoded, and their counts are appended to the cache, a Parquet folder. Normal form: runs
of space, tab, CR and LF become one space, without any at the ends. It is meant for tokenizers that drop white space; the
counts of two texts with one normal form are then equal.

Encoding works word by word: the library's count of a text is the sum of its counts of the pieces between spaces, since
neither the normaliser nor the pre-tokenizer nor a special token reaches across a space. Counts of pieces are remembered by
each worker. Set ``by_word=False`` for a tokenizer of which that is not true; whole texts are then encoded.

Nulls count as empty: 0 bytes, 0 tokens. Texts are never cut. Copies, however many, are encoded once: each task passes on
a digest once, and what arrives for one digest is reduced to one row before it is encoded. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postgrain.llm.workers import per_worker
from postgrain.session import stage

CACHE_SCHEMA = "content binary, tokenizer string, n_tokens long"
REMEMBERED = 1 << 18  # pieces in each half of a worker's memory
PIECE_LENGTH = 64
TOGETHER = 2048  # pieces
SLICE = 1 << 20  # characters


def normal_form(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t\\r\\n]+", " "))


class Counter:
    """Counts tokens with the tokenizers library, without added special tokens, truncation or padding."""

    def __init__(self, path: str, by_word: bool) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_word = by_word
        self.known: dict[str, int] = {"": 0}
        self.older: dict[str, int] = {}

    def count(self, texts: list[str]) -> Iterator[int]:
        """The counts of ``texts``, a slice of about a megabyte at a time."""
        at = 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size < SLICE:
                size += len(texts[end])
                end += 1
            yield from self.by_pieces(texts[at:end]) if self.by_word else map(self.whole, texts[at:end])
            at = end

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def by_pieces(self, texts: list[str]) -> list[int]:
        split = [text.split(" ") for text in texts]
        missing = set(chain.from_iterable(split)) - self.known.keys()
        again = missing & self.older.keys()
        self.known.update((x, self.older[x]) for x in again)
        missing -= again
        self.known.update(self.learn(list(missing)))
        out = [sum(map(self.known.__getitem__, pieces)) for pieces in split]
        for x in missing:
            if len(x) > PIECE_LENGTH:
                del self.known[x]
        if len(self.known) > REMEMBERED:
            self.known, self.older = {"": 0}, self.known
        return out

    def learn(self, pieces: list[str]) -> Iterator[tuple[str, int]]:
        """The counts of pieces without spaces: many are encoded as one text, and tokens fall to the piece they begin in."""
        for at in range(0, len(pieces), TOGETHER):
            part = pieces[at : at + TOGETHER]
            begins = np.cumsum([0, *(len(x) + 1 for x in part[:-1])])
            offsets = self.tokenizer.encode(" ".join(part), add_special_tokens=False).offsets
            owner = np.searchsorted(begins, [a for a, _ in offsets], side="right") - 1
            yield from zip(part, np.bincount(owner, minlength=len(part)).tolist())


def read_cache(spark, path: str) -> DataFrame | None:
    """The cache, or None when nothing was stored yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def count_tokens(docs: DataFrame, cache: str, tokenizer: str, keep: list[str], by_word: bool = True) -> DataFrame:
    """Columns ``keep`` with n_bytes (UTF-8) and n_tokens. ``tokenizer`` is a file that driver and executors have.

    Misses are encoded and appended to ``cache`` before this returns.
    """
    spark = docs.sparkSession
    with open(tokenizer, "rb") as f:
        version = sha256(f.read()).hexdigest()
    text = F.col("text")
    content = F.unhex(F.sha2(F.col("__text"), 256)).alias("__content")

    def first_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            rows = []
            for k, key in enumerate(keys):
                if key not in seen:
                    seen.add(key)
                    rows.append(k)
            yield batch.take(pa.array(rows, pa.int64()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        counter = per_worker(("token_cache", tokenizer, version, by_word), lambda: Counter(tokenizer, by_word))
        for batch in first_of_task(batches):
            n = list(counter.count(batch.column(1).to_pylist()))
            columns = [batch.column(0), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["content", "tokenizer", "n_tokens"])

    texts = docs.select(normal_form(text).alias("__text")).select(content, "__text")
    todo = texts.mapInArrow(first_of_task, texts.schema)
    stored = read_cache(spark, cache)
    if stored is not None:
        known = stored.filter(F.col("tokenizer") == version).select(F.col("content").alias("__content"))
        todo = todo.join(known, "__content", "left_anti")
    todo.repartition("__content").mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)

    counts = read_cache(spark, cache).filter(F.col("tokenizer") == version)
    counts = stage(counts.groupBy(F.col("content").alias("__counted")).agg(F.max("n_tokens").alias("n_tokens")))
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")
    keyed = docs.select(*keep, size, normal_form(text).alias("__text")).select(*keep, "n_bytes", content)
    joined = keyed.join(counts, F.col("__content") == F.col("__counted"), "left")
    return joined.select(*keep, "n_bytes", "n_tokens")
