"""Removal of repeated passages: words covered by a window of words that also starts earlier, by a count-min prefilter.

Earlier means in a document before this one in the order of doc_id, or further ahead in the same document. Three passes over
whole texts:

1. Every task counts windows in a count-min sketch of fixed size, and Spark adds the sketches up. A window is counted under
   its least run of ``RUN`` words (by hash, the first of equals), at most once a place: windows that overlap mostly share
   one, so that a sketch holds some seven times more text, and equal windows at two places always count two such runs. So
   the sketch can only overestimate a window's count. Counters stop at two, which is all that is asked.
2. Windows estimated at two or more go, under 96-bit hashes of their words, into an exact grouping that keeps the first
   place of each. Spark combines it before the shuffle, so that a passage of very many documents is sent about once a task.
3. First places return to their document as one list, no longer than its text. A window that is estimated as repeated and
   is not the first place of its words covers words that go.

A sketch that overflows costs time in step 2, never results. What is broadcast is one bit a counter, 16 MB.

Nulls and texts without words have no words; texts shorter than a window stay. A null doc_id comes last. Different texts
under one doc_id (or under none) count as documents in the order of their digests; equal rows as one document after
the other. Columns other than doc_id and text play no part, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postgrain.llm.hashing import CASED, chunks, mix, run_hashes, word_bounds, word_hashes
from postgrain.llm.ordering import positions
from postgrain.llm.workers import lean
from postgrain.session import stage

RUN = 8
DEPTH = 2
WIDTH_BITS = 26  # counters of a sketch row: 2 ** WIDTH_BITS
SLICE_BITS = 20  # sketches are added up in slices of so many counters
LAST = (1 << 63) - 1


def cells(runs: np.ndarray) -> list[np.ndarray]:
    """The counter of each run in every row of the sketch."""
    salted = (mix(runs ^ np.uint64((0x9E3779B97F4A7C15 * row) & (1 << 64) - 1)) for row in range(DEPTH))
    return [(h >> np.uint64(64 - WIDTH_BITS)).astype(np.int64) + (row << WIDTH_BITS) for row, h in enumerate(salted)]


@dataclass
class Windows:
    """The windows of a slice of texts: where they start, as word numbers, and the least run of each."""

    words: np.ndarray
    firsts: np.ndarray  # first word of each text, and the end
    starts: np.ndarray
    at: np.ndarray  # word number where the least run of each window begins
    runs: np.ndarray

    @classmethod
    def of(cls, raw: np.ndarray, offsets: np.ndarray, size: int) -> Windows:
        words, firsts = word_hashes(raw, offsets, CASED)
        if len(words) < size:
            none = np.zeros(0, dtype=np.int64)
            return cls(words, firsts, none, none, np.zeros(0, dtype=np.uint64))
        short = min(RUN, size)
        runs = run_hashes(words, short)
        n = len(words) - size + 1
        least, at = runs[:n].copy(), np.zeros(n, dtype=np.int64)
        for k in range(1, size - short + 1):
            less = runs[k : k + n] < least
            least[less] = runs[k : k + n][less]
            at[less] = k
        starts = np.flatnonzero(np.arange(n) + size <= np.repeat(firsts[1:], np.diff(firsts))[:n])
        return cls(words, firsts, starts, starts + at[starts], runs)

    def counted(self) -> np.ndarray:
        """The least runs by place; neighbours with the same place count once."""
        new = np.ones(len(self.at), dtype=bool)
        new[1:] = self.at[1:] != self.at[:-1]
        return self.runs[self.at[new]]

    def repeated(self, twice: np.ndarray) -> np.ndarray:
        """Starts of the windows that the sketch's bits estimate at two or more."""
        found = np.ones(len(self.at), dtype=bool)
        for c in cells(self.runs[self.at]):
            found &= (twice[c >> 3] >> (c & 7).astype(np.uint8)) & 1 == 1
        return self.starts[found]


@dataclass
class Counters:
    """Counters up to two, a bit of ``once`` and a bit of ``twice`` for each."""

    once: np.ndarray
    twice: np.ndarray

    @classmethod
    def of(cls, n: int) -> Counters:
        return cls(np.zeros(n // 8, dtype=np.uint8), np.zeros(n // 8, dtype=np.uint8))

    def add(self, c: np.ndarray) -> None:
        """Count each of ``c``."""
        c = np.sort(c)
        at, bits = set_bits(c[1:][c[1:] == c[:-1]])
        self.twice[at] |= bits
        at, bits = set_bits(c)
        self.twice[at] |= bits & self.once[at]
        self.once[at] |= bits


def set_bits(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that hold the bits at rising ``places``, each once, and these bits in them."""
    at = places >> 3
    heads = np.flatnonzero(np.diff(at, prepend=-1))
    return at[heads], np.bitwise_or.reduceat(np.uint8(1) << (places & 7).astype(np.uint8), heads) if len(heads) else np.zeros(0, dtype=np.uint8)


def sketch(texts: DataFrame, size: int) -> np.ndarray:
    """A bit for each counter of the added sketches: whether it reached two."""
    n, width = DEPTH << WIDTH_BITS, 1 << SLICE_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counters.of(n)
        for batch in batches:
            for _, raw, offsets in chunks(batch.column("text")):
                for c in cells(Windows.of(raw, offsets, size).counted()):
                    total.add(c)
        for k, bits in enumerate(zip(*(x.reshape(-1, width // 8) for x in (total.once, total.twice)))):
            if bits[0].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([b.tobytes()], pa.binary()) for b in bits)], ["slice", "once", "twice"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                once, twice = (np.frombuffer(row[c], dtype=np.uint8) for c in ("once", "twice"))
                before = kept.setdefault(row["slice"], [np.zeros(width // 8, dtype=np.uint8) for _ in range(2)])
                before[1] |= twice | (before[0] & once)
                before[0] |= once
        for k, (_, twice) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([twice.tobytes()], pa.binary())], ["slice", "twice"])

    # As many sketches as cores: each has a fixed size, however much text it counts.
    counted = texts.select("text").coalesce(texts.sparkSession.sparkContext.defaultParallelism)
    parts = counted.mapInArrow(lean(count), "slice int, once binary, twice binary")
    added = parts.repartition(n // width, "slice").mapInArrow(lean(add), "slice int, twice binary")
    twice = np.zeros(n // 8, dtype=np.uint8)
    for row in added.toLocalIterator():  # n / 8 bytes in all
        twice[row["slice"] * width // 8 : (row["slice"] + 1) * width // 8] = np.frombuffer(row["twice"], dtype=np.uint8)
    return twice


def shared_ids(docs: DataFrame) -> DataFrame:
    """Documents whose doc_id is null or not theirs alone: doc_id, digest, ``turn`` (from 1, in their order) and ``copies``."""
    keyed = stage(docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest")).groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies")))
    several = keyed.filter("doc_id is not null").groupBy("doc_id").agg(F.sum("copies").alias("n")).filter("n > 1")
    rows = keyed.filter("doc_id is null").unionByName(keyed.join(several.select("doc_id"), "doc_id", "left_semi"))
    placed = positions(rows.withColumn("part", F.lit("")), "part", [F.asc_nulls_last("doc_id"), F.asc_nulls_first("digest")])
    return placed.select(F.col("doc_id").alias("of_id"), F.col("digest").alias("of_digest"), (F.col("pos") + 1).alias("turn"), "copies")


def first_places(texts: DataFrame, size: int, twice) -> DataFrame:
    """Columns id, turn, first: for each document the starts (word numbers) of repeated windows that occur there first.

    Written to the shared folder, so that what was shuffled for them can go before texts are.
    """

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(twice.value, dtype=np.uint8)
        for batch in batches:
            ids, turns = (np.asarray(batch.column(c)) for c in ("id", "turn"))
            for row, raw, offsets in chunks(batch.column("text")):
                windows = Windows.of(raw, offsets, size)
                starts = windows.repeated(bits)
                if len(starts):
                    of = np.searchsorted(windows.firsts, starts, side="right") - 1
                    h, g = (run_hashes(windows.words, size, f)[starts] for f in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
                    hashes = h.view(np.int64), (g >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    columns = [*hashes, ids[row + of], turns[row + of], (starts - windows.firsts[of]).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "g", "id", "turn", "start"])

    found = texts.mapInArrow(lean(candidates), "h long, g int, id long, turn long, start int")
    first = found.groupBy("h", "g").agg(F.min(F.struct("id", "turn", "start")).alias("first")).select("first.*")
    return stage(first.groupBy("id", "turn").agg(F.collect_list("start").alias("first")))


def remove_repeats(docs: DataFrame, size: int = 20) -> DataFrame:
    """Columns doc_id, n_words, n_removed and ``kept``: the words that stay, joined by one space."""
    twice = docs.sparkSession.sparkContext.broadcast(sketch(docs, size).tobytes())
    shared = stage(shared_ids(docs))
    plain = docs.select("doc_id", "text")
    same = plain["doc_id"].eqNullSafe(shared["of_id"]) & F.md5(plain["text"].cast("binary")).eqNullSafe(shared["of_digest"])
    key = [F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.coalesce("turn", F.lit(0).cast("long")).alias("turn")]
    columns = [*key, "doc_id", "text", F.coalesce("copies", F.lit(1).cast("long")).alias("copies")]
    texts = plain.join(shared, same, "left").select(*columns)
    # Of equal rows only one goes through the last pass; the others follow from it.
    several = plain.join(shared.filter("copies > 1"), same).select(*columns).dropDuplicates(["id", "turn"])
    once = texts.filter("copies = 1").unionByName(several)
    places = first_places(texts.select("id", "turn", "text"), size, twice)
    joined = once.join(places.select(F.col("id").alias("at_id"), F.col("turn").alias("at_turn"), "first"), (F.col("id") == F.col("at_id")) & (F.col("turn") == F.col("at_turn")), "left")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(twice.value, dtype=np.uint8)
        for batch in batches:
            texts, first = batch.column("text"), batch.column("first")
            for row, raw, offsets in chunks(texts):
                n = len(offsets) - 1
                windows = Windows.of(raw, offsets, size)
                own = first.slice(row, n)
                sizes = np.asarray(pc.fill_null(pc.list_value_length(own), 0))
                stay = np.repeat(windows.firsts[:-1], sizes) + np.asarray(own.flatten(), dtype=np.int64)
                starts = np.setdiff1d(windows.repeated(bits), stay, assume_unique=True)
                change = np.zeros(len(windows.words) + 1, dtype=np.int64)
                change[starts] += 1
                change[starts + size] -= 1
                gone = np.cumsum(change[:-1]) > 0
                before = np.concatenate([[0], np.cumsum(gone)])[windows.firsts]
                kept, ends = kept_bytes(raw, offsets, ~gone, windows.firsts)
                text = pa.StringArray.from_buffers(n, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(kept))
                counts = [pa.array(np.diff(x)) for x in (windows.firsts, before)]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(row, n) for c in ("doc_id", "copies")] + counts + [text], ["doc_id", "copies", "n_words", "n_removed", "kept"])

    settled = joined.select("doc_id", "copies", "text", "first").mapInArrow(lean(settle), "doc_id long, copies long, n_words long, n_removed long, kept string")
    repeat = settled.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    again = (F.col("copy") > 1) & (F.col("n_words") >= size)  # all its windows also start in the copy before
    return repeat.select(
        "doc_id", "n_words", F.when(again, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(again, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )


def kept_bytes(raw: np.ndarray, offsets: np.ndarray, keep: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words to keep of a slice of texts, joined by one space, as bytes, and where each text's begin (and the end)."""
    starts, ends = word_bounds(raw, offsets) if len(raw) else (np.zeros(0, dtype=np.int64),) * 2
    of = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))[keep]
    starts, ends = starts[keep], ends[keep]
    change = np.zeros(len(raw) + 1, dtype=np.int8)
    change[starts] += 1
    change[ends] -= 1
    stay = np.cumsum(change[:-1], dtype=np.int8) > 0
    later = np.zeros(len(of), dtype=bool)
    later[1:] = of[1:] == of[:-1]
    out = raw.copy()
    out[starts[later] - 1] = 0x20  # a later word has a separator before it
    stay[starts[later] - 1] = True
    return out[stay], np.concatenate([[0], np.cumsum(stay)])[offsets]
