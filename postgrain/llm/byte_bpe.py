"""Byte-level BPE encoding and decoding with a queue of merge ranks under a hierarchical bitmap.

Every adjacent pair of parts that the vocabulary can merge waits in the bucket of its rank, as the linked-list position of
its left part. Bitmaps of two levels say which buckets have entries: find-first-set on each level gives the lowest rank
in a constant number of steps, however long the pre-token. A merge leaves entries of its neighbours behind; such stale
entries no longer agree with the list and are skipped. A pre-token of n bytes takes O(n log n) time at worst (a bucket is
a heap, so that equal ranks merge from the left), where rescanning after each merge would take O(n^2).

The new pre-tokens of a slice of texts share one queue, with a part that merges with nothing between them: a bucket is
found once for all its entries, of which those of a wide one are merged as arrays, and a pair is looked up by the ids of its
parts. A bucket is left as soon as a merge makes a pair of lower rank, so that each pre-token sees its merges in the order
that it would see alone.

Nulls and empty texts have no ids. Texts are never cut. Rows are independent of each other; other columns play no part.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from postgrain.llm.hashing import pieces
from postgrain.llm.workers import mapped, per_worker

CACHED_BYTES = 48 << 20  # about, in each half of a worker's cache; a full half becomes the older one
ENTRY_BYTES = 140  # of a cached pre-token besides its characters and ids
CACHED_LENGTH = 64
TOGETHER = 1 << 17  # bytes of pre-tokens in one queue, about
WIDE = 64  # entries of a bucket that are merged as arrays, where all pre-tokens are of at most SHORT bytes
SHORT = 256


class ByteBpe:
    """A vocabulary of byte strings by rank, with the pattern that splits texts into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            self.bytes[rank] = piece
        self.split = regex.compile(pattern).findall
        self.shift = max(1, (len(self.bytes).bit_length() + 1) // 2)  # bits of a rank that one bitmap level covers
        self.buckets: list[list[int]] = [[] for _ in self.bytes]
        self.low = [0] * ((len(self.bytes) >> self.shift) + 1)  # all buckets and bitmaps are empty between queues
        self.bit = [1 << k for k in range(max(1 << self.shift, len(self.low)))]
        self.pair_up()
        self.cache: dict[str, bytes] = {}  # ids as 32-bit integers
        self.older: dict[str, bytes] = {}
        self.room = CACHED_BYTES

    def pair_up(self) -> None:
        """The rank of every pair of parts: ``after[a][b]`` and ``ahead[b][a]``. Parts are ids; a byte that is no piece of the
        vocabulary has one beyond its ids, and the last stands for the part between pre-tokens."""
        part = self.ranks | {x: len(self.bytes) + x[0] for x in map(bytes, zip(range(256))) if x not in self.ranks}
        self.stop = len(self.bytes) + 256
        none: dict[int, int] = {}
        self.after, self.ahead = [none] * (self.stop + 1), [none] * (self.stop + 1)
        self.byte_part = np.array([*(part[bytes([k])] for k in range(256)), self.stop], dtype=np.int32)
        self.byte_pair = np.full((257, 257), -1, dtype=np.int32)
        for piece, rank in self.ranks.items():
            for k in range(1, len(piece)):
                a, b = part.get(piece[:k]), part.get(piece[k:])
                if a is not None and b is not None:
                    for table, x, y in ((self.after, a, b), (self.ahead, b, a)):
                        if table[x] is none:
                            table[x] = {}
                        table[x][y] = rank
            if len(piece) == 2:
                self.byte_pair[piece[0], piece[1]] = rank

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}, pattern)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, as 32-bit integers."""
        lengths = np.array([len(x) for x in pieces], dtype=np.int64)
        stops = np.concatenate(([0], np.cumsum(lengths + 1)))  # a part between pre-tokens, and one at both ends
        n = int(stops[-1]) + 1
        raw = np.full(n, 256, dtype=np.int64)
        inner = np.ones(n, dtype=bool)
        inner[stops] = False
        raw[inner] = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        pair = np.append(self.byte_pair[raw[:-1], raw[1:]], -1)
        owner = np.cumsum(~inner)
        all_parts = self.byte_part[raw]
        all_end = np.arange(1, n + 1)  # where the part at each position ends; the next part begins there
        all_before = np.arange(-1, n)  # where the previous part begins
        all_waiting = pair.copy()  # the rank at which each part would merge with the next; other entries are stale
        parts, end, before, waiting = map(memoryview, (all_parts, all_end, all_before, all_waiting))
        wide = WIDE if lengths.max(initial=0) <= SHORT else n
        buckets, low, bit, shift = self.buckets, self.low, self.bit, self.shift
        mask, top = (1 << shift) - 1, 0
        at = np.flatnonzero(pair >= 0)
        at = at[np.argsort(pair[at], kind="stable")]
        found, first = np.unique(pair[at], return_index=True)
        at, first = at.tolist(), [*first.tolist(), len(at)]
        for k, rank in enumerate(found.tolist()):
            buckets[rank] = at[first[k] : first[k + 1]]  # positions rise, so that the bucket is a heap
            top |= bit[rank >> shift]
            low[rank >> shift] |= bit[rank & mask]
        while top:
            word = (top & -top).bit_length() - 1
            bits = low[word]
            rank = word << shift | (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            after, ahead = self.after[rank].get, self.ahead[rank].get
            lowest = rank
            if len(bucket) >= wide:  # the first entry of each pre-token
                at = np.array(bucket)
                at = np.sort(at[all_waiting[at] == rank])
                first = np.diff(owner[at], prepend=0) > 0
                buckets[rank] = bucket = at[~first].tolist()
                at = at[first]
                gone = all_end[at]
                last = all_end[gone]
                left = all_before[at]
                all_end[at], all_before[last] = last, at
                all_parts[at], all_parts[gone] = rank, -1
                all_waiting[gone] = -1
                right_ranks = [after(x, -1) for x in all_parts[last].tolist()]
                left_ranks = [ahead(x, -1) for x in all_parts[left].tolist()]
                all_waiting[at], all_waiting[left] = right_ranks, left_ranks
                for new, i in zip(right_ranks + left_ranks, at.tolist() + left.tolist()):
                    if new >= 0:
                        if not buckets[new]:
                            top |= bit[new >> shift]
                            low[new >> shift] |= bit[new & mask]
                        heappush(buckets[new], i)
                        if new < lowest:
                            lowest = new
            while bucket and lowest == rank:
                i = heappop(bucket)
                if waiting[i] != rank:
                    continue
                gone = end[i]
                end[i] = last = end[gone]
                before[last] = i
                parts[i], parts[gone] = rank, -1
                waiting[gone] = -1
                waiting[i] = new = after(parts[last], -1)
                if new >= 0:
                    if not buckets[new]:
                        top |= bit[new >> shift]
                        low[new >> shift] |= bit[new & mask]
                    heappush(buckets[new], i)
                    if new < lowest:
                        lowest = new
                left = before[i]
                waiting[left] = new = ahead(parts[left], -1)
                if new >= 0:
                    if not buckets[new]:
                        top |= bit[new >> shift]
                        low[new >> shift] |= bit[new & mask]
                    heappush(buckets[new], left)
                    if new < lowest:
                        lowest = new
            if not bucket:
                low[word] &= ~bit[rank & mask]
                if not low[word]:
                    top &= ~bit[word]
        kept = (all_parts >= 0) & inner
        ids_before = np.cumsum(kept)[stops]
        ids = all_parts[kept]
        if len(ids) and ids.max() >= len(self.bytes):
            raise KeyError(f"byte {int(ids.max()) - len(self.bytes)} is not in the vocabulary")
        ends = (4 * ids_before).tolist()
        packed = ids.tobytes()
        return [packed[a:b] for a, b in zip(ends, ends[1:])]

    def find(self, texts: Iterable[str]) -> dict[str, bytes]:
        """Ids of distinct pre-tokens, which are kept in the cache."""
        found, new, todo, raws, size = {}, {}, [], [], 0
        cached, older, rank_of = self.cache.get, self.older.get, self.ranks.get
        for text in texts:
            if ids := cached(text):
                found[text] = ids
            elif ids := older(text):
                new[text] = ids
            elif (whole := rank_of(raw := text.encode())) is not None:
                new[text] = whole.to_bytes(4, sys.byteorder)
            else:
                todo.append(text)
                raws.append(raw)
                size += len(raw)
                if size >= TOGETHER:
                    new.update(zip(todo, self.merge(raws)))
                    todo, raws, size = [], [], 0
        if todo:
            new.update(zip(todo, self.merge(raws)))
        self.remember(new)
        found.update(new)
        return found

    def remember(self, new: dict[str, bytes]) -> None:
        for text, ids in new.items():
            if len(text) <= CACHED_LENGTH:
                if self.room <= 0:
                    self.cache, self.older, self.room = {}, self.cache, CACHED_BYTES
                self.cache[text] = ids
                self.room -= ENTRY_BYTES + len(text) + len(ids)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text of a slice, as 32-bit integers. Each distinct pre-token of the slice is looked up once."""
        split = [self.split(text) if text else [] for text in texts]
        ids_of = self.find(set(chain.from_iterable(split))).__getitem__
        return [b"".join(map(ids_of, parts)) for parts in split]

    def encode(self, text: str | None) -> list[int]:
        return unpacked(self.encode_all([text])[0])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def unpacked(ids: bytes) -> list[int]:
    return memoryview(ids).cast("i").tolist()


def id_lists(encoded: list[bytes]) -> pa.ListArray:
    offsets = np.cumsum([0, *(len(x) // 4 for x in encoded)], dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(encoded), dtype=np.int32)))


def loaded(path: str, pattern: str) -> ByteBpe:
    """One vocabulary per Python worker, kept with its cache for the worker's later tasks."""
    return per_worker(("byte_bpe", path, pattern), lambda: ByteBpe.load(path, pattern))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches by bytes of text, not rows: the pre-tokens of a slice, as Python strings, take some ten times the room of its text."""
    for batch in batches:
        yield from pieces(batch, "__text")


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` with the array ``ids``. ``path`` is the rank file, which every executor has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in slices(batches):
            ids = id_lists(bpe.encode_all(batch.column("__text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [ids], [*keep, "ids"])

    made = docs.select(*keep, F.col(text).alias("__text"))
    return mapped(made, run, docs.select(*keep).schema.add("ids", ArrayType(IntegerType())), "byte_bpe")


def decode(encoded: DataFrame, path: str, pattern: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with the binary ``decoded``; null ids have no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in batches:
            out = pa.array([bpe.decode(x.as_py() or []) for x in batch.column("__ids")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [out], [*keep, "decoded"])

    made = encoded.select(*keep, F.col("ids").alias("__ids"))
    return mapped(made, run, encoded.select(*keep).schema.add("decoded", "binary"), "byte_bpe")


def encode_and_check(docs: DataFrame, path: str, pattern: str, keep: list[str], text: str = "text") -> DataFrame:
    """Encode and decode in one pass: columns ``keep``, n_tokens, the array ids, and the SHA-256 of the decoded bytes."""
    schema = docs.select(*keep).schema.add("n_tokens", "long").add("ids", ArrayType(IntegerType())).add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        bpe = loaded(path, pattern)
        for batch in slices(batches):
            encoded = bpe.encode_all(batch.column("__text").to_pylist())
            made = [
                pa.array([len(x) // 4 for x in encoded], pa.int64()),
                id_lists(encoded),
                pa.array([sha256(bpe.decode(unpacked(x))).hexdigest() for x in encoded], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + made, schema.names)

    return mapped(docs.select(*keep, F.col(text).alias("__text")), run, schema, "byte_bpe")


def round_trip(docs: DataFrame, path: str, pattern: str, keep: list[str], text: str = "text") -> DataFrame:
    """Encode and decode in one pass: columns ``keep``, n_tokens, and the SHA-256 of the ids and of the decoded bytes."""
    schema = docs.select(*keep).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        bpe = loaded(path, pattern)
        decimal = [str(k) for k in range(len(bpe.bytes))].__getitem__
        for batch in slices(batches):
            count, ids_sha, text_sha = [], [], []
            for encoded in bpe.encode_all(batch.column("__text").to_pylist()):
                ids = unpacked(encoded)
                count.append(len(ids))
                ids_sha.append(sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
                text_sha.append(sha256(bpe.decode(ids)).hexdigest())
            made = [pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + made, schema.names)

    return mapped(docs.select(*keep, F.col(text).alias("__text")), run, schema, "byte_bpe")
