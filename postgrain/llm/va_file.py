"""Exact top-k inner products by vector approximation files.

Vectors are stored in blocks of integers with an approximation beside them: each dimension of a block is cut into at most
64 cells of equal width, and a vector's code is the cell of each component. From codes alone follow a lower and an upper
bound of every score. A first scan over the codes finds, for each query, a score that k vectors are sure to reach; a
second one visits the exact vectors of those whose upper bound is not below it, best bound first, until the bound of the
next cannot change the k best. Both scans keep k entries per query and task; only those are shuffled.

Queries go in waves of about ``wave`` rows, so that what is broadcast has a fixed size; each wave scans all blocks, is
written out and gives its broadcasts back before the next begins. A task bounds a strip of ``STRIP`` queries against a block
at a time, so that its memory depends on neither the wave nor the table.

Vectors that are null, or hold null or non-finite components, take no part; an empty table has an empty result. Vectors are
compared with those of the same number of components. Rows that share a query's id are the query's own; of several such rows
the smallest vector that takes part asks. Otherwise repeated rows are separate candidates, with the smaller id first at equal
scores. Scores beyond 64 bits count as the ends of that range. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postgrain.session import stage

CELLS = 64
BLOCK = 4096
STRIP = 256  # queries whose bounds with a block are held at once: 8 MB a matrix
SAFE = 1 << 53
ENDS = float(1 << 63)  # scores are clipped to 64 bits
BLOCK_SCHEMA = "dim int, n int, ids binary, codes binary, lows binary, widths binary, exact binary"


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 x) of double components; Python integers where 64 bits could not hold the products."""
    scaled = np.floor(1024.0 * vectors.astype(np.float64))
    if not scaled.size or np.abs(scaled).max() ** 2 * max(scaled.shape[1], 1) < SAFE:
        return scaled.astype(np.int64)
    return np.array([[int(x) for x in row] for row in scaled], dtype=object)


def usable(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ids and vectors of a batch that take part, by number of components."""
    ids, vectors = batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist()
    by_size: dict[int, list[int]] = {}
    for k, (i, v) in enumerate(zip(ids, vectors)):
        if i is not None and v is not None and None not in v:
            by_size.setdefault(len(v), []).append(k)
    for size, rows in by_size.items():
        block = np.array([vectors[k] for k in rows], dtype=np.float64).reshape(len(rows), size)
        good = np.isfinite(block).all(axis=1)
        yield np.array([ids[k] for k in rows], dtype=np.int64)[good], block[good]


def build(vectors: DataFrame) -> DataFrame:
    """The approximation file of a table (vec_id, embedding), written to the shared folder."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ids, block in usable(batch):
                for at in range(0, len(ids), BLOCK):
                    part = block[at : at + BLOCK]
                    exact = integers(part)
                    floats = exact.astype(np.float64)
                    low = floats.min(axis=0)
                    width = np.maximum(1.0, np.ceil((floats.max(axis=0) - low + 1) / CELLS))
                    codes = np.floor((floats - low) / width).astype(np.uint8)
                    exact = exact.tobytes() if exact.dtype != object else part.tobytes()
                    kind = part.shape[1] if integers(part).dtype != object else -part.shape[1]
                    rows.append((kind, len(part), ids[at : at + BLOCK].tobytes(), codes.tobytes(), low.tobytes(), width.tobytes(), exact))
            columns = list(zip(*rows)) if rows else [[]] * 7
            types = [pa.int32(), pa.int32()] + [pa.binary()] * 5
            names = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return stage(vectors.select("vec_id", "embedding").mapInArrow(pack, BLOCK_SCHEMA))


class Block:
    """One row of the file; a negative dim marks exact parts kept as doubles, since their integers exceed 64 bits."""

    def __init__(self, row: dict) -> None:
        self.dim, self.n = abs(row["dim"]), row["n"]
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        codes = np.frombuffer(row["codes"], dtype=np.uint8).reshape(self.n, self.dim)
        self.width = np.frombuffer(row["widths"], dtype=np.float64)
        self.corner = np.frombuffer(row["lows"], dtype=np.float64) + codes * self.width
        if row.get("exact") is not None:
            kind = np.int64 if row["dim"] >= 0 else np.float64
            exact = np.frombuffer(row["exact"], dtype=kind).reshape(self.n, self.dim)
            self.exact = exact if row["dim"] >= 0 else integers(exact)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all scores (queries x vectors), widened by the rounding of doubles."""
        base = queries @ self.corner.T
        room = self.width - 1
        slack = 1e-12 * (np.abs(queries) @ (np.abs(self.corner) + self.width).T)
        low = base + (np.minimum(queries, 0) @ room)[:, None] - slack
        high = base + (np.maximum(queries, 0) @ room)[:, None] + slack
        return np.clip(low, -ENDS, ENDS), np.clip(high, -ENDS, ENDS)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for row in batch.to_pylist():
            yield Block(row)


def strips(queries: np.ndarray) -> Iterator[slice]:
    for at in range(0, len(queries), STRIP):
        yield slice(at, at + STRIP)


def top_k(vectors: DataFrame, is_query: Column, k: int, wave: int = 4096) -> DataFrame:
    """Columns query_id, rank (from 1), vec_id, score: for each query row the k best other vectors (all, if fewer)."""
    file = build(vectors)
    x = F.col("embedding")
    takes_part = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    asked = vectors.filter(is_query & F.col("vec_id").isNotNull() & takes_part).groupBy("vec_id").agg(F.min(x).alias("embedding"))
    asked = stage(asked)
    waves = max(1, -(-asked.count() // wave))
    if waves > 1:  # a folder a wave
        asked = stage(asked.withColumn("wave", F.pmod(F.xxhash64("vec_id"), F.lit(waves))), ["wave"])
    found = [_wave(file, asked.filter(F.col("wave") == w) if waves > 1 else asked, k) for w in range(waves)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _wave(file: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    spark = asked.sparkSession
    queries: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    table = asked.select("vec_id", "embedding").toArrow()  # a wave: bounded
    for batch in table.to_batches():
        for ids, block in usable(batch):
            before = queries.get(block.shape[1])
            if before:
                ids, block = np.concatenate([before[0], ids]), np.concatenate([before[1], block])
            queries[block.shape[1]] = ids, block
    sent = spark.sparkContext.broadcast(queries)

    def sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        for b in blocks(batches):
            if b.dim not in sent.value:
                continue
            ids, vectors = sent.value[b.dim]
            kept = best.setdefault(b.dim, np.full((len(ids), k), -np.inf))
            for part in strips(ids):
                low, _ = b.bounds(integers(vectors[part]).astype(np.float64))
                low[ids[part, None] == b.ids[None, :]] = -np.inf
                both = np.concatenate([kept[part], low], axis=1)
                kept[part] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        for dim, bound in best.items():
            query = np.repeat(sent.value[dim][0], k)
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(bound.ravel())], ["query_id", "bound"])

    bounds = file.drop("exact").mapInArrow(sure, "query_id long, bound double")
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"))
    least = bounds.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).groupBy("query_id").agg(F.min("bound").alias("bound"))
    reach = spark.sparkContext.broadcast({r.query_id: r.bound for r in least.toLocalIterator()})  # a number per query of the wave

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, int]]] = {}
        for b in blocks(batches):
            if b.dim not in sent.value:
                continue
            ids, vectors = sent.value[b.dim]
            for part in strips(ids):
                exact = integers(vectors[part])
                _, high = b.bounds(exact.astype(np.float64))
                for query, own, row in zip(ids[part].tolist(), exact, high):
                    best[query] = visited(b, query, own, row, best.get(query, []))
        rows = [(q, i, -s) for q, kept in best.items() for s, i in kept]
        columns = list(zip(*rows)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    def visited(b: Block, query: int, own: np.ndarray, high: np.ndarray, kept: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The k best (-score, vec_id) of ``kept`` and a block, whose exact vectors are read by falling bound."""
        near = np.flatnonzero((high >= reach.value.get(query, -np.inf)) & (b.ids != query))
        near = near[np.argsort(-high[near], kind="stable")]
        for at in range(0, len(near), 64):
            part = near[at : at + 64]
            if len(kept) == k and high[part[0]] < -kept[-1][0]:
                break
            scores = [max(-(1 << 63), min((1 << 63) - 1, s)) for s in (b.exact[part] @ own).tolist()]
            kept = sorted([*kept, *((-s, i) for s, i in zip(scores, b.ids[part].tolist()))])[:k]
        return kept

    scored = file.mapInArrow(refine, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    written = stage(ranked.select("query_id", "rank", "vec_id", "score"))
    sent.unpersist()
    reach.unpersist()
    return written
