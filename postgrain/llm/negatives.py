"""Hard negatives of anchors: shared candidate lists of anchor clusters, walked until termination is certain.

Anchors are grouped by direction. For a cluster with centre c whose members lie within the angle r of it, a candidate x at
the angle t from c scores at most |a| |x| cos(max(0, t - r)) with a member a. The candidates of a block are sorted by that
bound once for each cluster, and every member walks the same list: strips of it are scored exactly for the members still
on their way, and a member stops when the bound of what is left is below all that it could still use.

The table is cut into blocks of candidates and packs of anchors (members of one cluster), rows of bounded size that meet in
a grid of block numbers and groups of packs; no list, anchor set or label passes through one task or the driver, and a label
of any size is no group of the work. A member's best rows of a block go on, at most k for each of its targets, so what is
shuffled is a fixed part of the scores computed. Two walks follow each other: the best rows of the anchor's label, its
positives, and then the rows of other labels in the range of scores that each positive sets. Before each a walk over the
``SEED`` rows with the smallest hashes finds a floor that k rows are sure to reach, so that walks stop early in all blocks;
it changes no result.

Rows with a null id, label or vector, or a null or non-finite component, take no part. Vectors are compared with
those of the same number of components. Components are scaled and floored; scores are exact integers up to 2^53, and doubles
clipped to 64 bits beyond. Rows that share an anchor's id are its own; of these the one with the smallest label, then vector,
is the anchor. Otherwise repeated rows are candidates of their own, so that an id can be a positive twice. Equal scores come
in the order of ids. Other columns play no part. Without anchors or candidates there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postgrain.session import stage

BLOCK_BYTES = 1 << 21  # of the vectors of a block of candidates: 4,096 of 64 components
PACK_BYTES = 1 << 19  # of a pack of anchors
GROUP = 16  # packs that meet a block at once
CLUSTERS = 32
FIT_ROWS = 4096  # anchors that the centres are fitted on
SEED = 4096
STRIP = 256
MOST = 1e150  # larger components count as this
FIELDS = {"dim": pa.int32(), "n": pa.int32(), "ids": pa.binary(), "labels": pa.binary(), "vectors": pa.binary(), "limits": pa.binary()}
PACKED = "dim int, n int, ids binary, labels binary, vectors binary, limits binary"
FOUND = "id long, target int, other long, score long"


def usable(vectors: DataFrame, is_anchor: Column, scale: int) -> DataFrame:
    """Columns id, label, vector (scaled and floored), anchor of the rows that take part."""
    given = F.col("embedding").cast("array<double>")
    bad = F.exists(given, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    inside = lambda x: F.greatest(F.least(x, F.lit(MOST)), F.lit(-MOST)) * scale
    whole = F.transform(given, lambda x: F.when(F.abs(x) < 1e12, F.floor(x * scale).cast("double")).otherwise(inside(x)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), whole.alias("vector"), bad.alias("bad"), is_anchor.alias("anchor"))
    return rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.col("bad")).drop("bad")


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one size."""
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), len(column[0]))


def by_size(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, by the size of their vectors."""
    sizes = np.array([len(v) for v in batch.column("vector")])
    for size in np.unique(sizes):
        yield batch.filter(pa.array(sizes == size))


def norms(rows: np.ndarray) -> np.ndarray:
    """Lengths of rows; scaled first, so that no square leaves the range of doubles."""
    most = np.abs(rows).max(axis=1, initial=0)
    return most * np.sqrt(((rows / np.where(most > 0, most, 1)[:, None]) ** 2).sum(axis=1))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows with norm 1, or 0 where they are 0."""
    most = np.abs(rows).max(axis=1, initial=0)[:, None]
    rows = rows / np.where(most > 0, most, 1)
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(norm > 0, norm, 1)


def centres(anchors: DataFrame, clusters: int) -> dict[int, np.ndarray]:
    """Unit vectors for each size of vectors, by spherical k-means over at most ``FIT_ROWS`` anchors."""
    fit = anchors.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("vector").toArrow()
    rows: dict[int, np.ndarray] = {}
    for batch in fit.to_batches():
        for part in by_size(batch):
            found = unit(matrix(part.column("vector")))
            rows[found.shape[1]] = np.concatenate([rows.get(found.shape[1], found[:0]), found])
    return {size: _fit(found, clusters) for size, found in rows.items()}


def _fit(rows: np.ndarray, clusters: int) -> np.ndarray:
    centre = rows[:clusters]
    for _ in range(10):
        own = (rows @ centre.T).argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, own, rows)
        lost = ~total.any(axis=1)
        total[lost] = centre[lost]
        centre = unit(total)
    return centre


def packed(rows: DataFrame, limit: int, tasks: int, middle: dict[int, np.ndarray]) -> DataFrame:
    """Rows of vectors of one size, at most ``limit`` bytes, with a dense ``number`` from 0. Written to the shared folder.

    Where ``middle`` has centres, a row holds vectors that are nearest to the same one. Columns beyond id, label and vector
    are arrays of doubles; they go into ``limits`` in their order.
    """
    more = [c for c in rows.columns if c not in ("id", "label", "vector")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[np.ndarray]] = {}

        def out(dim: int, parts: list[np.ndarray]) -> pa.RecordBatch:
            ids, labels, vectors, *limits = parts
            values = [dim, len(ids), *(np.ascontiguousarray(x).tobytes() for x in (ids, labels, vectors)), b"".join(x.tobytes() for x in limits)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, FIELDS.values())], list(FIELDS))

        for batch in batches:
            for part in by_size(batch):
                vectors = matrix(part.column("vector"))
                parts = [np.asarray(part.column("id")), np.asarray(part.column("label")), vectors, *(matrix(part.column(c)) for c in more)]
                dim = vectors.shape[1]
                size = max(1, limit // (8 * max(dim, 1)))
                own = (unit(vectors) @ middle[dim].T).argmax(axis=1) if dim in middle else np.zeros(len(vectors), dtype=np.int64)
                for cluster in np.unique(own).tolist():
                    new = [x[own == cluster] for x in parts]
                    if (dim, cluster) in held:
                        new = [np.concatenate(x) for x in zip(held[dim, cluster], new)]
                    while len(new[0]) >= size:
                        yield out(dim, [x[:size] for x in new])
                        new = [x[size:] for x in new]
                    held[dim, cluster] = new
        for (dim, _), new in held.items():
            if len(new[0]):
                yield out(dim, new)

    made = rows.repartition(tasks).mapInArrow(pack, PACKED).withColumn("at", F.monotonically_increasing_id())
    made = stage(made)
    task = F.shiftright("at", 33)
    sizes = made.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n_task"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("task", F.coalesce(F.sum("n_task").over(before), F.lit(0)).alias("before"))  # a row for each of the tasks
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("before")
    return made.join(F.broadcast(starts), task == F.col("task")).select(place.alias("number"), *FIELDS)


@dataclass
class Vectors:
    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    limits: np.ndarray  # kind (low, high, floor) x rows x targets

    @classmethod
    def of(cls, row: dict) -> Vectors:
        limits = np.frombuffer(row["limits"]).reshape(3, row["n"], -1) if row["limits"] else np.zeros((3, 0, 0))
        ids, labels = (np.frombuffer(row[c], dtype=np.int64) for c in ("ids", "labels"))
        return cls(ids, labels, np.frombuffer(row["vectors"]).reshape(row["n"], row["dim"]), limits)


def bounds(members: np.ndarray, block: np.ndarray) -> np.ndarray:
    """For each candidate what no member's score, divided by the member's norm, exceeds."""
    directions = unit(members)
    centre = unit(directions.sum(axis=0)[None, :])[0]
    radius = np.arccos(np.clip(directions @ centre, -1, 1)).max()
    away = np.arccos(np.clip(unit(block) @ centre, -1, 1))
    return norms(block) * (np.cos(np.maximum(0, away - radius)) + 1e-7)  # with room for rounding


def walk(members: Vectors, block: Vectors, same: bool, k: int) -> tuple[np.ndarray, ...]:
    """For each member and target the ``k`` best rows of the block that have its label (or another one) and low <= score <= high.

    Rows with scores below the floor can be left out. Arrays of member, target, row of the block and score.
    """
    low, high, floor = members.limits
    bound, norm = bounds(members.rows, block.rows), norms(members.rows)
    order = np.argsort(-bound, kind="stable")
    least = np.maximum(low, floor)  # what a target can still use
    best = np.full((*low.shape, k), -np.inf)
    found: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(order), STRIP):
        live = (low <= high) & ((bound[order[at]] * norm)[:, None] >= least)
        who = np.flatnonzero(live.any(axis=1))
        if not len(who):
            break
        strip = order[at : at + STRIP]
        score = np.clip(members.rows[who] @ block.rows[strip].T, -(2.0**63), 2.0**63 - 1024)
        fits = (members.labels[who][:, None] == block.labels[strip]) == same
        fits &= members.ids[who][:, None] != block.ids[strip]
        for t in range(low.shape[1]):
            good = fits & live[who, t][:, None] & (score >= least[who, t][:, None]) & (score <= high[who, t][:, None])
            some = np.flatnonzero(good.any(axis=1))
            if len(some):
                both = np.concatenate([best[who[some], t], np.where(good[some], score[some], -np.inf)], axis=1)
                best[who[some], t] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                least[who[some], t] = np.maximum(least[who[some], t], best[who[some], t].min(axis=1))
                member, column = np.nonzero(good)
                found.append((who[member], np.full(len(member), t), strip[column], score[member, column]))
    if not found:
        return tuple(np.zeros(0, dtype=kind) for kind in (np.int64, np.int64, np.int64, np.float64))
    member, target, row, score = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((block.ids[row], -score, target, member))
    member, target, row, score = (x[order] for x in (member, target, row, score))
    new = np.ones(len(member), dtype=bool)
    new[1:] = (member[1:] != member[:-1]) | (target[1:] != target[:-1])
    first = np.flatnonzero(new)
    keep = np.arange(len(member)) - np.repeat(first, np.diff(np.append(first, len(member)))) < k
    return member[keep], target[keep], row[keep], score[keep]


def search(anchors: DataFrame, blocks: DataFrame, same: bool, k: int, middle: dict[int, np.ndarray]) -> DataFrame:
    """Columns id, target, other, score, rank: for each anchor and target (from 0) the ``k`` best of all blocks.

    ``anchors`` has id, label, vector and the arrays low, high and floor with a value for each target.
    """
    per_task = len(middle) * CLUSTERS * PACK_BYTES // (8 * max([*middle, 1]))
    packs = packed(anchors.select("id", "label", "vector", "low", "high", "floor"), PACK_BYTES, -(-max(1, anchors.count()) // max(1, per_task)), middle)
    n_blocks, n_groups = blocks.count(), -(-packs.count() // GROUP)
    if not n_blocks or not n_groups:
        return anchors.sparkSession.createDataFrame([], f"{FOUND}, rank int")

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    left = blocks.withColumn("meets", each(n_groups))
    right = packs.withColumn("meets", F.floor(F.col("number") / GROUP).cast("long")).drop("number").withColumn("number", each(n_blocks))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            block = Vectors.of(row)
            for pack in right.to_pylist():
                if pack["dim"] == row["dim"]:
                    members = Vectors.of(pack)
                    member, target, at, score = walk(members, block, same, k)
                    out.append((members.ids[member], target, block.ids[at], score.astype(np.int64)))
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, dtype=np.int64)] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "target", "other", "score"])

    found = left.groupBy("number", "meets").cogroup(right.groupBy("number", "meets")).applyInArrow(cell, FOUND)
    order = Window.partitionBy("id", "target").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def floored(anchors: DataFrame, seed: DataFrame, same: bool, k: int, targets: int, middle: dict[int, np.ndarray]) -> DataFrame:
    """``anchors`` with the score that k rows of the seed reach as ``floor`` of each target."""
    none = F.array_repeat(F.lit(float("-inf")), targets)
    found = search(anchors.withColumn("floor", none), seed, same, k, middle).filter(F.col("rank") == k)
    of = found.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("target", F.col("score").cast("double")))).alias("reached"))  # a row for each target
    reached = F.transform(F.sequence(F.lit(0), F.lit(targets - 1)), lambda t: F.coalesce(F.get(F.map_values(F.map_filter("reached", lambda x, _: x == t)), F.lit(0)), F.lit(float("-inf"))))
    return stage(anchors.join(of, "id", "left").withColumn("floor", F.when(F.col("reached").isNull(), none).otherwise(reached)).drop("reached"))


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256
) -> DataFrame:
    """Columns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each anchor its first ``positives`` rows of the same label, and for each of these the first ``negatives`` rows of other
    labels with low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    rows = stage(usable(vectors, is_anchor, scale))
    anchors = rows.filter("anchor").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("of")).select("id", "of.*")
    anchors = stage(anchors)
    middle = centres(anchors, CLUSTERS)
    widest = max([*middle, 1])
    plain = rows.select("id", "label", "vector")
    tasks = -(-max(1, rows.count()) * 8 * widest // (4 * BLOCK_BYTES))
    blocks = stage(packed(plain, BLOCK_BYTES, tasks, {}))
    seed = stage(packed(plain.orderBy(F.xxhash64("id"), "id").limit(SEED), BLOCK_BYTES, 1, {}))

    ends = [F.array(F.lit(x)).alias(c) for c, x in (("low", float("-inf")), ("high", float("inf")))]
    asked = floored(anchors.select("*", *ends), seed, True, positives, 1, middle)
    found = stage(search(asked, blocks, True, positives, middle))

    def range_of(percent: int, edge) -> Column:
        return edge(F.col("score").cast("decimal(20,0)") * percent / 100).cast("double")

    sides = found.select("id", "rank", F.struct(range_of(low, F.ceil).alias("low"), range_of(high, F.floor).alias("high")).alias("side"))
    listed = sides.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "side"))), lambda x: x["side"]).alias("sides"))  # at most `positives`
    absent = F.array_repeat(F.struct(F.lit(1.0).alias("low"), F.lit(0.0).alias("high")), positives)
    filled = F.slice(F.concat("sides", absent), 1, positives)
    ranged = anchors.join(listed.select("id", filled.alias("sides")), "id").select("id", "label", "vector", F.col("sides.low").alias("low"), F.col("sides.high").alias("high"))
    asked = floored(stage(ranged), seed, False, negatives, positives, middle)
    against = search(asked, blocks, False, negatives, middle)
    of = found.select(F.col("id").alias("anchor_id"), (F.col("rank") - 1).alias("place"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    joined = against.join(of, (F.col("id") == F.col("anchor_id")) & (F.col("target") == F.col("place")))
    return joined.select("anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
