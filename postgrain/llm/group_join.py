"""Similarity join of documents on n-word shingles by grouped prefixes, and the components of its links.

Two documents link when the Jaccard similarity of their shingle sets is at least ``percent`` / 100. The join is exact:

1. Documents with equal sets are one node.
2. A node survives when enough of its smallest shingle hashes occur in other nodes. (Linked sets share at least
   ``needed`` of the first ``reach`` hashes of each, so no link is lost.) Repeats within a task are settled there, so
   that a shingle of very many documents is sent about once a task.
3. Shingles of survivors are ordered by frequency, then hash. Nodes with the same size and prefix in that order form one
   group. Groups meet in the lists of their prefix shingles; pairs pass the size and the position filter, are expanded to
   their members and verified against the whole sets.
4. Components only need connecting links. First each group meets the most central group of each list; then all pairs are
   joined that share a list but not a component so far. Pairs within a component add nothing, so that large groups of near
   copies never form all pairs, while no link between components is left out.

Nulls and texts without words have empty sets and link with nothing; with fewer words than ``n`` the whole sequence is one
shingle. Repeated rows and equal texts under several ids are in one component. A null doc_id never becomes a component's
id unless the component has no other. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postgrain.llm.hashing import shingle_sets, text_digest
from postgrain.llm.workers import mapped
from postgrain.session import stage

REACH = 0.35  # part of a set's smallest hashes that is compared in step 2
BLOCK_TOKENS = 1 << 21  # hashes that a task gathers before it settles repeats among them
SEEN_BITS = 1 << 25  # of the survivors' filter that is broadcast: 4 MB, whatever the input


def overlap_tail(n: int, percent: int) -> int:
    """How many shingles of a set of ``n`` a linked set can lack."""
    return n - -(-n * percent // 100)


def reach(n: int, percent: int) -> tuple[int, int]:
    """How many of the smallest hashes of a set of ``n`` are compared, and how many of them a linked set must have too.

    With t = percent / 100 a linked set of m shingles, t n <= m <= n / t, shares o >= t (n + m) / (1 + t). Its j-th common
    hash is among the first j + n - o of the one set and the first j + m - o of the other.
    """
    t = percent / 100
    first = min(n, max(overlap_tail(n, percent) + 1, int(np.ceil(REACH * n))))
    of_other = t / (1 + t) - (1 - REACH - t / (1 + t)) / t
    return first, max(1, min(first - overlap_tail(n, percent), int(np.ceil(of_other * n - 1e-9))))


def node_of(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def document_sets(docs: DataFrame, n: int, keep: list[str]) -> DataFrame:
    """Columns ``keep``, n_shingles and set (a digest of the shingle set; null when it is empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, digest = [], []
            for found in shingle_sets(batch.column("text"), n):
                size.append(len(found))
                digest.append(text_digest(found) if len(found) else None)
            columns = [*(batch.column(c) for c in keep), pa.array(size, pa.int64()), pa.array(digest, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "n_shingles", "set"])

    schema = docs.select(*keep).schema.add("n_shingles", "long").add("set", "binary")
    return mapped(docs.select(*keep, "text"), run, schema)


def settle(tokens: list[np.ndarray], nodes: list[int], needed: list[int], task: int) -> pa.RecordBatch:
    """Rows (hash, node, info) of a block of sets, with what they know of each other already settled.

    A hash of several nodes of the block is one row without node. A hash of one node asks (info: task and how many answers
    the node still needs), or only tells, where the node needs no answer (info -1). A node that needs none is a row too.
    """
    hashes, owner = np.concatenate(tokens), np.repeat(np.arange(len(nodes)), [len(x) for x in tokens])
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    last = np.concatenate([new[1:], [True]])
    alone, several = new & last, new & ~last
    ids = np.array(nodes, dtype=np.int64)
    need = np.array(needed) - np.bincount(owner[~alone], minlength=len(nodes))
    info = np.where(need > 0, (np.int64(task) << 32) + need, -1)
    done = ids[need <= 0]
    rows = [
        (hashes[alone].view(np.int64), ids[owner[alone]], info[owner[alone]]),
        (hashes[several].view(np.int64), None, 0),
        (done, done, np.int64(task) << 32),  # with the next row a hash of several nodes, which is one answer
        (done, None, 0),
    ]
    hash_ = np.concatenate([h for h, _, _ in rows])
    node = pa.concat_arrays([pa.nulls(len(h), pa.int64()) if x is None else pa.array(x) for h, x, _ in rows])
    more = np.concatenate([np.broadcast_to(np.asarray(i, dtype=np.int64), len(h)) for h, _, i in rows])
    return pa.RecordBatch.from_arrays([pa.array(hash_), node, pa.array(more)], ["hash", "node", "info"])


def surviving_nodes(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Column node: sets that may have a partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen: set[int] = set()
        tokens, nodes, needed, held = [], [], [], 0
        for batch in batches:
            for found in shingle_sets(batch.column("text"), n):
                node = node_of(text_digest(found)) if len(found) else None
                if node is None or node in seen:
                    continue
                seen.add(node)
                first, need = reach(len(found), percent)
                tokens.append(found[:first].copy())
                nodes.append(node)
                needed.append(need)
                held += first
                if held >= BLOCK_TOKENS:
                    yield settle(tokens, nodes, needed, task)
                    tokens, nodes, needed, held = [], [], [], 0
        if nodes:
            yield settle(tokens, nodes, needed, task)

    rows = mapped(docs.select("text"), run, "hash long, node long, info long")
    same = Window.partitionBy("hash")  # a node once a task, several nodes of a block once a block
    several = (F.min("node").over(same) != F.max("node").over(same)) | (F.count(F.lit(1)).over(same) > F.count("node").over(same))
    answered = rows.withColumn("several", several).filter(F.col("several") & F.col("node").isNotNull() & (F.col("info") >= 0))
    enough = answered.groupBy("node", "info").agg(F.count(F.lit(1)).alias("found"))
    return enough.filter(F.col("found") >= F.col("info") % (1 << 32)).select("node").distinct()


def survivor_sets(docs: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """Columns node, n, shingles of the nodes of ``chosen`` (node, doc_id): whole sets, one row a node.

    A bitmap of fixed size over the chosen ids keeps other documents' sets from being made and shuffled. As it fills up,
    it lets more of them pass; the join that follows drops them.
    """
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(SEEN_BITS)) + 1
    maps = chosen.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
    maps = maps.agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map")).toArrow().to_pylist()  # SEEN_BITS
    width = 8 * 4096
    seen = np.zeros(SEEN_BITS // 8 + 4096, dtype=np.uint8)
    for row in maps:
        at = (row["bucket"] - 1) * width // 8
        seen[at : at + 4096] = np.frombuffer(row["map"], dtype=np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(seen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column("bit").to_numpy().astype(np.int64) - 1
            # Buckets count from 1, hold the values from 1 on, and bit p of a bucket's bytes stands for its p-th value.
            rows = np.flatnonzero(sent.value[bits >> 3] >> (bits & 7).astype(np.uint8) & 1)
            size, node, data = [], [], []
            for found in shingle_sets(batch.column("text").take(pa.array(rows)), n):
                if len(found):
                    size.append(len(found))
                    node.append(node_of(text_digest(found)))
                    data.append(found.tobytes())
            columns = [pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "n", "shingles"])

    made = mapped(docs.select(bit.alias("bit"), "text"), run, "node long, n long, shingles binary")
    kept = made.join(chosen.select("node"), "node", "left_semi")
    return kept.groupBy("node").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))


def prefix_lists(sets: DataFrame, percent: int) -> DataFrame:
    """Columns hash, node, n, rare, at: each node's prefix shingles that other nodes have, with their place in its order.

    ``rare`` counts the shingles that no other node has; they come first in the order and need no list.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, n, data in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "shingles"))):
                hashes = np.frombuffer(data, dtype=np.int64)
                columns = [pa.array(hashes), pa.array(np.full(n, node)), pa.array(np.full(n, n))]
                yield pa.RecordBatch.from_arrays(columns, ["hash", "node", "n"])

    tokens = mapped(sets, explode, "hash long, node long, n long")
    often = tokens.groupBy("hash").agg(F.count(F.lit(1)).alias("often")).filter(F.col("often") > 1)
    shared = tokens.join(often, "hash").groupBy("node", "n")
    ordered = shared.agg(F.sort_array(F.collect_list(F.struct("often", "hash"))).alias("common"))  # a node's own shingles
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    ordered = ordered.withColumn("rare", F.col("n") - F.size("common")).withColumn("take", (length - F.col("rare")).cast("int"))
    prefix = ordered.filter(F.col("take") > 0).withColumn("prefix", F.slice("common.hash", 1, F.col("take")))
    return prefix.select("node", "n", "rare", "prefix")


def groups(prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (group, n, rare, prefix) of nodes with the same size and prefix, and their members (node, group).

    Nodes with shingles of their own in the prefix share it with no other node.
    """
    own = F.when(F.col("rare") > 0, F.col("node"))
    keyed = prefixes.withColumn("own", own).withColumn("same", F.xxhash64("prefix"))
    made = keyed.groupBy("n", "rare", "own", "same").agg(F.min("node").alias("group"), F.first("prefix").alias("prefix"))
    made = made.select("group", "n", "rare", "prefix")
    leaders = keyed.groupBy("n", "rare", "own", "same").agg(F.min("node").alias("group")).filter("own is null")
    matching = ["n", "rare", "same"]
    grouped = keyed.filter("own is null").join(leaders.drop("own"), matching).select("node", "group")
    return made, keyed.filter("own is not null").select("node", F.col("node").alias("group")).unionByName(grouped)


def near_enough(a: str, b: str, percent: int):
    """Size and position filter for two entries of one list."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    least = F.ceil((n + m) * percent / (100 + percent))
    rest = F.least(n - F.col(f"{a}.at"), m - F.col(f"{b}.at"))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (rest >= least)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that link, by their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(k)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return mapped(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y"), run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """Columns node, component (the smallest node) for the nodes of edges (a, b), by alternating large and small stars."""
    edges = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        large = stage(large)
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b")
        edges = stage(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if tuple(state) == before:
            break
        before = tuple(state)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def connected(sets: DataFrame, percent: int) -> DataFrame:
    """Columns node, component of all nodes that link with another."""
    prefixes = stage(prefix_lists(sets, percent))
    made, members = groups(prefixes)
    made, members = stage(made), stage(members)
    lists = made.select("group", "n", "rare", F.posexplode("prefix").alias("at", "hash"))
    lists = lists.withColumn("at", F.col("at") + F.col("rare"))

    central = F.struct((F.col("rare") / F.col("n")).alias("part"), "group", "n", "at")
    pivots = lists.groupBy("hash").agg(F.min(central).alias("pivot"), F.count(F.lit(1)).alias("entries")).filter("entries > 1")
    pivots = pivots.select("hash", "pivot.*")
    met = lists.alias("l").join(pivots.alias("p"), "hash").filter((F.col("l.group") != F.col("p.group")) & near_enough("l", "p", percent))
    met = met.select(F.col("l.group").alias("g"), F.col("p.group").alias("b")).distinct()
    stars = met.join(members.select(F.col("group").alias("g"), F.col("node").alias("a")), "g").select("a", "b")
    inside = members.filter("node <> group").select(F.col("node").alias("a"), F.col("group").alias("b"))
    pairs = stage(stars.unionByName(inside))
    edges = stage(verified(pairs, sets, percent))
    linked = stage(components(edges))

    # What remains: lists with groups of several components. A group's members may be in several, so members go in.
    labelled = members.join(linked, "node", "left").select("group", "node", F.coalesce("component", "node").alias("component"))
    labelled = stage(labelled)
    entries = lists.join(labelled, "group").select("hash", "node", "n", "at", "component")
    open_ = entries.groupBy("hash").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("hash")
    entries = stage(entries.join(open_, "hash"))
    across = entries.alias("l").join(entries.alias("r"), "hash").filter(
        (F.col("l.component") < F.col("r.component")) & near_enough("l", "r", percent)
    )
    rest = across.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()
    rest = rest.join(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    more = stage(verified(stage(rest), sets, percent))
    return linked if more.isEmpty() else components(edges.unionByName(more))


def link_documents(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """Columns doc_id, n_shingles, component_id (the smallest doc_id that links reach), n_copies (documents of equal set)."""
    out = link_rows(docs, n, percent, [])
    component_id = F.coalesce("lowest.doc_id", "doc_id").alias("component_id")
    return out.select("doc_id", "n_shingles", component_id, F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def link_rows(docs: DataFrame, n: int, percent: int, then: list[str]) -> DataFrame:
    """Columns doc_id, ``then``, n_shingles, n_copies and lowest, a row for each of ``docs``.

    ``lowest`` has doc_id and ``then`` of the first row of the component in their order, a null doc_id last; it is null
    where the set is empty.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent is 50 to 100")
    found = stage(document_sets(docs, n, ["doc_id", *then]))
    same = found.filter(F.col("set").isNotNull()).groupBy("set")
    first = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", *then) if then else F.col("doc_id")
    made = same.agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n_copies")).withColumn("node", node_column("set"))
    distinct = stage(made)
    alive = surviving_nodes(docs, n, percent)
    first_id = F.col("first.doc_id" if then else "first").alias("doc_id")
    chosen = stage(distinct.select("node", first_id).join(alive, "node", "left_semi"))
    sets = stage(survivor_sets(docs, chosen, n))
    linked = distinct.join(connected(sets, percent), "node", "left").withColumn("component", F.coalesce("component", "node"))
    linked = stage(linked.select("set", "first", "n_copies", "component"))
    lowest = linked.groupBy("component").agg(F.min("first").alias("lowest"))
    by_set = linked.join(lowest, "component").select(F.col("set").alias("of"), "lowest", "n_copies")
    if not then:
        by_set = by_set.withColumn("lowest", F.struct(F.col("lowest").alias("doc_id")))
    out = found.join(by_set, F.col("set") == F.col("of"), "left")
    return out.select("doc_id", *then, "n_shingles", "n_copies", "lowest")


def node_column(column: str):
    """``node_of`` of a binary column: its first eight bytes, the lowest first, as a signed number."""
    parts = F.concat(*(F.substring(F.hex(F.col(column)), 2 * k + 1, 2) for k in range(7, -1, -1)))
    high, low = F.conv(F.substring(parts, 1, 8), 16, 10).cast("long"), F.conv(F.substring(parts, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)
