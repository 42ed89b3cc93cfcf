"""SimHash fingerprints of whole texts and the search for fingerprints within a Hamming radius.

Terms are the pairs of neighbouring words (the single word, where there is only one), each with the weight 1 + log2 of its
count. Every term's 128-bit hash votes with its weight for 1 on its set bits and for 0 on the others; the fingerprint keeps
the sign of each bit's total. A text without words has the fingerprint 0, and so has a null.

The search cuts fingerprints into blocks. Fingerprints within the radius agree on at least (blocks - radius) whole blocks,
so there is one table for each choice of such blocks, keyed by the blocks permuted to the front. Equal fingerprints are
collapsed first, so that a group of copies is one entry. ``within_radius`` lists all pairs, for tables in which few are near;
``near_groups`` gives the components of these links and never forms all pairs of a bucket:

1. The entries of a bucket of at most ``SMALL`` are compared within one task, which returns only what connects them.
2. In a larger bucket every entry meets the smallest one. If all lie within the radius of it, or all are of one component by
   the links found so far, the bucket is settled.
3. Else it is cut anew: the bits in which its entries vary are divided into blocks, and the entries go to one smaller bucket
   for each choice of blocks, as in the first tables. No link is lost, as entries within the radius agree on some choice
   again. Entries that vary in ``w`` bits are at most 2^w, so the cuts come to an end.

Very long texts are read whole. An empty table has empty results. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postgrain.llm.group_join import components
from postgrain.llm.hashing import mix, run_hashes, word_hashes
from postgrain.session import stage

BITS = 128
SMALL = 1024  # entries of a bucket that one task compares: 16 MB of distances


def fingerprint(text: bytes) -> bytes:
    """The fingerprint of one text in UTF-8."""
    words, _ = word_hashes(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))
    if not len(words):
        return bytes(BITS // 8)
    terms, count = np.unique(run_hashes(words, 2), return_counts=True)
    weight = (1 + np.log2(count)).astype(np.float32)
    hashes = np.column_stack([terms, mix(terms + np.uint64(0x5851F42D4C957F2D))])
    total = np.zeros(BITS, dtype=np.float64)
    for at in range(0, len(terms), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, BITS // 8), axis=1)
        total += weight[at : at + 4096] @ (bits.astype(np.float32) * 2 - 1)
    return np.packbits(total > 0).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """1 for equal fingerprints, 0 for opposite ones."""
    return 1 - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / BITS


def edited(text: str, following: str) -> str:
    """The second half of the text's code points replaced by as many from the start of the next text (all, if fewer)."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` with ``fingerprint`` (32 hex digits). Equal texts have equal fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint((x.as_py() or "").encode()).hex() for x in batch.column("__text")]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(made, pa.string())], [*keep, "fingerprint"])

    made = docs.select(*keep, F.col(text).alias("__text"))
    return made.mapInArrow(run, docs.select(*keep).schema.add("fingerprint", "string"))


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare(doc_id: int | None, text: str, own: bytes, following: str, next_own: bytes) -> tuple:
    from hashlib import sha256

    changed = edited(text, following).encode()
    print_of = fingerprint(changed)
    return doc_id, len(text), sha256(changed).hexdigest(), own.hex(), print_of.hex(), likeness(own, print_of), likeness(own, next_own)


def edit_study(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document, of its edited text and of the next document, with their likeness.

    Documents are ordered by doc_id, then by text where ids repeat; a null id comes first and a null text is empty. After
    the last comes the first, so that a single document follows itself.

    One range shuffle brings neighbours together. Where a task's range ends, its last document waits for the first of the
    next range that has rows: these few rows are written out whole and compared in a second step.
    """
    spark = docs.sparkSession
    ordered = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).repartitionByRange("doc_id")
    ordered = ordered.sortWithinPartitions("doc_id", "text").withColumn("at", F.spark_partition_id())
    fields = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    names = [*fields, "kind", "at", "text"]

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            rows = []
            ids, texts, at = (batch.column(c) for c in ("doc_id", "text", "at"))
            for k in range(batch.num_rows):
                here = ids[k].as_py(), texts[k].as_py(), at[k].as_py()
                own = fingerprint(here[1].encode())
                if before is None:
                    rows.append((here[0], None, None, own.hex(), None, None, None, "head", here[2], here[1]))
                else:
                    rows.append((*compare(before[0], before[1], before[3], here[1], own), "done", here[2], None))
                before = *here, own
            yield packed(rows)
        if before is not None:
            yield packed([(before[0], None, None, before[3].hex(), None, None, None, "tail", before[2], before[1])])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.int32(), pa.string()]
        columns = list(zip(*rows)) if rows else [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    made = stage(ordered.mapInArrow(neighbours, f"{RESULT}, kind string, at int, text string"))
    # A row for each task that had rows: the next such task in order, after the last the first.
    heads = made.filter(F.col("kind") == "head").select("at", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_own"))
    tasks = made.filter(F.col("kind") == "head").select(F.col("at").alias("task"))
    following = Window.orderBy("task")
    after = F.coalesce(F.lead("task").over(following), F.min("task").over(following.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    tails = made.filter(F.col("kind") == "tail").select("doc_id", "text", "fingerprint", F.col("at").alias("task"))
    pairs = tails.join(tasks.withColumn("after", after), "task").join(heads, F.col("after") == F.col("at"))
    pairs = pairs.select("doc_id", "text", "fingerprint", "next_text", "next_own")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [compare(r["doc_id"], r["text"], bytes.fromhex(r["fingerprint"]), r["next_text"], bytes.fromhex(r["next_own"])) for r in batch.to_pylist()]
            yield packed([(*r, None, None, None) for r in rows]).select(fields)

    return made.filter(F.col("kind") == "done").select(*fields).unionByName(pairs.mapInArrow(finish, RESULT))


def within_radius(prints: DataFrame, radius: int = 3, blocks: int = 8, column: str = "fingerprint") -> DataFrame:
    """All pairs (a, b, distance), a < b, of different fingerprints (hex strings) at most ``radius`` bits apart.

    Join the result with the documents on the fingerprint for document pairs; documents of one fingerprint are at
    distance 0. Nulls have no partner. ``blocks`` must exceed ``radius`` and divide 32 digits.
    """
    digits = BITS // 4 // blocks
    if not 0 < radius < blocks or digits * blocks * 4 != BITS:
        raise ValueError("more blocks than radius are needed, all of whole digits")
    distinct = prints.filter(F.col(column).isNotNull()).select(F.col(column).alias("p")).distinct()

    def key(chosen: tuple[int, ...]) -> Column:
        return F.concat(F.lit(f"{'.'.join(map(str, chosen))}:"), *(F.substring("p", 1 + digits * k, digits) for k in chosen))

    tables = F.array(*(key(c) for c in combinations(range(blocks), blocks - radius)))
    keyed = distinct.select("p", F.explode(tables).alias("key"))
    both = keyed.alias("x").join(keyed.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.p") < F.col("y.p")))
    halves = [F.expr(f"bit_count(conv(substring(x.p, {k}, 8), 16, 10)::bigint ^ conv(substring(y.p, {k}, 8), 16, 10)::bigint)") for k in (1, 9, 17, 25)]
    distance = halves[0] + halves[1] + halves[2] + halves[3]
    found = both.select(F.col("x.p").alias("a"), F.col("y.p").alias("b"), distance.cast("int").alias("distance"))
    return found.filter(F.col("distance") <= radius).distinct()


def cut(used: int, blocks: int, agree: int) -> list[int]:
    """Masks of ``used`` bits and the bits of ``agree`` of the ``blocks`` blocks into which the others are divided."""
    left = [k for k in range(BITS) if not used >> k & 1]
    parts = [sum(1 << k for k in part.tolist()) for part in np.array_split(np.array(left, dtype=object), blocks)]
    return [used | sum(chosen) for chosen in combinations(parts, agree)]


def buckets(entries: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Entries (p, used), a fingerprint and the mask that it shares with its bucket, in the buckets of the next cut.

    Columns key (64 bits of mask and shared bits), used, p; all masks are binary of 16 bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = batch.column("used").dictionary_encode()
            prints = np.frombuffer(b"".join(batch.column("p").to_pylist()), dtype=">u8").reshape(-1, 2).astype(np.uint64)
            which = masks.indices.to_numpy()
            for number, used in enumerate(masks.dictionary.to_pylist()):
                rows = np.flatnonzero(which == number)
                own = batch.column("p").take(pa.array(rows))
                for mask in cut(int.from_bytes(used, "big"), blocks, blocks - radius):
                    wide = mask.to_bytes(BITS // 8, "big")
                    high, low = (np.uint64(x) for x in np.frombuffer(wide, dtype=">u8"))
                    salt = mix(np.array([high ^ mix(np.array([low]))[0]], dtype=np.uint64))[0]
                    key = mix(mix(prints[rows, 0] & high ^ salt) ^ prints[rows, 1] & low)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array([wide] * len(rows), pa.binary()), own], ["key", "used", "p"]
                    )

    return entries.select("p", "used").mapInArrow(run, "key long, used binary, p binary")


def apart(a: str, b: str) -> Column:
    """The Hamming distance of two fingerprints of 16 bytes."""
    halves = [f"bit_count(conv(hex(substring({a}, {k}, 4)), 16, 10)::bigint ^ conv(hex(substring({b}, {k}, 4)), 16, 10)::bigint)" for k in (1, 5, 9, 13)]
    return F.expr(" + ".join(halves))


def forest(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Places (a, b), b the first of a's component, of fingerprints (rows of two words) linked within the radius."""
    apart_by = sum(np.bitwise_count(prints[:, None, k] ^ prints[None, :, k]) for k in range(2))
    near, fresh, out = apart_by <= radius, np.ones(len(prints), dtype=bool), []
    for first in range(len(prints)):
        reached = np.array([first] if fresh[first] else [], dtype=int)
        while len(reached):
            fresh[reached] = False
            out += [(k, first) for k in reached.tolist() if k != first]
            reached = np.flatnonzero(near[reached].any(axis=0) & fresh)
    return out


def shared(a: str, b: str) -> Column:
    """Over a group, the mask of the bits in which no ``a`` differs from ``b``."""
    words = [f"conv(hex(substring({{}}, {k}, 4)), 16, 10)::bigint" for k in (1, 5, 9, 13)]
    same = [f"lpad(hex(4294967295 ^ bit_or({w.format(a)} ^ {w.format(b)})), 8, '0')" for w in words]
    return F.expr(f"unhex(concat({', '.join(same)}))")


def near_groups(prints: DataFrame, radius: int = 3, blocks: int = 4, column: str = "fingerprint", small: int = SMALL) -> DataFrame:
    """Columns fingerprint, lowest: for each fingerprint (hex) that others reach by links of at most ``radius`` bits, the
    smallest fingerprint of its component. That one itself and fingerprints without a link have no row; nulls and repeated
    rows add none.
    """
    if not 0 < radius < blocks or small < 1 << blocks:
        raise ValueError("more blocks than radius are needed, and small buckets of 2^blocks entries or more")

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for own in batch.column("own").to_pylist():
                words = np.frombuffer(b"".join(own), dtype=">u8").reshape(-1, 2).astype(np.uint64)
                for x, y in forest(words, radius):
                    a.append(own[x])
                    b.append(own[y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    distinct = prints.filter(F.col(column).isNotNull()).select(F.unhex(column).alias("p")).distinct()
    entries, edges = stage(distinct.withColumn("used", F.lit(bytes(BITS // 8)))), None
    while True:
        keyed = buckets(entries, radius, blocks)
        filled = keyed.groupBy("key", "used").agg(F.min("p").alias("first"), F.count(F.lit(1)).alias("n"))
        # Buckets of one entry leave before the shuffle where Spark finds ``filled`` small enough to send.
        met = stage(keyed.join(stage(filled.filter("n > 1")), ["key", "used"]))
        lists = met.filter(F.col("n") <= small).groupBy("key", "used").agg(F.sort_array(F.collect_list("p")).alias("own"))
        within = lists.select("own").mapInArrow(connect, "a binary, b binary")
        large = met.filter(F.col("n") > small).withColumn("far", apart("p", "first"))
        stars = large.filter(F.col("far").between(1, radius)).select(F.col("p").alias("a"), F.col("first").alias("b"))
        found = within.unionByName(stars).distinct()
        edges = stage(found) if edges is None else edges.unionByName(stage(found))
        wide = large.groupBy("key", "used").agg(F.max("far").alias("spread"), shared("p", "first").alias("common"))
        wide = stage(large.join(wide.filter(F.col("spread") > radius), ["key", "used"]).select("key", "common", "p"))
        if wide.isEmpty():
            break
        own = components(edges).select(F.col("node").alias("p"), "component")
        labelled = stage(wide.join(own, "p", "left").withColumn("component", F.coalesce("component", "p")))
        several = labelled.groupBy("key", "common").agg(F.min("component").alias("x"), F.max("component").alias("y"))
        still = labelled.join(several.filter("x <> y").select("key", "common"), ["key", "common"], "left_semi")
        entries = stage(still.select("p", F.col("common").alias("used")).distinct())
        if entries.isEmpty():
            break
    linked = components(edges)
    return linked.select(F.lower(F.hex("node")).alias("fingerprint"), F.lower(F.hex("component")).alias("lowest"))


def with_near_id(docs: DataFrame, radius: int = 3) -> DataFrame:
    """``docs`` (doc_id, fingerprint, others) with near_id, the smallest doc_id among the documents whose fingerprints links
    of at most ``radius`` bits reach, equal fingerprints included. A null id is a component's only where it has no other; a null fingerprint has no near_id.
    """
    own = stage(docs.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    groups = stage(near_groups(own, radius))
    of = own.join(groups, "fingerprint", "left").withColumn("lowest", F.coalesce("lowest", "fingerprint"))
    least = of.groupBy("lowest").agg(F.min("first").alias("near_id"))
    by_print = of.join(least, "lowest").select("fingerprint", "near_id")
    return docs.join(by_print, "fingerprint", "left").select(*docs.columns, "near_id")
