"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Each source is a queue of its documents in shuffled order, served up to ``epochs`` times. The virtual finish time of a copy
of a document is the number of its source's words up to and including it, divided by the source's weight. All copies are
range-sorted by finish time and taken until the total budget is used. A source that runs out leaves its share to the others
in proportion to their weights, which is what resharing the excess of capped targets gives.

Running totals never gather a source, however large, in one task: ranges of the shuffled order are buckets, bucket
sums (combined before the shuffle) give each bucket's start, and only the few documents of one bucket are ordered together.
The global cut works the same way over ranges of finish time. The table of sources has one row per source.

Size is the number of words of a text, 0 for nulls and empty texts; such documents take part without using any budget and
are taken with 0 words. A null source is a source that sorts last. Repeated rows are separate documents, and null ids are ids
like others: the order comes from MD5 of seed, doc_id, source, text and the number of the row among equal ones, so that
reruns agree, also on the same rows in other files. An empty table gives an empty mix. Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postgrain.llm.ordering import positions
from postgrain.session import stage

BUCKET_ROWS = 4096  # about, of one bucket of the shuffled order

WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2


def word_count(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "w")
    return F.length(F.regexp_replace(marked, r"^[\x20\x09-\x0D]+", "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, epochs: int) -> DataFrame:
    """Columns source, place, weight, source_size and target of a table (source, source_size) with a row per source.

    The target is min(weight x t, epochs x size), where t makes the targets add up to ``share`` of all sizes.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # a row per source
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    named = sizes.withColumn("place", (F.row_number().over(order) - 1).cast("int")).withColumn("weight", weight)
    most = F.col("source_size") * epochs
    everything = Window.partitionBy()
    filled = Window.orderBy(most / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = (
        named.withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("full", F.sum(most).over(filled))
        .withColumn("open", F.sum("weight").over(everything) - F.sum("weight").over(filled))
    )
    # With the first k sources full the others share what is left; the right k is the one with the greatest such time.
    before_full, before_open = F.col("full") - most, F.col("open") + F.col("weight")
    time = F.max((F.col("budget") - before_full) / before_open).over(everything)
    fits = F.col("budget") >= F.sum(most).over(everything)
    target = F.when(fits, most).otherwise(F.least(F.col("weight") * time, most))
    return steps.select("source", "place", "weight", "source_size", target.cast("double").alias("target"), "budget")


def row_key(doc_id: Column, source: Column, text: Column) -> Column:
    """128 bits that rows share which agree in doc_id, source and text, nulls included."""
    plain = lambda c: F.coalesce(F.md5(c.cast("string").cast("binary")), F.lit("-"))
    return F.md5(F.concat_ws("|", plain(doc_id), plain(source), plain(text)))


def told_apart(rows: DataFrame, key: str) -> DataFrame:
    """Add ``same``: the number (from 0) of each row among those with its key. Only repeated keys are ordered."""
    counts = stage(rows.groupBy(F.col(key).alias("__met")).agg(F.count(F.lit(1)).alias("__met_n")).filter("__met_n > 1").select("__met"))
    met = F.col(key) == F.col("__met")
    single = rows.join(counts, met, "left_anti").withColumn("same", F.lit(0).cast("long"))
    return single.unionByName(positions(rows.join(counts, met, "left_semi"), key, []).withColumnRenamed("pos", "same").drop("of"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    epochs: int = EPOCHS,
    seed: str = "mix",
    keep: tuple[str, ...] = (),
    ranges: int = 4096,
) -> DataFrame:
    """Every document with place in the mix: columns doc_id, ``keep``, size, source_size, target, taken, copies, finish.

    ``taken`` counts words over all copies and ``copies`` the times a document is taken; ``finish`` is the first virtual
    finish time. ``ranges`` sets how finely running totals are split, not what they are. Kept columns of these names are
    replaced.
    """
    keep = tuple(c for c in keep if c not in ("doc_id", "size", "source_size", "target", "taken", "copies", "finish"))
    spark = docs.sparkSession
    key = row_key(F.col("doc_id"), F.col("source"), F.col("text"))
    narrow = stage(docs.select("doc_id", "source", *keep, word_count(F.col("text")).alias("size"), key.alias("__row_key")))
    buckets = 1 + narrow.count() // BUCKET_ROWS
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col("__row_key"), F.col("same")))
    made = told_apart(narrow, "__row_key").withColumn("shuffled", order).drop("__row_key", "same")
    made = stage(made.withColumn("bucket", F.shiftright(F.conv(F.substring("shuffled", 1, 8), 16, 10).cast("long") * buckets, 32)))
    by_bucket = stage(made.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")))
    sizes = by_bucket.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = stage(source_targets(sizes, weights, share, epochs))
    start = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_bucket.select("source", "bucket", F.coalesce(F.sum("words").over(start), F.lit(0)).alias("start"))
    placed = starts.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
    placed = placed.select(F.col("b.source").alias("of"), F.col("bucket").alias("at"), "start", "place", "weight", "source_size", "target")
    within = Window.partitionBy("place", "bucket").orderBy("shuffled", "doc_id", "size")
    running = (
        made.join(placed, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at")))
        .drop("of", "at")
        .withColumn("upto", F.col("start") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("turn", F.row_number().over(within))
    )
    first = F.col("upto") / F.col("weight")
    running = stage(running.withColumn("finish", first.cast("double")).drop("source", "start"))
    copies = running.select("place", "bucket", "turn", "size", "weight", "source_size", "upto", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    finish = ((F.col("upto") + F.col("epoch") * F.col("source_size")) / F.col("weight")).cast("double")
    copies = copies.select("place", "bucket", "turn", "epoch", "size", finish.alias("finish"))
    last = targets.agg(F.max(F.col("source_size") * epochs / F.col("weight")).alias("last"), F.max("budget").alias("budget"))
    last_time, budget = last.head()  # one row: numbers of the whole table
    if not last_time:
        cut = copies.withColumn("in_mix", F.lit(True))
    else:
        ranged = copies.withColumn("range", F.least(F.floor(F.col("finish") / F.lit(last_time) * ranges), F.lit(ranges - 1)).cast("int"))
        sums = ranged.groupBy("range").agg(F.sum("size").alias("words"))
        upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = stage(sums.withColumn("end", F.sum("words").over(upto)))  # a row per range
        over = sums.filter(F.col("end") > F.lit(budget)).agg(F.min(F.struct("range", F.col("end") - F.col("words"))).alias("x")).head()[0]
        edge, used = over if over is not None else (ranges, 0)
        queue = Window.orderBy("finish", "place", "bucket", "turn", "epoch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        crossing = ranged.filter(F.col("range") == edge).withColumn("in_mix", F.sum("size").over(queue) + F.lit(used) <= F.lit(budget))
        cut = ranged.filter(F.col("range") < edge).withColumn("in_mix", F.lit(True)).unionByName(crossing)
    counted = cut.filter("in_mix").groupBy("place", "bucket", "turn").agg(F.count(F.lit(1)).alias("copies"))
    out = running.join(counted, ["place", "bucket", "turn"], "left").withColumn("copies", F.coalesce("copies", F.lit(0)).cast("int"))
    taken = (F.col("size") * F.col("copies")).cast("long")
    return out.select("doc_id", *keep, "size", "source_size", "target", taken.alias("taken"), "copies", "finish")
