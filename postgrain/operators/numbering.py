"""Exact global positions, batches and samples without a single-task sort.

Rows are ordered by the MD5 of their (unique) key. The leading hex digits of the hash split them into uniform buckets;
bucket sizes are counted first, so a row's global position is its bucket's offset plus its place inside the bucket. The
positions do not depend on the number of buckets or partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postgrain.session import broadcast_bounded


BUCKET_ROWS = 100_000  # at most, about, that a task orders


def _digits(df: DataFrame, digits: int | None) -> int:
    """Hex digits that split the counted rows into buckets of about ``BUCKET_ROWS`` at most; three up to 400 million rows."""
    if digits is not None:
        return digits
    rows, enough = df.count(), 3
    while rows > BUCKET_ROWS * 16**enough:
        enough += 1
    return enough


def _hashed(df: DataFrame, key: str, seed: int, digits: int) -> DataFrame:
    text = F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))
    hashed = df.withColumn("_hash", F.md5(text.cast("binary")))
    return hashed.withColumn("_bucket", F.substring("_hash", 1, digits))


def _offsets(hashed: DataFrame) -> DataFrame:
    # At most 16**digits rows, so one task can take the running sum.
    sizes = hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0)))


def numbered(df: DataFrame, key: str, seed: int = 42, digits: int | None = None, name: str = "pos") -> DataFrame:
    """Add the 1-based position of each row in seeded hash order of ``key``."""
    digits = _digits(df, digits)
    hashed = _hashed(df, key, seed, digits)
    offsets = broadcast_bounded(_offsets(hashed.select("_bucket")), 16**digits)
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash", key))
    return (
        hashed.join(offsets, "_bucket")
        .withColumn(name, F.col("_offset") + inside)
        .drop("_hash", "_bucket", "_size", "_offset")
    )


def batch_slots(df: DataFrame, key: str, size: int, seed: int = 42, digits: int | None = None) -> DataFrame:
    """Add ``batch_id`` (from 0) and ``slot`` (from 1): full batches of ``size``, with one shorter batch at the end."""
    pos = F.col("_pos") - 1
    return (
        numbered(df, key, seed, digits, "_pos")
        .withColumn("batch_id", F.floor(pos / size).cast("bigint"))
        .withColumn("slot", (pos % size + 1).cast("int"))
        .drop("_pos")
    )


def sample_exact(df: DataFrame, key: str, n: int, seed: int = 42, digits: int | None = None) -> DataFrame:
    """Uniform sample of exactly ``min(n, rows)`` rows without replacement.

    Only rows of the buckets that can reach the sample, about ``n`` plus one bucket, leave their map task.
    """
    digits = _digits(df, digits)
    hashed = _hashed(df, key, seed, digits)
    offsets = _offsets(hashed.select("_bucket")).filter(F.col("_offset") < n)
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash", key))
    return (
        hashed.join(broadcast_bounded(offsets, 16**digits), "_bucket")
        .withColumn("_pos", F.col("_offset") + inside)
        .filter(F.col("_pos") <= n)
        .drop("_hash", "_bucket", "_size", "_offset", "_pos")
    )


def rest_of(df: DataFrame, sample: DataFrame, key: str, sample_rows: int) -> DataFrame:
    """Rows whose key is not in the sample of at most ``sample_rows`` rows."""
    return df.join(broadcast_bounded(sample.select(key), sample_rows), key, "left_anti")
