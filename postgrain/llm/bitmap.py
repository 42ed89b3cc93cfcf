"""A bitmap of fixed size over the keys of one table, to keep wide rows of another one out of a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postgrain.session import stage

BITS = 1 << 25  # at most 4 MB, in maps of 4 KB each, whatever the input


def _bit(keys: list[str]):
    return F.pmod(F.xxhash64(*keys), F.lit(BITS)) + 1


def split(rows: DataFrame, keys: list[str], wanted: DataFrame, wanted_keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose keys may be among those of ``wanted``, and the others, which are certainly not there.

    Nulls are keys like others. As the bitmap fills up, more rows are among the first; a join has to settle those.
    """
    marked = wanted.select(_bit(wanted_keys).alias("bit"))
    maps = marked.groupBy(F.bitmap_bucket_number("bit").alias("__bucket"))
    maps = stage(maps.agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("__map")))
    placed = rows.withColumn("__bit", _bit(keys))
    looked = placed.join(F.broadcast(maps), F.bitmap_bucket_number("__bit") == F.col("__bucket"), "left")
    place = F.bitmap_bit_position("__bit").cast("int")
    byte = F.conv(F.hex(F.substring("__map", F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    among = F.coalesce(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), place.bitwiseAND(7))) != 0, F.lit(False))
    return looked.filter(among).select(rows.columns), looked.filter(~among).select(rows.columns)
