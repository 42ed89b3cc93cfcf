"""Per-group top N, de-duplication by key, and the summaries of a selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postgrain.session import stage

SALTS = 32
CELLS = 4096  # of a group's histogram


def topn(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str = "rn", value: Column | None = None) -> DataFrame:
    """First ``n`` rows of every group under ``order``, numbered from 1 in ``rank``.

    ``order`` must end in a unique column. Each map task keeps at most ``n`` rows per group before the shuffle (for ``n`` up to
    Spark's ``windowGroupLimitThreshold``); a group's survivors are then spread over ``SALTS`` tasks before the last task
    sees ``n * SALTS`` rows of it, so one hot group does not land whole in one task. Where ``order`` begins with a number in
    descending order, that number as ``value`` leaves only rows that can be chosen to be ranked at all, whatever ``n`` is.
    """
    by = list(by)
    df = df if value is None else reaching(df, by, value, n)
    salted = df.withColumn("_salt", F.spark_partition_id() % SALTS)
    for keys in ([*by, "_salt"], by or [F.lit(0)]):
        window = Window.partitionBy(*keys).orderBy(*order)
        salted = salted.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)
    return salted.drop("_salt")


def reaching(df: DataFrame, by: Sequence[str], value: Column, n: int) -> DataFrame:
    """Rows that can be among the ``n`` largest of their group by ``value``: those from the histogram cell on that reaches n.

    Counts of at most ``CELLS`` cells a group, combined before the shuffle, give the cell; no row travels for it. Only rows of
    that one cell are too many. Nulls are smallest and NaN is largest, as when Spark sorts descending.
    """
    infinite = F.lit(float("inf"))
    number = value.cast("double")
    finite = F.when(F.abs(number) < infinite, number)
    keys = [F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]
    names = [f"_by{i}" for i in range(len(by))]

    def met(other: DataFrame) -> Column:
        on = F.lit(True)
        for c, name in zip(by, names):
            on = on & F.col(c).eqNullSafe(other[name])
        return on

    ends = stage(df.select(*keys, finite.alias("_v")).groupBy(*names).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high")))
    share = (number / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2)  # halves: no difference overflows
    inner = F.least(F.floor(share * CELLS), F.lit(CELLS - 1))
    cell = (
        F.when(number.isNull(), F.lit(-2))
        .when(number == -infinite, F.lit(-1))
        .when(finite.isNull(), F.lit(CELLS))
        .when(F.col("_low") == F.col("_high"), F.lit(0))
        .otherwise(inner)
    )

    def known(row: DataFrame) -> DataFrame:
        """``df`` with the columns of a table that has a row for each group; without groups these are a few numbers."""
        if by:
            return df.join(row, met(row))
        found = row.first()
        return df.withColumns({c: F.lit(found and found[c]).cast(row.schema[c].dataType) for c in row.columns})

    placed = known(ends)
    ranges = [*names, "_low", "_high"]
    counts = placed.select(*(keys if by else []), "_low", "_high", cell.alias("_cell")).groupBy(*ranges, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    above = F.sum("_n").over(Window.partitionBy(*(names or [F.lit(0)])).orderBy(F.desc("_cell")))
    cut = counts.withColumn("_above", above).groupBy(*ranges).agg(F.coalesce(F.max(F.when(F.col("_above") >= n, F.col("_cell"))), F.lit(-2)).alias("_cut"))
    # The ends go along with the cut: a group has the same ends in every row.
    return known(stage(cut)).filter(cell >= F.col("_cut")).select(*df.columns)


def topn_pool(scored: DataFrame, n: int = 1000, rounded: bool = False) -> DataFrame:
    """Best ``n`` posts per topic by quality score.

    ``rounded`` ranks by the stored four-decimal score, as a rebuild from a score table does.
    """
    score = F.round("score", 4) if rounded else F.col("score")
    return topn(scored, ["topic_name"], [score.desc(), F.col("post_id")], n, "pool_rn", score)


def topn_agent(pool: DataFrame, n: int = 150) -> DataFrame:
    """Best ``n`` posts per topic by agent score; a missing score counts as 0 and ties keep pool order."""
    order = [F.coalesce("agent_score", F.lit(0.0)).desc(), F.col("pool_rn"), F.col("post_id")]
    return topn(pool, ["topic_name"], order, n)


def rank_all(pool: DataFrame) -> DataFrame:
    """Every post in global agent-score order (range-partitioned sort; the ties are spread by the other keys)."""
    return pool.orderBy(F.coalesce("agent_score", F.lit(0.0)).desc(), "topic_name", "pool_rn", "post_id")


def select_midrange(posts: DataFrame, n: int = 70) -> DataFrame:
    """Posts with the most mid-range axis scores, ``n`` per named topic."""
    named = posts.filter(F.col("topic_name").isNotNull())
    return topn(named, ["topic_name"], [F.col("mid_count").desc(), F.col("post_id")], n)


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "last") -> DataFrame:
    """One row per key: the first or last under ``order``, which must be unique within a key.

    Every map task sends one row per key at most, so a key with very many copies stays cheap.
    """
    if keep not in ("first", "last"):
        raise ValueError("keep is 'first' or 'last'")
    cols = [F.col(c).asc() if keep == "first" else F.col(c).desc() for c in order]
    window = Window.partitionBy(*keys).orderBy(*cols)
    return df.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")


def topic_counts(df: DataFrame) -> DataFrame:
    """Rows per topic, and the total in a row whose topic is null."""
    return df.rollup("topic_name").agg(F.count(F.lit(1)).alias("n"))


def topic_cutoffs(selected: DataFrame, score: str = "agent_score") -> DataFrame:
    """Size, best and cutoff score of each topic's selection; a missing score counts as 0."""
    value = F.coalesce(score, F.lit(0.0))
    return selected.groupBy("topic_name").agg(
        F.count(F.lit(1)).alias("n"), F.max(value).alias("top"), F.min(value).alias("cutoff")
    )


def distinct_topics(df: DataFrame) -> DataFrame:
    return df.agg(F.countDistinct("topic_name").alias("n_topics"))
