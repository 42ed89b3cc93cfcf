"""Topic and axis dimensions from one YAML document, and the checks on them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_CONFIG = Path(__file__).with_name("default_config.yaml")

AXIS_FIELDS = ("name", "short", "color", "label_description", "rewrite_up", "rewrite_down")


@dataclass(frozen=True)
class Config:
    topics: tuple[dict, ...]
    axes: tuple[dict, ...]

    @property
    def axis_names(self) -> list[str]:
        return [a["name"] for a in self.axes]


def load_config(path: str | Path = DEFAULT_CONFIG) -> Config:
    import yaml

    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    return Config(tuple(raw.get("topics") or ()), tuple(raw.get("axes") or ()))


def topic_dim(spark: SparkSession, cfg: Config) -> DataFrame:
    rows = [(t.get("cluster_id"), t.get("name")) for t in cfg.topics]
    return spark.createDataFrame(rows, "cluster_id int, topic_name string")


def axis_dim(spark: SparkSession, cfg: Config) -> DataFrame:
    rows = [(i, *(a.get(f) for f in AXIS_FIELDS)) for i, a in enumerate(cfg.axes)]
    return spark.createDataFrame(
        rows,
        "ord int, axis string, short string, color string, "
        "label_description string, rewrite_up string, rewrite_down string",
    )


def config_violations(topics: DataFrame, axes: DataFrame) -> DataFrame:
    """One row ``(kind, item, field)`` per broken rule: an empty dimension, a missing required field or an id defined twice.

    ``topics`` and ``axes`` have the columns of ``topic_dim`` and ``axis_dim``; a missing field is null.
    """

    def missing(dim: DataFrame, kind: str, label: str, fields: dict[str, str]) -> DataFrame:
        gaps = F.filter(
            F.array(*(F.when(F.col(c).isNull(), F.lit(f)) for f, c in fields.items())), lambda x: x.isNotNull()
        )
        return dim.select(
            F.lit(kind).alias("kind"),
            F.coalesce(F.col(label).cast("string"), F.lit("?")).alias("item"),
            F.explode(gaps).alias("field"),
        )

    def empty(dim: DataFrame, kind: str) -> DataFrame:
        none = dim.agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
        return none.select(F.lit(kind).alias("kind"), F.lit("*").alias("item"), F.lit("none defined").alias("field"))

    def twice(dim: DataFrame, kind: str, label: str) -> DataFrame:
        again = dim.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        item = F.col(label).cast("string").alias("item")
        return again.select(F.lit(kind).alias("kind"), item, F.lit("defined twice").alias("field"))

    axis_fields = {f: ("axis" if f == "name" else f) for f in AXIS_FIELDS}
    parts = [
        empty(topics, "topic"),
        empty(axes, "axis"),
        missing(topics, "topic", "cluster_id", {"cluster_id": "cluster_id", "name": "topic_name"}),
        missing(axes, "axis", "axis", axis_fields),
        twice(topics, "topic", "cluster_id"),
        twice(axes, "axis", "axis"),
    ]
    return reduce(DataFrame.unionByName, parts)


def require_valid(topics: DataFrame, axes: DataFrame) -> None:
    """Raise on the first few violations; an action over the two small dimensions."""
    bad = config_violations(topics, axes).orderBy("kind", "item", "field").take(20)
    if bad:
        raise ValueError("invalid configuration: " + "; ".join(f"{r.kind} {r.item}: {r.field}" for r in bad))
