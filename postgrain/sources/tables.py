"""Typed readers and writers. Malformed input stops the job; ids are always strings."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postgrain.functions.text import run_number
from postgrain.operators.filters import with_keys
from postgrain.operators.rewrites import NESTED_SCHEMA, explode_rewrites
from postgrain.operators.topn import dedupe
from postgrain.session import stage

POST_SCHEMA = "post_id string, text string, engagement bigint"
POST_RAW_SCHEMA = POST_SCHEMA + ", lang string, is_reply boolean, is_repost boolean, is_quote boolean"
VECTOR_SCHEMA = "post_id string, embedding array<float>"
TOPIC_SCHEMA = "post_id string, topic int"
SCORE_SCHEMA = "post_id string, topic_name string, cluster_id int, probability_score double"
POOL_SCHEMA = (
    "post_id string, topic_name string, cluster_id int, text string, engagement bigint, lr_score double"
)
RANKING_SCHEMA = (
    "post_id string, topic_name string, agent_score double, lr_score double, engagement bigint, text string"
)
DATASET_SCHEMA = RANKING_SCHEMA + ", axes_json string"


# Fixed value: the key of the axis names in a document of rewrites.
AXES_KEY = "__axis_names__"
AXES_SCHEMA = "ord int, axis string"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Newline-delimited JSON, plain or compressed by file extension."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_posts(spark: SparkSession, path: str, schema: str = POST_SCHEMA, partitions: int | None = None) -> DataFrame:
    """Posts that have an id and a text.

    A gzip file is one split: pass ``partitions`` to spread such input right after the read.
    """
    posts = with_keys(read_json(spark, path, schema), "post_id", "text")
    return posts.repartition(partitions) if partitions else posts


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header that names ``post_id`` and an integer ``label``, among any other columns, in any order.

    One row per post: of several labels of a post the last line counts, files in the order of their names.
    """
    rows = spark.read.csv(path, header=True, mode="FAILFAST")
    # Numbers of lines ascend within a block of a file, whatever task reads it.
    line = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
    rows = rows.select(F.col("post_id").cast("string"), F.col("label").cast("int"), line.alias("_line"))
    return dedupe(rows, ["post_id"], ["_line"]).drop("_line")


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, TOPIC_SCHEMA)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, SCORE_SCHEMA)


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, POOL_SCHEMA)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Final posts; ``axes_json`` keeps an object's JSON text, whether it was stored as an object or a string."""
    return read_json(spark, path, DATASET_SCHEMA)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VECTOR_SCHEMA).parquet(path)


def write_vectors(df: DataFrame, path: str) -> None:
    df.select("post_id", F.col("embedding").cast("array<float>")).write.parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row; files keep the row order of a sorted frame."""
    df.write.json(path)


def write_scores(scored: DataFrame, path: str) -> None:
    """Scores rounded to four decimals."""
    stored = F.round("score", 4).alias("probability_score")
    write_json(scored.select("post_id", "topic_name", "cluster_id", stored), path)


def write_by_topic(df: DataFrame, path: str) -> None:
    """Final posts in one folder per topic, so a reader of one topic reads only its files."""
    df.write.partitionBy("topic_name").json(path)


def write_topic_info(info: DataFrame, path: str) -> None:
    """CSV with a header; the terms become one text column."""
    terms = F.array_join(F.transform("terms", lambda t: t["term"]), " ")
    info.select("topic", "n", "name", terms.alias("terms")).write.csv(path, header=True)


def write_report(report: DataFrame, path: str) -> None:
    """Feature records as JSON in report order. The table has one row per feature."""
    report.coalesce(1).write.json(path)


def read_rewrites(spark: SparkSession, path: str, layout: str = "wrapped") -> DataFrame:
    """Long rewrites from any of the three stored layouts.

    ``wrapped`` is one document with a list of posts, ``list`` the bare list, ``flat`` one document whose values carry
    post and axis; ``lines`` is one nested post per line, the form that splits.
    """
    reader = spark.read.option("mode", "FAILFAST")
    if layout == "wrapped":
        document = reader.schema(f"posts array<struct<{_fields(NESTED_SCHEMA)}>>").json(path, multiLine=True)
        return explode_rewrites(document.select(F.inline("posts")))
    if layout == "list":
        return explode_rewrites(reader.schema(NESTED_SCHEMA).json(path, multiLine=True))
    if layout == "lines":
        return explode_rewrites(reader.schema(NESTED_SCHEMA).json(path))
    if layout == "flat":
        entry = "struct<post_id:string,axis:string,direction:string,original:string,rewrite:string>"
        text = spark.read.text(path, wholetext=True)
        entries = F.from_json("value", f"map<string,{entry}>", {"mode": "FAILFAST"})
        values = text.select(F.explode(F.map_values(entries)).alias("r"))
        return values.select("r.post_id", "r.axis", "r.direction", "r.original", "r.rewrite")
    raise ValueError(f"unknown layout {layout!r}")


def _fields(ddl: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (f.split(" ", 1) for f in ddl.split(", ")))


def write_rewrites(
    nested: DataFrame, path: str, axes: Sequence[str] = (), layout: str = "lines", posts_per_file: int = 10_000
) -> None:
    """Nested posts in one of the layouts of ``read_rewrites``, with the names of the axes.

    ``lines``, one post per line, is the form that splits; the names go to a file beside the lines (``_axes``, which
    readers of the folder pass over). The other layouts are documents, of about ``posts_per_file`` posts each, so that
    no task holds more however many posts there are; each ``wrapped`` document carries the names. ``list`` and ``flat``
    documents have no place for them, and get the same file.
    """
    spark = nested.sparkSession
    if layout == "lines":
        nested.write.json(path)
    elif layout in ("wrapped", "list", "flat"):
        nested = stage(nested)
        files = max(1, math.ceil(nested.count() / posts_per_file))
        bucket = F.pmod(F.xxhash64("post_id"), F.lit(files)).alias("file")
        entry = F.struct("post_id", "original", "rewrites")
        if layout == "flat":
            items = F.transform(F.map_entries("rewrites"), lambda e: _flat_item(e))
            document = F.to_json(F.map_from_entries(F.flatten(F.collect_list(items))))
        elif layout == "list":
            document = F.to_json(F.collect_list(entry))
        else:
            names = F.array(*(F.lit(a) for a in axes)).cast("array<string>").alias(AXES_KEY)
            document = F.to_json(F.struct(names, F.collect_list(entry).alias("posts")))
        texts = nested.select("*", bucket).groupBy("file").agg(document.alias("value"))
        texts.write.partitionBy("file").text(path)
    else:
        raise ValueError(f"unknown layout {layout!r}")
    if axes and layout != "wrapped":
        names = [(i, a) for i, a in enumerate(axes)]
        spark.createDataFrame(names, AXES_SCHEMA).coalesce(1).write.json(f"{path}/_axes")


def _flat_item(entry: Column) -> Column:
    """Key and value of one post and axis in the flat layout."""
    r = entry["value"]
    value = F.struct(
        F.col("post_id"), entry["key"].alias("axis"), r["direction"].alias("direction"), F.col("original"), r["rewrite"].alias("rewrite")
    )
    return F.struct(F.concat(F.col("post_id"), F.lit("|"), entry["key"]), value)


def read_axis_names(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """``(ord, axis)``: the names of the axes stored with rewrites, in order; no rows where none were stored."""
    if layout == "wrapped":
        documents = spark.read.schema(f"`{AXES_KEY}` array<string>").json(path, multiLine=True, mode="FAILFAST")
        return documents.select(F.posexplode(AXES_KEY).alias("ord", "axis")).distinct()
    if not exists(spark, f"{path}/_axes"):
        return spark.createDataFrame([], AXES_SCHEMA)
    return spark.read.schema(AXES_SCHEMA).json(f"{path}/_axes", mode="FAILFAST")


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    system, hadoop_path = _file_system(spark, path)
    return system.exists(hadoop_path)


def read_checkpoint(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Finished keys and values; empty when nothing was stored yet."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def append_checkpoint(df: DataFrame, path: str) -> None:
    """Append rows; Zstandard stores a text that neighbouring rows repeat about once, however long it is."""
    df.write.mode("append").option("compression", "zstd").parquet(path)


def reuse_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored table when its write was completed, else build, write and read it."""
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite" if exists(spark, path) else "errorifexists").parquet(path)
    return spark.read.parquet(path)


def replace_dataset(df: DataFrame, base: str, version: int) -> str:
    """Write a new version next to the ones being read; the newest completed version is current."""
    path = f"{base}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def latest_version(spark: SparkSession, base: str, column: str = "version") -> int | None:
    """The numerically largest completed version, by folder names alone; None without one."""
    if not exists(spark, base):
        return None
    system, hadoop_path = _file_system(spark, base)
    names = [f.getPath().getName() for f in system.listStatus(hadoop_path) if f.isDirectory()]
    whole = exists(spark, f"{base}/_SUCCESS")  # written in one go, partitioned by the version
    numbers = [int(n.split("=")[1]) for n in names if n.startswith(f"{column}=") and n.split("=")[1].isdigit()]
    done = [n for n in numbers if whole or exists(spark, f"{base}/{column}={n}/_SUCCESS")]
    return max(done, default=None)


def read_latest(spark: SparkSession, base: str, column: str = "version") -> DataFrame:
    """Rows of the numerically largest completed version; the files of the others are not touched.

    Versions may have different columns.
    """
    newest = latest_version(spark, base, column)
    if newest is None:
        raise FileNotFoundError(f"no completed {column} below {base}")
    return spark.read.option("basePath", base).parquet(f"{base}/{column}={newest}")


def latest_run(names: DataFrame, col: str = "name") -> DataFrame:
    """The name with the largest trailing number."""
    return names.select(F.max_by(col, run_number(F.col(col))).alias(col), F.max(run_number(F.col(col))).alias("run_n"))


def save_weights(weights: DataFrame, path: str) -> None:
    weights.write.parquet(path)


def load_weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("param string, row int, values array<double>").parquet(path)
