"""A training corpus from raw documents: language, near duplicates, personal data, source mix, token ids.

Every stage takes and returns documents (the last returns token ids); ``run`` writes each stage's result as Parquet and
reads it again. Nulls, empty texts, ties, repeated rows and empty tables are handled as the operators say. Columns beyond
those of documents pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postgrain.llm.bitmap import split
from postgrain.llm.byte_bpe import encode_and_check
from postgrain.llm.fair_mix import mix, row_key
from postgrain.llm.group_join import link_rows
from postgrain.llm.language import UNKNOWN, fit_languages, predict_languages
from postgrain.llm.ordering import positions
from postgrain.llm.pii import find, redacted, select, train
from postgrain.session import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def shielded(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply ``work`` while columns beyond those of documents have names that meet none of an operator's own."""
    names = docs.columns
    inner = [c if c in COLUMNS else f"__extra_{k}" for k, c in enumerate(names)]
    done = work(docs.toDF(*inner))
    return done.select(*(F.col(c).alias(name) for c, name in zip(inner, names)))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known and not ambiguous; the others go."""

    def work(docs: DataFrame) -> DataFrame:
        predicted = predict_languages(docs, fit_languages(docs), docs.columns)
        return predicted.filter((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous"))

    return shielded(docs, work)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked documents: the one with the smallest doc_id, then the smallest digest of the text.

    A null doc_id comes after all others. Documents without words are in no group and stay; of those, rows of one doc_id
    and one text are one document, and rows with a null doc_id are documents of their own.
    """

    def work(docs: DataFrame) -> DataFrame:
        keyed = docs.withColumn("__row", F.md5(F.col("text").cast("binary")))
        linked = link_rows(keyed, 5, 75, ["__row"])
        grouped = F.col("lowest").isNotNull()
        same = F.col("doc_id").eqNullSafe(F.col("lowest.doc_id")) & F.col("__row").eqNullSafe(F.col("lowest.__row"))
        stays = ~grouped | same
        rows = linked.select("doc_id", "__row", stays.alias("stays"), (grouped | F.col("doc_id").isNotNull()).alias("once"))
        counted = rows.groupBy("doc_id", "__row", "stays", "once").agg(F.count(F.lit(1)).alias("n"))
        # Rows that go, and those of which one stays.
        suspects = stage(counted.filter(~F.col("stays") | F.col("once") & (F.col("n") > 1)).drop("n", "once"))
        key = suspects.select(F.col("doc_id").alias("__id"), F.col("__row").alias("__of"), "stays")
        on = keyed["doc_id"].eqNullSafe(key["__id"]) & keyed["__row"].eqNullSafe(key["__of"])
        # Texts are shuffled only where a bitmap of fixed size says that their key may be among these.
        near, clear = split(keyed, ["doc_id", "__row"], suspects, ["doc_id", "__row"])
        repeated, _ = split(keyed, ["doc_id", "__row"], suspects.filter("stays"), ["doc_id", "__row"])
        kept = clear.unionByName(near.join(key, on, "left_anti"))
        several = repeated.join(key.filter("stays"), on, "left_semi").dropDuplicates(["doc_id", "__row"])
        return kept.unionByName(several).drop("__row")

    return shielded(docs, work)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""

    def work(docs: DataFrame) -> DataFrame:
        model = train(find(docs.select("doc_id", "text")).drop("text"))
        marked = select(find(docs), model).withColumn("text", redacted("text", "spans"))
        return marked.withColumn("n_chars", F.length("text").cast("long"))

    return shielded(docs, work)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Of rows that agree in doc_id, source and text the first ones take one more,
    where the copies that these rows have in the mix do not divide evenly.
    """

    def work(docs: DataFrame) -> DataFrame:
        keyed = docs.withColumn("__key", row_key(F.col("doc_id"), F.col("source"), F.col("text")))
        of = F.col("__key").alias("__of")
        taken = mix(keyed, keep=("__key",)).groupBy(of).agg(F.sum("copies").alias("__all"), F.count(F.lit(1)).alias("__n"))
        taken = stage(taken.filter("__all > 0"))
        own = F.col("__key") == F.col("__of")
        single = keyed.join(taken.filter("__n = 1"), own).withColumn("__copies", F.col("__all"))
        repeated, _ = split(keyed, ["__key"], taken.filter("__n > 1"), ["__of"])
        equal = positions(repeated.join(taken.filter("__n > 1"), own), "__key", [])
        more = (F.col("pos") < F.col("__all") % F.col("__n")).cast("long")
        equal = equal.withColumn("__copies", F.floor(F.col("__all") / F.col("__n")) + more).drop("pos", "of")
        both = single.unionByName(equal).filter("__copies > 0")
        return both.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))

    return shielded(docs, work)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, and the digest of what they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encode_and_check(docs, path, public_tokenizers.PATTERN, ["doc_id", "lang", "source"])


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

# Trained classifiers and byte-pair merges have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, work in STAGES:
        docs = stage(work(spark, docs, sf_dir))
    return docs
