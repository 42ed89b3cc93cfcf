"""Quality classifier: standardisation, weighted logistic regression, scoring and its report."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postgrain.functions.vectors import linear, sigmoid

ROWS_PER_FIT_TASK = 20_000


@dataclass(frozen=True)
class LinearModel:
    """Logistic model on raw vectors; the standardisation is folded into weights and bias."""

    weights: np.ndarray
    bias: float

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [("weights", 0, self.weights.tolist()), ("bias", 0, [float(self.bias)])]
        return spark.createDataFrame(rows, "param string, row int, values array<double>")

    @staticmethod
    def from_frame(df: DataFrame) -> LinearModel:
        parts = {r.param: r["values"] for r in df.filter(F.col("param").isin("weights", "bias")).collect()}
        return LinearModel(np.array(parts["weights"]), float(parts["bias"][0]))


def scaler_stats(vectors: DataFrame, col: str = "embedding") -> DataFrame:
    """Mean and population deviation of every dimension: ``(dim, mean, std)``, from one vector aggregate."""
    metrics = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(col))
    one = vectors.filter(F.col(col).isNotNull()).select(metrics.alias("s"))
    sample_to_population = (F.col("s.count") - 1) / F.col("s.count")
    moments = F.arrays_zip(
        vector_to_array("s.mean").alias("mean"),
        F.transform(vector_to_array("s.variance"), lambda v: F.sqrt(v * sample_to_population)).alias("std"),
    )
    return one.select(F.posexplode(moments).alias("dim", "m")).select("dim", "m.mean", "m.std")


def class_weights(labels: DataFrame) -> DataFrame:
    """Balanced weight ``n / (classes * n_class)`` per label."""
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(0))  # one row per class
    weight = F.sum("n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n"))
    return sizes.select("label", "n", weight.alias("weight"))


def training_rows(labels: DataFrame, vectors: DataFrame) -> DataFrame:
    """Labelled rows that have a vector.

    Labels are few, so Spark normally broadcasts them from their file size and reads the vectors without a shuffle;
    when they are many it falls back to a shuffle join by itself.
    """
    return labels.select("post_id", "label").join(vectors.select("post_id", "embedding"), "post_id")


def fit_quality(
    training: DataFrame, C: float = 1.0, max_iter: int = 1000, tol: float = 1e-8, balanced: bool = True
) -> LinearModel:
    """L2 logistic regression on standardised vectors with balanced class weights.

    ``training`` has ``label`` (0/1) and ``embedding``. The objective is ``C * sum(w_i * loss_i) + |b|^2 / 2`` on columns
    scaled by their population deviation. Spark's scaler uses the sample deviation; the penalty is rescaled by the
    constant ratio of the two instead of touching the data again.
    """
    rows = training.select(F.col("label").cast("double").alias("label"), array_to_vector("embedding").alias("raw"))
    rows = rows.persist()
    try:
        counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
        n = sum(counts.values())
        if len(counts) != 2:
            raise ValueError("training needs rows of both classes")
        scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(rows)
        weight = F.lit(1.0)
        if balanced:
            weight = F.when(F.col("label") == 1.0, n / (2 * counts[1.0])).otherwise(n / (2 * counts[0.0]))
        rows_fit = rows.coalesce(math.ceil(n / ROWS_PER_FIT_TASK))
        ratio2 = n / (n - 1)  # (sample variance) / (population variance)
        model = LogisticRegression(
            weightCol="weight",
            regParam=1.0 / (C * n) / ratio2,
            elasticNetParam=0.0,
            standardization=False,
            maxIter=max_iter,
            tol=tol,
        ).fit(scaler.transform(rows_fit.withColumn("weight", weight)))
        std = scaler.std.toArray()
        folded = np.divide(model.coefficients.toArray(), std, out=np.zeros_like(std), where=std > 0)
        return LinearModel(folded, float(model.intercept - folded @ scaler.mean.toArray()))
    finally:
        rows.unpersist()


def score_quality(model: LinearModel, df: DataFrame, col: str = "embedding") -> DataFrame:
    """Add ``score``, the probability of label 1. Row-local: the vector can be dropped right after."""
    return df.withColumn("score", sigmoid(linear(F.col(col), model.weights, model.bias)))


def predict(scored: DataFrame) -> DataFrame:
    return scored.withColumn("pred", (F.col("score") > 0.5).cast("int"))


def class_report(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages.

    ``df`` has integer ``label`` and ``pred``. One pass reduces it to at most four counts; the rest is arithmetic on
    those rows. A zero denominator gives 0.
    """
    cells = df.groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n"))

    def cell(label: int, pred: int):
        return F.coalesce(F.sum(F.when((F.col("label") == label) & (F.col("pred") == pred), F.col("n"))), F.lit(0))

    def ratio(a, b):
        return F.when(b == 0, 0.0).otherwise(a / F.when(b != 0, b))

    table = cells.agg(*(cell(i, j).alias(f"n{i}{j}") for i in (0, 1) for j in (0, 1)))
    names = {0: "low quality", 1: "high quality"}
    for c in (0, 1):
        hit, wrong, missed = F.col(f"n{c}{c}"), F.col(f"n{1 - c}{c}"), F.col(f"n{c}{1 - c}")
        table = table.withColumns(
            {f"p{c}": ratio(hit, hit + wrong), f"r{c}": ratio(hit, hit + missed), f"s{c}": hit + missed}
        ).withColumn(f"f{c}", ratio(2 * F.col(f"p{c}") * F.col(f"r{c}"), F.col(f"p{c}") + F.col(f"r{c}")))
    total = F.col("s0") + F.col("s1")

    def macro(m: str):
        return (F.col(f"{m}0") + F.col(f"{m}1")) / 2

    def weighted(m: str):
        return ratio(F.col(f"{m}0") * F.col("s0") + F.col(f"{m}1") * F.col("s1"), total)

    def line(name, p, r, f, s):
        return F.struct(
            F.lit(name).alias("row"), p.alias("precision"), r.alias("recall"), f.alias("f1"), s.alias("support")
        )

    null = F.lit(None).cast("double")
    lines = [line(names[c], F.col(f"p{c}"), F.col(f"r{c}"), F.col(f"f{c}"), F.col(f"s{c}")) for c in (0, 1)]
    lines.append(line("accuracy", null, null, ratio(F.col("n00") + F.col("n11"), total), total))
    lines.append(line("macro avg", macro("p"), macro("r"), macro("f"), total))
    lines.append(line("weighted avg", weighted("p"), weighted("r"), weighted("f"), total))
    return table.select(F.inline(F.array(*lines)))
