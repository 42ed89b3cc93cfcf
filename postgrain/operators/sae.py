"""Sparse autoencoder: parallel training, encoding, losses, and the probes around it."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postgrain.functions.vectors import affine, subtract
from postgrain.operators.lift import DEAD_DENSITY
from postgrain.session import stage

# Training defaults and the optimiser's constants.
FEATURES, L1, LEARNING_RATE, EPOCHS, BATCH, SEED = 64, 0.05, 1e-3, 600, 128, 42
WORKERS = 8  # models that are trained side by side and averaged
CHUNK = 4096  # vectors that a worker trains on at a time
BETA1, BETA2, ADAM_EPS, NORM_FLOOR = 0.9, 0.999, 1e-8, 1e-8

NAMES = ("W_enc", "b_enc", "W_dec", "b_dec")
WEIGHT_SCHEMA = "param string, row int, values array<double>"


@dataclass
class Sae:
    """Weights by name. ``W_enc`` and ``W_dec`` both have one row per feature (the decoder is kept transposed)."""

    params: dict[str, np.ndarray]

    @staticmethod
    def initial(dim: int, features: int = FEATURES, seed: int = SEED) -> Sae:
        """Uniform encoder within one over the root of the width, unit Gaussian decoder directions, zero biases."""
        rng = np.random.default_rng(seed)
        bound = 1.0 / math.sqrt(dim)
        decoder = rng.standard_normal((features, dim))
        return Sae(
            {
                "W_enc": rng.uniform(-bound, bound, (features, dim)),
                "b_enc": np.zeros((1, features)),
                "W_dec": unit_rows(decoder),
                "b_dec": np.zeros((1, dim)),
            }
        )

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(p, i, v.tolist()) for p in NAMES for i, v in enumerate(self.params[p])]
        return spark.createDataFrame(rows, WEIGHT_SCHEMA)

    @staticmethod
    def from_frame(df: DataFrame) -> Sae:
        """Read a weight table; its size is the model's, not the data's."""
        rows = df.orderBy("param", "row").collect()
        return Sae({p: np.array([r["values"] for r in rows if r.param == p]) for p in NAMES})


def unit_rows(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), NORM_FLOOR)


def _gradients(p: dict[str, np.ndarray], x: np.ndarray, l1: float) -> tuple[dict[str, np.ndarray], float]:
    """Gradients of mean squared reconstruction error plus ``l1`` times mean activation; and the former."""
    f = np.maximum(x @ p["W_enc"].T + p["b_enc"], 0.0)
    error = f @ p["W_dec"] + p["b_dec"] - x
    d_out = 2.0 * error / len(x)
    d_pre = (d_out @ p["W_dec"].T + l1 / len(x)) * (f > 0)
    grads = {
        "W_enc": d_pre.T @ x,
        "b_enc": d_pre.sum(0, keepdims=True),
        "W_dec": f.T @ d_out,
        "b_dec": d_out.sum(0, keepdims=True),
    }
    return grads, float((error**2).sum(1).mean())


def _train_chunk(x: np.ndarray, state: dict, step: int, epochs: range, cfg: dict, rng: np.random.Generator) -> list[tuple[int, float, float]]:
    """Adam over shuffled mini-batches, in place on ``state``; decoder rows are made unit length after every step.

    A step works on all parameters as one array, of which those in ``state`` become views.
    """
    flat = {kind: np.concatenate([params[k].ravel() for k in NAMES]) for kind, params in state.items()}
    ends = np.cumsum([state["w"][k].size for k in NAMES])
    for kind, params in state.items():
        params |= {k: v.reshape(params[k].shape) for k, v in zip(NAMES, np.split(flat[kind], ends[:-1]))}
    w, m, s = flat["w"], flat["m"], flat["s"]
    part, root = np.empty_like(w), np.empty_like(w)
    history = []
    for epoch in epochs:
        order = rng.permutation(len(x))
        recon = 0.0
        for start in range(0, len(x), cfg["batch"]):
            grads, loss = _gradients(state["w"], x[order[start : start + cfg["batch"]]], cfg["l1"])
            g = np.concatenate([grads[k].ravel() for k in NAMES])
            step += 1
            rate = cfg["lr"] * math.sqrt(1 - BETA2**step) / (1 - BETA1**step)
            eps = ADAM_EPS * math.sqrt(1 - BETA2**step)
            m *= BETA1
            m += np.multiply(g, 1 - BETA1, out=part)
            s *= BETA2
            np.multiply(g, 1 - BETA2, out=part)
            part *= g
            s += part
            np.sqrt(s, out=root)
            root += eps
            np.multiply(m, rate, out=part)
            part /= root
            w -= part
            state["w"]["W_dec"][:] = unit_rows(state["w"]["W_dec"])
            recon += loss
        history.append((epoch, recon, _active(x, state["w"]) if cfg.get("densities", True) else 0.0))
    return history


def _active(x: np.ndarray, w: dict[str, np.ndarray]) -> float:
    return float((x @ w["W_enc"].T + w["b_enc"] > 0).sum())


def _chunks(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each worker's vectors in pieces of ``rows``, however the stream is cut; workers follow each other."""
    of, held = -1, np.zeros((0, 0))
    for batch in batches:
        for worker, part in batch.groupby("worker", sort=True):
            if worker != of and len(held):
                yield of, held
                held = held[:0]
            new = np.stack(part["x"].to_numpy()).astype(np.float64)
            of, held = worker, np.concatenate([held, new]) if len(held) else new
            while len(held) >= rows:
                yield of, held[:rows]
                held = held[rows:]
    if len(held):
        yield of, held


def sae_vectors(diffs: DataFrame, workers: int = WORKERS, key: str = "pair_id", col: str = "diff") -> DataFrame:
    """The vectors as training reads them, in the shared folder: a worker by the hash of the key, and an order."""
    worker = F.pmod(F.xxhash64(key), F.lit(workers)).cast("int").alias("worker")
    return stage(diffs.select(worker, F.xxhash64(key, F.lit(1)).alias("place"), F.col(col).cast("array<float>").alias("x")))


def sae_fit(
    diffs: DataFrame,
    features: int = FEATURES,
    l1: float = L1,
    lr: float = LEARNING_RATE,
    epochs: int = EPOCHS,
    batch: int = BATCH,
    seed: int = SEED,
    local_epochs: int = 10,
    workers: int = WORKERS,
    chunk: int = CHUNK,
    key: str = "pair_id",
    col: str = "diff",
    vectors: DataFrame | None = None,
    densities: bool = True,
) -> tuple[Sae, DataFrame]:
    """Train on unit vectors; returns the weights and the history ``(epoch, recon, density)``.

    Data-parallel in the same way at every size: a vector belongs to one of ``workers`` by the hash of its key. Every round
    each worker reads its vectors once, in chunks of ``chunk`` rows, and trains ``local_epochs`` epochs on each chunk in
    turn, from the current weights; so a task holds one chunk, however many vectors there are. Spark averages weights and
    optimiser moments by row count, and only the averaged model (its size is fixed) comes back to the driver. The result
    depends on the number of workers, never on partitions or cores. A lost task is repeated from the written table with
    the same seed. In the history the last epoch of each round has the density of the averaged model, others that of the
    workers' own weights; ``recon`` is the loss while training. ``vectors`` from ``sae_vectors`` spare the writing;
    without ``densities``, which need all vectors once more an epoch, those of the history are null.
    """
    spark = diffs.sparkSession
    data = vectors if vectors is not None else sae_vectors(diffs, workers, key, col)
    sizes = data.groupBy("worker").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("dim")).collect()  # a row per worker
    if not sizes:
        raise ValueError("no vectors to train on")
    n, dim = sum(r.n for r in sizes), max(r.dim for r in sizes)
    # About one worker a partition; where two meet they follow each other.
    data = data.repartitionByRange(workers, "worker").sortWithinPartitions("worker", "place", "x").select("worker", "x").persist()

    model = Sae.initial(dim, features, seed)
    zeros = {k: np.zeros_like(v) for k, v in model.params.items()}
    state = {"w": model.params, "m": zeros, "s": zeros}
    cfg = {"l1": l1, "lr": lr, "batch": batch, "chunk": chunk, "seed": seed, "densities": densities}
    steps_per_epoch = math.ceil(math.ceil(n / len(sizes)) / batch)
    history: dict[int, list[float]] = {}
    try:
        for first in range(0, epochs, local_epochs):
            span = range(first, min(first + local_epochs, epochs))
            state, recorded, before = _round(data, state, first * steps_per_epoch, span, cfg)
            state["w"]["W_dec"] = unit_rows(state["w"]["W_dec"])
            if first:
                history[first - 1][1] = before
            history |= {epoch: [recon, active] for epoch, recon, active in recorded}
        if history and densities:
            history[epochs - 1][1] = _round(data, state, 0, range(epochs, epochs), cfg)[2]
    finally:
        data.unpersist()
    rows = [(epoch, recon, active / (n * features) if densities else None) for epoch, (recon, active) in sorted(history.items())]
    return Sae(state["w"]), spark.createDataFrame(rows, "epoch int, recon double, density double")


def _round(data: DataFrame, state: dict, step: int, span: range, cfg: dict) -> tuple[dict, list[tuple[int, float, float]], float]:
    """One round on all workers: the averaged state, the summed history, and how often ``state`` itself is active."""
    shared = data.sparkSession.sparkContext.broadcast(state)  # the size of the model

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given = shared.value
        for worker, pieces in groupby(_chunks(batches, cfg["chunk"]), key=lambda piece: piece[0]):
            own = {kind: {k: v.copy() for k, v in params.items()} for kind, params in given.items()}
            recorded, before, n, taken = {}, 0.0, 0, step
            for k, (_, x) in enumerate(pieces):
                before, n = before + (_active(x, given["w"]) if cfg.get("densities", True) else 0.0), n + len(x)
                rng = np.random.default_rng([cfg["seed"], span.start, worker, k])
                for epoch, recon, active in _train_chunk(x, own, taken, span, cfg, rng):
                    recorded[epoch] = recorded.get(epoch, 0.0) + np.array([recon, active])
                taken += len(span) * math.ceil(len(x) / cfg["batch"])
            rows = [(f"{kind}.{k}", i, v, float(n)) for kind, params in own.items() for k, matrix in params.items() for i, v in enumerate(matrix)]
            rows += [("history", epoch, values, 1.0) for epoch, values in recorded.items()] + [("before", 0, np.array([before]), 1.0)]
            yield pd.DataFrame(rows, columns=["param", "row", "v", "weight"])

    out = data.mapInPandas(train, "param string, row int, v array<double>, weight double")
    mean = Summarizer.mean(array_to_vector("v"), F.col("weight"))
    merged = out.groupBy("param", "row").agg(vector_to_array(mean).alias("v"), F.count(F.lit(1)).alias("workers"))
    rows = sorted(merged.collect(), key=lambda r: (r.param, r.row))  # the size of the model
    shared.destroy()
    new = {kind: {k: np.array([r.v for r in rows if r.param == f"{kind}.{k}"]) for k in NAMES} for kind in ("w", "m", "s")}
    before = next(r.v[0] * r.workers for r in rows if r.param == "before")
    return new, [(r.row, r.v[0] * r.workers, r.v[1] * r.workers) for r in rows if r.param == "history"], before


def sae_encode(df: DataFrame, sae: Sae, col: str = "diff") -> DataFrame:
    """Add ``activations``, the clipped encoder outputs."""
    p = sae.params
    return df.withColumn("activations", affine(F.col(col), p["W_enc"], p["b_enc"][0], positive=True))


def sae_losses(encoded: DataFrame, sae: Sae, l1: float = L1, col: str = "diff") -> DataFrame:
    """One row: mean squared reconstruction error, mean activation sum, their weighted total, and density."""
    p = sae.params
    recon = affine(F.col("activations"), p["W_dec"].T, p["b_dec"][0])
    error = subtract(recon, F.col(col))
    squares = F.aggregate(error, F.lit(0.0), lambda s, x: s + x * x)
    per_row = encoded.select(
        squares.alias("recon"),
        F.aggregate("activations", F.lit(0.0), lambda s, x: s + x).alias("sparsity"),
        F.size(F.filter("activations", lambda x: x > 0)).alias("active"),
        F.size("activations").alias("features"),
    )
    means = per_row.agg(
        F.avg("recon").alias("recon"),
        F.avg("sparsity").alias("sparsity"),
        (F.sum("active") / F.sum("features")).alias("density"),
    )
    return means.select("recon", "sparsity", (F.col("recon") + l1 * F.col("sparsity")).alias("loss"), "density")


def axis_probe(diffs: DataFrame, axes: Sequence[str], max_iter: int = 100, col: str = "diff") -> DataFrame:
    """Accuracy of a multinomial logistic regression that reads the axis off a normalised difference vector."""
    index = F.array_position(F.array(*(F.lit(a) for a in axes)), F.col("axis")) - 1
    rows = diffs.select(index.cast("double").alias("label"), array_to_vector(col).alias("features")).filter("label >= 0")
    rows = rows.persist()
    try:
        model = LogisticRegression(family="multinomial", maxIter=max_iter).fit(rows)
        hit = F.avg((F.col("prediction") == F.col("label")).cast("double"))
        return stage(model.transform(rows).agg(F.count(F.lit(1)).alias("pairs"), hit.alias("accuracy")))
    finally:
        rows.unpersist()


def l1_sweep(diffs: DataFrame, l1s: Sequence[float], col: str = "diff", key: str = "pair_id", workers: int = WORKERS, **fit) -> DataFrame:
    """Train once per coefficient on vectors written once: ``(l1, features, dead, density)``."""
    found, vectors = None, sae_vectors(diffs, workers, key, col)
    for l1 in l1s:
        sae, _ = sae_fit(diffs, l1=l1, workers=workers, vectors=vectors, densities=False, **fit)
        acts = sae_encode(diffs.select(col), sae, col).select(F.posexplode("activations").alias("feature", "value"))
        density = acts.groupBy("feature").agg(F.avg((F.col("value") > 0).cast("double")).alias("density"))
        row = density.agg(
            F.lit(float(l1)).alias("l1"),
            F.count(F.lit(1)).alias("features"),
            F.count_if(F.col("density") < DEAD_DENSITY).alias("dead"),
            F.avg("density").alias("density"),
        )
        found = row if found is None else found.unionByName(row)
    return found
