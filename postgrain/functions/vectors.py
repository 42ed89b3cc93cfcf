"""Vector column expressions on ``array<float>`` / ``array<double>`` columns.

Element-wise work uses Spark's higher-order functions. Products with a dense weight matrix go through Arrow in one
matrix multiplication per record batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def negate(v: Column) -> Column:
    return F.transform(v, lambda x: -x)


def scale(v: Column, factor: Column) -> Column:
    return F.transform(v, lambda x: x * factor)


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def batch_matrix(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Valid rows of a list array as a float64 matrix, and the mask of valid rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    valid = np.asarray(col.is_valid())
    flat = col.drop_null().flatten().to_numpy(zero_copy_only=False)
    if flat.size != int(valid.sum()) * width:
        raise ValueError(f"expected vectors of {width} values")
    return flat.reshape(-1, width).astype(np.float64), valid


def matrix_list(rows: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Rows of ``rows`` as a list array, with nulls where ``valid`` is false."""
    sizes = np.where(valid, rows.shape[1], 0)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = pa.array(rows.reshape(-1))
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(~valid))


def affine(v: Column, weights: np.ndarray, bias: np.ndarray, positive: bool = False) -> Column:
    """``weights @ v + bias`` per row, with ``weights`` of shape (outputs, width); ``positive`` clips at zero."""
    matrix = np.asarray(weights, dtype=np.float64).T.copy()
    shift = np.asarray(bias, dtype=np.float64)

    @F.arrow_udf("array<double>")
    def apply(col: pa.Array) -> pa.Array:
        x, valid = batch_matrix(col, matrix.shape[0])
        y = x @ matrix + shift
        return matrix_list(np.maximum(y, 0.0) if positive else y, valid)

    return apply(v)


def linear(v: Column, weights: np.ndarray, bias: float) -> Column:
    """``weights . v + bias`` per row as one double."""
    w = np.asarray(weights, dtype=np.float64)

    @F.arrow_udf("double")
    def apply(col: pa.Array) -> pa.Array:
        x, valid = batch_matrix(col, w.shape[0])
        out = np.zeros(len(valid))
        out[valid] = x @ w + bias
        return pa.array(out, mask=~valid)

    return apply(v)
