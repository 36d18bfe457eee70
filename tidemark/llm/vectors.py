"""Vectors as nodes: rows with equal vectors are one node; vectors that have no direction are none."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def keyed(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, key, dim, raw) of df: a digest of the vector, its length and its components as floats of the
    column's own width, all null where the vector is null, empty, zero or has a null or non-finite component."""
    kind = df.schema[vector].dataType
    if not isinstance(kind, T.ArrayType):
        raise TypeError(f"{vector} is not an array")
    width = "<f4" if isinstance(kind.elementType, T.FloatType) else "<f8"

    def run(batches):
        for b in batches:
            col = b.column(vector)
            keys, dims, raws = [], [], []
            for x in range(len(col)):
                v = col[x].values
                raw = None
                if v is not None and len(v) and not v.null_count:
                    a = v.to_numpy(zero_copy_only=False).astype(width) + 0
                    raw = a.tobytes() if np.isfinite(a).all() and a.any() else None
                keys.append(raw and hashlib.blake2b(raw, digest_size=16).digest())
                dims.append(raw and len(v))
                raws.append(raw)
            yield pa.RecordBatch.from_arrays([b.column(vec_id).cast(pa.int64()), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(raws, pa.binary())], names=["vec_id", "key", "dim", "raw"])

    return df.select(vec_id, vector).mapInArrow(run, "vec_id long, key binary, dim int, raw binary")


def matrix(raw: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """[rows, dim] in double precision, of components as ``keyed`` gives them"""
    data = b"".join(raw.to_pylist())
    return np.frombuffer(data, dtype="<f4" if len(data) == 4 * dim * len(raw) else "<f8").astype(np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
