"""Vectors of embedding tables as bytes, and groups of equal ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dtype_of(df: DataFrame, column: str) -> np.dtype:
    return np.dtype(np.float32 if isinstance(df.schema[column].dataType.elementType, T.FloatType) else np.float64)


def pack_vectors(df: DataFrame, vector: str, columns: list) -> DataFrame:
    """The columns, dim and vec: each vector's bytes in its own precision. vec is null for a vector that is null, empty, zero or holds a null or non-finite component."""
    kind = dtype_of(df, vector)
    elem = F.transform(F.col(vector), lambda x: x.cast("double" if kind.itemsize == 8 else "float"))
    src = df.select(*columns, elem.alias("__v"))
    head = src.schema[:-1]

    def run(batches):
        for b in batches:
            lists = b.column(b.num_columns - 1)
            vecs, dims = [], []
            for at in range(0, b.num_rows, 2000):
                for x in lists.slice(at, 2000).to_pylist():
                    ok = x is not None and len(x) and None not in x
                    if ok:
                        v = np.array(x, np.float64)
                        n = np.sqrt(v @ v) if np.isfinite(v).all() else 0.0
                        ok = n > 0 and np.isfinite(n)
                    vecs.append(v.astype(kind).tobytes() if ok else None)
                    dims.append(len(x) if ok else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(dims, pa.int32()), pa.array(vecs, pa.binary())], [*b.schema.names[:-1], "dim", "vec"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in head)
    return src.mapInArrow(run, f"{ddl}, dim int, vec binary")


def matrix(blobs: list[bytes], kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]
