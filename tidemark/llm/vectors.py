"""Vector columns as fixed-width binary rows, for numpy inside tasks."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

PACKED = "vec_id long, label string, dim int, node string, vec binary"


def pack_vectors(df: DataFrame, id_col: str, vec_col: str, label_col: str | None = None) -> DataFrame:
    """Usable rows of ``df`` as ``(vec_id, label, dim, node, vec)``.

    ``vec`` holds the vector as little-endian doubles or, for a float column,
    floats; ``node`` is a 128-bit hash of label and vector, equal for equal
    vectors of one label.  Left out: null ids and vectors that are null,
    empty, zero or hold null or non-finite components.
    """
    kind = df.schema[vec_col].dataType.simpleString()
    code = "<f4" if kind == "array<float>" else "<f8"
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    vec = F.col(vec_col).cast("array<float>" if code == "<f4" else "array<double>")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), vec.alias("vec")).where(
        F.col("vec_id").isNotNull() & fine & F.exists("vec", lambda x: x != 0))
    if label_col:
        rows = rows.where(F.col("label").isNotNull())

    def pack(batches):
        for b in batches:
            vecs = b.column("vec")
            flat = vecs.flatten().to_numpy(zero_copy_only=False).astype(code) + 0.0   # no -0.0
            ends = np.concatenate([[0], np.cumsum(vecs.value_lengths().to_numpy())]).astype(int)
            raw = [flat[i:j].astype(code).tobytes() for i, j in zip(ends, ends[1:])]
            labels = b.column("label").to_pylist()
            nodes = [hashlib.blake2b(v, digest_size=16, salt=b"node",
                                     person=hashlib.blake2b(str(x).encode(), digest_size=16).digest()).hexdigest()
                     for v, x in zip(raw, labels)]
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("label"), pa.array(np.diff(ends).astype("int32")),
                 pa.array(nodes), pa.array(raw, pa.binary())], ["vec_id", "label", "dim", "node", "vec"])

    return rows.mapInArrow(pack, PACKED)


def vector_type(df: DataFrame, vec_col: str) -> str:
    return "<f4" if df.schema[vec_col].dataType.simpleString() == "array<float>" else "<f8"


def unpack(column, code: str) -> np.ndarray:
    """A binary Arrow column of equally long vectors as a matrix of doubles."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, code).reshape(len(column), -1).astype("f8")


def unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that very small or large components don't under- or overflow
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
