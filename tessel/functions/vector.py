"""Vector expressions as Spark columns: doubles, null where a length is 0 or unequal."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def hash_values(texts: pa.Array, dim: int) -> pa.Array:
    """The vectors of hash_vector; a text is hashed once, and each place adds its number to a copy of that state."""
    marks, raw = [str(i).encode() for i in range(dim)], []
    for text in texts.to_pylist():
        begun = hashlib.sha256(f"{text}:".encode())
        for mark in marks:
            one = begun.copy()
            one.update(mark)
            raw.append(one.digest()[:4])
    values = np.frombuffer(b"".join(raw), ">u4").reshape(-1, dim) / 4294967295.0 * 2.0 - 1.0
    length = np.sqrt(np.add.accumulate(values * values, axis=1)[:, -1:])  # in order, as a sum over the places
    unit = np.where(length > 0, values / np.where(length > 0, length, 1), values)
    unknown = np.repeat(texts.is_null().to_numpy(zero_copy_only=False), dim)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * dim, pa.int32()), pa.array(unit.ravel(), pa.float64(), mask=unknown))


def hash_vector(text: Column, dim: int) -> Column:
    """A unit vector that depends on the text alone: value i comes from the first four bytes of sha256(text:i)."""

    def run(texts: pa.Array) -> pa.Array:
        return hash_values(texts, dim)

    return F.arrow_udf(run, "array<double>")(text)


def check_dimension(column: Column, dim: int) -> Column:
    """The column itself; the query fails at a vector of another length."""
    said = F.concat(F.lit(f"expected {dim} values, got "), F.size(column).cast("string"))
    return F.when(F.size(column) != dim, F.raise_error(said).cast("array<float>")).otherwise(column.cast("array<float>"))


def check_query(vector, dim: int) -> list[float]:
    values = np.asarray(vector, float)
    if values.shape != (dim,):
        raise ValueError(f"expected {dim} values, got {values.shape}")
    return values.tolist()
