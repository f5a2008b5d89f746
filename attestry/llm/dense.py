"""Dense vectors in tasks: packed rows, exact integers and centres fitted on a bounded sample."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers; never null."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def floored(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, in double precision, as array<double>."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale)).cast("double"))


def extent(rows: DataFrame, vector: str) -> tuple[int, int, float]:
    """Rows, longest length and largest absolute component."""
    largest = F.coalesce(F.array_max(F.transform(vector, lambda x: F.abs(x).cast("double"))), F.lit(0.0))
    row = rows.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d"), F.max(largest).alias("m")).first()
    return row["n"], row["d"] or 0, row["m"] or 0.0


def integer_type(largest: float, dims: int) -> np.dtype:
    """The narrowest type that holds the components; refuses those whose sums of dims squared differences pass 53 bits, up to which float products are exact."""
    if dims * (2.0 * largest + 2) ** 2 >= 2.0**53:
        raise ValueError(f"components up to {largest:.4g} after scaling are too large for exact sums over {dims} of them")
    return np.dtype(np.int16 if largest < 2**15 - 1 else np.int32)


def padded(values: pa.Array, dims: int) -> np.ndarray:
    """Lists of numbers as a matrix; shorter ones end in zeros."""
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    length = values.value_lengths().to_numpy(zero_copy_only=False)
    if (length == dims).all():
        return flat.reshape(len(values), dims)
    out = np.zeros((len(values), dims))
    out[np.arange(dims)[None, :] < length[:, None]] = flat
    return out


def as_binary(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary value."""
    data = np.ascontiguousarray(rows)
    width = data.dtype.itemsize * data.shape[1]
    at = np.arange(len(data) + 1, dtype=np.int64) * width
    if at[-1] >= 1 << 31:
        raise ValueError("batch of vectors is too large")
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])


def from_binary(values: pa.Array, dtype: np.dtype, dims: int) -> np.ndarray:
    """The matrix of as_binary()."""
    if not len(values) or not dims:
        return np.zeros((len(values), dims), dtype)
    values = values.cast(pa.binary())
    at = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2], np.uint8)[at[0] : at[-1]].view(dtype).reshape(len(values), dims)


def packed(vector: Column, dtype: np.dtype, dims: int) -> Column:
    """A list column as binary rows of dims components."""

    @F.arrow_udf("binary")
    def run(values: pa.Array) -> pa.Array:
        return as_binary(padded(values, dims).astype(dtype))

    return run(vector)


def fields(batch: pa.RecordBatch, name: str) -> Iterator[pa.StructArray]:
    """The rows packed into each value of a list<struct> column."""
    lists = batch.column(batch.schema.get_field_index(name))
    return (lists[k].values for k in range(len(lists)))


@contextmanager
def small_batches(spark: SparkSession, rows: int, size: str = "64m"):
    """Arrow batches of few rows inside, for rows that hold whole blocks; the session's setting comes back after."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def sample(rows: DataFrame, key: str, n: int, most: int) -> DataFrame:
    """About most of n rows by a hash of their unique key, all of them where there are no more."""
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def nearest(points: np.ndarray, centers: np.ndarray, step: int = 4096) -> np.ndarray:
    """The nearest centre of each point, by floats; of equal ones the first."""
    half = (centers * centers).sum(1) / 2
    return np.concatenate([np.zeros(0, np.int64), *[(half - points[k : k + step] @ centers.T).argmin(1) for k in range(0, len(points), step)]])


def fit_centers(points: np.ndarray, count: int, rounds: int = 5) -> np.ndarray:
    """Centres of a bounded sample by Lloyd's rounds from its first distinct points; an unused one stays."""
    _, first = np.unique(points, axis=0, return_index=True)
    centers = points[np.sort(first)[:count]].astype(np.float64)
    for _ in range(rounds):
        own = nearest(points, centers)
        used, n = np.unique(own, return_counts=True)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, points)
        centers[used] = sums[used] / n[:, None]
    return centers


def cluster_count(n: int, most: int) -> int:
    return max(1, min(most, math.isqrt(n)))
