"""Vectors floored to integers: what takes part, how they are packed, and which numbers keep their products exact."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shape:
    """length: components of each vector that takes part; most: the largest size among the floored components."""

    length: int
    most: int

    @property
    def stored(self) -> np.dtype:
        """The type that a component is packed as."""
        return np.dtype("<i2" if self.most < 2**15 else "<i4" if self.most < 2**31 else "<i8")

    def numbers(self, times: int) -> type:
        """A type in which sums of `times` products of two components are exact."""
        largest = times * self.most * self.most
        if largest >= 2**63:
            raise ValueError(f"components of size {self.most} are too large: sums of their products don't fit in a long")
        return np.float32 if largest < 2**24 else np.float64 if largest < 2**53 else np.int64


def floored_rows(embeddings: DataFrame, factor: int, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """vec_id, label (as text) and x, floor(factor * component) as longs, of rows whose vector is whole and finite."""
    v = F.col(vector_column)
    finite = F.forall(v, lambda e: F.coalesce(~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < math.inf), F.lit(False)))
    rows = embeddings.where(v.isNotNull() & (F.size(v) > 0) & finite)
    x = F.transform(v, lambda e: F.floor(e.cast("double") * factor).cast("long"))
    return rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("string").alias("label"), x.alias("x"))


def common_shape(rows: DataFrame, divisor: int = 1) -> Shape | None:
    """The most common length that divisor divides, the least among equals; None without rows."""
    size = F.size("x")
    # a component at a long's limits would be as large as its negative doesn't fit
    largest = F.array_max(F.transform("x", lambda e: F.greatest(e, -F.greatest(e, F.lit(-(2**63) + 1)))))
    found = rows.where(size % divisor == 0).groupBy(size.alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(largest).alias("most"))
    first = found.orderBy(F.desc("n"), "d").limit(1).collect()
    return Shape(first[0].d, first[0].most) if first else None


def packed(rows: DataFrame, shape: Shape, columns: Sequence[str]) -> DataFrame:
    """The columns named and x as bytes of shape's stored type, of the rows with shape's length."""
    kinds = dict(rows.dtypes)
    stored = shape.stored

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(stored)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array([r.tobytes() for r in x], pa.binary())], [*columns, "x"])

    held = rows.where(F.size("x") == shape.length).select(*columns, "x")
    return held.mapInArrow(pack, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", x binary")


def matrix(joined: bytes, shape: Shape) -> np.ndarray:
    return np.frombuffer(joined, shape.stored).reshape(-1, shape.length)


def task_numbers() -> Iterator[int]:
    """Numbers that no other task of the job gives out."""
    number = TaskContext.get().partitionId() << 33
    while True:
        yield number
        number += 1
