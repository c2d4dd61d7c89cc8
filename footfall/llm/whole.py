"""Vectors as whole numbers, and matrices of them inside tasks.

Inner products of whole numbers are exact: in doubles while they stay below 2**53, in
64-bit integers beyond. Components that a vector lacks count as zero.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: No score: below every score of two vectors.
NONE = -(2**63)


@dataclass(frozen=True)
class Shape:
    """How many vectors there are, their largest length and component."""

    rows: int
    size: int
    largest: int

    @property
    def kind(self) -> type:
        """The numbers that hold all sums of products exactly."""
        most = 4 * max(self.size, 1) * max(self.largest, 1) ** 2
        if most >= 2**63:
            raise ValueError("inner products of these vectors do not fit into 64 bits")
        return np.float64 if most < 2**53 else np.int64


def finite(vector: Column) -> Column:
    """Whether the vector is there and all its components are finite numbers."""
    every = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(every, F.lit(False))


def whole(vectors: DataFrame, scale: float, *labels: Column) -> DataFrame:
    """``vec_id``, the labels and ``v``, the floor of ``scale`` times each component.

    Rows without ``vec_id``, with a null label or without a finite vector are left out. Of
    rows with one ``vec_id`` the one with the least labels and vector stays.
    """
    raw = F.col("embedding").cast("array<double>")
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), *labels, raw.alias("raw"))
    names = [c for c in own.columns if c not in ("vec_id", "raw")]
    taken = own.filter(finite(F.col("raw"))).dropna(subset=["vec_id", *names]).select(
        "vec_id", F.struct(*names, F.transform("raw", lambda x: F.floor(F.lit(scale) * x)).alias("v")).alias("row")
    )
    return taken.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.*")


def shape(rows: DataFrame) -> Shape:
    found = rows.agg(
        F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)),
        F.coalesce(F.max(F.array_max(F.transform("v", F.abs))), F.lit(0)),
    ).first()
    return Shape(*found)


def drawn(rows: DataFrame, total: int, size: int, most: int, numbers: int = 1 << 19) -> DataFrame:
    """About ``most`` rows by the hash of their id, fewer if they hold more than ``numbers``."""
    most = max(1, min(most, numbers // max(size, 1)))
    share = max(1.25 * most, 64) / max(total, 1)  # that none is drawn is out of the question
    some = rows if share >= 1 else rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return some.limit(most) if total > most else some


def matrix(column: pa.Array, size: int, kind: type) -> np.ndarray:
    """Rows of a list column, padded with zeros to ``size``."""
    rows = len(column)
    counts = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    out = np.zeros((rows, size), dtype=kind)
    out[np.arange(size)[None, :] < counts[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x @ y.T if x.dtype == np.float64 else np.einsum("ij,kj->ik", x, y)


def lists(values: np.ndarray) -> pa.Array:
    """A list column from the rows of a matrix."""
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))


def runs(batch: pa.RecordBatch, names: list[str]) -> list[tuple[int, int]]:
    """Consecutive rows that agree in the named columns, as begin and end."""
    differ = np.zeros(batch.num_rows, dtype=bool)
    differ[0] = True
    for name in names:
        values = batch.column(name).to_numpy(zero_copy_only=False)
        differ[1:] |= values[1:] != values[:-1]
    edges = [*np.flatnonzero(differ).tolist(), batch.num_rows]
    return list(zip(edges, edges[1:], strict=False))
