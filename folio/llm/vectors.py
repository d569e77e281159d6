"""Input checks and exact measures shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(embedding: Column) -> Column:
    """False for vectors that are null, empty, zero or hold null or non-finite components."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def vectors_of(table: DataFrame, *more: str) -> DataFrame:
    """``vec_id, embedding`` (and ``more``), a 128-bit content hash ``h1, h2`` and ``usable``.

    Components stay single where they are, since double precision holds them exactly; any others become double.
    """
    kind = "array<float>" if dict(table.dtypes)["embedding"] == "array<float>" else "array<double>"
    out = table.select(table["vec_id"].cast("long").alias("vec_id"), table["embedding"].cast(kind).alias("embedding"), *(table[c] for c in more))
    return out.select(
        "*",
        F.xxhash64("embedding").alias("h1"),
        F.xxhash64(F.lit(1), F.size("embedding"), "embedding").alias("h2"),
        (usable(F.col("embedding")) & F.col("vec_id").isNotNull()).alias("usable"),
    )


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists have one length, in double precision.

    Each is scaled by a power of two to components below 1: no cosine changes, and no square overflows.
    """
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    if not rows.size:
        return rows
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None])


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def groups(batches, *names: str):
    """Runs of rows with equal values in ``names`` from batches sorted by them: ``(values, table)``."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        starts, ends = [0, *change.tolist()], [*change.tolist(), batch.num_rows]
        for i, j in zip(starts, ends, strict=True):
            values = tuple(c[i] for c in columns)
            if now is not None and values != now:
                yield now, pa.Table.from_batches(held).combine_chunks()
                held = []
            now = values
            held.append(batch.slice(i, j - i))
    if held:
        yield now, pa.Table.from_batches(held).combine_chunks()
