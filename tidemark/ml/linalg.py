"""Matrices as DataFrames: (i, j, v) entries, or rows with an array column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sparse product: entries meet on the inner index and are summed with partial aggregation."""
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("_a"))
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("_b"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("v"))


def to_indexed_rows(m: DataFrame, size: int) -> DataFrame:
    """(i, row): a dense row of ``size`` columns; sums per column need no list per row."""
    cells = [F.coalesce(F.sum(F.when(F.col("j") == j, F.col("v"))), F.lit(0.0)) for j in range(size)]
    return m.groupBy("i").agg(F.array(*cells).alias("row"))


def gramian(df: DataFrame, column: str) -> DataFrame:
    """(i, j, v) of X'X for rows in an array column of one length.

    Each task multiplies its own rows and gives one d x d block, so what is shuffled depends on
    the number of tasks and columns, not on the number of rows.
    """
    def blocks(batches):
        total = None
        for batch in batches:
            rows = batch.column(0)
            if len(rows) == 0:
                continue
            x = np.asarray(rows.flatten(), dtype=np.float64).reshape(len(rows), -1)
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            d = len(total)
            i, j = np.divmod(np.arange(d * d), d)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "v"])

    rows = df.where(F.col(column).isNotNull()).select(F.col(column).cast("array<double>"))
    return rows.mapInArrow(blocks, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def column_sums(df: DataFrame, column: str) -> DataFrame:
    """(j, n, s, lowest, highest, nonzero, absolute, squares) of every column of the rows."""
    long = df.select(F.posexplode(F.col(column).cast("array<double>")).alias("j", "x"))
    return long.groupBy("j").agg(
        F.count("*").alias("n"), F.sum("x").alias("s"), F.min("x").alias("lowest"), F.max("x").alias("highest"),
        F.sum(F.when(F.col("x") != 0, 1).otherwise(0)).alias("nonzero"), F.sum(F.abs("x")).alias("absolute"),
        F.sum(F.col("x") * F.col("x")).alias("squares"))


def correlation(df: DataFrame, column: str) -> DataFrame:
    """(i, j, v): Pearson matrix from the Gramian and the column sums."""
    sums = column_sums(df, column).select("j", "n", "s", "squares")
    a = sums.select(F.col("j").alias("i"), F.col("s").alias("_si"), F.col("squares").alias("_qi"))
    b = sums.select("j", "n", F.col("s").alias("_sj"), F.col("squares").alias("_qj"))
    joined = gramian(df, column).join(a, "i").join(b, "j")
    n = F.col("n")
    top = n * F.col("v") - F.col("_si") * F.col("_sj")
    below = F.sqrt(n * F.col("_qi") - F.col("_si") * F.col("_si")) * F.sqrt(n * F.col("_qj") - F.col("_sj") * F.col("_sj"))
    return joined.select("i", "j", (top / below).alias("v"))


def dense(entries: DataFrame, size: int) -> np.ndarray:
    """A small square matrix on the driver: size * size entries."""
    out = np.zeros((size, size))
    rows = entries.limit(size * size + 1).collect()  # one more than fits, to see that it doesn't
    if len(rows) > size * size or any(r.i >= size or r.j >= size for r in rows):
        raise ValueError(f"the entries don't fit in a {size} x {size} matrix")
    for r in rows:
        out[r.i, r.j] = r.v
    return out


def svd(df: DataFrame, column: str, size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest k singular values and right vectors of a tall matrix, by its Gramian."""
    values, vectors = np.linalg.eigh(dense(gramian(df, column), size))
    order = np.argsort(values)[::-1][:k]
    return np.sqrt(np.maximum(values[order], 0)), vectors[:, order]


def times_local(df: DataFrame, column: str, matrix: np.ndarray, name: str) -> DataFrame:
    """Rows times a small local matrix, in Arrow batches."""
    fields = [f for f in df.schema.fields if f.name != column]
    from pyspark.sql import types as T

    schema = T.StructType([*fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    ordered = df.select(*[f.name for f in fields], F.col(column).cast("array<double>"))

    def run(batches):
        for b in batches:
            rows = b.column(len(fields))
            x = np.asarray(rows.flatten(), dtype=np.float64).reshape(len(rows), -1) @ matrix
            product = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * matrix.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(fields))], product], names=[f.name for f in schema.fields])

    return ordered.mapInArrow(run, schema)
