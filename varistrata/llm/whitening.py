"""Whitening of embeddings.

Vectors become vectors of whole numbers. The fit list has each different vector once. The covariance comes from one
aggregation: for every pair of dimensions of the upper triangle an SQL expression sums the products of the centred
values. The symmetric matrix is put together and decomposed on the driver by LAPACK: dims x dims numbers, however
many rows there are. Rows are projected where they lie.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varistrata.llm.common import delete_folder, shared_folder, table

#: A coordinate c is the whole number floor(STEPS * c) + SHIFT.
STEPS, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Sums of pairs come to the driver in so many rows at most.
PARTS = 16
#: Deviations beyond this don't fit into a long and are null.
LARGEST = float(2**62)


def whole(vector: Column) -> Column:
    """The vector in whole numbers; null for a null vector and for one with a null or a coordinate that is not finite."""
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return F.when(good, F.transform(vector, lambda c: (F.floor(c.cast("double") * STEPS) + SHIFT).cast("long")))


def triangle(dims: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(dims) for j in range(i, dims)]


def pair_sums(rows: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray]:
    """How many rows, and the matrix of the sums of the products of all pairs of (centred) columns; one aggregation of generated SQL."""
    pairs = triangle(len(columns))
    sums = [F.expr(f"sum(`{columns[i]}` * `{columns[j]}`)").alias(f"s{k}") for k, (i, j) in enumerate(pairs)]
    found = rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("part")).agg(F.count("*").alias("n"), *sums).collect()
    out = np.zeros((len(columns), len(columns)))
    for r in found:
        for k, (i, j) in enumerate(pairs):
            out[i, j] += r[k + 2]
    return sum(r["n"] for r in found), np.triu(out) + np.triu(out, 1).T


@dataclass
class Whitener:
    """What fitting leaves: n and the sums of the fit list, components as columns with their eigenvalues, their shares, and how far whitened data are from the identity."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    @property
    def turns(self) -> np.ndarray:
        """Centred values to whitened ones; NaN for a component without variance."""
        with np.errstate(all="ignore"):
            return np.where(self.varies, self.components / np.sqrt(self.values), np.nan)

    @property
    def varies(self) -> np.ndarray:
        """Components whose eigenvalue is more than rounding."""
        return self.values > len(self.sums) * np.finfo(float).eps * max(self.values.max(initial=0.0), np.finfo(float).tiny)


def centred(dims: int, n: int, sums: Sequence[int]) -> list[Column]:
    """x - S / n of each dimension, from n * x - S in whole numbers, so no digit is lost to the shift."""
    return [((F.col("x")[i] * F.lit(n) - F.lit(sums[i])).cast("double") / F.lit(float(n))).alias(f"c{i}") for i in range(dims)]


def fit(vectors: DataFrame, dims: int, components: int = COMPONENTS) -> Whitener | None:
    """From a DataFrame with a column `x` of whole-number vectors of `dims` coordinates, each of them once; None if there is none."""
    row = vectors.agg(F.count("*"), *[F.sum(F.col("x")[i]) for i in range(dims)]).first()
    n, sums = row[0], [int(v or 0) for v in row[1:]]
    if not n:
        return None
    _, products = pair_sums(vectors.select(*centred(dims, n, sums)), [f"c{i}" for i in range(dims)])
    values, axes = np.linalg.eigh(products / n)
    values, axes = np.maximum(values[::-1], 0.0), axes[:, ::-1]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), range(dims)] < 0, -1.0, 1.0)
    total = float(np.trace(products / n))
    explained = values / total if total > 0 else np.zeros(dims)
    k = min(components, dims)
    out = Whitener(n, sums, axes[:, :k], values[:k], explained[:k])
    kept = np.flatnonzero(out.varies)
    if len(kept):
        # Whitened data have the mean 0, so their products are sums over centred values again.
        turned = projected(vectors.select(F.lit(0).alias("k"), "x"), "k", out).select(*[F.col("_w")[int(j)].alias(f"w{j}") for j in kept])
        m, found = pair_sums(turned, [f"w{j}" for j in kept])
        out.identity_error = float(np.abs(found / m - np.eye(len(kept))).max())
    return out


def projected(rows: DataFrame, key: str, model: Whitener) -> DataFrame:
    """key, _d (exact sum of the squares of n * x - S; null beyond LARGEST) and _w (whitened values, null without variance) of rows with whole-number vectors x."""
    n, sums, turns = model.n, np.array(model.sums, dtype=np.int64), model.turns

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(sums))
            far = n * x - sums
            fits = (far.astype(float) ** 2).sum(axis=1) < LARGEST
            square = np.where(fits, (np.where(fits[:, None], far, 0) ** 2).sum(axis=1), 0)
            w = (far.astype(float) / n) @ turns
            flat = pa.array(w.ravel(), mask=np.isnan(w).ravel())
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * turns.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(square, pa.int64(), mask=~fits), pa.ListArray.from_arrays(ends, flat)], [key, "_d", "_w"])

    return rows.select(F.col(f"`{key}`"), "x").mapInArrow(turn, f"`{key}` {rows.schema[key].dataType.simpleString()}, _d long, _w array<double>")


def whitened(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """key, component (from 1, by falling eigenvalue), n, deviation, whitened, explained, identity_error for each row and component.

    Rows go whose vector is null, has a null or a coordinate that is not finite, or is shorter than the longest good
    one (what it lacks counts as null). Repeated rows and equal vectors count once in the fit and are all returned; null keys
    stay. A component without variance (a single vector, or fewer than there are components) has null as `whitened`
    and doesn't count in identity_error, which is null without any. No good row, or vectors without a coordinate, give
    no rows. Coordinates beyond 2**40 overflow the whole numbers and are an error. Other columns, whatever their names, don't count.
    """
    spark = embeddings.sparkSession
    good = embeddings.select(F.col(f"`{key}`").alias("k"), whole(F.col(f"`{vector}`")).alias("x")).where("x is not null")
    dims = good.agg(F.max(F.size("x"))).first()[0] or 0
    rows = good.where(F.size("x") == dims)
    model = None
    if dims:
        # Read several times, so the distinct vectors are written once; whole numbers of few bits are small in Parquet.
        folder = f"{shared_folder(spark)}/whitening-{uuid.uuid4().hex}"
        rows.groupBy("x").agg(F.lit(1)).select("x").write.parquet(folder)
        model = fit(spark.read.parquet(folder), dims, components)
        delete_folder(spark, folder)
    schema = f"`{key}` {embeddings.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return spark.createDataFrame([], schema)
    told = F.array(*[F.lit(float(e)) for e in model.explained])
    out = projected(rows, "k", model).select("k", "_d", F.posexplode("_w").alias("at", "w"))
    return out.select(
        F.col("k").alias(key), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("_d").alias("deviation"), F.col("w").alias("whitened"),
        told[F.col("at")].alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
