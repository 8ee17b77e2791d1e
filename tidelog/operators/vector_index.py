"""A persisted approximate index of vectors: cells around centroids, searched from the nearest on.

Centroids are fitted on a bounded sample on the driver (``sample`` rows, the root of all rows as many cells, ``max_cells`` at most). Rows lie
in one Parquet folder a cell, so that a search reads the folders of the cells it visits. How many these are is calibrated on the
sample: as many as hold ``recall`` of its rows' nearest neighbours. Distances are exact on what is read. Vectors that arrived since are
searched beside it as a pending frame, and added by append.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vector import ASCENDING, knn


def _matrix(values) -> np.ndarray:
    return np.asarray([list(v) for v in values], dtype=np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


class VectorIndex:
    """The index in a folder: build(), add(), search(), statistics(), clear(); another session opens it by its path."""

    def __init__(self, spark: SparkSession, path: str, *, id_col: str = "id", vector: str = "embedding") -> None:
        self.spark, self.path, self.id_col, self.vector = spark, path.rstrip("/"), id_col, vector

    def _meta(self) -> dict | None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/meta/_SUCCESS")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return None
        return json.loads(self.spark.read.text(f"{self.path}/meta").first()[0])

    def build(self, vectors: DataFrame, *, metric: str = "cosine", sample: int = 10_000, max_cells: int = 1024, recall: float = 0.95, rounds: int = 10) -> VectorIndex:
        """Index the rows of vectors (id_col, vector, ...), all of one dimension; what was there before goes."""
        rows = vectors.where(F.col(self.vector).isNotNull())
        n = rows.count()
        some = rows if n <= sample else rows.where(F.pmod(F.xxhash64(self.id_col), F.lit(1 << 20)) < int(1.125 * (1 << 20) * sample / n))
        x = _matrix(some.orderBy(F.xxhash64(self.id_col)).limit(sample).select(self.vector).toPandas()[self.vector])
        x = _unit(x) if metric == "cosine" and len(x) else x
        cells = max(1, min(max_cells, int(n**0.5), len(x)))
        rng = np.random.default_rng(5)
        centres = x[rng.choice(len(x), cells, replace=False)] if len(x) else np.zeros((1, 0))
        for _ in range(rounds if len(x) else 0):
            to = self._nearest(x, centres)
            centres = np.asarray([x[to == j].mean(0) if (to == j).any() else centres[j] for j in range(cells)])
        meta = {"metric": metric, "centres": centres.tolist(), "probes": self._probes(x, centres, metric, recall)}
        self.spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{self.path}/meta")
        self._write(rows, meta, "overwrite")
        return self

    @staticmethod
    def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return (x @ centres.T - (centres**2).sum(1) / 2).argmax(1)

    @staticmethod
    def _order(q: np.ndarray, centres: np.ndarray, metric: str) -> np.ndarray:
        """Cells of each query, the most promising first."""
        return np.argsort(-(q @ centres.T - (0 if metric == "dot" else (centres**2).sum(1) / 2)), axis=1, kind="stable")

    def _probes(self, x: np.ndarray, centres: np.ndarray, metric: str, recall: float, k: int = 10, queries: int = 200) -> int:
        if len(x) <= k:
            return len(centres)
        q = x[:queries]
        score = q @ x.T - (0 if metric != "euclidean" else (x**2).sum(1) / 2)
        score[np.arange(len(q)), np.arange(len(q))] = -np.inf
        near = np.argsort(-score, axis=1, kind="stable")[:, :k]
        place = np.argsort(self._order(q, centres, metric), axis=1)
        at = np.sort(np.take_along_axis(place, self._nearest(x, centres)[near], 1).ravel())
        return int(at[min(len(at) - 1, int(np.ceil(recall * len(at))))]) + 1

    def _write(self, rows: DataFrame, meta: dict, mode: str) -> None:
        centres, metric = np.asarray(meta["centres"]), meta["metric"]

        @F.pandas_udf("int")
        def cell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for v in batches:
                x = _matrix(v) if len(v) else np.zeros((0, centres.shape[1]))
                yield pd.Series(VectorIndex._nearest(_unit(x) if metric == "cosine" else x, centres).astype(np.int32))

        rows.withColumn("cell", cell(F.col(self.vector))).repartition("cell", F.pmod(F.xxhash64(self.id_col), F.lit(4))).write.mode(mode).partitionBy("cell").parquet(f"{self.path}/rows")

    def add(self, vectors: DataFrame) -> VectorIndex:
        """Append rows with ids that the index hasn't; cells stay as they are."""
        meta = self._meta()
        if meta is None:
            return self.build(vectors)
        known = self.spark.read.parquet(f"{self.path}/rows").select(self.id_col)
        self._write(vectors.where(F.col(self.vector).isNotNull()).join(known, self.id_col, "left_anti"), meta, "append")
        return self

    def search(self, query: list[float], k: int, *, probes: int | None = None, pending: DataFrame | None = None, where: Column | None = None, tie: list[str] | None = None) -> DataFrame:
        """The k nearest rows found, with distance, among the calibrated number of cells and all of pending."""
        meta = self._meta()
        if meta is None:
            raise ValueError(f"no index at {self.path}")
        q = np.asarray([query], dtype=np.float64)
        order = self._order(_unit(q) if meta["metric"] == "cosine" else q, np.asarray(meta["centres"]), meta["metric"])[0]
        rows = self.spark.read.parquet(f"{self.path}/rows")
        rows = rows.where(F.col("cell").isin([int(c) for c in order[: probes or meta["probes"]]])).drop("cell")
        if pending is not None:
            rows = rows.unionByName(pending.join(rows.select(self.id_col), self.id_col, "left_anti"), allowMissingColumns=True)
        return knn(rows, query, k, meta["metric"], vector=self.vector, where=where, tie=tie or [self.id_col])

    def statistics(self) -> DataFrame:
        """(cell, rows), a row a cell that has any."""
        return self.spark.read.parquet(f"{self.path}/rows").groupBy("cell").agg(F.count(F.lit(1)).alias("rows"))

    def clear(self) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


__all__ = ["ASCENDING", "VectorIndex"]
