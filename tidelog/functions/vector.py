"""Vector functions and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Whether a smaller value is nearer.
ASCENDING = {"cosine": True, "euclidean": True, "dot": False}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def vector_distance(a: Column, b: Column, metric: str) -> Column:
    """cosine (1 - cos), euclidean or dot; NaN for different lengths and, with cosine, a zero or empty vector; null for other metrics."""
    if metric not in ASCENDING:
        return F.lit(None).cast("double")
    if metric == "dot":
        value = dot(a, b)
    elif metric == "euclidean":
        value = F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))
    else:
        value = F.coalesce(1 - F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(float("nan")))
    return F.when(F.size(a) != F.size(b), F.lit(float("nan"))).otherwise(value)


def index_distance(a: Column, b: Column, metric: str) -> Column:
    """As the vector index has it: a zero vector's cosine distance is 1."""
    d = vector_distance(a, b, metric)
    return F.when(F.isnan(d) & (F.size(a) == F.size(b)), F.lit(1.0)).otherwise(d) if metric == "cosine" else d


def knn(vectors: DataFrame, query: list[float], k: int, metric: str = "cosine", *, vector: str = "embedding", tie: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """The k rows nearest to query, with distance; filters come before the ranking, so they never shorten the answer."""
    df = vectors if where is None else vectors.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    d = df.withColumn("distance", index_distance(F.col(vector), q, metric)).where(~F.isnan("distance"))
    order = F.asc("distance") if ASCENDING[metric] else F.desc("distance")
    return d.orderBy(order, *(tie or [])).limit(k)


def truncated(v: Column, d: int) -> Column:
    """The first d components."""
    return F.slice(v, 1, d)


def two_phase(vectors: DataFrame, query: list[float], k: int, *, dims: int, factor: int = 5, metric: str = "cosine", vector: str = "embedding", tie: list[str] | None = None) -> DataFrame:
    """k * factor nearest by the first dims components, then the k nearest of them by all."""
    first = knn(vectors.withColumn("_short", truncated(F.col(vector), dims)), query[:dims], k * factor, metric, vector="_short", tie=tie).drop("distance", "_short")
    return knn(first, query, k, metric, vector=vector, tie=tie)


def quantiser(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(low, step) arrays, one row: each component's minimum and 1/255 of its range (1 where all are equal)."""
    parts = vectors.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.min("x").cast("double").alias("lo"), F.max("x").cast("double").alias("hi"))
    one = parts.agg(F.sort_array(F.collect_list(F.struct("i", "lo", "hi"))).alias("p"))  # a row a dimension
    width = lambda x: F.when(x["hi"] == x["lo"], F.lit(1.0)).otherwise(x["hi"] - x["lo"])
    return one.select(F.transform("p", lambda x: x["lo"]).alias("low"), F.transform("p", lambda x: width(x) / 255).alias("step"))


def quantise(v: Column, low: Column, step: Column) -> Column:
    """Components as integers from 0 to 255."""
    scaled = F.zip_with(F.zip_with(v, low, lambda x, l: x.cast("double") - l), step, lambda x, s: F.floor(x / s))
    return F.transform(scaled, lambda x: F.greatest(F.lit(0), F.least(F.lit(255), x)).cast("int"))


def dequantise(q: Column, low: Column, step: Column) -> Column:
    return F.zip_with(F.zip_with(q, step, lambda x, s: x * s), low, lambda x, l: x + l)


def asymmetric_distance(query: list[float], codes: Column, low: Column, step: Column, metric: str) -> Column:
    """Distance of a query as it is to a vector kept as codes: only the kept side is rounded."""
    return index_distance(dequantise(codes, low, step), F.array(*[F.lit(float(x)) for x in query]), metric)


def embed(df: DataFrame, text: str, embedder: Callable[[list[str]], list[list[float]]], *, batch: int = 64, out: str = "embedding") -> DataFrame:
    """df with vectors of a column's texts from any embedder, batch by batch."""

    @F.pandas_udf("array<float>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            values = t.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(values), batch) for v in embedder(values[i : i + batch])])

    return df.withColumn(out, run(F.col(text)))


def rerank(df: DataFrame, query: str, text: str, scorer: Callable[[str, list[str]], list[float]], top_k: int) -> DataFrame:
    """The top_k rows by a scorer of (query, texts); it decides last."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(scorer(query, texts.fillna("").tolist()), dtype="float64")

    return df.withColumn("rerank_score", run(F.col(text))).orderBy(F.desc("rerank_score")).limit(top_k)


def add_vectors(base: DataFrame, new: DataFrame, keys: list[str], order: str, vector: str = "embedding", dims: int | None = None) -> DataFrame:
    """base and the rows of new with other keys, of repeats in new the first by order; wrong dimensions raise."""
    if dims is not None:
        from ..sources.sinks import check_dimension

        new = new.withColumn(vector, check_dimension(F.col(vector), dims))
    w = Window.partitionBy(*keys).orderBy(order)
    first = new.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return base.unionByName(first.join(base.select(*keys), keys, "left_anti"))
