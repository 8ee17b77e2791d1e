"""Bucket and metric aggregations of search requests."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTERVAL_MS = {"1m": 60_000, "minute": 60_000, "1h": 3_600_000, "hour": 3_600_000, "1d": 86_400_000, "day": 86_400_000, "1w": 604_800_000, "week": 604_800_000}


def terms(df: DataFrame, field: str, *, size: int = 10, min_doc_count: int = 1, order: dict[str, str] | None = None) -> DataFrame:
    """(key, doc_count) of the commonest values, ties by key; of an array each value counts."""
    col = F.explode(field) if isinstance(df.schema[field].dataType, T.ArrayType) else F.col(field)
    counts = df.select(col.alias("key")).where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("doc_count")).where(F.col("doc_count") >= min_doc_count)
    by = [F.desc("doc_count"), F.asc("key")]
    if order:
        by = [F.col({"_key": "key", "_count": "doc_count"}[k]).asc() if how == "asc" else F.col({"_key": "key", "_count": "doc_count"}[k]).desc() for k, how in order.items()] + [F.asc("key")]
    return counts.orderBy(*by).limit(size)


def stats(df: DataFrame, field: str) -> DataFrame:
    """count, min, max, avg, sum; 0 where there is nothing."""
    c = F.col(field).cast("double")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return df.agg(F.count(c).alias("count"), zero(F.min(c)).alias("min"), zero(F.max(c)).alias("max"), zero(F.avg(c)).alias("avg"), zero(F.sum(c)).alias("sum"))


def value_count(df: DataFrame, field: str, *, strict: bool = False) -> DataFrame:
    return df.agg((F.count(field) if strict else F.count(F.lit(1))).alias("value"))


def cardinality(df: DataFrame, field: str, *, approximate: bool = False) -> DataFrame:
    return df.agg((F.approx_count_distinct(field) if approximate else F.countDistinct(field)).alias("value"))


def date_histogram(df: DataFrame, field: str, interval: str) -> DataFrame:
    """(key_ms, key, doc_count) of buckets that have rows, in order."""
    size = INTERVAL_MS[interval]
    ms = F.floor(F.unix_millis(F.col(field).cast("timestamp")) / size) * size
    out = df.where(F.col(field).isNotNull()).groupBy(ms.alias("key_ms")).agg(F.count(F.lit(1)).alias("doc_count"))
    return out.select("key_ms", F.date_format(F.timestamp_millis("key_ms"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("key"), "doc_count").orderBy("key_ms")


def range_buckets(df: DataFrame, field: str, ranges: list[dict[str, Any]]) -> DataFrame:
    """(key, doc_count) of [from, to), which may overlap, in one pass."""
    c = F.col(field).cast("double")
    names, sums = [], []
    for r in ranges:
        low, high = r.get("from"), r.get("to")
        names.append(r.get("key") or f"{'*' if low is None else float(low)}-{'*' if high is None else float(high)}")
        inside = F.lit(True) if low is None else c >= float(low)
        inside = inside if high is None else inside & (c < float(high))
        sums.append(F.count(F.when(inside & c.isNotNull(), 1)))
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), s.alias("doc_count")) for n, s in zip(names, sums, strict=True)])
    return df.agg(pairs.alias("b")).select(F.inline("b"))


def metric(df: DataFrame, kind: str, field: str) -> DataFrame:
    return df.agg({"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max}[kind](F.col(field).cast("double")).alias("value"))


def aggregate(df: DataFrame, request: dict[str, Any]) -> dict[str, DataFrame]:
    """Frames by name of a request's aggregations; unknown kinds are errors."""
    out = {}
    for name, spec in request.items():
        ((kind, body),) = spec.items()
        if kind in ("avg", "sum", "min", "max"):
            out[name] = metric(df, kind, body["field"])
        elif kind == "terms":
            out[name] = terms(df, body["field"], size=body.get("size", 10), min_doc_count=body.get("min_doc_count", 1), order=body.get("order"))
        elif kind == "date_histogram":
            out[name] = date_histogram(df, body["field"], body.get("interval") or body["fixed_interval"])
        elif kind == "range":
            out[name] = range_buckets(df, body["field"], body["ranges"])
        elif kind in ("stats", "value_count", "cardinality"):
            out[name] = {"stats": stats, "value_count": value_count, "cardinality": cardinality}[kind](df, body["field"])
        else:
            raise ValueError(f"unknown aggregation {kind!r}")
    return out
