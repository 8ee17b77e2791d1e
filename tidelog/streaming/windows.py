"""Streaming aggregates over event time, de-duplication and count-triggered rollups, the same code for batch and stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def number(field: str | None, value: str = "_value") -> Column:
    """A field of a JSON value as a double, or the whole value; null where there is none."""
    text = F.col(value).cast("string")
    return (text if field is None else F.get_json_object(text, f"$.{field}")).try_cast("double")


def group_key(fields: list[str], value: str = "_value") -> Column:
    """Fields joined by a colon, ``null`` where one is missing or not a string; ``key`` is the record's key."""
    one = lambda f: F.col("_key").cast("string") if f == "key" else F.try_variant_get(F.try_parse_json(F.col(value).cast("string")), f"$.{f}", "string")
    return F.concat_ws(":", *[F.coalesce(one(f), F.lit("null")) for f in fields])


def aggregate(kind: str, x: Column, ts: Column) -> Column:
    """count, sum (0 without a number), average, min, max (of finite ones), first and last by event time."""
    finite = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    return {
        "count": lambda: F.count(F.lit(1)), "sum": lambda: F.coalesce(F.sum(x), F.lit(0.0)), "average": lambda: F.avg(x),
        "min": lambda: F.min(finite), "max": lambda: F.max(finite), "first": lambda: F.min_by(x, ts), "last": lambda: F.max_by(x, ts),
    }[kind]()


def windowed(events: DataFrame, *, size: str, kinds: dict[str, str], value: Column, ts: str = "_timestamp", step: str | None = None, gap: str | None = None, keys: list[Column] | None = None, watermark: str | None = None, where: Column | None = None) -> DataFrame:
    """(start, end, keys, aggregates) of tumbling windows of size, sliding ones with a step, or sessions that end after a gap.

    On a stream give a watermark (rows later than it are dropped), and for sessions a key. kinds: name -> kind of aggregate.
    """
    df = events if where is None else events.where(where)
    if watermark:
        df = df.withWatermark(ts, watermark)
    if gap:
        w = F.session_window(ts, gap)
    else:
        w = F.window(ts, size, step) if step else F.window(ts, size)
    keys = keys or []
    out = df.groupBy(w.alias("w"), *keys).agg(*[aggregate(kind, value, F.col(ts)).alias(name) for name, kind in kinds.items()])
    rest = [c for c in out.columns if c != "w"]
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *rest)


class Aggregations:
    """Running windowed aggregations by name, each a streaming query into a table in memory."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.queries: dict = {}

    def register(self, name: str, aggregated: DataFrame, *, mode: str = "complete") -> None:
        self.queries[name] = aggregated.writeStream.outputMode(mode).format("memory").queryName(name).start()

    def poll(self, name: str) -> DataFrame:
        self.queries[name].processAllAvailable()
        return self.spark.table(name)

    def remove(self, name: str) -> None:
        self.queries.pop(name).stop()


def dedup_producers(stream: DataFrame, *, ts: str = "_timestamp", delay: str = "10 minutes") -> DataFrame:
    """Each (producer, partition, sequence) once."""
    keys = ["producer_id", "_partition", "sequence"]
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys) if stream.isStreaming else stream.dropDuplicates(keys)


def dedup_content(stream: DataFrame, *, ts: str = "_timestamp", ttl: str = "5 minutes") -> DataFrame:
    """Each content once within a time to live."""
    h = stream.withColumn("_hash", F.sha2("_value", 256))
    out = h.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(["_hash"]) if stream.isStreaming else h.dropDuplicates(["_hash"])
    return out.drop("_hash")


def rollup_stream(events: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """(keys, batch, n) each time n events of a key have come; the state is one counter and one batch number a key."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, batch = state.get if state.exists else (0, 0)
        seen += sum(len(f) for f in frames)
        done = seen // n
        state.update((seen % n, batch + done))
        if done:
            yield pd.DataFrame([(*key, batch + i, n) for i in range(done)], columns=[*keys, "batch", "n"])

    schema = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in keys)
    return events.groupBy(*keys).applyInPandasWithState(step, f"{schema}, batch long, n long", "seen long, batch long", "append", GroupStateTimeout.NoTimeout)


def rate_limited(requests: DataFrame, rate: float, *, ts: str = "_timestamp", key: str = "tenant") -> DataFrame:
    """requests with allowed and retry_after (seconds): a bucket of ``rate`` tokens a key that fills at ``rate`` a second. A batch is
    walked in order of time, a key at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts, kind="stable")
        left, last, allowed, retry = rate, None, [], []
        for t in pdf[ts]:
            if last is not None:
                left = min(rate, left + (t - last).total_seconds() * rate)
            last = t
            ok = left >= 1
            left -= ok
            allowed.append(ok)
            retry.append(0.0 if ok else (1 - left) / rate)
        return pdf.assign(allowed=allowed, retry_after=retry)

    schema = T.StructType([*requests.schema.fields, T.StructField("allowed", T.BooleanType()), T.StructField("retry_after", T.DoubleType())])
    return requests.groupBy(key).applyInPandas(run, schema)
