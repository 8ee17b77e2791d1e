"""The record envelope: eight columns that every topic has, and how names map to tables and fields."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADER = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())])
ENVELOPE = T.StructType(
    [
        T.StructField("_topic", T.StringType(), False),
        T.StructField("_partition", T.IntegerType(), False),
        T.StructField("_offset", T.LongType(), False),
        T.StructField("_timestamp", T.TimestampType(), False),
        T.StructField("_timestamp_type", T.ByteType(), False),
        T.StructField("_key", T.BinaryType(), True),
        T.StructField("_value", T.BinaryType(), False),
        T.StructField("_headers", T.ArrayType(HEADER), True),
    ]
)
KEY = ["_topic", "_partition", "_offset"]
#: The columns that the hot and the cold tier have in common.
UNIFIED = ["_topic", "_partition", "_offset", "_timestamp", "_timestamp_type", "_key", "_value"]


def as_topic(df: DataFrame, topic: str, *, partition: Column, offset: Column, timestamp: Column, key: Column | None = None, value: Column, headers: Column | None = None) -> DataFrame:
    """df as a topic in the envelope's columns and types. A null value becomes empty bytes, as the log stores it."""
    return df.select(
        F.lit(topic).alias("_topic"),
        partition.cast("int").alias("_partition"),
        offset.cast("long").alias("_offset"),
        timestamp.cast("timestamp").alias("_timestamp"),
        F.lit(0).cast("byte").alias("_timestamp_type"),
        (F.lit(None) if key is None else key).cast("binary").alias("_key"),
        F.coalesce(value.cast("binary"), F.lit(b"")).alias("_value"),
        (F.lit(None) if headers is None else headers).cast(T.ArrayType(HEADER)).alias("_headers"),
    )


def table_name(topic: str) -> str:
    """A topic's name as a table's: anything but letters, digits and _ becomes _."""
    return re.sub(r"[^\w]", "_", topic)


def header(name: str) -> Column:
    """Value of the last header of that name, null without one."""
    own = F.filter("_headers", lambda h: h["key"] == name)
    return F.when(F.size(own) > 0, F.element_at(own, -1)["value"])


def headers_map() -> Column:
    """Headers as a map; of repeated names the last value stays."""
    names = F.array_distinct(F.transform("_headers", lambda h: h["key"]))
    last = lambda n: F.element_at(F.filter("_headers", lambda h: h["key"] == n), -1)["value"]
    return F.map_from_arrays(names, F.transform(names, last))


def resolve_field(df: DataFrame, name: str) -> str | None:
    """The column that a query's field name means: itself, with a leading underscore, or without one."""
    for n in (name, f"_{name}", name[1:] if name.startswith("_") else ""):
        if n and n in df.columns:
            return n
    return None


def millis(ts: Column) -> Column:
    return F.unix_millis(ts)
