"""Ways into the log and its tables: schema inference, typed JSON columns, partitioned writes, offsets, indexing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.json import type_name
from ..model import KEY
from .catalog import time_key

MAX_FIELDS = 64
SAMPLE = 100


def infer_json(values: DataFrame, column: str = "_value", *, max_fields: int = MAX_FIELDS, sample: int | None = SAMPLE, order: list[str] | None = None) -> DataFrame:
    """(name, type, nullable, n) of the top-level fields of JSON objects in column, most frequent first.

    Integers and floats widen to float64, other conflicts to string, null counts as string; objects and arrays stay
    JSON text. The first ``sample`` rows by ``order`` are looked at (None: all rows).
    """
    df = values
    if sample is not None:
        df = (df.orderBy(*order) if order else df).limit(sample)
    v = df.select(F.try_parse_json(F.col(column).cast("string")).alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    n = v.agg(F.count(F.lit(1)).alias("total"))
    fields = v.sparkSession.sql("SELECT e.key AS name, e.value AS value FROM {v} AS t, LATERAL variant_explode(t.v) AS e", v=v)
    kinds = fields.select("name", type_name(F.col("value")).alias("t")).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.collect_set("t").alias("ts"))
    one = F.element_at("ts", 1)
    numeric = F.forall("ts", lambda t: t.isin("int64", "float64"))
    kinds = kinds.withColumn("type", F.when(F.size("ts") == 1, one).when(numeric, "float64").otherwise("string"))
    return kinds.crossJoin(F.broadcast(n)).select("name", "type", (F.col("n") < F.col("total")).alias("nullable"), "n").orderBy(F.desc("n"), "name").limit(max_fields)


SPARK_TYPES = {"string": "string", "int64": "long", "float64": "double", "boolean": "boolean"}


def schema_text(fields: list[tuple[str, str, bool]]) -> str:
    """``name:type,name:type?`` of (name, type, nullable)."""
    return ",".join(f"{n}:{t}{'?' if null else ''}" for n, t, null in fields)


def parse_schema(text: str) -> list[tuple[str, str, bool]]:
    out = []
    for part in filter(None, text.split(",")):
        name, _, kind = part.rpartition(":")
        null = kind.endswith("?")
        if not name or kind.rstrip("?") not in SPARK_TYPES:
            raise ValueError(f"not a field: {part!r}")
        out.append((name, kind.rstrip("?"), null))
    return out


def with_json_columns(df: DataFrame, fields: list[tuple[str, str, bool]], column: str = "_value") -> DataFrame:
    """df with a typed column for each field; absent, null and wrongly typed values are null, objects and arrays JSON text."""
    df = df.withColumn("_v", F.try_parse_json(F.col(column).cast("string")))
    for name, kind, _ in fields:
        part = F.try_variant_get("_v", f"$['{name}']", "variant")
        t = type_name(part)
        if kind == "string":
            value = F.when(t == "string", F.coalesce(F.try_variant_get(part, "$", "string"), F.to_json(part)))
            value = F.when(F.schema_of_variant(part) == "VOID", None).otherwise(value)
        else:
            ok = t.isin("int64", "float64") if kind == "float64" else t == kind
            value = F.when(ok, F.try_variant_get(part, "$", SPARK_TYPES[kind]))
        df = df.withColumn(name, value)
    return df.drop("_v")


def check_dimension(vector: Column, d: int) -> Column:
    """vector, if null or of d components; other rows raise."""
    return F.when(vector.isNull() | (F.size(vector) == d), vector).otherwise(F.raise_error(F.concat(F.lit(f"expected {d} dimensions, got "), F.size(vector).cast("string"))).cast("array<float>"))


def write_segments(df: DataFrame, path: str, *, unit: str | None = None, codec: str = "zstd", bloom: list[str] | None = None, row_group_bytes: int | None = None, mode: str = "append", file_rows: int = 5_000_000) -> None:
    """Parquet files by topic, partition and, if asked for, hour or day, sorted by offset within a file; a busy partition is dealt to
    a task for every file_rows offsets."""
    by = ["_topic", "_partition"] + ([unit] if unit else [])
    if unit:
        df = df.withColumn(unit, time_key(unit))
    out = df.repartition(*by, F.floor(F.col("_offset") / file_rows)).sortWithinPartitions(*by, "_offset").write.mode(mode).option("compression", codec).option("maxRecordsPerFile", file_rows).partitionBy(*by)
    for c in bloom or []:
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
    if row_group_bytes:
        out = out.option("parquet.block.size", row_group_bytes)
    out.parquet(path)


def assign_offsets(batch: DataFrame, base: DataFrame, order: list[str]) -> DataFrame:
    """batch (_topic, _partition, ...) with _offset: the partition's next one (base: _topic, _partition, next_offset), then on."""
    w = Window.partitionBy("_topic", "_partition").orderBy(*order)
    return batch.withColumn("_rn", F.row_number().over(w) - 1).join(base, ["_topic", "_partition"], "left").withColumn("_offset", F.coalesce("next_offset", F.lit(0)) + F.col("_rn")).drop("_rn", "next_offset")


def fan_out(stream: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str):
    """A query that hands each batch of new records to all sinks (Parquet, text, vectors) once."""

    def run(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        for sink in sinks:
            sink(batch, epoch)
        batch.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def advance_flushed(flushed: DataFrame, written: DataFrame) -> DataFrame:
    """(_topic, _partition, flushed_offset) after written (KEY) reached the cold tier; it never goes back."""
    top = written.groupBy("_topic", "_partition").agg(F.max("_offset").alias("flushed_offset"))
    return flushed.unionByName(top).groupBy("_topic", "_partition").agg(F.max("flushed_offset").alias("flushed_offset"))


def embedding_text(selector: str) -> Column:
    """What of a record is embedded: ``key``, ``$.path`` into a JSON value, or the value."""
    value = F.col("_value").cast("string")
    if selector == "key":
        return F.col("_key").cast("string")
    if selector.startswith("$."):
        v = F.try_variant_get(F.try_parse_json(value), selector, "variant")
        return F.coalesce(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), F.to_json(v))
    return value


def missing_vectors(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Records that no vector has been made for, for a backfill."""
    return docs.join(vectors.select(*KEY), KEY, "left_anti")


def query_log(results: DataFrame, query_id: str, profile: str, top: int = 20) -> DataFrame:
    """Feature log of one query: its first results with their features, ready to append."""
    return results.orderBy(F.desc("score"), *[c for c in KEY if c in results.columns]).limit(top).select(F.lit(query_id).alias("query_id"), F.lit(profile).alias("profile"), "*")
