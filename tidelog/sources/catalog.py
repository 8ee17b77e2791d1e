"""Tables of the engine: files, directories, frames and topics with a hot and a cold tier, all as temporary views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import KEY, UNIFIED, table_name

MAX_ROWS = 100_000
HOT_ROWS = 100_000


class Catalog:
    """Named tables over a session. Views are resolved on every query, so a registered provider is never stale."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._providers: dict[str, Callable[[], DataFrame]] = {}

    def register(self, name: str, df: DataFrame) -> str:
        name = table_name(name)
        df.createOrReplaceTempView(name)
        return name

    def register_file(self, name: str, path: str) -> str:
        return self.register(name, self.spark.read.parquet(path))

    def register_files(self, name: str, paths: list[str], *, merge_schema: bool = True) -> str:
        """One table over several files; their schemas are merged, or the first file's holds. No files: ValueError."""
        if not paths:
            raise ValueError("no files")
        if merge_schema:
            return self.register(name, self.spark.read.option("mergeSchema", True).parquet(*paths))
        return self.register(name, self.spark.read.schema(self.spark.read.parquet(paths[0]).schema).parquet(*paths))

    def register_directory(self, name: str, base: str) -> str:
        return self.register(name, read_directory(self.spark, base))

    def register_memory(self, name: str, rows, schema) -> str:
        return self.register(name, self.spark.createDataFrame(rows, schema))

    def register_provider(self, name: str, provider: Callable[[], DataFrame]) -> str:
        """A table whose frame is asked for anew before each query."""
        self._providers[table_name(name)] = provider
        return table_name(name)

    def register_topic(self, topic: str, hot: DataFrame, cold: DataFrame, flushed: DataFrame | None = None) -> str:
        """Views {topic}_hot, {topic}_cold and {topic}, the union without overlap."""
        name = table_name(topic)
        self.register(f"{name}_hot", hot)
        self.register(f"{name}_cold", cold)
        return self.register(name, unified(hot, cold, flushed))

    def tables(self) -> list[str]:
        return sorted({t.name for t in self.spark.catalog.listTables() if t.isTemporary} | set(self._providers))

    def exists(self, name: str) -> bool:
        return table_name(name) in self.tables()

    def describe(self, name: str):
        self._refresh()
        return self.spark.table(table_name(name)).schema

    def deregister(self, name: str) -> bool:
        self._providers.pop(table_name(name), None)
        return self.spark.catalog.dropTempView(table_name(name))

    def _refresh(self) -> None:
        for name, provider in self._providers.items():
            provider().createOrReplaceTempView(name)

    def sql(self, query: str, *, max_rows: int | None = MAX_ROWS) -> DataFrame:
        """Rows of a query, max_rows at most unless None: a limit of responses, not of what a query reads."""
        self._refresh()
        out = self.spark.sql(query)
        return out if max_rows is None else out.limit(max_rows)

    def explain(self, query: str) -> str:
        self._refresh()
        return self.spark.sql(f"EXPLAIN FORMATTED {query}").first()[0]

    def rows(self, query: str, limit: int = 1000) -> tuple[list[dict], bool]:
        """(rows as dicts, whether there were more): limit rows at most reach the driver."""
        got = self.sql(query, max_rows=limit + 1).collect()
        return [r.asDict(recursive=True) for r in got[:limit]], len(got) > limit

    def stream(self, query: str):
        """Rows one by one, a partition at a time on the driver."""
        return self.sql(query, max_rows=None).toLocalIterator(prefetchPartitions=True)

    def ticket(self, text: str) -> tuple[str, ...]:
        """A transport ticket: ("sql", query) or ("vector", topic, text, k)."""
        kind, _, rest = text.partition(":")
        if kind == "sql" and rest:
            return "sql", rest
        if kind == "vector":
            topic, _, rest = rest.partition(":")
            query, _, k = rest.rpartition(":")
            if topic and query and k.isdigit():
                return "vector", topic, query, int(k)
        raise ValueError(f"not a ticket: {text!r}")


def read_directory(spark: SparkSession, base: str) -> DataFrame:
    """All Parquet files below base, at any depth."""
    return spark.read.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(base)


def offset_range(df: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """low <= _offset < high, as predicates that reach the scan."""
    if low is not None:
        df = df.where(F.col("_offset") >= low)
    return df if high is None else df.where(F.col("_offset") < high)


def time_range(df: DataFrame, low=None, high=None) -> DataFrame:
    """low <= _timestamp < high."""
    if low is not None:
        df = df.where(F.col("_timestamp") >= F.lit(low).cast("timestamp"))
    return df if high is None else df.where(F.col("_timestamp") < F.lit(high).cast("timestamp"))


def time_key(unit: str):
    """Partition key of a timestamp: hours or days since 1970, ten digits."""
    size = {"hour": 3_600_000, "day": 86_400_000}[unit]
    return F.lpad(F.floor(F.unix_millis("_timestamp") / size).cast("string"), 10, "0")


def time_partitions(df: DataFrame, unit: str, keys: list[str]) -> DataFrame:
    """Rows of hours or days named by their keys: as ranges of _timestamp, which reach the scan, and by the folders that
    write_segments makes, where df has them as a column."""
    size = {"hour": 3_600, "day": 86_400}[unit]
    numbers = sorted({int(k) for k in keys if len(k) == 10 and k.isdigit()})
    within = F.lit(False)
    at = 0
    while at < len(numbers):  # neighbouring keys are one range
        to = at
        while to + 1 < len(numbers) and numbers[to + 1] == numbers[to] + 1:
            to += 1
        first, last = (F.timestamp_seconds(F.lit(x * size)) for x in (numbers[at], numbers[to] + 1))
        within = within | ((F.col("_timestamp") >= first) & (F.col("_timestamp") < last))
        at = to + 1
    out = df.where(within)
    if unit in df.columns:
        text = df.schema[unit].dataType.typeName() == "string"
        out = out.where(F.col(unit).isin([f"{n:010d}" if text else n for n in numbers]))
    return out


def manifest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Zone map, one row a file: path, topic, partition, rows, bytes, offset and time ranges. File paths come from the scan itself."""
    df = spark.read.parquet(*paths)
    return df.groupBy(F.col("_metadata.file_path").alias("path"), "_topic", "_partition").agg(
        F.count(F.lit(1)).alias("rows"), F.max("_metadata.file_size").alias("bytes"), F.min("_offset").alias("min_offset"), F.max("_offset").alias("max_offset"), F.min("_timestamp").alias("min_timestamp"), F.max("_timestamp").alias("max_timestamp")
    )


def overlapping(segments: DataFrame, low: str, high: str, start, end) -> DataFrame:
    """Segments whose range [low, high] meets [start, end], both inclusive, by min_offset."""
    return segments.where((F.col(low) <= F.lit(end)) & (F.col(high) >= F.lit(start))).orderBy("min_offset")


def pruned_scan(spark: SparkSession, segments: DataFrame, schema, *, offsets: tuple[int, int] | None = None, times: tuple | None = None, keys: tuple[str, list[str]] | None = None) -> DataFrame:
    """Rows of the files that the zone map leaves, with the same conditions on the rows; conditions add up.

    The zone map is a few rows a file; only the paths that are left reach the driver.
    """
    kept = segments
    if offsets:
        kept = kept.where((F.col("min_offset") < offsets[1]) & (F.col("max_offset") >= offsets[0]))
    if times:
        kept = kept.where((F.col("min_timestamp") < F.lit(times[1]).cast("timestamp")) & (F.col("max_timestamp") >= F.lit(times[0]).cast("timestamp")))
    paths = [r.path for r in kept.select("path").distinct().collect()]
    df = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    if offsets:
        df = offset_range(df, *offsets)
    if times:
        df = time_range(df, *times)
    return time_partitions(df, *keys) if keys else df


def hot_scan(log: DataFrame, flushed: DataFrame, cap: int = HOT_ROWS) -> DataFrame:
    """The log after each partition's flushed offset, its first cap records a partition. flushed: _topic, _partition, flushed_offset."""
    from pyspark.sql import Window

    tail = log.join(flushed, ["_topic", "_partition"], "left").where("flushed_offset IS NULL OR _offset > flushed_offset").drop("flushed_offset")
    w = Window.partitionBy("_topic", "_partition").orderBy("_offset")
    return tail.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap).drop("_rn")


def unified(hot: DataFrame, cold: DataFrame, flushed: DataFrame | None = None) -> DataFrame:
    """Hot rows beyond the flushed offset and all cold rows, in the columns both have."""
    if flushed is not None:
        hot = hot.join(flushed, ["_topic", "_partition"], "left").where("flushed_offset IS NULL OR _offset > flushed_offset")
    return hot.select(*UNIFIED).unionByName(cold.select(*UNIFIED))


def fetch(log: DataFrame, topic: str, partition: int, offset: int, *, max_records: int | None = None, max_bytes: int | None = None, below: int | None = None) -> DataFrame:
    """Records from an offset on, in order, as many as fit max_bytes (the first one always) and max_records.

    A record counts as one byte at least, so the first max_bytes records are all that sizes are summed of.
    """
    from pyspark.sql import Window

    df = log.where((F.col("_topic") == topic) & (F.col("_partition") == partition) & (F.col("_offset") >= offset))
    if below is not None:
        df = df.where(F.col("_offset") < below)
    if max_bytes is not None:
        df = df.orderBy("_offset").limit(max(1, min(max_bytes, 2**31 - 1)))
        size = F.greatest(F.lit(1), F.coalesce(F.octet_length("_key"), F.lit(0)) + F.coalesce(F.octet_length("_value"), F.lit(0)))
        w = Window.partitionBy("_topic", "_partition").orderBy("_offset")
        df = df.withColumn("_sum", F.sum(size).over(w)).withColumn("_rn", F.row_number().over(w)).where((F.col("_sum") <= max_bytes) | (F.col("_rn") == 1)).drop("_sum", "_rn")
    df = df.orderBy("_offset")
    return df if max_records is None else df.limit(max_records)


def list_offsets(log: DataFrame, at=None) -> DataFrame:
    """Of each partition: log_start, high_watermark, and the first offset with _timestamp >= at, null without one."""
    first = F.min(F.when(F.col("_timestamp") >= F.lit(at).cast("timestamp"), F.col("_offset"))) if at is not None else F.lit(None).cast("long")
    return log.groupBy("_topic", "_partition").agg(F.min("_offset").alias("log_start"), (F.max("_offset") + 1).alias("high_watermark"), first.alias("at_offset"))


__all__ = ["Catalog", "KEY", "fetch", "hot_scan", "list_offsets", "manifest", "offset_range", "overlapping", "pruned_scan", "read_directory", "time_key", "time_partitions", "time_range", "unified"]
