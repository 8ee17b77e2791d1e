"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\f\r"

#: Bits that a sieve has for each value, and at most.
SIEVE_BITS, SIEVE_MOST = 32, 1 << 26

_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where the session names none and runs in this process alone."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="tidelog-"))
    return _own_dir[0]


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Give the package to the executors' Python workers, once an application: they may not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent.parent
    handle, path = tempfile.mkstemp(prefix="tidelog-", suffix=".zip")
    with os.fdopen(handle, "wb") as f, zipfile.ZipFile(f, "w") as z:
        for source in sorted(top.rglob("*.py")):
            z.write(source, str(source.relative_to(top.parent)))
    context.addPyFile(path)
    atexit.register(Path(path).unlink, missing_ok=True)
    _shipped.add(context.applicationId)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, so a lost executor costs a re-read only."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def cut_apart(df: DataFrame, name: str, part: Column, parts: int) -> list[DataFrame]:
    """cut() of df as one table for each value of part, from 0 to parts - 1, each with files of its own to drop."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.withColumn("_part", part.cast("int")).write.option("compression", "zstd").partitionBy("_part").parquet(path)
    out = []
    for i in range(parts):
        own = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_part={i}")
        own.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(own)  # without rows there is none yet
        out.append(spark.read.schema(df.schema).parquet(f"{path}/_part={i}"))
        out[-1]._cut_path = f"{path}/_part={i}"
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind a table made by cut() that no later step reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._cut_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session has these settings while it lasts."""
    before = {name: spark.conf.get(name) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def batches_of(spark: SparkSession, rows: int):
    """Python workers get so many rows at once while it lasts: for rows that hold whole texts."""
    return settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)})


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files and broadcasts, which the driver holds, of frames that nothing refers to any longer; it does so when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def sieved(rows: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """rows without most of those whose column (a whole number) is not in the one column of values; all that are in it stay, so an exact join may follow.

    It is for rows too wide to be shuffled only to find out: a bitmap of the values' hashes is broadcast instead. Its size
    follows the number of values up to SIEVE_MOST bits; with more values, more of the other rows stay.
    """
    values = values.select(F.col(values.columns[0]).cast("long").alias("_value"))
    n = values.agg(F.approx_count_distinct("_value")).first()[0]
    bits = min(SIEVE_MOST, 1 << max(10, (SIEVE_BITS * n).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    in_word = lambda c: c.bitwiseAND(F.lit(63)).cast("int")
    # whether null is among the values is told by the hash of null
    marks = values.select(place(F.col("_value")).alias("_at")).groupBy(F.shiftright("_at", 6).alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), in_word(F.col("_at")))).alias("_marks"))
    at = place(F.col(column).cast("long"))
    return rows.join(F.broadcast(marks), F.shiftright(at, 6) == F.col("_word")).where(F.getbit("_marks", in_word(at)) == 1).select(*rows.columns)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once; a plain reference inside a lambda would be computed for each element."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text, in order; an empty array for null or blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK_CHARS))
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, BLANK))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
