"""Log maintenance: compaction, retention, transactions, assignment of partitions, quotas."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PART = ["_topic", "_partition"]


def compact_by_key(log: DataFrame, *, drop_tombstones: bool = False) -> DataFrame:
    """Of each key the record with the largest offset, and all records without a key. Keyed records are reduced before their one
    shuffle, however skewed; the others are not shuffled."""
    keyed = log.where("_key IS NOT NULL").groupBy(*PART, "_key").agg(F.max_by(F.struct(*log.columns), "_offset").alias("_r")).select("_r.*")
    if drop_tombstones:
        keyed = keyed.where("octet_length(_value) > 0")
    return keyed.unionByName(log.where("_key IS NULL"))


def compact_by_time(log: DataFrame, now, retention_ms: int) -> DataFrame:
    return log.where(F.unix_millis("_timestamp") >= F.unix_millis(F.lit(now).cast("timestamp")) - retention_ms)


def compact_hybrid(log: DataFrame, now, retention_ms: int) -> DataFrame:
    return compact_by_key(compact_by_time(log, now, retention_ms))


def key_class():
    """txn, offset or meta by the key's prefix, else other."""
    k = F.col("_key").cast("string")
    return F.when(k.startswith("__txn__"), "txn").when(k.startswith("__offset__"), "offset").when(k.startswith("__meta__"), "meta").otherwise("other")


def compact_custom(log: DataFrame, now, txn_retention_ms: int) -> DataFrame:
    """Transaction markers by age, committed offsets and metadata by key, other records all."""
    c = log.withColumn("_class", key_class())
    part = lambda name: c.where(F.col("_class") == name).drop("_class")
    latest = compact_by_key(c.where(F.col("_class").isin("offset", "meta")).drop("_class"))
    return compact_by_time(part("txn"), now, txn_retention_ms).unionByName(latest).unionByName(part("other"))


def retain_segments(segments: DataFrame, *, now=None, max_age_ms: int | None = None, max_bytes: int | None = None, keep_offsets: int | None = None) -> DataFrame:
    """Segments (topic, partition, min/max_offset, max_timestamp, bytes) that every given rule keeps: young enough, in the newest
    ones of at most max_bytes, with an offset among the last keep_offsets."""
    out = segments
    if max_age_ms is not None:
        out = out.where(F.unix_millis("max_timestamp") >= F.unix_millis(F.lit(now).cast("timestamp")) - max_age_ms)
    if max_bytes is not None:
        newest = Window.partitionBy(*PART).orderBy(F.desc("min_offset"))
        out = out.withColumn("_sum", F.sum("bytes").over(newest)).where(F.col("_sum") <= max_bytes).drop("_sum")
    if keep_offsets is not None:
        high = segments.groupBy(*PART).agg((F.max("max_offset") + 1).alias("_high"))
        out = out.join(high, PART).where(F.col("max_offset") >= F.col("_high") - keep_offsets).drop("_high")
    return out


def delete_before(log: DataFrame, starts: DataFrame) -> DataFrame:
    """Records from each partition's start on (starts: _topic, _partition, log_start)."""
    return log.join(starts, PART, "left").where("log_start IS NULL OR _offset >= log_start").drop("log_start")


def _numbered(log: DataFrame) -> DataFrame:
    """log with _n: the number of a record's transaction among its producer's, null outside of transactions."""
    w = Window.partitionBy(*PART, "producer_id").orderBy("_offset")
    inside = F.col("producer_id").isNotNull() & F.col("transactional")
    ended = F.when(inside & F.col("control").isNotNull(), 1).otherwise(0)
    return log.withColumn("_n", F.when(inside, F.sum(ended).over(w) - ended))


def transactions(log: DataFrame) -> DataFrame:
    """(producer_id, first_offset, last_offset, state) of each transaction: records of a producer up to its next control row.

    log: partition columns, _offset, producer_id, transactional, control (``commit``, ``abort`` or null). state is committed, aborted or open.
    """
    return _states(_numbered(log)).drop("_n")


def _states(numbered: DataFrame) -> DataFrame:
    g = numbered.where("_n IS NOT NULL").groupBy(*PART, "producer_id", "_n").agg(F.min("_offset").alias("first_offset"), F.max("_offset").alias("last_offset"), F.max("control").alias("_c"))
    return g.withColumn("state", F.when(F.col("_c") == "commit", "committed").when(F.col("_c") == "abort", "aborted").otherwise("open")).drop("_c")


def last_stable(log: DataFrame) -> DataFrame:
    """(partition, high_watermark, last_stable_offset): the first offset of the earliest open transaction, else the high watermark."""
    high = log.groupBy(*PART).agg((F.max("_offset") + 1).alias("high_watermark"))
    first = transactions(log).where("state = 'open'").groupBy(*PART).agg(F.min("first_offset").alias("_open"))
    return high.join(first, PART, "left").select(*PART, "high_watermark", F.coalesce("_open", "high_watermark").alias("last_stable_offset"))


def read_committed(log: DataFrame) -> DataFrame:
    """Data records below the last stable offset whose transaction was not aborted; a record finds its transaction by its number."""
    numbered = _numbered(log)
    bad = _states(numbered).where("state = 'aborted'").select(*PART, "producer_id", "_n")
    below = numbered.join(last_stable(log).select(*PART, "last_stable_offset"), PART).where("_offset < last_stable_offset AND control IS NULL").drop("last_stable_offset")
    return below.join(bad, [*PART, "producer_id", "_n"], "left_anti").select(*log.columns)


def committed_offsets(commits: DataFrame, order: str = "_offset") -> DataFrame:
    """The last commit of each (group, topic, partition)."""
    return commits.groupBy("group_id", "topic", "partition").agg(F.max_by("committed", order).alias("committed"))


def assign_range(partitions: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(topic, partition, member): contiguous ranges of each topic, the first members get one more."""
    members = subscriptions.withColumn("_m", F.row_number().over(Window.partitionBy("topic").orderBy("member")) - 1).withColumn("_ms", F.count(F.lit(1)).over(Window.partitionBy("topic")))
    parts = partitions.withColumn("_p", F.row_number().over(Window.partitionBy("topic").orderBy("partition")) - 1).withColumn("_ps", F.count(F.lit(1)).over(Window.partitionBy("topic")))
    sizes = parts.select("topic", "_ps").distinct().join(members, "topic")
    each, more = F.expr("_ps div _ms"), F.expr("_ps % _ms")
    spans = sizes.select("topic", "member", (F.col("_m") * each + F.least("_m", more)).alias("_from"), (each + F.when(F.col("_m") < more, 1).otherwise(0)).alias("_n"))
    return parts.join(spans, "topic").where("_p >= _from AND _p < _from + _n").select("topic", "partition", "member")


def assign_round_robin(partitions: DataFrame, members: DataFrame) -> DataFrame:
    """(topic, partition, member): all partitions in order, dealt to the members in order."""
    m = members.select("member").distinct().withColumn("_m", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("member")) - 1).withColumn("_ms", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    p = partitions.withColumn("_p", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("topic", "partition")) - 1)
    n = m.select("_ms").limit(1)
    return p.crossJoin(F.broadcast(n)).withColumn("_m", F.pmod("_p", "_ms")).join(m.drop("_ms"), "_m").select("topic", "partition", "member")


def assign_sticky(partitions: list[tuple[str, int]], members: dict[str, set[str]], previous: dict[str, list[tuple[str, int]]]) -> dict[str, list[tuple[str, int]]]:
    """Members keep what they had and may still have; the rest is dealt in turn, beginning with the member that has least."""
    there = set(partitions)
    held: dict[str, list[tuple[str, int]]] = {m: [] for m in sorted(members)}
    taken: set[tuple[str, int]] = set()
    for m in held:
        for tp in sorted(previous.get(m, [])):
            if tp in there and tp[0] in members[m] and tp not in taken:
                held[m].append(tp)
                taken.add(tp)
    turn = sorted(held, key=lambda m: (len(held[m]), m))
    at = 0
    for tp in sorted(there - taken):
        for k in range(len(turn)):
            m = turn[(at + k) % len(turn)]
            if tp[0] in members[m]:
                held[m].append(tp)
                at = (at + k + 1) % len(turn)
                break
    return held


def quota(requests: DataFrame, used: DataFrame, order: str) -> DataFrame:
    """requests (tenant, size, ...) with granted: whether used + all sizes up to it stay within the limit; used: tenant, used, limit."""
    w = Window.partitionBy("tenant").orderBy(order)
    return requests.withColumn("_sum", F.sum("size").over(w)).join(used, "tenant").withColumn("granted", F.col("used") + F.col("_sum") <= F.col("limit")).drop("_sum", "used", "limit")


def compatible(reader: dict, writer: dict) -> list[str]:
    """What keeps a reader's Avro record schema from reading a writer's data: type changes and new fields without a default."""
    promotions = {("int", "long"), ("int", "float"), ("int", "double"), ("long", "float"), ("long", "double"), ("float", "double"), ("string", "bytes"), ("bytes", "string")}

    def reads(r, w) -> bool:
        if isinstance(w, list):
            return all(reads(r, x) for x in w)
        if isinstance(r, list):
            return any(reads(x, w) for x in r)
        if isinstance(r, dict) and isinstance(w, dict) and r.get("type") == w.get("type"):
            if r["type"] == "record":
                return not compatible(r, w)
            if r["type"] in ("array", "map"):
                key = "items" if r["type"] == "array" else "values"
                return reads(r[key], w[key])
            return r["type"] != "enum" or set(w["symbols"]) <= set(r["symbols"])
        kind = lambda s: s["type"] if isinstance(s, dict) else s
        return kind(r) == kind(w) or (kind(w), kind(r)) in promotions

    theirs = {f["name"]: f for f in writer.get("fields", [])}
    found = []
    for f in reader.get("fields", []):
        names = [f["name"], *f.get("aliases", [])]
        other = next((theirs[n] for n in names if n in theirs), None)
        if other is None:
            if "default" not in f:
                found.append(f"{f['name']}: no default")
        elif not reads(f["type"], other["type"]):
            found.append(f"{f['name']}: type changed")
    return found


def check_compatibility(new: dict, history: list[dict], level: str) -> list[str]:
    """Reasons against a new schema by level: NONE, BACKWARD, FORWARD, FULL, and each of the last three with _TRANSITIVE."""
    if level == "NONE" or not history:
        return []
    against = history if level.endswith("_TRANSITIVE") else history[-1:]
    kind = level.removesuffix("_TRANSITIVE")
    out = []
    for old in against:
        if kind in ("BACKWARD", "FULL"):
            out += compatible(new, old)
        if kind in ("FORWARD", "FULL"):
            out += compatible(old, new)
    return out


def memory_topic(namespace: str, kind: str) -> str:
    """mem.{kind}.{tenant}[.{rest}] of a namespace tenant:rest."""
    tenant, _, rest = namespace.partition(":")
    clean = lambda s: re.sub(r"[^A-Za-z0-9._-]", "_", s.replace(":", "."))
    return ".".join(filter(None, ["mem", kind, clean(tenant), clean(rest) if kind == "raw" else ""]))
