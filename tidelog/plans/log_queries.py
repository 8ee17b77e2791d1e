"""Queries over the event log: scans, tiers, offsets, compaction, retention, transactions, assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json as J
from ..model import as_topic
from ..operators import dsl, logops
from ..sources import catalog as C
from ..sources import sinks as K
from ..streaming import windows as S

NOW = "2024-01-08 00:00:00"


def events_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return as_topic(
        e, "events", partition=F.pmod("user_id", F.lit(4)), offset=F.col("event_id"), timestamp=F.col("ts"), key=F.when(F.col("user_id") % 5 != 0, F.col("user_id").cast("string")),
        value=F.to_json(F.struct("event_type", "value", "user_id", "props")), headers=F.array(F.struct(F.lit("type").alias("key"), F.col("event_type").cast("binary").alias("value"))),
    )


#: The same topic for the SQL side.
LOG = """(SELECT CAST(user_id % 4 AS INT) AS p, event_id AS o, ts, CASE WHEN user_id % 5 <> 0 THEN CAST(user_id AS VARCHAR) END AS k, event_type, value, user_id, props FROM events)"""
ROW = {"_partition": "p", "_offset": "o"}


def rows(df: DataFrame) -> DataFrame:
    return df.select("_partition", "_offset", F.col("_key").cast("string").alias("k"))


def q_log_partition_summary(spark, d):
    return events_topic(spark, d).groupBy("_partition").agg(F.count(F.lit(1)).alias("n"), F.min("_offset").alias("min_offset"), F.max("_offset").alias("max_offset"))


def q_scan_offset_range(spark, d):
    return rows(C.offset_range(events_topic(spark, d), 200, 700))


def q_scan_time_range(spark, d):
    return rows(C.time_range(events_topic(spark, d), "2024-01-01 02:00:00", "2024-01-01 09:30:00"))


def q_scan_time_partition(spark, d):
    t = events_topic(spark, d)
    keys = ["0000473352", "0000473355", "0000473360"]
    return rows(C.time_partitions(t, "hour", keys))


def _flushed(t: DataFrame) -> DataFrame:
    high = t.groupBy("_topic", "_partition").agg(F.max("_offset").alias("m"))
    return high.select("_topic", "_partition", F.floor(F.col("m") / 2).cast("long").alias("flushed_offset"))


def q_unified_view(spark, d):
    t = events_topic(spark, d)
    f = _flushed(t)
    cold = t.join(f, ["_topic", "_partition"]).where("_offset <= flushed_offset").drop("flushed_offset")
    c = C.Catalog(spark)
    c.register_topic("unified-events", t, cold, f)
    return c.sql("SELECT _partition, count(*) AS n, count(DISTINCT _offset) AS d, max(_offset) AS m FROM unified_events GROUP BY _partition", max_rows=None)


def q_hot_scan(spark, d):
    t = events_topic(spark, d)
    return rows(C.hot_scan(t, _flushed(t)))


def q_list_offsets(spark, d):
    return C.list_offsets(events_topic(spark, d), "2024-01-01 03:00:00").drop("_topic")


def q_fetch_max_bytes(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    t = as_topic(docs, "documents", partition=F.pmod("doc_id", F.lit(4)), offset=F.col("doc_id"), timestamp=F.timestamp_seconds("doc_id"), key=F.col("source"), value=F.col("text"))
    return rows(C.fetch(t, "documents", 1, 100, max_bytes=20_000))


def q_fetch_max_records(spark, d):
    return rows(C.fetch(events_topic(spark, d), "events", 2, 300, max_records=20))


def q_json_infer(spark, d):
    return K.infer_json(events_topic(spark, d), sample=None)


def q_json_columns(spark, d):
    fields = [("event_type", "string", True), ("value", "float64", True), ("user_id", "int64", True), ("props", "string", True), ("nothing", "boolean", True)]
    t = K.with_json_columns(events_topic(spark, d), fields)
    return t.select("_offset", "event_type", F.round("value", 6).alias("value"), "user_id", F.col("nothing").cast("string").alias("nothing"))


def q_assign_offsets(spark, d):
    t = events_topic(spark, d).drop("_offset")
    base = spark.createDataFrame([("events", 0, 1000), ("events", 1, 5)], "_topic string, _partition int, next_offset long")
    return K.assign_offsets(t, base, ["_timestamp", "_value"]).select("_partition", "_offset", F.unix_micros("_timestamp").alias("at"))


def q_filter_kafka(spark, d):
    return rows(dsl.log_query(events_topic(spark, d), topic="events", partition=1, offsets=(50, 900), key="1*", headers={"type": "click"}))


def q_filter_value_regex(spark, d):
    return rows(dsl.log_query(events_topic(spark, d), value_regex='"event_type":"(click|view)"', times=(None, "2024-01-01 12:00:00")))


def q_headers_last(spark, d):
    from ..model import header, headers_map

    return events_topic(spark, d).select("_offset", header("type").cast("string").alias("h"), headers_map()["type"].cast("string").alias("m"), header("none").cast("string").alias("x"))


def q_compact_key(spark, d):
    return rows(logops.compact_by_key(events_topic(spark, d)))


def q_compact_time(spark, d):
    return rows(logops.compact_by_time(events_topic(spark, d), "2024-01-01 08:00:00", 3 * 3_600_000))


def q_compact_hybrid(spark, d):
    return rows(logops.compact_hybrid(events_topic(spark, d), "2024-01-01 08:00:00", 3 * 3_600_000))


def q_compact_custom(spark, d):
    t = events_topic(spark, d)
    name = F.concat(F.element_at(F.array(F.lit("__txn__"), F.lit("__offset__"), F.lit("__meta__"), F.lit("x")), (F.pmod("_offset", F.lit(4)) + 1).cast("int")), F.pmod("_offset", F.lit(12)).cast("string"))
    return rows(logops.compact_custom(t.withColumn("_key", name.cast("binary")), "2024-01-01 08:00:00", 3 * 3_600_000))


def _segments(spark, d):
    t = events_topic(spark, d)
    s = F.floor(F.col("_offset") / 50)
    return t.groupBy("_topic", "_partition", s.alias("seg")).agg(F.min("_offset").alias("min_offset"), F.max("_offset").alias("max_offset"), F.max("_timestamp").alias("max_timestamp"), (F.count(F.lit(1)) * 100).alias("bytes"))


SEG = f"(SELECT p, o // 50 AS seg, min(o) AS lo, max(o) AS hi, max(ts) AS mt, count(*) * 100 AS b FROM {LOG} GROUP BY ALL)"


def q_retention_size(spark, d):
    return logops.retain_segments(_segments(spark, d), max_bytes=5000).select("_partition", "seg")


def q_retention_offset(spark, d):
    return logops.retain_segments(_segments(spark, d), keep_offsets=200).select("_partition", "seg")


def q_retention_time(spark, d):
    return logops.retain_segments(_segments(spark, d), now="2024-01-01 12:00:00", max_age_ms=6 * 3_600_000).select("_partition", "seg")


def q_manifest_overlap(spark, d):
    return C.overlapping(_segments(spark, d), "min_offset", "max_offset", 120, 330).select("_partition", "seg", "min_offset", "max_offset")


def q_delete_records(spark, d):
    starts = spark.createDataFrame([("events", 0, 300), ("events", 2, 10**9)], "_topic string, _partition int, log_start long")
    return rows(logops.delete_before(events_topic(spark, d), starts))


def _transactional(spark, d):
    t = events_topic(spark, d)
    control = F.when(F.pmod("_offset", F.lit(37)) == 0, F.when(F.pmod("_offset", F.lit(2)) == 0, "commit").otherwise("abort"))
    return t.withColumn("producer_id", F.pmod("_offset", F.lit(3))).withColumn("transactional", F.lit(True)).withColumn("control", control)


def q_txn_lso(spark, d):
    return logops.last_stable(_transactional(spark, d)).drop("_topic")


def q_txn_committed(spark, d):
    return logops.read_committed(_transactional(spark, d)).select("_partition", "_offset")


TXN = f"(SELECT p, o, o % 3 AS pid, CASE WHEN o % 37 = 0 THEN CASE WHEN o % 2 = 0 THEN 'commit' ELSE 'abort' END END AS c FROM {LOG})"
TXNS = f"(SELECT p, pid, n, min(o) AS lo, max(o) AS hi, max(c) AS c FROM (SELECT *, sum(CASE WHEN c IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY p, pid ORDER BY o) - CASE WHEN c IS NOT NULL THEN 1 ELSE 0 END AS n FROM {TXN}) GROUP BY p, pid, n)"
LSO = f"(SELECT h.p, h.hw, coalesce(q.f, h.hw) AS lso FROM (SELECT p, max(o) + 1 AS hw FROM {TXN} GROUP BY p) h LEFT JOIN (SELECT p, min(lo) AS f FROM {TXNS} WHERE c IS NULL GROUP BY p) q USING (p))"


def _members(spark):
    return spark.createDataFrame([(t, m) for t, ms in (("a", "xyz"), ("b", "yz"), ("c", "x")) for m in ms], "topic string, member string")


def _parts(spark):
    return spark.createDataFrame([(t, i) for t, n in (("a", 7), ("b", 5), ("c", 2), ("d", 3)) for i in range(n)], "topic string, partition int")


def q_assign_range(spark, d):
    return logops.assign_range(_parts(spark), _members(spark))


def q_assign_roundrobin(spark, d):
    return logops.assign_round_robin(_parts(spark), _members(spark))


def q_committed_offsets(spark, d):
    t = events_topic(spark, d)
    commits = t.select(F.col("_key").cast("string").alias("group_id"), F.lit("t").alias("topic"), F.col("_partition").alias("partition"), F.unix_millis("_timestamp").alias("committed"), "_offset").where("group_id IS NOT NULL")
    return logops.committed_offsets(commits)


def q_quota(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("tenant"), F.floor("value").cast("long").alias("size"), "event_id")
    used = e.select("tenant").distinct().select("tenant", F.lit(10).alias("used"), F.lit(5000).alias("limit"))
    return logops.quota(e, used, "event_id").groupBy("tenant").agg(F.count(F.when(F.col("granted"), 1)).alias("granted"), F.count(F.lit(1)).alias("n"))


PARTS_SQL = "(SELECT * FROM (VALUES ('a', 7), ('b', 5), ('c', 2), ('d', 3)) v(topic, n), range(7) r(partition) WHERE partition < n)"
MEMBERS_SQL = "(VALUES ('a', 'x'), ('a', 'y'), ('a', 'z'), ('b', 'y'), ('b', 'z'), ('c', 'x')) m(topic, member)"


def _number():
    return S.number("value")


def q_win_tumbling(spark, d):
    out = S.windowed(events_topic(spark, d), size="1 hour", kinds={"n": "count", "total": "sum", "mean": "average", "lo": "min", "hi": "max"}, value=_number(), keys=[S.group_key(["event_type"]).alias("g")])
    return out.select(F.unix_millis("start").alias("start_ms"), "g", "n", F.round("total", 4).alias("total"), F.round("mean", 5).alias("mean"), "lo", "hi")


def q_win_sliding(spark, d):
    out = S.windowed(events_topic(spark, d), size="1 hour", step="30 minutes", kinds={"n": "count", "total": "sum"}, value=_number())
    return out.select(F.unix_millis("start").alias("start_ms"), "n", F.round("total", 4).alias("total"))


def q_win_session(spark, d):
    out = S.windowed(events_topic(spark, d), size="", gap="10 minutes", kinds={"n": "count"}, value=_number(), keys=[F.col("_partition")])
    return out.select(F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "_partition", "n")


def q_win_first_last(spark, d):
    t = events_topic(spark, d).withColumn("_order", F.struct("_timestamp", "_offset"))
    return t.groupBy("_partition").agg(S.aggregate("first", _number(), F.col("_order")).alias("f"), S.aggregate("last", _number(), F.col("_order")).alias("l"))


def q_dedup_sequence(spark, d):
    t = events_topic(spark, d).withColumn("producer_id", F.pmod("_offset", F.lit(3))).withColumn("sequence", F.floor(F.col("_offset") / 9))
    return S.dedup_producers(t).select("producer_id", "_partition", "sequence")


def q_dedup_content(spark, d):
    t = events_topic(spark, d).withColumn("_value", F.floor(_number()).cast("string").cast("binary"))
    return S.dedup_content(t).agg(F.count(F.lit(1)).alias("n"))


_J = "CAST(value AS DOUBLE)"
QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
_HOURS = ", ".join(str(x) for x in (473352, 473355, 473360))
_ROWS = "SELECT p AS _partition, o AS _offset, k FROM"
ORACLE_SQL = {
    "log_partition_summary": f"SELECT p AS _partition, count(*) AS n, min(o) AS min_offset, max(o) AS max_offset FROM {LOG} GROUP BY p",
    "scan_offset_range": f"{_ROWS} {LOG} WHERE o >= 200 AND o < 700",
    "scan_time_range": f"{_ROWS} {LOG} WHERE ts >= TIMESTAMP '2024-01-01 02:00:00' AND ts < TIMESTAMP '2024-01-01 09:30:00'",
    "scan_time_partition": f"{_ROWS} {LOG} WHERE epoch_us(ts) // 3600000000 IN ({_HOURS})",
    "unified_view": f"SELECT p AS _partition, count(*) AS n, count(DISTINCT o) AS d, max(o) AS m FROM {LOG} GROUP BY p",
    "hot_scan": f"{_ROWS} (SELECT *, row_number() OVER (PARTITION BY p ORDER BY o) AS rn FROM (SELECT *, max(o) OVER (PARTITION BY p) // 2 AS f FROM {LOG}) WHERE o > f) WHERE rn <= {C.HOT_ROWS}",
    "list_offsets": f"SELECT p AS _partition, min(o) AS log_start, max(o) + 1 AS high_watermark, min(o) FILTER (WHERE ts >= TIMESTAMP '2024-01-01 03:00:00') AS at_offset FROM {LOG} GROUP BY p",
    "fetch_max_bytes": "SELECT CAST(1 AS INT) AS _partition, doc_id AS _offset, source AS k FROM (SELECT doc_id, source, sum(greatest(1, coalesce(strlen(source), 0) + coalesce(strlen(text), 0))) OVER (ORDER BY doc_id) AS b, row_number() OVER (ORDER BY doc_id) AS n FROM documents WHERE doc_id % 4 = 1 AND doc_id >= 100) WHERE b <= 20000 OR n = 1",
    "fetch_max_records": f"{_ROWS} {LOG} WHERE p = 2 AND o >= 300 ORDER BY o LIMIT 20",
    "json_infer": "SELECT unnest(['event_type', 'props', 'user_id', 'value']) AS name, unnest(['string', 'string', 'int64', 'float64']) AS type, false AS nullable, (SELECT count(*) FROM events) AS n",
    "json_columns": "SELECT event_id AS _offset, event_type, round(value, 6) AS value, user_id, CAST(NULL AS VARCHAR) AS nothing FROM events",
    "assign_offsets": f"SELECT p AS _partition, CASE p WHEN 0 THEN 1000 WHEN 1 THEN 5 ELSE 0 END + row_number() OVER (PARTITION BY p ORDER BY ts) - 1 AS _offset, epoch_us(ts) AS at FROM {LOG}",
    "filter_kafka": f"{_ROWS} {LOG} WHERE p = 1 AND o BETWEEN 50 AND 900 AND regexp_full_match(k, '1.+') AND event_type = 'click'",
    "filter_value_regex": f"{_ROWS} {LOG} WHERE event_type IN ('click', 'view') AND ts <= TIMESTAMP '2024-01-01 12:00:00'",
    "headers_last": "SELECT event_id AS _offset, event_type AS h, event_type AS m, CAST(NULL AS VARCHAR) AS x FROM events",
    "compact_key": f"{_ROWS} {LOG} WHERE k IS NULL OR o IN (SELECT max(o) FROM {LOG} WHERE k IS NOT NULL GROUP BY p, k)",
    "compact_time": f"{_ROWS} {LOG} WHERE ts >= TIMESTAMP '2024-01-01 05:00:00'",
    "compact_hybrid": f"WITH t AS (SELECT * FROM {LOG} WHERE ts >= TIMESTAMP '2024-01-01 05:00:00') {_ROWS} t WHERE k IS NULL OR o IN (SELECT max(o) FROM t WHERE k IS NOT NULL GROUP BY p, k)",
    "compact_custom": f"WITH t AS (SELECT p, o, ts, ['__txn__', '__offset__', '__meta__', 'x'][o % 4 + 1] || CAST(o % 12 AS VARCHAR) AS k, o % 4 AS c FROM {LOG}) {_ROWS} t WHERE c = 3 OR (c = 0 AND ts >= TIMESTAMP '2024-01-01 05:00:00') OR (c IN (1, 2) AND o IN (SELECT max(o) FROM t GROUP BY p, k))",
    "retention_size": f"SELECT p AS _partition, seg FROM (SELECT *, sum(b) OVER (PARTITION BY p ORDER BY lo DESC) AS s FROM {SEG}) WHERE s <= 5000",
    "retention_offset": f"SELECT p AS _partition, seg FROM (SELECT *, max(hi) OVER (PARTITION BY p) + 1 AS hw FROM {SEG}) WHERE hi >= hw - 200",
    "retention_time": f"SELECT p AS _partition, seg FROM {SEG} WHERE mt >= TIMESTAMP '2024-01-01 06:00:00'",
    "manifest_overlap": f"SELECT p AS _partition, seg, lo AS min_offset, hi AS max_offset FROM {SEG} WHERE lo <= 330 AND hi >= 120",
    "delete_records": f"{_ROWS} {LOG} WHERE NOT (p = 0 AND o < 300) AND p <> 2",
    "txn_lso": f"SELECT p AS _partition, hw AS high_watermark, lso AS last_stable_offset FROM {LSO}",
    "txn_committed": f"SELECT t.p AS _partition, t.o AS _offset FROM {TXN} t JOIN {LSO} l ON t.p = l.p AND t.o < l.lso WHERE t.c IS NULL AND NOT EXISTS (SELECT 1 FROM {TXNS} x WHERE x.c = 'abort' AND x.p = t.p AND x.pid = t.pid AND t.o BETWEEN x.lo AND x.hi)",
    "assign_range": f"WITH m AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY member) - 1 AS i, count(*) OVER (PARTITION BY topic) AS k FROM {MEMBERS_SQL}), s AS (SELECT m.*, n // k AS e, n % k AS x FROM m JOIN (VALUES ('a', 7), ('b', 5), ('c', 2)) v(topic, n) USING (topic)) SELECT p.topic, CAST(p.partition AS INT) AS partition, s.member FROM {PARTS_SQL} p JOIN s ON p.topic = s.topic AND p.partition >= i * e + least(i, x) AND p.partition < i * e + least(i, x) + e + CASE WHEN i < x THEN 1 ELSE 0 END",
    "assign_roundrobin": f"WITH m AS (SELECT member, row_number() OVER (ORDER BY member) - 1 AS i FROM (SELECT DISTINCT member FROM {MEMBERS_SQL})), p AS (SELECT *, row_number() OVER (ORDER BY topic, partition) - 1 AS j FROM {PARTS_SQL}) SELECT topic, CAST(partition AS INT) AS partition, member FROM p JOIN m ON j % 3 = i",
    "committed_offsets": f"SELECT k AS group_id, 't' AS topic, p AS partition, arg_max(epoch_us(ts) // 1000, o) AS committed FROM {LOG} WHERE k IS NOT NULL GROUP BY k, p",
    "quota": "SELECT event_type AS tenant, count(*) FILTER (WHERE 10 + s <= 5000) AS granted, count(*) AS n FROM (SELECT *, sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY event_type ORDER BY event_id) AS s FROM events) GROUP BY event_type",
    "win_tumbling": "SELECT epoch_ms(time_bucket(INTERVAL 1 HOUR, ts)) AS start_ms, event_type AS g, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 5) AS mean, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1, 2",
    "win_sliding": "SELECT s AS start_ms, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT value, unnest([epoch_us(ts) // 1800000000 * 1800000, epoch_us(ts) // 1800000000 * 1800000 - 1800000]) AS s FROM events) GROUP BY s",
    "win_session": f"SELECT min(t) // 1000 AS start_ms, (max(t) + 600000000) // 1000 AS end_ms, p AS _partition, count(*) AS n FROM (SELECT *, sum(CASE WHEN t - prev >= 600000000 OR prev IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY p ORDER BY t, o) AS s FROM (SELECT p, o, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY p ORDER BY ts, o) AS prev FROM {LOG})) GROUP BY p, s",
    "win_first_last": f"SELECT p AS _partition, arg_min(value, {{'t': ts, 'o': o}}) AS f, arg_max(value, {{'t': ts, 'o': o}}) AS l FROM {LOG} GROUP BY p",
    "dedup_sequence": f"SELECT DISTINCT o % 3 AS producer_id, p AS _partition, o // 9 AS sequence FROM {LOG}",
    "dedup_content": "SELECT count(DISTINCT floor(value)) AS n FROM events",
}
