"""Queries over order-based joins, quantised vectors, sinks' bookkeeping and recall from a question."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text, vector
from ..operators import dsl, fusion, joins, memory
from ..operators.vector_index import VectorIndex
from ..sources import sinks
from . import log_queries as L
from . import memory_queries as M
from . import search_queries as S


def _events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


def q_asof_join(spark, d):
    """Each purchase with the user's last click before it."""
    e = _events(spark, d)
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"))
    return joins.asof_join(left, right, ["user_id"], "ts", ["click_id"]).select("event_id", "click_id")


def q_interval_join(spark, d):
    """Errors and signups of one user whose hour-long spans overlap."""
    e = _events(spark, d).select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("begin")).withColumn("end", F.col("begin") + 3_600_000_000)
    a, b = (e.where(F.col("event_type") == t).select("user_id", "event_id", "begin", "end") for t in ("error", "signup"))
    return joins.interval_join(a, b, ["user_id"], width=3_600_000_000).select("event_id", "right_event_id")


QUERY = [((i * 37) % 11 - 5) / 5 for i in range(64)]


def q_knn_asymmetric(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    both = e.crossJoin(F.broadcast(vector.quantiser(e)))  # one row
    codes = both.withColumn("codes", vector.quantise(F.col("embedding"), F.col("low"), F.col("step")))
    far = codes.select("vec_id", vector.asymmetric_distance(QUERY, F.col("codes"), F.col("low"), F.col("step"), "euclidean").alias("distance"))
    return far.orderBy("distance", "vec_id").limit(15).select("vec_id", F.round("distance", 5).alias("distance"))


def q_knn_index_recall(spark, d):
    """Whether the index finds at least 9 of 10 of what an exact search does, over ten queries."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")
    index = VectorIndex(spark, f"{base.rstrip('/')}/tidelog-vectors-{uuid.uuid4().hex}", id_col="vec_id").build(e)
    queries = [list(r.embedding) for r in e.where("vec_id % 10 = 3").orderBy("vec_id").limit(10).collect()]
    both = None
    for i, q in enumerate(queries):
        hits = index.search(q, 10).select("vec_id").join(vector.knn(e, q, 10, "cosine", tie=["vec_id"]).select("vec_id"), "vec_id").withColumn("q", F.lit(i))
        both = hits if both is None else both.unionByName(hits)
    return both.agg((F.count(F.lit(1)) >= 9 * len(queries)).alias("enough"))


def q_count_hits(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return dsl.execute(docs, {"query": {"range": {"n_chars": {"gt": 500}}}}, "count")


def q_advance_flushed(spark, d):
    t = L.events_topic(spark, d)
    flushed = spark.createDataFrame([("events", 0, 10**9), ("events", 1, 5)], "_topic string, _partition int, flushed_offset long")
    return sinks.advance_flushed(flushed, t.where("_offset % 3 = 0")).select("_partition", "flushed_offset")


def q_embedding_text(spark, d):
    t = L.events_topic(spark, d)
    return t.select("_offset", sinks.embedding_text("key").alias("k"), sinks.embedding_text("$.event_type").alias("e"), sinks.embedding_text("$.user_id").alias("u"))


def q_missing_vectors(spark, d):
    t = L.events_topic(spark, d)
    done = t.where("_offset % 5 <> 2").select(*sinks.KEY)
    return sinks.missing_vectors(t, done).select("_offset")


def q_simple_query(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.where(dsl.simple_query(docs, "the retion src3")).select("doc_id")


def q_highlight(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.select("c_custkey", text.highlight(F.col("c_mktsegment"), ["building", "auto", "machinery"]).alias("t"))


QUESTIONS = ["Did Anna meet user:luis and Bob, the Anna?", "Hello,World tell About X-1", "who is it", "Says Paul: yes"]


def q_subjects(spark, d):
    q = spark.createDataFrame([(x,) for x in QUESTIONS], "q string")
    return q.select("q", F.array_join(text.subjects(F.col("q")), " ").alias("found"))


def q_memory_polarity(spark, d):
    return memory.mark_conflicts(M.memories(spark, d)).select("memory_id", "polarity")


def q_provenance(spark, d):
    m = M.memories(spark, d)
    both = m.unionByName(memory.forget(m, m.where("memory_id % 4 = 0").select("memory_id")))
    return memory.provenance(both).select("memory_id", F.col("source.topic").alias("topic"))


def q_envelopes(spark, d):
    t = L.events_topic(spark, d)
    ids = t.where("_offset % 10 = 3").select("_topic", "_partition", "_offset").unionByName(spark.createDataFrame([("events", 0, -1)], "_topic string, _partition int, _offset long"))
    return L.rows(fusion.with_envelopes(ids, t, ["_topic", "_partition", "_offset"]))


def q_memory_extract(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("lang").alias("role"), "text")
    return memory.extract(docs).groupBy("type", "subject", "predicate", "key", "confidence").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("first"), F.max("object").alias("last"))


def q_memory_ask(spark, d):
    m = M.memories(spark, d)
    out = memory.ask(m, "When did a Click happen, within 3 days?", now=F.lit("2024-02-01 00:00:00").cast("timestamp"), predicate="type = 'task'", min_confidence=0.1, k=25)
    return out.select("memory_id", F.round("score", 8).alias("score"))


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
_Q = "[" + ", ".join(f"CAST({x} AS DOUBLE)" for x in QUERY) + "]"
ORACLE_SQL = {
    "asof_join": "SELECT l.event_id, r.event_id AS click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') l ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY user_id, ts) r ON l.user_id = r.user_id AND l.ts >= r.ts",
    "interval_join": "SELECT a.event_id, b.event_id AS right_event_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'signup' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600000000",
    "knn_asymmetric": f"WITH x AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(i)), s AS (SELECT i, min(v) AS lo, CASE WHEN max(v) = min(v) THEN 1.0 ELSE max(v) - min(v) END / 255 AS st FROM x GROUP BY i), c AS (SELECT vec_id, sqrt(sum(pow(lo + st * greatest(0, least(255, floor((v - lo) / st))) - {_Q}[i], 2))) AS dist FROM x JOIN s USING (i) GROUP BY vec_id) SELECT vec_id, round(dist, 5) AS distance FROM c ORDER BY dist, vec_id LIMIT 15",
    "knn_index_recall": "SELECT true AS enough",
    "count_hits": "SELECT count(*) AS total FROM documents WHERE n_chars > 500",
    "advance_flushed": f"SELECT p AS _partition, max(m) AS flushed_offset FROM (SELECT p, max(o) AS m FROM {L.LOG} WHERE o % 3 = 0 GROUP BY p UNION ALL SELECT 0, 1000000000 UNION ALL SELECT 1, 5) GROUP BY p",
    "embedding_text": f"SELECT o AS _offset, k, event_type AS e, CAST(user_id AS VARCHAR) AS u FROM {L.LOG}",
    "missing_vectors": f"SELECT o AS _offset FROM {L.LOG} WHERE o % 5 = 2",
    "simple_query": f"WITH {S.STEMMED} SELECT doc_id FROM documents LEFT JOIN tok USING (doc_id) WHERE list_has_any(coalesce(s, []), ['retion', 'src3']) OR source = 'src3'",
    "highlight": "SELECT c_custkey, regexp_replace(c_mktsegment, '(?i)\\b(building|auto|machinery)\\b', '<em>\\1</em>', 'g') AS t FROM customer",
    "subjects": "SELECT * FROM (VALUES ('Did Anna meet user:luis and Bob, the Anna?', 'anna bob user:luis'), ('Hello,World tell About X-1', 'hello world x-1'), ('who is it', ''), ('Says Paul: yes', 'Paul:')) v(q, found)",
    "memory_polarity": f"SELECT memory_id, CASE WHEN n > 1 THEN 'conflicting' END AS polarity FROM {M.MEM} JOIN (SELECT namespace, subject, predicate, count(DISTINCT object) AS n FROM {M.MEM} GROUP BY ALL) USING (namespace, subject, predicate)",
    "provenance": "SELECT event_id AS memory_id, 'raw' AS topic FROM events WHERE event_id % 23 <> 0 AND event_id % 4 <> 0",
    "envelopes": f"SELECT p AS _partition, o AS _offset, k FROM {L.LOG} WHERE o % 10 = 3",
    "memory_extract": "SELECT type, lang AS subject, predicate, CASE WHEN type = 'fact' THEN lang || '|' || predicate END AS key, 0.6::DOUBLE AS confidence, count(*) AS n, min(lang || ' ' || says || ' ' || v) AS first, max(v) AS last FROM ("
    + " UNION ALL ".join(f"SELECT lang, '{p}' AS predicate, '{w}' AS says, '{'event' if k == 'date' else 'fact'}' AS type, trim(unnest(regexp_extract_all(text, '{text.RULES[k].replace(chr(39), chr(39) * 2)}')), chr(32) || '(' || chr(10) || chr(9)) AS v FROM documents" for k, (p, w) in memory.RULE_PREDICATES.items())
    + ") WHERE type = 'fact' OR TRY_CAST(v AS TIMESTAMPTZ) IS NOT NULL GROUP BY ALL",
    "memory_ask": f"""WITH m AS {M.MEM}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE subject = 'click') AS d FROM m),
    a AS (SELECT memory_id, row_number() OVER (ORDER BY CASE WHEN subject = 'click' THEN 1 ELSE 0 END DESC, memory_id) - 1 AS r FROM m QUALIFY r < 200),
    b AS (SELECT memory_id, row_number() OVER (ORDER BY memory_id) - 1 AS r FROM m WHERE subject = 'click' QUALIFY r < 200),
    q AS (SELECT memory_id, row_number() OVER (ORDER BY ts DESC, memory_id) - 1 AS r FROM m WHERE type = 'task' QUALIFY r < 200),
    f AS (SELECT memory_id, sum(w / (60 + r)) AS rrf FROM (SELECT memory_id, r, 1.0 AS w FROM a UNION ALL SELECT memory_id, r, 2.0 FROM b UNION ALL SELECT memory_id, r, 1.5 FROM q) GROUP BY memory_id),
    s AS (SELECT m.*, rrf * {M._TW} * CASE WHEN ts >= TIMESTAMP '2024-02-01' THEN 1.0 ELSE exp(-0.6931471805599453 * floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 1e6) / {M._HL}) END * confidence * CASE type WHEN 'event' THEN 1.6 WHEN 'fact' THEN 1.3 ELSE 1.0 END AS score FROM m JOIN f USING (memory_id) WHERE confidence >= 0.1),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY namespace, key ORDER BY version DESC, score DESC, memory_id) AS rn FROM s WHERE NOT ({M.CURRENT})) WHERE rn = 1 UNION ALL SELECT *, 1 FROM s WHERE {M.CURRENT})
    SELECT memory_id, round(score, 8) AS score FROM k WHERE NOT tombstoned ORDER BY k.score DESC, memory_id LIMIT 25""",
}
