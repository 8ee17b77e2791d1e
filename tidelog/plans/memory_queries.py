"""Queries over versioned memories, made from the events table: one memory an event."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import fusion, memory

KINDS = ("fact", "instruction", "event", "task", "concept")


def memories(spark, d) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.pmod("event_id", F.lit(5)) + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("memory_id"), F.concat(F.lit("t"), F.pmod("user_id", F.lit(9)).cast("string")).alias("namespace"), F.when(F.col("event_id") % 7 != 0, F.pmod("user_id", F.lit(50)).cast("string")).alias("key"),
        (F.col("event_id") % 11).alias("version"), F.col("ts").cast("timestamp").alias("created_at"), F.col("ts").cast("timestamp").alias("valid_from"), (F.pmod("event_id", F.lit(10)) / 10).alias("confidence"), (F.pmod("event_id", F.lit(23)) == 0).alias("tombstoned"),
        kind.alias("type"), F.concat(F.col("event_type"), F.lit(" in 3 days")).alias("text"), F.col("event_type").alias("subject"), F.concat(F.lit("p"), F.pmod("user_id", F.lit(4)).cast("string")).alias("predicate"), F.pmod("event_id", F.lit(3)).cast("string").alias("object"),
        F.struct(F.lit("raw").alias("topic"), F.array(F.col("event_id"), F.floor(F.col("event_id") / 2)).alias("offsets"), F.lit("rules").alias("extractor")).alias("source"),
    )


MEM = f"""(SELECT event_id AS memory_id, 't' || (user_id % 9) AS namespace, CASE WHEN event_id % 7 <> 0 THEN CAST(user_id % 50 AS VARCHAR) END AS key, event_id % 11 AS version, ts, event_id % 10 / 10 AS confidence,
 event_id % 23 = 0 AS tombstoned, {list(KINDS)}[event_id % 5 + 1] AS type, event_type || ' in 3 days' AS text, event_type AS subject, 'p' || (user_id % 4) AS predicate, CAST(event_id % 3 AS VARCHAR) AS object FROM events)"""
CURRENT = "type = 'event' OR key IS NULL"


def q_memory_supersede(spark, d):
    return memory.current(memories(spark, d)).select("memory_id", "namespace", "key", "version")


def q_memory_conflict(spark, d):
    return memory.conflicts(memories(spark, d))


def q_memory_latest_wins(spark, d):
    return memory.resolve_conflicts(memories(spark, d), "latest_wins").select("memory_id")


def q_memory_surest_wins(spark, d):
    return memory.resolve_conflicts(memories(spark, d), "highest_confidence_wins").select("memory_id")


def _channels(m: DataFrame) -> DataFrame:
    a = fusion.ranked(m.select("memory_id", (F.col("memory_id") * 7 % 101).alias("s")), "bm25", "s", ["memory_id"], limit=200)
    b = fusion.ranked(m.select("memory_id", (F.col("memory_id") * 13 % 97).alias("s")), "sql", "s", ["memory_id"], limit=200)
    return a.unionByName(b).select(F.col("mode").alias("channel"), "memory_id", "rank")


def q_memory_recall(spark, d):
    m = memories(spark, d)
    out = memory.recall(m, _channels(m), now=F.lit("2024-02-01 00:00:00").cast("timestamp"), query_intent="temporal", min_confidence=0.1, k=25)
    return out.select("memory_id", F.round("score", 8).alias("score"))


def q_memory_forget(spark, d):
    m = memories(spark, d)
    gone = memory.forget(m, m.where("memory_id % 6 = 0").select("memory_id"))
    return memory.current(m.unionByName(gone)).select("memory_id")


def q_semantic_dedup(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    v = F.transform("embedding", lambda x: F.round(x * 2).cast("double"))
    f = e.select(F.col("vec_id").alias("memory_id"), F.pmod("vec_id", F.lit(4)).cast("string").alias("namespace"), F.lit("s").alias("subject"), F.col("label").cast("string").alias("predicate"), (F.pmod("vec_id", F.lit(3)) / 3).alias("confidence"), v.alias("embedding"))
    f = f.unionByName(f.where("memory_id % 5 = 0").withColumn("memory_id", F.col("memory_id") + 100_000).withColumn("confidence", F.lit(0.5)))
    return memory.semantic_dedup(f).select("memory_id", "decision")


def q_dedup_report(spark, d):
    m = memories(spark, d).withColumn("decision", F.element_at(F.array(*map(F.lit, ("keep", "drop", "supersede"))), (F.pmod("memory_id", F.lit(3)) + 1).cast("int")))
    return memory.dedup_report(m, namespace="t1")


def q_lineage(spark, d):
    return memory.lineage(memories(spark, d))


def q_lineage_descendants(spark, d):
    return memory.descendants(memories(spark, d)).select("topic", "parent_offset", "n", F.concat_ws(",", "memory_ids").alias("ids"))


def q_rollup_count(spark, d):
    return memory.rollups(spark.read.parquet(f"{d}/events.parquet"), 5, ["user_id", "event_type"], ["event_id"])


def q_task_list(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    t = e.select(F.pmod("user_id", F.lit(40)).alias("task_id"), F.col("event_id").alias("version"), F.when(F.col("event_id") % 3 != 0, F.col("ts")).alias("due_at"), F.col("event_type").alias("state"))
    return memory.tasks(t).select("task_id", "version", "state")


def _graded(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    results = e.select(F.col("event_type").alias("query_id"), F.col("event_id").alias("doc_id"), F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")).alias("rank"))
    return results, e.where("event_id % 4 = 0").select(F.col("event_type").alias("query_id"), F.col("event_id").alias("doc_id"))


def q_metric_ranking(spark, d):
    out = memory.ranking_metrics(*_graded(spark, d))
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in ("ndcg", "precision", "mrr")])


def q_metric_extraction(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    m = e.select(F.when(F.col("event_id") % 5 != 0, F.col("event_id")).alias("expected_id"), F.when(F.col("event_id") % 5 != 1, F.col("event_id")).alias("extracted_id"), (F.col("event_id") % 2 == 0).alias("type_ok"), (F.col("event_id") % 3 == 0).alias("cite_ok"))
    out = memory.extraction_metrics(m)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
_BEST = f"SELECT *, row_number() OVER (PARTITION BY namespace, key ORDER BY version DESC, memory_id) AS rn FROM {MEM}"
_TW = "CASE type " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in memory.TYPE_WEIGHTS.items()) + " END"
_HL = "CASE type " + " ".join(f"WHEN '{k}' THEN {h}" for k, h in memory.HALF_LIVES.items()) + " END"
_DEDUP = """f AS (SELECT vec_id AS id, vec_id % 4 AS ns, label AS p, vec_id % 3 / 3 AS c, list_transform(embedding, lambda x: round(CAST(x * 2 AS FLOAT))::DOUBLE) AS v FROM embeddings),
g AS (SELECT * FROM f UNION ALL SELECT id + 100000, ns, p, 0.5, v FROM f WHERE id % 5 = 0)"""
ORACLE_SQL = {
    "memory_supersede": f"SELECT memory_id, namespace, key, version FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY namespace, key ORDER BY version DESC, memory_id) AS rn FROM {MEM} WHERE NOT ({CURRENT})) WHERE rn = 1 UNION ALL SELECT *, 1 FROM {MEM} WHERE {CURRENT}) WHERE NOT tombstoned",
    "memory_conflict": f"SELECT namespace, subject, predicate, count(DISTINCT object) AS n_objects, count(*) AS n_facts FROM {MEM} GROUP BY ALL HAVING count(DISTINCT object) > 1",
    "memory_latest_wins": f"SELECT memory_id FROM (SELECT *, row_number() OVER (PARTITION BY namespace, subject, predicate ORDER BY version DESC, confidence DESC, memory_id) AS rn FROM {MEM}) WHERE rn = 1",
    "memory_surest_wins": f"SELECT memory_id FROM (SELECT *, row_number() OVER (PARTITION BY namespace, subject, predicate ORDER BY confidence DESC, version DESC, memory_id) AS rn FROM {MEM}) WHERE rn = 1",
    "memory_recall": f"""WITH m AS {MEM}, a AS (SELECT memory_id, row_number() OVER (ORDER BY memory_id * 7 % 101 DESC, memory_id) - 1 AS r FROM m QUALIFY r < 200), b AS (SELECT memory_id, row_number() OVER (ORDER BY memory_id * 13 % 97 DESC, memory_id) - 1 AS r FROM m QUALIFY r < 200),
    f AS (SELECT memory_id, sum(w / (60 + r)) AS rrf FROM (SELECT memory_id, r, 1.0 AS w FROM a UNION ALL SELECT memory_id, r, 1.5 FROM b) GROUP BY memory_id),
    s AS (SELECT m.*, rrf * {_TW} * CASE WHEN ts >= TIMESTAMP '2024-02-01' THEN 1.0 ELSE exp(-0.6931471805599453 * floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 1e6) / {_HL}) END * confidence * CASE type WHEN 'event' THEN 1.6 WHEN 'fact' THEN 1.3 ELSE 1.0 END AS score FROM m JOIN f USING (memory_id) WHERE confidence >= 0.1),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY namespace, key ORDER BY version DESC, score DESC, memory_id) AS rn FROM s WHERE NOT ({CURRENT})) WHERE rn = 1 UNION ALL SELECT *, 1 FROM s WHERE {CURRENT})
    SELECT memory_id, round(score, 8) AS score FROM k WHERE NOT tombstoned ORDER BY k.score DESC, memory_id LIMIT 25""",
    "memory_forget": f"WITH g AS (SELECT * FROM {MEM} UNION ALL SELECT memory_id, namespace, key, {memory.TOMBSTONE}, ts, confidence, true, type, text, subject, predicate, object FROM {MEM} WHERE memory_id % 6 = 0) SELECT memory_id FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY namespace, key ORDER BY version DESC, memory_id) AS rn FROM g WHERE NOT ({CURRENT})) WHERE rn = 1 UNION ALL SELECT *, 1 FROM g WHERE {CURRENT}) WHERE NOT tombstoned",
    "semantic_dedup": f"WITH {_DEDUP}, n AS (SELECT a.id, max(CASE WHEN b.c > a.c OR (b.c = a.c AND b.id < a.id) THEN 1 ELSE 0 END) AS beaten FROM g a JOIN g b ON a.ns = b.ns AND a.p = b.p AND a.id <> b.id WHERE list_inner_product(a.v, b.v) / nullif(sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)), 0) >= 0.97 GROUP BY a.id) SELECT g.id AS memory_id, CASE WHEN beaten IS NULL THEN 'keep' WHEN beaten = 1 THEN 'drop' ELSE 'supersede' END AS decision FROM g LEFT JOIN n USING (id)",
    "dedup_report": f"SELECT count(*) AS records, count(DISTINCT (namespace, subject, predicate)) AS groups, count(*) FILTER (WHERE memory_id % 3 = 0) AS keeps, count(*) FILTER (WHERE memory_id % 3 = 1) AS drops, count(*) FILTER (WHERE memory_id % 3 = 2) AS supersedes FROM {MEM} WHERE namespace = 't1'",
    "lineage": "SELECT event_id AS memory_id, 'raw' AS topic, unnest([event_id, event_id // 2]) AS parent_offset FROM events",
    "lineage_descendants": "SELECT topic, parent_offset, count(*) AS n, string_agg(CAST(memory_id AS VARCHAR), ',' ORDER BY memory_id) AS ids FROM (SELECT event_id AS memory_id, 'raw' AS topic, unnest([event_id, event_id // 2]) AS parent_offset FROM events) GROUP BY topic, parent_offset",
    "rollup_count": "SELECT user_id, event_type, (rn - 1) // 5 AS batch, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) GROUP BY 1, 2, 3 HAVING count(*) = 5",
    "task_list": "SELECT user_id % 40 AS task_id, max(event_id) AS version, arg_max(event_type, event_id) AS state FROM events GROUP BY 1",
    "metric_ranking": "WITH r AS (SELECT event_type AS q, event_id AS d, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k FROM events), n AS (SELECT event_type AS q, count(*) AS n FROM events WHERE event_id % 4 = 0 GROUP BY 1), h AS (SELECT q, sum(CASE WHEN d % 4 = 0 THEN 1.0 / log2(k + 1) ELSE 0 END) AS dcg, sum(CASE WHEN d % 4 = 0 THEN 1 ELSE 0 END) AS f, min(CASE WHEN d % 4 = 0 THEN k END) AS first FROM r WHERE k <= 10 GROUP BY q) SELECT n.q AS query_id, round(coalesce(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= n.n), 0), 6) AS ndcg, round(coalesce(f / 10, 0), 6) AS precision, round(coalesce(1 / first, 0), 6) AS mrr FROM n LEFT JOIN h USING (q)",
    "metric_extraction": "SELECT round(h / got, 6) AS precision, round(h / want, 6) AS recall, round(t / h, 6) AS type_accuracy, round(c / h, 6) AS cite_accuracy, round(2 * (h / got) * (h / want) / (h / got + h / want), 6) AS f1 FROM (SELECT count(*) FILTER (WHERE event_id % 5 > 1) AS h, count(*) FILTER (WHERE event_id % 5 <> 1) AS got, count(*) FILTER (WHERE event_id % 5 <> 0) AS want, count(*) FILTER (WHERE event_id % 5 > 1 AND event_id % 2 = 0) AS t, count(*) FILTER (WHERE event_id % 5 > 1 AND event_id % 3 = 0) AS c FROM events)",
}
