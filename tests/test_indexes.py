"""Persisted indexes and caches."""

import numpy as np

from tidelog.functions import text
from tidelog.functions.vector import knn
from tidelog.operators import dsl
from tidelog.operators.caches import Cache, cached_embedder, cached_top
from tidelog.operators.joins import asof_join, interval_join
from tidelog.operators.text_index import TextIndex
from tidelog.operators.vector_index import VectorIndex
from tidelog.sources import catalog, sinks
from pyspark.sql import functions as F


def test_stems_are_the_same_on_the_driver(spark, sf):
    words = spark.read.parquet(f"{sf}/documents.parquet").select(F.explode(text.raw_tokens(F.col("text"))).alias("w")).distinct()
    words = words.union(spark.createDataFrame([(w,) for w in "relational hopefulness analogies yes boyish sayings enjoyed agreedly feudalism ratio tionally exceeding".split()], "w string"))
    got = words.select("w", text.stem(F.col("w")).alias("s")).collect()
    assert len(got) > 1000 and all(r.s == text.stem_word(r.w) for r in got)


def test_text_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Running shoes and batteries"), (2, "the run of a shoe"), (3, None), (4, "batteries, running"), (5, "shoes " * 50)], "id long, text string")
    index = TextIndex(spark, f"file://{tmp_path}/index")
    assert not index.exists()
    index.add(docs, "text")
    assert index.exists()
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(index.match(["RUN", "the"])) == [1, 2, 4] and ids(index.match(["run", "shoes"], every=True)) == [1, 2]
    assert ids(index.phrase(["run", "shoe"])) == [1, 2] and ids(index.phrase(["batteries", "run"])) == [4]
    best = index.bm25(["shoe"]).orderBy(F.desc("score")).collect()
    assert [r.id for r in best] == [5, 2, 1] and index.match(["nothing"]).count() == 0 and index.bm25(["of"]).count() == 0
    plan = index.match(["shoe"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "EqualTo(term,shoe)" in plan or "In(term, [shoe])" in plan
    # another epoch adds to it, the same one replaces
    more = spark.createDataFrame([(6, "shoe")], "id long, text string")
    index.sink("text")(more, 1)
    index.sink("text")(more, 1)
    assert ids(index.match(["shoe"])) == [1, 2, 5, 6]
    assert tuple(index.statistics().first()) == (6, 3 + 2 + 0 + 2 + 50 + 1, 3)


def test_vector_index(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 8)) * 5
    x = centres[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None)], "id long, embedding array<double>")
    index = VectorIndex(spark, f"file://{tmp_path}/vectors").build(rows, metric="euclidean")
    again = VectorIndex(spark, f"file://{tmp_path}/vectors")
    assert again._meta()["probes"] < len(again._meta()["centres"]) / 2 and again.statistics().agg(F.sum("rows")).first()[0] == 1500
    hits = total = 0
    for i in range(0, 1500, 300):
        q = x[i].tolist()
        got = [r.id for r in again.search(q, 10).collect()]
        hits += len(set(got) & {r.id for r in knn(rows.where("id < 5000"), q, 10, "euclidean", tie=["id"]).collect()})
        total += 10
    assert hits >= 0.9 * total
    plan = again.search(x[0].tolist(), 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell#" in plan or "cell#" in plan.split("PartitionFilters")[1].split("]")[0]
    new = spark.createDataFrame([(9000, (x[0] + 1e-6).tolist()), (0, x[0].tolist())], "id long, embedding array<double>")
    assert [r.id for r in again.search(x[0].tolist(), 2, pending=new).collect()] == [0, 9000]
    again.add(new)
    assert again.statistics().agg(F.sum("rows")).first()[0] == 1501
    index.clear()
    assert again._meta() is None


def test_caches(spark):
    now = [0.0]
    c = Cache(2, ttl=10, clock=lambda: now[0])
    assert [c.get(k, lambda k=k: k * 2) for k in (1, 2, 1, 3, 2)] == [2, 4, 2, 6, 4] and (c.hits, c.misses) == (1, 4)
    now[0] = 11
    assert c.get(2, lambda: "new") == "new"
    calls = []
    e = cached_embedder(lambda ts: calls.append(ts) or [[1.0] for _ in ts])
    assert e("a") == e("a") == [1.0] and calls == [["a"]]
    top = [cached_top(c, "q", lambda: spark.range(9).orderBy("id"), 2) for _ in range(2)]
    assert top[0] == top[1] == [{"id": 0}, {"id": 1}]


def test_joins_on_order(spark):
    left = spark.createDataFrame([("a", 5, "x"), ("a", 1, "y"), (None, 9, "z"), ("b", None, "w"), ("a", 5, "x")], "k string, t int, v string")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 5, 40), (None, 1, 1), ("b", 1, 7), ("a", None, 99)], "k string, t int, v int")
    got = asof_join(left, right, ["k"], "t", ["v"])
    assert got.columns == ["k", "t", "v", "right_v"]
    assert sorted((r.v, r.right_v) for r in got.collect()) == sorted([("x", 50), ("x", 50), ("y", None), ("z", None), ("w", None)], key=lambda p: (p[0], p[1] or 0))
    a = spark.createDataFrame([(1, 0, 10), (2, 25, 26)], "id int, begin int, end int").withColumn("k", F.lit(1))
    b = spark.createDataFrame([(1, 10, 30), (2, 11, 24), (3, -5, 100)], "id int, begin int, end int").withColumn("k", F.lit(1))
    pairs = sorted((r.id, r.right_id) for r in interval_join(a, b, ["k"], width=7).collect())
    assert pairs == [(1, 1), (1, 3), (2, 1), (2, 3)]


def test_time_keys_reach_the_folders(spark, sf, tmp_path):
    from tidelog.plans.log_queries import events_topic

    t = events_topic(spark, sf)
    sinks.write_segments(t, f"{tmp_path}/log", unit="hour", file_rows=50)
    back = spark.read.parquet(f"{tmp_path}/log")
    keys = ["0000473352", "0000473353", "0000473360", "oddity"]
    got = catalog.time_partitions(back, "hour", keys)
    want = t.where(catalog.time_key("hour").isin(keys)).count()
    assert got.count() == want > 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hour#" in plan.split("PartitionFilters")[1].split("]")[0] and "GreaterThanOrEqual(_timestamp" in plan


def test_result_modes(spark):
    df = spark.range(20)
    request = {"query": {"range": {"id": {"gte": 5}}}, "size": 3, "_source": ["id"]}
    assert dsl.execute(df, request, "count").first()[0] == 15 and dsl.execute(df, request, "all").count() == 15
    assert len(dsl.execute(df, request, tie=["id"]).collect()) == 3
