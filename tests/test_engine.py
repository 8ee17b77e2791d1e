"""Operators that SQL cannot express, edge cases, and plans."""

import datetime as dt
import json
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidelog.functions import geo, text, vector
from tidelog.functions import json as J
from tidelog.model import ENVELOPE, as_topic, resolve_field, table_name
from tidelog.operators import aggs, dsl, fusion, logops, memory, text_index
from tidelog.plans import log_queries as L
from tidelog.plans import planner
from tidelog.sources import catalog as C
from tidelog.sources import sinks as K
from tidelog.streaming import windows as S


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


# sources and sinks


def test_envelope_and_names(spark, sf):
    t = L.events_topic(spark, sf)
    assert [(f.name, f.dataType) for f in t.schema] == [(f.name, f.dataType) for f in ENVELOPE]
    empty = as_topic(spark.range(1), "t", partition=F.lit(0), offset=F.col("id"), timestamp=F.lit(0).cast("timestamp"), value=F.lit(None).cast("string"))
    assert bytes(empty.first()._value) == b""
    assert table_name("a-b.c d_é") == "a_b_c_d_é"
    assert [resolve_field(t, n) for n in ("offset", "_offset", "nothing")] == ["_offset", "_offset", None]


def test_catalog(spark, sf, tmp_path):
    c = C.Catalog(spark)
    c.register_file("nation-x", f"{sf}/nation.parquet")
    c.register_memory("mem", [(1,), (2,)], "a int")
    assert c.exists("nation-x") and c.describe("mem").names == ["a"]
    assert c.rows("SELECT a FROM mem ORDER BY a", limit=1) == ([{"a": 1}], True)
    assert c.rows("SELECT a FROM mem", limit=2)[1] is False
    n = [0]

    def provider():
        n[0] += 1
        return spark.range(n[0])

    c.register_provider("live", provider)
    assert [c.sql("SELECT count(*) AS n FROM live").first().n for _ in range(2)] == [1, 2]
    assert len(list(c.stream("SELECT * FROM mem"))) == 2 and "Physical Plan" in c.explain("SELECT * FROM mem")
    assert c.deregister("mem") and not c.exists("mem")
    assert c.ticket("sql:SELECT 1") == ("sql", "SELECT 1") and c.ticket("vector:t:a:b:5") == ("vector", "t", "a:b", 5)
    for bad in ("sql:", "vector:t:x", "z"):
        with pytest.raises(ValueError):
            c.ticket(bad)
    with pytest.raises(ValueError):
        c.register_files("none", [])
    spark.range(3).write.parquet(str(tmp_path / "a"))
    spark.range(3).withColumn("b", F.lit(1)).write.parquet(str(tmp_path / "b"))
    c.register_files("two", [str(tmp_path / "a"), str(tmp_path / "b")])
    assert c.describe("two").names == ["id", "b"]
    c.register_files("first", [str(tmp_path / "a"), str(tmp_path / "b")], merge_schema=False)
    assert c.describe("first").names == ["id"]
    c.register_directory("dir", str(tmp_path))
    assert c.sql("SELECT * FROM dir").count() == 6


def test_segments_are_pruned(spark, sf, tmp_path):
    t = L.events_topic(spark, sf).withColumn("topic_", F.lit(0)).drop("topic_")
    path = str(tmp_path / "seg")
    t.repartitionByRange(8, "_offset").write.parquet(path)
    m = C.manifest(spark, [path]).cache()
    assert m.agg(F.sum("rows")).first()[0] == t.count()
    want = sorted(r._offset for r in C.offset_range(t, 100, 180).collect())
    kept = C.pruned_scan(spark, m, t.schema, offsets=(100, 180))
    assert sorted(r._offset for r in kept.collect()) == want
    assert len(kept.inputFiles()) < 8
    assert C.pruned_scan(spark, m, t.schema, offsets=(10**9, 10**9 + 1)).count() == 0
    both = C.pruned_scan(spark, m, t.schema, offsets=(0, 500), times=("2024-01-01 00:00:00", "2024-01-03 00:00:00"))
    assert both.count() == C.time_range(C.offset_range(t, 0, 500), "2024-01-01 00:00:00", "2024-01-03 00:00:00").count()


def test_pushdown(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").where("event_id >= 5 AND event_id < 9").select("event_id")
    plan = e._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(event_id), GreaterThanOrEqual(event_id,5), LessThan(event_id,9)]" in plan and "ReadSchema: struct<event_id:bigint>" in plan


def test_write_segments(spark, sf, tmp_path):
    t = L.events_topic(spark, sf)
    K.write_segments(t, str(tmp_path / "x"), unit="day", bloom=["_offset"])
    back = spark.read.parquet(str(tmp_path / "x"))
    assert back.count() == t.count() and {"_topic", "_partition", "day"} <= set(back.columns)
    assert all(len(str(r.day).zfill(10)) == 10 for r in back.select("day").distinct().collect())


@pytest.mark.parametrize(
    "value, want",
    [('{"a": 1}', {"a": "int64"}), ('{"a": 1.0}', {"a": "float64"}), ('{"a": null}', {"a": "string"}), ('{"a": [1]}', {"a": "string"}), ('{"a": true}', {"a": "boolean"}), ("[1]", {}), ("nope", {}), ('{"a":"x","b":2}', {"a": "string", "b": "int64"})],
)
def test_inferred_types(spark, value, want):
    got = K.infer_json(spark.createDataFrame([(value,)], "_value string")).collect()
    assert {r.name: r.type for r in got} == want


def test_inference_widens_and_caps(spark):
    rows = [('{"a":1,"b":1}',), ('{"a":1.5,"b":"x"}',), ('{"c":%s}' % "1",)]
    got = {r.name: (r.type, r.nullable, r.n) for r in K.infer_json(spark.createDataFrame(rows, "_value string")).collect()}
    assert got == {"a": ("float64", True, 2), "b": ("string", True, 2), "c": ("int64", True, 1)}
    wide = json.dumps({f"k{i:03}": i for i in range(90)})
    assert K.infer_json(spark.createDataFrame([(wide,)], "_value string")).count() == 64
    fields = [("a", "int64", False), ("b:c", "string", True)]
    assert K.parse_schema(K.schema_text(fields)) == fields


def test_json_columns(spark):
    rows = [('{"a": 1, "s": {"x": 1}}',), ('{"a": "1", "s": null}',), ('{"a": 1.5}',), ("no",)]
    got = K.with_json_columns(spark.createDataFrame(rows, "_value string"), [("a", "int64", True), ("s", "string", True)]).collect()
    assert [r.a for r in got] == [1, None, None, None] and [r.s for r in got] == ['{"x":1}', None, None, None]


def test_dimension_check(spark):
    df = spark.createDataFrame([([1.0, 2.0],), (None,)], "v array<float>")
    assert df.select(K.check_dimension(F.col("v"), 2)).count() == 2
    with pytest.raises(Exception, match="expected 3 dimensions"):
        df.select(K.check_dimension(F.col("v"), 3)).collect()


@pytest.mark.parametrize("selector, want", [("value", '{"a":{"b":"x"},"n":5}'), ("key", "k"), ("$.a.b", "x"), ("$.n", "5"), ("$.z", None), ("other", '{"a":{"b":"x"},"n":5}')])
def test_embedding_text(spark, selector, want):
    df = spark.createDataFrame([('{"a":{"b":"x"},"n":5}', "k")], "_value string, _key string")
    assert df.select(K.embedding_text(selector).alias("t")).first().t == want


def test_flushed_offset_never_goes_back(spark):
    f = spark.createDataFrame([("t", 0, 10), ("t", 1, 3)], "_topic string, _partition int, flushed_offset long")
    w = spark.createDataFrame([("t", 0, 4), ("t", 1, 9), ("t", 2, 1)], "_topic string, _partition int, _offset long")
    assert {r._partition: r.flushed_offset for r in K.advance_flushed(f, w).collect()} == {0: 10, 1: 9, 2: 1}


# functions


@pytest.mark.parametrize(
    "value, path, text_, string, int_, float_",
    [
        ('{"a":"x"}', "$.a", '"x"', "x", None, None), ('{"a":7}', "$.a", "7", None, 7, 7.0), ('{"a":"7"}', "$.a", '"7"', "7", None, None), ('{"a":1.5}', "$.a", "1.5", None, None, 1.5),
        ('{"a":1e3}', "$.a", "1000.0", None, None, 1000.0), ('{"a":{"b":[1,2]}}', "$.a.b[1]", "2", None, 2, 2.0), ('{"a":null}', "$.a", "null", None, None, None), ('{"a":1}', "$.b", None, None, None, None),
        ('{"a":1}', "a", None, None, None, None), ("{bad", "$.a", None, None, None, None), (None, "$.a", None, None, None, None),
    ],
)
def test_json_functions(spark, value, path, text_, string, int_, float_):
    v = spark.createDataFrame([(value,)], "v string")
    r = v.select(J.json_extract(F.col("v"), path).alias("t"), J.json_extract_string(F.col("v"), path).alias("s"), J.json_extract_int(F.col("v"), path).alias("i"), J.json_extract_float(F.col("v"), path).alias("f")).first()
    assert (r.t, r.s, r.i, r.f) == (text_, string, int_, float_)


@pytest.mark.parametrize("a, b, metric, want", [([1, 0], [1, 0], "cosine", 0), ([1, 0], [0, 1], "cosine", 1), ([1, 0], [-1, 0], "cosine", 2), ([3, 4], [0, 0], "euclidean", 5), ([1, 2], [3, 4], "dot", 11), ([1], [2], "other", None), ([0, 0], [1, 1], "cosine", "nan"), ([1], [1, 2], "dot", "nan")])
def test_vector_distance(spark, a, b, metric, want):
    df = spark.createDataFrame([([float(x) for x in a], [float(x) for x in b])], "a array<double>, b array<double>")
    got = df.select(vector.vector_distance(F.col("a"), F.col("b"), metric).alias("d")).first().d
    J.register(spark)
    sql = spark.sql("SELECT vector_distance(a, b, :m) AS d FROM {t}", args={"m": metric}, t=df).first().d
    for x in (got, sql):
        assert x is None if want is None else (x != x) if want == "nan" else x == pytest.approx(want)


def test_quantiser_round_trip(spark):
    df = spark.createDataFrame([([0.0, 5.0],), ([1.0, 5.0],), ([0.5, 5.0],)], "embedding array<float>")
    both = df.crossJoin(vector.quantiser(df))
    code = vector.quantise(F.col("embedding"), F.col("low"), F.col("step"))
    for r in both.select("embedding", code.alias("c"), vector.dequantise(code, F.col("low"), F.col("step")).alias("d")).collect():
        assert all(0 <= x <= 255 for x in r.c) and r.d == pytest.approx(r.embedding, abs=0.005)


def test_embed_rerank_and_add(spark):
    df = spark.createDataFrame([(1, "aa"), (2, "b"), (3, None)], "id int, t string")
    got = vector.embed(df, "t", lambda ts: [[float(len(t))] for t in ts])
    assert [list(r.embedding) for r in got.orderBy("id").collect()] == [[2.0], [1.0], [0.0]]
    top = vector.rerank(df, "q", "t", lambda q, ts: [-float(len(t)) for t in ts], 2).collect()
    assert [r.id for r in top] == [3, 2]
    base = spark.createDataFrame([(1, [1.0])], "id int, embedding array<double>")
    new = spark.createDataFrame([(1, [9.0]), (2, [2.0]), (2, [3.0])], "id int, embedding array<double>")
    assert {r.id: r.embedding[0] for r in vector.add_vectors(base, new.withColumn("o", F.col("embedding")[0]).drop("o"), ["id"], "embedding").collect()} == {1: 1.0, 2: 2.0}


def test_geo(spark):
    assert geo.parse_distance("12km") == 12000 and geo.parse_distance("3mi") == pytest.approx(4828.032)
    assert geo.parse_point("1,2") == geo.parse_point([2, 1]) == geo.parse_point({"lat": 1, "lon": 2}) == (1.0, 2.0)
    for bad in ("91,0", {"lat": 0, "lon": 181}):
        with pytest.raises(ValueError):
            geo.parse_point(bad)
    with pytest.raises(ValueError):
        geo.parse_distance("far")
    with pytest.raises(ValueError):
        geo.in_polygon(F.lit(0.0), F.lit(0.0), [(0, 0), (1, 1)])
    assert one(spark, geo.haversine(F.lit(0.0), F.lit(0.0), 0.0, 180.0)) == pytest.approx(geo.EARTH_M * 3.141592653589793)
    assert one(spark, geo.within(F.lit(0.0), F.lit(179.9), 0.0, -179.9, 30_000))  # over the antimeridian
    assert one(spark, geo.within(F.lit(89.95), F.lit(0.0), 89.95, 180.0, 30_000))  # over the pole
    corner = geo.within(F.lit(0.9), F.lit(0.9), 0.0, 0.0, 112_000)
    assert not one(spark, corner) and one(spark, geo.within(F.lit(0.9), F.lit(0.9), 0.0, 0.0, 112_000, bbox_only=True))


def test_text(spark):
    t = lambda s, **k: one(spark, text.tokens(F.lit(s), **k))
    assert t("The QUICK-brown fox's den") == ["quick", "brown", "fox", "s", "den"] and t("the of and") == [] and t("") == []
    assert t("running caresses ponies agreed relational") == ["run", "caress", "poni", "agre", "relat"]
    assert one(spark, text.subjects(F.lit("Did Anna meet user:luis and Bob, the Anna?"))) == ["anna", "bob", "user:luis"]
    assert one(spark, text.subjects(F.lit("Hello,World tell About Users: Says X-1"))) == ["Users:", "hello", "world", "x-1"]
    facts = one(spark, text.rule_facts(F.lit("mail a.b@c.org or call (+1 555 123 4567, see https://x.y/z at 2024-01-02T03:04:05Z")))
    assert {(f.kind, f.value) for f in facts} >= {("email", "a.b@c.org"), ("url", "https://x.y/z"), ("date", "2024-01-02T03:04:05Z")}
    assert one(spark, text.highlight(F.lit("a Cat sat"), ["cat"])) == "a <em>Cat</em> sat"
    b = lambda i, k, s, **kw: one(spark, text.intent_boost(F.lit(i), F.lit(k), F.lit(s), **kw))
    assert [b("numeric", "fact", "5 cats"), b("numeric", "fact", "x", object_is_number=F.lit(True)), b("numeric", "event", ""), b("temporal", "event", ""), b("temporal", "task", "", due_at=F.lit(1)), b("temporal", "fact", "on Monday"), b("identity", "fact", "5")] == [1.3, 1.8, 1.1, 1.6, 1.4, 1.3, 1.0]


# query language


def test_query_errors(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    for q in ({}, {"nope": {}}, {"range": {"n_chars": {}}}, {"term": {"nothing": 1}}, {"term": {"a": 1, "b": 2}}):
        with pytest.raises(dsl.QueryError):
            dsl.compile_query(df, q)
    with pytest.raises(dsl.QueryError):
        dsl.simple_query(spark.range(1), "x")
    assert df.where(dsl.compile_query(df, {"exists": {"field": "nothing"}})).count() == 0
    assert df.where(dsl.simple_query(df, "src3")).count() == df.where("source = 'src3'").count()
    with pytest.raises(ValueError):
        aggs.aggregate(df, {"x": {"nope": {"field": "lang"}}})


def test_wildcard_needs_a_character(spark):
    df = spark.createDataFrame([("ab",), ("abc",), ("xabc",)], "t string")
    assert [r.t for r in df.where(dsl.wildcard(df, {"t": "ab*"})).collect()] == ["abc"]
    assert [r.t for r in df.where(dsl.fuzzy(df, {"t": {"value": "abd", "fuzziness": 1, "prefix_length": 1}})).collect()] == ["ab", "abc"]


def test_fuzzy_counts_bytes(spark):
    words = ["retion", "rétion", "retioné", "reton", "éretion", "retiones", "ŕétion"]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    for word in ("retion", "rétion"):
        for n in (1, 2, 3):
            want = [r[0] for r in duckdb.sql(f"SELECT w FROM (SELECT unnest({words}) AS w) WHERE levenshtein(w, '{word}') <= {n}").fetchall()]
            assert [r.t for r in df.where(dsl.fuzzy(df, {"t": {"value": word, "fuzziness": n}})).collect()] == want


def test_field_types_and_arrays(spark):
    rows = [('{"d":"2024-01-01T00:00:00Z","k":"id-1","t":"two words","n":1,"f":1.5,"b":true,"o":{}}',)]
    got = {r.path: r.type for r in text_index.field_types(spark.createDataFrame(rows, "_value string")).collect()}
    assert got == {"d": "date", "k": "keyword", "t": "text", "n": "i64", "f": "f64", "b": "bool", "o": "json"}
    tags = spark.createDataFrame([(["a", "b"],), (["a"],)], "tags array<string>")
    assert [tuple(r) for r in aggs.terms(tags, "tags").collect()] == [("a", 2), ("b", 1)]


# fusion and planning


def test_rrf_does_not_depend_on_order(spark):
    a = spark.createDataFrame([("x", 0), ("y", 1)], "id string, rank int").withColumn("mode", F.lit("text"))
    b = spark.createDataFrame([("y", 0), ("z", 1)], "id string, rank int").withColumn("mode", F.lit("vector"))
    get = lambda *ls: {r.id: r.score for r in fusion.rrf(list(ls), ["id"]).collect()}
    assert get(a, b) == get(b, a) and get(a, b)["y"] == pytest.approx(1 / 61 + 1 / 60)


def test_profiles(spark, tmp_path):
    (tmp_path / "own.json").write_text('{"weights": {"source_count": 2.0}}')
    p = fusion.load_profiles(str(tmp_path))
    df = spark.createDataFrame([(1, 3, float("inf"))], "id int, source_count int, x double")
    assert fusion.rank(df, "own", profiles=p).first().final_score == 6.0
    assert fusion.rank(df, "unknown", profiles=p).first().final_score == pytest.approx(30 * 1.2)
    assert [one(spark, fusion.boost_holds(F.lit(1.0), op, 1.0)) for op in ("gt", "gte", "lt", "lte", "eq")] == [False, True, False, True, True]


def topics(spark):
    rows = [("t", i % 2, i, dt.datetime(2024, 1, 1, i), f"alpha {'beta' if i % 3 else 'gamma'} {i}", [float(i), 1.0]) for i in range(12)]
    df = spark.createDataFrame(rows, "_topic string, _partition int, _offset long, _timestamp timestamp, body string, vec array<double>")
    return {"t": planner.Topic(df, text="body", vector="vec"), "u": planner.Topic(df.withColumn("_topic", F.lit("u")), text="body")}


def test_planner(spark):
    now = F.lit("2024-01-02").cast("timestamp")
    r = planner.Request(["t", "u"], ["text", "vector"], words="gamma", vector=[1.0, 0.0], k=3)
    got = planner.run(topics(spark), r, now=now).orderBy("position").collect()
    assert [x.position for x in got] == [1, 2, 3] and all(x.explanation.startswith("score=") for x in got)
    assert got[0].source_count == 2
    grouped = planner.run(topics(spark), planner.Request(["t", "u"], ["text"], words="gamma", k=2, grouped=True), now=now).collect()
    assert sorted((x._topic, x.position) for x in grouped) == [("t", 1), ("t", 2), ("u", 1), ("u", 2)]
    some = planner.Request(["t"], ["text"], words="alpha", k=20, partitions=[1], timestamp_gte="2024-01-01 04:00:00")
    assert {x._offset for x in planner.run(topics(spark), some, now=now).collect()} == {5, 7, 9, 11}
    with pytest.raises(planner.PlanError):
        planner.run(topics(spark), planner.Request(["u"], ["vector"], vector=[1.0]), now=now)
    last = planner.run(topics(spark), planner.Request(["t"], ["text"], words="alpha", k=2), now=now, reranker=lambda d: d.withColumn("rerank_score", F.col("_offset").cast("double")))
    assert last.orderBy("position").first()._offset == max(x._offset for x in last.collect())


def test_timeout(spark):
    slow = spark.range(1, numPartitions=1).select(F.expr("reflect('java.lang.Thread', 'sleep', 20000L)"))
    slow = spark.range(2_000_000_000, numPartitions=2).select(F.sum(F.sin("id"))) if slow is not None else slow
    with pytest.raises(TimeoutError):
        planner.collect(slow, 100)
    assert planner.collect(spark.range(2)) and len(planner.collect(spark.range(2))) == 2


# maintenance, memory


def test_compaction_is_idempotent(spark, sf):
    t = logops.compact_by_key(L.events_topic(spark, sf))
    assert sorted(r._offset for r in logops.compact_by_key(t).collect()) == sorted(r._offset for r in t.collect())


def test_assignment():
    parts = [("a", i) for i in range(5)]
    first = logops.assign_sticky(parts, {"x": {"a"}, "y": {"a"}}, {})
    assert sorted(sum(first.values(), [])) == parts and {len(v) for v in first.values()} == {2, 3}
    then = logops.assign_sticky(parts, {"x": {"a"}, "y": {"a"}, "z": {"a"}}, first)
    assert then["x"] == first["x"] and then["z"] == []
    gone = logops.assign_sticky(parts, {"x": {"a"}, "z": {"a"}}, first)
    assert set(first["x"]) <= set(gone["x"]) and sorted(sum(gone.values(), [])) == parts


def test_schemas():
    rec = lambda *fs: {"type": "record", "name": "r", "fields": list(fs)}
    a, b = {"name": "a", "type": "int"}, {"name": "b", "type": "string"}
    assert logops.check_compatibility(rec(a, b), [rec(a)], "BACKWARD") == ["b: no default"]
    assert logops.check_compatibility(rec(a, b | {"default": ""}), [rec(a)], "FULL") == []
    assert logops.check_compatibility(rec({"name": "a", "type": "long"}), [rec(a)], "BACKWARD") == []
    assert logops.check_compatibility(rec({"name": "a", "type": "long"}), [rec(a)], "FORWARD") == ["a: type changed"]
    assert logops.check_compatibility(rec(b), [rec(a), rec()], "FORWARD_TRANSITIVE") == ["a: no default"]
    assert logops.check_compatibility(rec(b), [rec(a)], "NONE") == []
    assert logops.memory_topic("acme:user:1", "fact") == "mem.fact.acme" and logops.memory_topic("acme:u:1", "raw") == "mem.raw.acme.u.1"


def test_semantic_dedup_pairs_no_copies(spark, monkeypatch):
    """The decisions of all pairs, over several blocks; vectors' products come from matrices, never from a join of the facts with themselves."""
    monkeypatch.setattr(memory, "DEDUP_BLOCK", 3)
    rng = random.Random(5)
    base = [[rng.choice([-1.0, 0.0, 1.0]) for _ in range(6)] for _ in range(8)]
    odd = [None, [0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [3.0, 4.0], [6.0, 8.0], []]
    rows = []
    for i in range(160):
        v = list(rng.choice(base + odd) or []) or rng.choice(odd)
        if v and len(v) == 6 and None not in v and i % 3 == 0:
            v = [x + rng.uniform(-0.2, 0.2) for x in v]
        rows.append((i if i < 150 else i - 20, rng.choice(["a", None, ""]), "s", rng.choice(["p", "q", None]), rng.choice([0.1, 0.5, 0.9]), v))
    facts = spark.createDataFrame(rows, "memory_id long, namespace string, subject string, predicate string, confidence double, embedding array<double>")

    def cos(a, b):
        if not a or not b or len(a) != len(b) or None in a or None in b:
            return 0
        under = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b, strict=True)) / under if under else 0

    beaten = {}
    for a in rows:
        for b in rows:
            if a[1:4] == b[1:4] and a[0] != b[0] and cos(a[5], b[5]) >= 0.9:
                beaten[a[0]] = beaten.get(a[0], False) or (-b[4], b[0]) < (-a[4], a[0])
    want = sorted((r[0], {None: "keep", True: "drop", False: "supersede"}[beaten.get(r[0])]) for r in rows)
    out = memory.semantic_dedup(facts, threshold=0.9)
    assert out.columns == [*facts.columns, "decision"]
    assert sorted((r.memory_id, r.decision) for r in out.collect()) == want
    assert len({d for _, d in want}) == 3
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "aggregate(zip_with" not in plan


def test_supersession_is_idempotent(spark, sf):
    from tidelog.plans.memory_queries import memories

    m = memory.current(memories(spark, sf))
    assert memory.current(m).count() == m.count()


# streaming


@pytest.fixture
def source(spark, sf, tmp_path):
    t = L.events_topic(spark, sf).orderBy("_timestamp")
    path = str(tmp_path / "log")
    t.coalesce(1).write.parquet(path)
    return spark.readStream.schema(t.schema).parquet(path), t, tmp_path


def drain(stream, tmp_path, mode="append"):
    name = f"q{abs(hash(str(tmp_path)))}_{mode}"
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
    q.awaitTermination()
    return sorted(map(tuple, stream.sparkSession.table(name).collect()), key=repr)


@pytest.mark.parametrize("shape", [{"size": "1 hour"}, {"size": "1 hour", "step": "30 minutes"}, {"size": "", "gap": "10 minutes"}])
def test_stream_equals_batch(source, shape):
    stream, batch, tmp = source
    keys = [F.col("_partition")] if "gap" in shape else None
    make = lambda df, **k: S.windowed(df, kinds={"n": "count", "hi": "max"}, value=S.number("value"), keys=keys, **shape, **k)
    whole = sorted(map(tuple, make(batch).collect()), key=repr)
    if "gap" in shape:  # sessions are told once the watermark has passed them
        got = drain(make(stream, watermark="10 hours"), tmp)
        assert len(got) > 0.9 * len(whole) and set(got) <= set(whole)
    else:
        assert drain(make(stream, watermark="10 hours"), tmp, "complete") == whole


def test_stream_dedup_and_rollup(source):
    stream, batch, tmp = source
    keyed = lambda df: df.withColumn("producer_id", F.pmod("_offset", F.lit(3))).withColumn("sequence", F.floor(F.col("_offset") / 9))
    got = drain(S.dedup_producers(keyed(stream), delay="100 days").select("producer_id", "_partition", "sequence"), tmp)
    assert got == sorted(map(tuple, S.dedup_producers(keyed(batch)).select("producer_id", "_partition", "sequence").collect()), key=repr)
    rolled = drain(S.rollup_stream(stream.select("_partition"), 20, ["_partition"]), tmp / "r")
    want = [(p, b, 20) for p, n in ((r._partition, r["count"]) for r in batch.groupBy("_partition").count().collect()) for b in range(n // 20)]
    assert rolled == sorted(want, key=repr)


def test_register_poll_remove(spark, source):
    stream, batch, _ = source
    a = S.Aggregations(spark)
    a.register("running_counts", S.windowed(stream, size="1 day", kinds={"n": "count"}, value=S.number("value")))
    assert a.poll("running_counts").agg(F.sum("n")).first()[0] == batch.count()
    a.remove("running_counts")
    assert a.queries == {}


def test_fan_out(spark, source):
    stream, batch, tmp = source
    seen = []
    K.fan_out(stream, [lambda b, e: seen.append(b.count()), lambda b, e: seen.append(-b.count())], str(tmp / "ck")).awaitTermination()
    assert sum(seen) == 0 and max(seen) == batch.count()


def test_rate_limit(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(seconds=s)) for s in (0, 0.1, 0.2, 1.2)] + [("b", t0)]
    got = S.rate_limited(spark.createDataFrame(rows, "tenant string, _timestamp timestamp"), 2).orderBy("tenant", "_timestamp").collect()
    assert [r.allowed for r in got] == [True, True, False, True, True] and got[2].retry_after > 0
