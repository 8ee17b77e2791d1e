"""Queries in the search language, with aggregations, full text, vectors, fusion and JSON functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text, vector
from ..functions import json as J
from ..operators import aggs, dsl, fusion, memory, text_index
from . import log_queries as L
from . import planner


def _t(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _found(spark, d, name, id_, query) -> DataFrame:
    df = _t(spark, d, name)
    return df.where(dsl.compile_query(df, query)).select(id_)


def _search(table, id_, query):
    return lambda spark, d: _found(spark, d, table, id_, query)


def _points(spark, d) -> DataFrame:
    return _t(spark, d, "customer").select("c_custkey", (F.col("c_custkey") * 7919 % 18000 / 100 - 90).alias("loc_lat"), (F.col("c_custkey") * 104729 % 36000 / 100 - 180).alias("loc_lon"))


POINTS = "(SELECT c_custkey, c_custkey * 7919 % 18000 / 100 - 90 AS lat, c_custkey * 104729 % 36000 / 100 - 180 AS lon FROM customer)"
POLYGON = [(0.0, 0.0), (60.0, 10.0), (20.0, 30.0), (50.0, 80.0), (-30.0, 60.0)]


def _geo(query):
    def run(spark, d):
        p = _points(spark, d)
        return p.where(dsl.compile_query(p, query)).select("c_custkey")

    return run


def _edges() -> str:
    out = []
    for (a, b), (c, e) in zip(POLYGON, [*POLYGON[1:], POLYGON[0]], strict=True):
        out.append(f"CASE WHEN ({a} > lat) <> ({c} > lat) AND lon < (lat - ({a})) * {(e - b) / (c - a)!r} + ({b}) THEN 1 ELSE 0 END")
    return " + ".join(out)


HAVERSINE = "2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(40.0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(40.0)) * pow(sin(radians(10.0 - lon) / 2), 2))))"
TOK = "list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda t: NOT list_contains([" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "], t))"
RAW = "regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+')"


def _stem_sql() -> str:
    """CTEs that stem the documents' words: voc (t, st), and tok (doc_id, s), each document's terms in order."""
    cut = lambda n: f"left(w, length(w) - {n})"
    chain = lambda rules, r: " ".join(f"WHEN ends_with(w, '{a}') THEN CASE WHEN length(w) - {len(a)} >= {r} THEN {cut(len(a))} || '{b}' ELSE w END" for a, b in rules)
    short, double = text.STEM_SHORT, text.STEM_DOUBLE
    re_ = lambda x, p: f"regexp_matches({x}, '{p}')"
    steps = [
        f"CASE WHEN ends_with(w, 'sses') THEN {cut(2)} WHEN {re_('w', '(?:ied|ies)$')} THEN CASE WHEN length(w) > 4 THEN {cut(2)} ELSE {cut(1)} END WHEN {re_('w', '(?:us|ss)$')} THEN w WHEN {re_('w', '[aeiouy].+s$')} THEN {cut(1)} ELSE w END",
        f"CASE WHEN kept THEN w WHEN ends_with(w, 'eedly') THEN CASE WHEN length(w) - 5 >= r1 THEN {cut(3)} ELSE w END WHEN ends_with(w, 'eed') THEN CASE WHEN length(w) - 3 >= r1 THEN {cut(1)} ELSE w END WHEN {re_('w', '[aeiouy].*(?:ingly|edly|ing|ed)$')} THEN regexp_replace(w, '(?:ingly|edly|ing|ed)$', '') || '#' ELSE w END",
        f"CASE WHEN NOT ends_with(w, '#') THEN w WHEN {re_('w', '(?:at|bl|iz)#$')} THEN {cut(1)} || 'e' WHEN {re_(cut(1), double)} THEN {cut(2)} WHEN length(w) - 1 <= r1 AND {re_(cut(1), short)} THEN {cut(1)} || 'e' ELSE {cut(1)} END",
        f"CASE WHEN NOT kept AND {re_('w', '^.+[^aeiouy][yY]$')} THEN {cut(1)} || 'i' ELSE w END",
        f"CASE WHEN kept THEN w {chain(text.STEM_2, 'r1')} WHEN ends_with(w, 'ogi') THEN CASE WHEN length(w) - 3 >= r1 AND ends_with(w, 'logi') THEN {cut(1)} ELSE w END WHEN ends_with(w, 'li') THEN CASE WHEN length(w) - 2 >= r1 AND {re_('w', '[cdeghkmnrt]li$')} THEN {cut(2)} ELSE w END ELSE w END",
        f"CASE WHEN kept THEN w WHEN ends_with(w, 'ative') THEN CASE WHEN length(w) - 5 >= r2 THEN {cut(5)} ELSE w END {chain(text.STEM_3, 'r1')} ELSE w END",
        f"CASE WHEN kept THEN w WHEN {re_('w', '[st]ion$')} THEN CASE WHEN length(w) - 3 >= r2 THEN {cut(3)} ELSE w END {chain([(x, '') for x in text.STEM_4], 'r2')} ELSE w END",
        f"CASE WHEN kept THEN w WHEN ends_with(w, 'e') THEN CASE WHEN length(w) - 1 >= r2 OR length(w) - 1 >= r1 AND NOT {re_(cut(1), short)} THEN {cut(1)} ELSE w END WHEN ends_with(w, 'll') AND length(w) - 1 >= r2 THEN {cut(1)} ELSE w END",
    ]
    whole = " ".join(f"WHEN t = '{a}' THEN '{b}'" for a, b in text.STEM_WHOLE.items())
    kept = ", ".join(f"'{w}'" for w in text.STEM_KEPT)
    out = f"raw AS (SELECT doc_id, unnest({RAW.format(c='text')}) AS t, generate_subscripts({RAW.format(c='text')}, 1) AS i FROM documents), v0 AS (SELECT t, regexp_replace(regexp_replace(t, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM (SELECT DISTINCT t FROM raw)), v1 AS (SELECT *, length(regexp_extract(w, '{text.STEM_REGION}')) AS f FROM v0), v2 AS (SELECT t, w, CASE WHEN f > 0 THEN f ELSE length(w) END AS r1 FROM v1), v3 AS (SELECT *, length(regexp_extract(w[r1 + 1:], '^.*?[aeiouy][^aeiouy]')) AS f FROM v2), v4 AS (SELECT t, w, r1, CASE WHEN f > 0 THEN r1 + f ELSE length(w) END AS r2 FROM v3), a0 AS (SELECT t, {steps[0]} AS w, r1, r2 FROM v4), s0 AS (SELECT *, w IN ({kept}) AS kept FROM a0)"
    for i, step in enumerate(steps[1:], 1):
        out += f", s{i} AS (SELECT t, {step} AS w, r1, r2, kept FROM s{i - 1})"
    out += f", voc AS (SELECT t, CASE WHEN length(t) <= 2 THEN t {whole} ELSE lower(w) END AS st FROM s{len(steps) - 1})"
    stop = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
    return out + f", tok AS (SELECT doc_id, list(st ORDER BY i) AS s FROM raw JOIN voc USING (t) WHERE t NOT IN ({stop}) GROUP BY doc_id)"


STEMMED = _stem_sql()
WORDS = ["retion", "hain", "therre", "reble", "ouing"]


def q_agg_terms(spark, d):
    return aggs.terms(_t(spark, d, "orders"), "o_orderpriority", size=3)


def q_agg_terms_ordered(spark, d):
    return aggs.terms(_t(spark, d, "events"), "user_id", size=7, min_doc_count=2, order={"_key": "desc"})


def q_agg_stats(spark, d):
    out = aggs.stats(_t(spark, d, "events"), "value")
    return out.select("count", "min", "max", F.round("avg", 6).alias("avg"), F.round("sum", 4).alias("sum"))


def q_agg_stats_empty(spark, d):
    return aggs.stats(_t(spark, d, "events").where("event_type = 'none at all'"), "value")


def q_agg_value_count(spark, d):
    return aggs.value_count(_t(spark, d, "events"), "value")


def q_agg_cardinality(spark, d):
    return aggs.cardinality(_t(spark, d, "events"), "user_id")


def q_agg_date_histogram(spark, d):
    return aggs.date_histogram(_t(spark, d, "events"), "ts", "1h")


def q_agg_range(spark, d):
    return aggs.range_buckets(_t(spark, d, "events"), "value", [{"to": 20}, {"from": 10, "to": 50}, {"key": "high", "from": 50}])


def q_agg_metrics(spark, d):
    made = aggs.aggregate(_t(spark, d, "orders"), {k: {k: {"field": "o_totalprice"}} for k in ("avg", "sum", "min", "max")})
    out = None
    for k, df in made.items():
        one = df.select(F.lit(k).alias("kind"), F.round("value", 2).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def q_search_sorted(spark, d):
    df = _t(spark, d, "orders")
    return dsl.search(df, {"query": {"range": {"o_totalprice": {"gt": 1000}}}, "sort": [{"o_totalprice": "desc"}], "from": 5, "size": 12, "_source": ["o_orderkey", "o_totalprice"]}, tie=["o_orderkey"])


def q_search_substring(spark, d):
    out = dsl.substring_search(L.events_topic(spark, d), "CLICK")
    return out.select("_offset", (F.col("score") > 0).alias("positive"))


def q_namespace_granted(spark, d):
    m = _t(spark, d, "events").select("event_id", F.concat_ws(":", F.concat(F.lit("t"), F.pmod("user_id", F.lit(9)).cast("string")), "event_type", F.pmod("event_id", F.lit(3)).cast("string")).alias("namespace"))
    g = spark.createDataFrame([("t1:*",), ("t2:click:**",), ("t3:view:0",), ("t4",)], "pattern string")
    return dsl.granted(m, g)


def q_geo_distances(spark, d):
    p = _points(spark, d)
    return p.select("c_custkey", F.round(geo.haversine(F.col("loc_lat"), F.col("loc_lon"), 40.0, 10.0), 2).alias("h"), F.round(geo.plane(F.col("loc_lat"), F.col("loc_lon"), 40.0, 10.0), 2).alias("p"))


def q_fn_json(spark, d):
    t = L.events_topic(spark, d)
    v = F.col("_value")
    return t.select("_offset", J.json_extract(v, "$.event_type").alias("j"), J.json_extract_string(v, "$.event_type").alias("s"), J.json_extract_string(v, "$.user_id").alias("sn"), J.json_extract_int(v, "$.user_id").alias("i"), J.json_extract_int(v, "$.event_type").alias("si"), F.round(J.json_extract_float(v, "$.value"), 6).alias("f"), J.json_extract(v, "event_type").alias("nopath"), J.json_extract_scalar(v, "$.event_type").alias("sc"))


def q_fn_json_sql(spark, d):
    J.register(spark)
    return spark.sql("SELECT _offset, json_extract_string(_value, '$.event_type') AS s, json_extract_int(_value, '$.user_id') AS i, json_extract_int(_value, '$.event_type') AS n, round(json_extract_float(_value, '$.value'), 6) AS f FROM {t}", t=L.events_topic(spark, d))


def q_fn_decode(spark, d):
    e = _t(spark, d, "events")
    raw = F.when(F.col("event_id") % 2 == 0, F.col("event_type").cast("binary")).otherwise(F.lit(b"\xff"))
    code = F.when(F.col("event_id") % 3 == 0, F.lit("!!!")).otherwise(F.base64(F.col("event_type").cast("binary")))
    return e.select("event_id", J.decode_utf8(raw).alias("u"), J.decode_base64(code).cast("string").alias("b"))


def q_fn_vector_distance(spark, d):
    e = _t(spark, d, "embeddings")
    other = F.reverse("embedding")
    return e.select("vec_id", *[F.round(vector.vector_distance(F.col("embedding"), other, m), 5).alias(m) for m in ("cosine", "euclidean", "dot")], vector.vector_distance(F.col("embedding"), other, "none").cast("string").alias("none"), F.isnan(vector.vector_distance(F.col("embedding"), F.slice("embedding", 1, 3), "dot")).alias("nan"))


def q_fn_decay(spark, d):
    e = _t(spark, d, "events")
    return e.select("event_id", F.round(text.time_decay(F.col("ts").cast("timestamp"), F.lit("2024-01-01 06:00:00").cast("timestamp"), F.lit(3600)), 6).alias("w"))


def q_text_tokens(spark, d):
    t = _t(spark, d, "documents")
    ts = text.tokens(F.col("text"), stem_words=False)
    return t.select("doc_id", F.size(ts).alias("n"), text.has_tokens(F.col("text")).alias("some"), F.coalesce(F.get(ts, F.lit(0)), F.lit("")).alias("first"))


def q_text_stems(spark, d):
    """Every word of the documents with its stem."""
    words = _t(spark, d, "documents").select(F.explode(text.raw_tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", text.stem(F.col("word")).alias("stem"))


def q_text_stemmed(spark, d):
    return spark.createDataFrame([(w,) for w, _ in STEMS], "word string").select("word", text.stem(F.col("word")).alias("stem"))


#: Words with their stems from the stemmer's public description and vocabulary.
STEMS = [
    ("consign", "consign"), ("consigned", "consign"), ("consigning", "consign"), ("consignment", "consign"), ("consist", "consist"), ("consistency", "consist"), ("consistently", "consist"),
    ("consolation", "consol"), ("consolatory", "consolatori"), ("console", "consol"), ("consolidate", "consolid"), ("consolidating", "consolid"), ("conspicuous", "conspicu"), ("conspicuously", "conspicu"),
    ("constancy", "constanc"), ("knackeries", "knackeri"), ("knave", "knave"), ("knavery", "knaveri"), ("kneeling", "kneel"), ("knightly", "knight"), ("knots", "knot"), ("running", "run"),
    ("shoes", "shoe"), ("batteries", "batteri"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("this", "this"), ("gaps", "gap"), ("kiwis", "kiwi"), ("luxuriating", "luxuri"), ("hopping", "hop"),
    ("hoping", "hope"), ("by", "by"), ("say", "say"), ("cry", "cri"), ("generate", "generat"), ("generously", "generous"), ("skies", "sky"), ("dying", "die"), ("news", "news"), ("proceed", "proceed"),
    ("relational", "relat"), ("agreed", "agre"), ("happily", "happili"), ("caresses", "caress"), ("ponies", "poni"), ("controlling", "control"), ("rolling", "roll"), ("falling", "fall"), ("youth", "youth"),
]


def q_text_intent(spark, d):
    qs = ["How many users?", "when did it start", "for how many days", "who is Anna", "last time we met", "cost of 3 days"]
    return spark.createDataFrame([(q,) for q in qs], "q string").select("q", text.intent(F.col("q")).alias("intent"))


def q_wikilinks(spark, d):
    rows = ["see [[user:luis]] and [[a|Alias]] [[a]]", "`[[no]]` [[yes-1]] [[Not valid]]", "```\n[[x]]\n``` [[y_z]] [[]]", "[[open [[closed]]", ""]
    t = spark.createDataFrame(list(enumerate(rows)), "id int, t string")
    return t.select("id", F.array_join(text.wikilinks(F.col("t")), ",").alias("links"))


def q_rule_extract(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.explode(text.rule_facts(F.col("text"))).alias("f"))
    return docs.where("f.kind IN ('email', 'url', 'date')").groupBy("doc_id", F.col("f.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min("f.value").alias("first"))


def q_bm25_scan(spark, d):
    out = text_index.bm25(_t(spark, d, "documents"), "doc_id", "text", WORDS)
    return out.select("doc_id", F.round("score", 5).alias("score"))


_indexes: dict[tuple, str] = {}


def _index(spark, d) -> text_index.TextIndex:
    """The documents' text index, built when a session first asks for these files."""
    docs = _t(spark, d, "documents")
    key = (spark.sparkContext.applicationId, d, tuple(sorted(docs.inputFiles())))
    if key not in _indexes:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
        path = f"{base.rstrip('/')}/tidelog-text-{uuid.uuid4().hex}"
        text_index.TextIndex(spark, path, "doc_id").add(docs.select("doc_id", "text"), "text")
        _indexes[key] = path
    return text_index.TextIndex(spark, _indexes[key], "doc_id")


def q_bm25(spark, d):
    return _index(spark, d).bm25(WORDS).select("doc_id", F.round("score", 5).alias("score"))


def q_index_match_all(spark, d):
    return _index(spark, d).match(["hain", "nd"], every=True)


def q_index_statistics(spark, d):
    return _index(spark, d).statistics()


def q_text_phrase(spark, d):
    return _index(spark, d).phrase(["nd", "nd"])


def _knn(metric):
    def run(spark, d):
        e = _t(spark, d, "embeddings")
        q = [((i * 37) % 11 - 5) / 5 for i in range(64)]
        return vector.knn(e, q, 15, metric, tie=["vec_id"]).select("vec_id", F.round("distance", 5).alias("distance"))

    return run


def _knn_sql(metric):
    fn = {"cosine": "1 - list_cosine_similarity({a}, {b})", "euclidean": "list_distance({a}, {b})", "dot": "list_inner_product({a}, {b})"}[metric]
    q = "[" + ", ".join(f"CAST({((i * 37) % 11 - 5) / 5} AS DOUBLE)" for i in range(64)) + "]"
    e = fn.format(a="CAST(embedding AS DOUBLE[])", b=q)
    return f"SELECT vec_id, round({e}, 5) AS distance FROM embeddings ORDER BY {e} {'DESC' if metric == 'dot' else 'ASC'}, vec_id LIMIT 15"


def q_knn_filtered(spark, d):
    e = _t(spark, d, "embeddings")
    q = [((i * 37) % 11 - 5) / 5 for i in range(64)]
    return vector.knn(e, q, 10, "cosine", tie=["vec_id"], where=F.col("label") == 1).select("vec_id", F.round("distance", 5).alias("distance"))


def q_knn_two_phase(spark, d):
    e = _t(spark, d, "embeddings")
    q = [((i * 37) % 11 - 5) / 5 for i in range(64)]
    return vector.two_phase(e, q, 5, dims=32, factor=10, metric="euclidean", tie=["vec_id"]).select("vec_id", F.round("distance", 5).alias("distance"))


def q_quantize_uint8(spark, d):
    e = _t(spark, d, "embeddings")
    both = e.crossJoin(F.broadcast(vector.quantiser(e)))  # one row
    code = vector.quantise(F.col("embedding"), F.col("low"), F.col("step"))
    return both.select("vec_id", F.get(code, F.lit(0)).alias("c0"), F.array_max(code).alias("hi"), F.array_min(code).alias("lo"))


def _lists(spark, d):
    """Two ranked lists: clicks and views, and events of a large value."""
    e = _t(spark, d, "events")
    a = e.where(F.col("event_type").isin("click", "view")).select(F.col("event_id").alias("id"), (F.col("value") * 7 % 13).alias("s"))
    b = e.where("value >= 30").select(F.col("event_id").alias("id"), (F.col("value") * 3 % 17).alias("s"))
    return a, b


LISTS = "a AS (SELECT event_id AS id, value * 7 % 13 AS s FROM events WHERE event_type IN ('click', 'view')), b AS (SELECT event_id AS id, value * 3 % 17 AS s FROM events WHERE value >= 30), ra AS (SELECT id, s, row_number() OVER (ORDER BY s DESC, id) - 1 AS r FROM a), rb AS (SELECT id, s, row_number() OVER (ORDER BY s DESC, id) - 1 AS r FROM b)"


def q_rrf_merge(spark, d):
    a, b = _lists(spark, d)
    return fusion.rrf([fusion.ranked(a, "text", "s", ["id"]), fusion.ranked(b, "vector", "s", ["id"])], ["id"]).select("id", F.round("score", 8).alias("score"))


def q_hybrid_rrf(spark, d):
    a, b = _lists(spark, d)
    return fusion.rrf([fusion.ranked(a, "text", "s", ["id"], base=1, limit=50), fusion.ranked(b, "vector", "s", ["id"], base=1, limit=50)], ["id"], weights={"text": 0.5, "vector": 0.5}).select("id", F.round("score", 8).alias("score"))


def _profile(name):
    def run(spark, d):
        a, b = _lists(spark, d)
        both = fusion.merged([fusion.ranked(a, "text", "s", ["id"]), fusion.ranked(b, "vector", "s", ["id"])], ["id"])
        stamped = both.join(_t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("timestamp")), "id")
        out = fusion.rank(fusion.features(stamped, now=F.lit("2024-01-02 00:00:00").cast("timestamp")), name)
        return out.select("id", F.round("final_score", 5).alias("final_score"), F.col("explanation").startswith("score=").alias("explained"))

    return run


def _profile_sql(name):
    p = fusion.PROFILES[name]
    w = lambda f: p["weights"].get(f, 0.0)
    boost = p["boosts"][0]["multiplier"] if p["boosts"] else 1.0
    return f"""WITH {LISTS}, m AS (SELECT coalesce(ra.id, rb.id) AS id, ra.r AS tr, ra.s AS tsc, rb.r AS vr, rb.s AS vs FROM ra FULL JOIN rb ON ra.id = rb.id),
    f AS (SELECT m.*, coalesce(1.0 / (60 + tr), 0) + coalesce(1.0 / (60 + vr), 0) AS rrf, CASE WHEN tr IS NULL OR vr IS NULL THEN 1 ELSE 2 END AS sc, 1.0 / (1.0 + greatest((epoch_us(TIMESTAMP '2024-01-02 00:00:00') // 1000 - epoch_us(ts) // 1000) / 3600000.0, 0.0)) AS fresh FROM m JOIN events ON event_id = id)
    SELECT id, round((rrf * {w("rrf_score")} + fresh * {w("freshness")} + sc * {w("source_count")} + coalesce({w("text_rank")} / (1.0 + tr), 0) + coalesce({w("vector_rank")} / (1.0 + vr), 0) + coalesce(tsc * {w("text_score")}, 0) + coalesce(vs * {w("vector_score")}, 0)) * CASE WHEN sc > 1 THEN {boost} ELSE 1.0 END, 5) AS final_score, true AS explained FROM f"""


def q_score_fusion(spark, d):
    a, b = _lists(spark, d)
    both = a.withColumnRenamed("s", "t").join(b.withColumnRenamed("s", "v"), "id", "full")
    out = [fusion.score_fusion(both, "v", "t", m).select("id", F.lit(m).alias("method"), F.round("score", 6).alias("score")) for m in ("rank_fusion", "vector_rerank", "vector_boost")]
    return out[0].unionByName(out[1]).unionByName(out[2])


def q_hot_cold_merge(spark, d):
    a, b = _lists(spark, d)
    return fusion.hot_wins(a, b, ["id"]).select("id", F.round("s", 6).alias("s"))


def q_best_of(spark, d):
    a, b = _lists(spark, d)
    return fusion.best_of(a.unionByName(b), ["id"], "s", limit=40).select("id", F.round("s", 6).alias("s"))


def q_orchestrated(spark, d):
    docs = _t(spark, d, "documents")
    topic = L.as_topic(docs, "documents", partition=F.pmod("doc_id", F.lit(4)), offset=F.col("doc_id"), timestamp=F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id")), key=F.col("source"), value=F.col("text")).withColumn("body", F.col("_value").cast("string"))
    r = planner.Request(topics=["documents"], modes=["text", "sql", "vector"], words=" ".join(WORDS), predicate={"match": {"body": "retion"}}, k=10, profile="relevance")
    out = planner.run({"documents": planner.Topic(topic, text="body")}, r, now=F.lit("2024-01-02").cast("timestamp"))
    return out.select("_offset", "position", F.round("final_score", 4).alias("final_score"))


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")} | {
    "filter_bool": _search("documents", "doc_id", {"bool": {"must": [{"term": {"lang": "en"}}], "must_not": [{"range": {"n_chars": {"gt": 3000}}}], "should": [{"match": {"text": "retion hain"}}, {"term": {"source": "src3"}}], "minimum_should_match": 1}}),
    "filter_match": _search("documents", "doc_id", {"match": {"text": "the retion Reble"}}),
    "filter_match_and": _search("documents", "doc_id", {"match": {"text": {"query": "hain nd", "operator": "and"}}}),
    "filter_match_all": _search("documents", "doc_id", {"match_all": {}}),
    "filter_match_stop_words": _search("documents", "doc_id", {"match": {"text": "the of and"}}),
    "filter_terms": _search("documents", "doc_id", {"terms": {"source": ["src1", "src5", 7]}}),
    "filter_term_number": _search("orders", "o_orderkey", {"term": {"o_custkey": 42}}),
    "filter_range": _search("orders", "o_orderkey", {"range": {"o_totalprice": {"gte": 50000, "lt": 120000}}}),
    "filter_range_date": _search("orders", "o_orderkey", {"range": {"o_orderdate": {"gt": "1995-01-01T00:00:00", "lte": "1996-06-30T00:00:00"}}}),
    "filter_wildcard": _search("documents", "doc_id", {"wildcard": {"text": "re?ion*s"}}),
    "filter_regexp": _search("documents", "doc_id", {"regexp": {"text": "hain(s|ed)?"}}),
    "filter_phrase": _search("documents", "doc_id", {"match_phrase": {"text": "of the"}}),
    "filter_fuzzy": _search("documents", "doc_id", {"bool": {"filter": {"term": {"lang": "en"}}, "must": {"fuzzy": {"text": {"value": "retion", "fuzziness": 1}}}}}),
    "filter_exists": _search("documents", "doc_id", {"exists": {"field": "source"}}),
    "filter_like_in_between": lambda spark, d: _t(spark, d, "customer").where("c_name LIKE '%1%' AND c_nationkey IN (1, 2, 3, 4) OR c_acctbal BETWEEN 100 AND 900").select("c_custkey"),
    "geo_distance": _geo({"geo_distance": {"distance": "2500km", "loc": {"lat": 40, "lon": 10}}}),
    "geo_bbox": _geo({"geo_bounding_box": {"loc": {"top_left": "60,-20", "bottom_right": "10,50"}}}),
    "geo_polygon": _geo({"geo_polygon": {"loc": {"points": [{"lat": a, "lon": b} for a, b in POLYGON]}}}),
    **{f"knn_{m}": _knn(m) for m in ("cosine", "euclidean", "dot")},
    **{f"rank_{p}": _profile(p) for p in fusion.PROFILES},
}
_RAW = RAW.format(c="text")
_Q64 = "[" + ", ".join(f"CAST({((i * 37) % 11 - 5) / 5} AS DOUBLE)" for i in range(64)) + "]"
_E = "CAST(embedding AS DOUBLE[])"
ORACLE_SQL = {
    "agg_terms": "SELECT o_orderpriority AS key, count(*) AS doc_count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3",
    "agg_terms_ordered": "SELECT user_id AS key, count(*) AS doc_count FROM events GROUP BY 1 HAVING count(*) >= 2 ORDER BY 1 DESC LIMIT 7",
    "agg_stats": "SELECT count(value) AS count, min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg, round(sum(value), 4) AS sum FROM events",
    "agg_stats_empty": "SELECT CAST(0 AS BIGINT) AS count, 0.0::DOUBLE AS min, 0.0::DOUBLE AS max, 0.0::DOUBLE AS avg, 0.0::DOUBLE AS sum",
    "agg_value_count": "SELECT count(*) AS value FROM events",
    "agg_cardinality": "SELECT count(DISTINCT user_id) AS value FROM events",
    "agg_date_histogram": "SELECT epoch_us(ts) // 3600000000 * 3600000 AS key_ms, strftime(make_timestamp(epoch_us(ts) // 3600000000 * 3600000000), '%Y-%m-%dT%H:%M:%SZ') AS key, count(*) AS doc_count FROM events GROUP BY 1, 2",
    "agg_range": "SELECT '*-20.0' AS key, count(*) FILTER (WHERE value < 20) AS doc_count FROM events UNION ALL SELECT '10.0-50.0', count(*) FILTER (WHERE value >= 10 AND value < 50) FROM events UNION ALL SELECT 'high', count(*) FILTER (WHERE value >= 50) FROM events",
    "agg_metrics": "SELECT unnest(['avg', 'sum', 'min', 'max']) AS kind, unnest([round(avg(o_totalprice), 2), round(sum(o_totalprice), 2), min(o_totalprice), max(o_totalprice)]) AS value FROM orders",
    "search_sorted": "SELECT o_orderkey, o_totalprice, 1.0::DOUBLE AS _score FROM orders WHERE o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 12 OFFSET 5",
    "search_substring": "SELECT event_id AS _offset, true AS positive FROM events WHERE event_type ILIKE '%click%' OR props ILIKE '%click%'",
    "namespace_granted": "SELECT event_id, namespace FROM (SELECT event_id, 't' || (user_id % 9) || ':' || event_type || ':' || (event_id % 3) AS namespace FROM events) WHERE starts_with(namespace, 't1:') OR starts_with(namespace, 't2:click:') OR namespace IN ('t1', 't2:click', 't3:view:0', 't4')",
    "geo_distances": f"SELECT c_custkey, round({HAVERSINE}, 2) AS h, round(111319.9 * sqrt(pow(40.0 - lat, 2) + pow((10.0 - lon) * cos(radians((lat + 40.0) / 2)), 2)), 2) AS p FROM {POINTS}",
    "fn_json": "SELECT event_id AS _offset, '\"' || event_type || '\"' AS j, event_type AS s, CAST(NULL AS VARCHAR) AS sn, user_id AS i, CAST(NULL AS BIGINT) AS si, round(value, 6) AS f, CAST(NULL AS VARCHAR) AS nopath, event_type AS sc FROM events",
    "fn_json_sql": "SELECT event_id AS _offset, event_type AS s, user_id AS i, CAST(NULL AS BIGINT) AS n, round(value, 6) AS f FROM events",
    "fn_decode": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS u, CASE WHEN event_id % 3 <> 0 THEN event_type END AS b FROM events",
    "fn_vector_distance": f"SELECT vec_id, round(1 - list_cosine_similarity({_E}, list_reverse({_E})), 5) AS cosine, round(list_distance({_E}, list_reverse({_E})), 5) AS euclidean, round(list_inner_product({_E}, list_reverse({_E})), 5) AS dot, CAST(NULL AS VARCHAR) AS none, true AS nan FROM embeddings",
    "fn_decay": "SELECT event_id, round(CASE WHEN epoch_us(TIMESTAMP '2024-01-01 06:00:00') <= epoch_us(ts) THEN 1.0 ELSE exp(-0.6931471805599453 * floor((epoch_us(TIMESTAMP '2024-01-01 06:00:00') - epoch_us(ts)) / 1e6) / 3600) END, 6) AS w FROM events",
    "text_stems": f"WITH {STEMMED} SELECT t AS word, st AS stem FROM voc",
    "text_stemmed": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in STEMS) + ") v(word, stem)",
    "index_match_all": f"WITH {STEMMED} SELECT doc_id FROM tok WHERE list_has_all(s, {text_index.analysed_terms(['hain', 'nd'])!r})",
    "index_statistics": f"WITH {STEMMED} SELECT (SELECT count(*) FROM documents) AS docs, CAST(sum(len(s)) AS BIGINT) AS tokens, (SELECT count(DISTINCT x) FROM (SELECT unnest(s) AS x FROM tok)) AS terms FROM tok",
    "text_tokens": f"SELECT doc_id, CAST(len(t) AS INT) AS n, len(t) > 0 AS some, coalesce(t[1], '') AS first FROM (SELECT doc_id, {TOK} AS t FROM documents)",
    "text_intent": "SELECT * FROM (VALUES ('How many users?', 'numeric'), ('when did it start', 'temporal'), ('for how many days', 'temporal'), ('who is Anna', 'identity'), ('last time we met', 'temporal'), ('cost of 3 days', 'numeric')) v(q, intent)",
    "wikilinks": "SELECT * FROM (VALUES (0, 'user:luis,a'), (1, 'yes-1'), (2, 'y_z'), (3, 'closed'), (4, '')) v(id, links)",
    "rule_extract": "SELECT doc_id, kind, count(*) AS n, min(trim(v, chr(32) || '(' || chr(10) || chr(9))) AS first FROM ("
    + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{text.RULES[k].replace(chr(39), chr(39) * 2)}')) AS v FROM documents" for k in ("email", "url", "date"))
    + ") GROUP BY doc_id, kind",
    **{
        name: f"WITH {STEMMED}, t AS (SELECT doc_id, coalesce(s, []) AS t FROM documents LEFT JOIN tok USING (doc_id)), c AS (SELECT count(*) AS n, avg(len(t)) AS a FROM t), q AS (SELECT unnest({text_index.analysed_terms(WORDS)!r}) AS w), f AS (SELECT doc_id, w, len(list_filter(t, lambda x: x = w)) AS tf, len(t) AS dl FROM t, q), df AS (SELECT w, count(*) FILTER (WHERE tf > 0) AS d FROM f GROUP BY w) SELECT doc_id, round(sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 5) AS score FROM f JOIN df USING (w), c GROUP BY doc_id HAVING sum(tf) > 0"
        for name in ("bm25", "bm25_scan")
    },
    "text_phrase": f"WITH {STEMMED} SELECT doc_id FROM tok WHERE contains(' ' || array_to_string(s, ' ') || ' ', ' nd nd ')",
    "knn_filtered": f"SELECT vec_id, round(1 - list_cosine_similarity({_E}, {_Q64}), 5) AS distance FROM embeddings WHERE label = 1 ORDER BY 1 - list_cosine_similarity({_E}, {_Q64}), vec_id LIMIT 10",
    "knn_two_phase": f"SELECT vec_id, round(list_distance({_E}, {_Q64}), 5) AS distance FROM (SELECT * FROM embeddings ORDER BY list_distance(list_slice({_E}, 1, 32), list_slice({_Q64}, 1, 32)), vec_id LIMIT 50) ORDER BY list_distance({_E}, {_Q64}), vec_id LIMIT 5",
    "quantize_uint8": "WITH x AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(i)), s AS (SELECT i, min(v) AS lo, CASE WHEN max(v) = min(v) THEN 1.0 ELSE max(v) - min(v) END / 255 AS st FROM x GROUP BY i), c AS (SELECT vec_id, i, CAST(greatest(0, least(255, floor((v - lo) / st))) AS INT) AS q FROM x JOIN s USING (i)) SELECT vec_id, max(q) FILTER (WHERE i = 1) AS c0, max(q) AS hi, min(q) AS lo FROM c GROUP BY vec_id",
    "rrf_merge": f"WITH {LISTS} SELECT id, round(sum(1.0 / (60 + r)), 8) AS score FROM (SELECT id, r FROM ra UNION ALL SELECT id, r FROM rb) GROUP BY id",
    "hybrid_rrf": f"WITH {LISTS} SELECT id, round(sum(0.5 / (61 + r)), 8) AS score FROM (SELECT id, r FROM ra WHERE r < 50 UNION ALL SELECT id, r FROM rb WHERE r < 50) GROUP BY id",
    "score_fusion": f"WITH {LISTS}, m AS (SELECT coalesce(a.id, b.id) AS id, a.s AS t, b.s AS v FROM a FULL JOIN b ON a.id = b.id) SELECT id, 'rank_fusion' AS method, round(coalesce(v, 0) * 0.5 + coalesce(t, 0) * 0.5, 6) AS score FROM m UNION ALL SELECT id, 'vector_rerank', round(coalesce(v, t), 6) FROM m UNION ALL SELECT id, 'vector_boost', round(CASE WHEN t IS NOT NULL AND v IS NOT NULL THEN t * 1.5 ELSE coalesce(t, v) END, 6) FROM m",
    "hot_cold_merge": f"WITH {LISTS} SELECT id, round(s, 6) AS s FROM a UNION ALL SELECT id, round(s, 6) FROM b WHERE id NOT IN (SELECT id FROM a)",
    "best_of": f"WITH {LISTS} SELECT id, round(max(s), 6) AS s FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id ORDER BY max(s) DESC, id LIMIT 40",
    "filter_bool": f"WITH {STEMMED} SELECT doc_id FROM documents LEFT JOIN tok USING (doc_id) WHERE lang = 'en' AND n_chars <= 3000 AND (list_has_any(coalesce(s, []), {text_index.analysed_terms(['retion', 'hain'])!r}) OR source = 'src3')",
    "filter_match": f"WITH {STEMMED} SELECT doc_id FROM tok WHERE list_has_any(s, {text_index.analysed_terms(['retion', 'reble'])!r})",
    "filter_match_and": f"WITH {STEMMED} SELECT doc_id FROM tok WHERE list_has_all(s, {text_index.analysed_terms(['hain', 'nd'])!r})",
    "filter_match_all": "SELECT doc_id FROM documents",
    "filter_match_stop_words": "SELECT doc_id FROM documents",
    "filter_terms": "SELECT doc_id FROM documents WHERE source IN ('src1', 'src5')",
    "filter_term_number": "SELECT o_orderkey FROM orders WHERE o_custkey = 42",
    "filter_range": "SELECT o_orderkey FROM orders WHERE o_totalprice >= 50000 AND o_totalprice < 120000",
    "filter_range_date": "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1996-06-30'",
    "filter_wildcard": f"SELECT doc_id FROM documents WHERE len(list_filter({_RAW}, lambda t: regexp_full_match(t, 're.ion.+s'))) > 0",
    "filter_regexp": f"SELECT doc_id FROM documents WHERE len(list_filter({_RAW}, lambda t: regexp_full_match(t, 'hain(s|ed)?'))) > 0",
    "filter_phrase": f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({_RAW}, ' ') || ' ', ' of the ')",
    "filter_fuzzy": f"SELECT doc_id FROM documents WHERE lang = 'en' AND len(list_filter({_RAW}, lambda t: levenshtein(t, 'retion') <= 1)) > 0",
    "filter_exists": "SELECT doc_id FROM documents WHERE source IS NOT NULL",
    "filter_like_in_between": "SELECT c_custkey FROM customer WHERE c_name LIKE '%1%' AND c_nationkey IN (1, 2, 3, 4) OR c_acctbal BETWEEN 100 AND 900",
    "geo_distance": f"SELECT c_custkey FROM {POINTS} WHERE {HAVERSINE} <= 2500000",
    "geo_bbox": f"SELECT c_custkey FROM {POINTS} WHERE lat BETWEEN 10 AND 60 AND lon BETWEEN -20 AND 50",
    "geo_polygon": f"SELECT c_custkey FROM {POINTS} WHERE lat BETWEEN -30 AND 60 AND lon BETWEEN 0 AND 80 AND ({_edges()}) % 2 = 1",
    **{f"knn_{m}": _knn_sql(m) for m in ("cosine", "euclidean", "dot")},
    **{f"rank_{p}": _profile_sql(p) for p in fusion.PROFILES},
}
