import re

import pytest
from pyspark.sql import functions as F

from tidelog.llm import mixing as M

DOCS = "doc_id long, text string, source string, size string, target int"


def fill(sizes, share=1.5, cap=2.0, weights=(3, 1, 2)):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in full]
        rest = total - sum(full.values())
        level = rest / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] > cap * sizes[s]]
        if not over:
            return full | {s: level * w[s] for s in free}
        full |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 500, None: 70}, {"x": 5}, {"a": 0, "b": 0}, {"é": 100, "z": 1, "a": 1, "": 1}, {f"s{i}": i * i for i in range(30)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in M.targets(df).collect()}
    for s, t in fill(sizes).items():
        assert got[s] == pytest.approx(t)


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_permutation(spark, n):
    from pyspark.sql import functions as F

    df = spark.range(n).select(M.permuted(F.col("id"), F.lit(n), F.lit("k")).alias("x"))
    assert sorted(r.x for r in df.collect()) == list(range(n))


def check(rows, docs):
    size = {}
    for i, text, source in docs:
        size[i] = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    total = {}
    for i, _, source in docs:
        total[source] = total.get(source, 0) + size[i]
    want, taken = fill(total), {}
    for r in rows:
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 2 * r.size
    src = {i: s for i, _, s in docs}
    for r in rows:
        s = src[r.doc_id]
        assert r.source_size == total[s] and r.target == pytest.approx(want[s])
        taken[s] = taken.get(s, 0) + r.taken
    for s, t in taken.items():
        assert abs(t - want[s]) <= 0.02 * want[s] + 64
    return taken


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    rows = M.op5_mix_sources(spark, sf).collect()
    assert len(rows) == len(docs)
    check(rows, docs)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, M.op5_mix_sources(spark, sf).collect()))


def test_draws(spark):
    """Shards' counts vary as draws do, another seed draws others, sources get their quotas and blocks their turns."""
    quotas = spark.createDataFrame([(0, 3000), (1, 500), (2, 0), (3, 1)], "sid long, quota long")
    got = [{(r.shard, r.sid): r.m for r in M.shard_counts(quotas, 100, seed).groupBy("shard", "sid").agg({"n": "sum"}).withColumnRenamed("sum(n)", "m").collect()} for seed in (1, 1, 2)]
    assert got[0] == got[1] != got[2]
    for g in got:
        assert {s: sum(n for (_, x), n in g.items() if x == s) for s in range(4)} == {0: 3000, 1: 500, 2: 0, 3: 1}
        per = [sum(n for (k, _), n in g.items() if k == shard) for shard in range(36)]
        assert per == [100] * 35 + [1]
        assert len({n for (_, s), n in g.items() if s == 0}) > 5
    sources = spark.createDataFrame([(0, "a", 1600, 3000), (1, None, 900, 500)], "sid long, source string, blocks long, quota long")
    plans = [sorted(tuple(r) for r in M.draw(sources, 100, seed).collect()) for seed in (1, 2)]
    assert plans[0] != plans[1]
    times = {}
    for _, sid, block, _ in plans[0]:
        times[sid, block] = times.get((sid, block), 0) + 1
    assert {times.get((0, b), 0) for b in range(1600)} == {1, 2} and max(times.get((1, b), 0) for b in range(900)) == 1


def test_mix_is_what_blocks_hold(spark, sf):
    """Rows of the mix are runs of words of their documents, and hold as many words as the blocks taken."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    sizes, _, blocks, slots = M.mix(docs)
    taken = {r.doc_id: r.taken for r in M.taken_words(sizes, blocks, slots).collect()}
    got, whole = {}, 0
    for r in M.mix_documents(docs).collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        got[r.doc_id] = got.get(r.doc_id, 0) + n
        whole += r.text == text[r.doc_id]
        assert r.text is None or (r.text in text[r.doc_id] and r.n_chars == len(r.text))
    assert whole > 0.2 * len(text)
    assert {d: n for d, n in got.items() if n} == {d: n for d, n in taken.items() if n}


def test_edges(spark):
    rows = [(1, "a b c", "x", "q", 1), (1, "a b c", "x", "q", 1), (None, "d", None, None, None), (3, None, "x", "", 2), (4, " \n", "empty", "", 2)]
    sizes, sources, blocks, slots = M.mix(spark.createDataFrame(rows, DOCS))
    got = M.taken_words(sizes, blocks, slots)
    assert got.count() == 5
    assert {(r.source, r.source_size) for r in sources.collect()} == {("x", 6), (None, 1), ("empty", 0)}
    out = M.mix_documents(spark.createDataFrame(rows, DOCS))
    assert out.columns == ["doc_id", "text", "source", "size", "target"]
    assert M.mix_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_no_more_ranges_than_rows_need(spark, monkeypatch):
    """Prefix sums of a few thousand rows are a few tasks, however many partitions the session has."""
    tables, whole = [], M.cut

    def cut(df, name):
        tables.append(whole(df, name))
        return tables[-1]

    monkeypatch.setattr(M, "cut", cut)
    monkeypatch.setattr(M, "TASK_ROWS", 1000)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        out = M.running(spark.range(2500).withColumn("x", F.lit(2).cast("long")), [F.col("id")], {"x": "y"})
        assert all(r.y == 2 * r.id for r in out.collect())
        assert len(tables[0].inputFiles()) <= 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
