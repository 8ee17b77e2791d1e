import numpy as np

from tidelog.llm import ann as A

SCHEMA = "vec_id long, embedding array<float>, v int, score string"


def exact(ids, x, q, k):
    s = np.zeros(len(x))
    for j in range(x.shape[1]):
        s += x[q, j] * x[:, j]
    s[ids == ids[q]] = -np.inf
    order = [i for i in np.lexsort((ids, -s)) if s[i] > -np.inf][:k]
    return [(int(ids[i]), s[i]) for i in order]


def test_recall_and_order(spark, sf):
    got = A.op1_nearest_vectors(spark, sf).toPandas()
    t = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    ids, x = t.vec_id.to_numpy(), np.asarray(t.embedding.to_list(), dtype=np.float64)
    hits = []
    for q in np.flatnonzero(ids % 20 == 0):
        want = exact(ids, x, q, 20)
        mine = got[got.query_id == ids[q]].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21))
        order = list(zip(-mine.score, mine.vec_id, strict=True))
        assert order == sorted(order)
        hits.append(len({i for i, _ in want} & set(mine.vec_id)) / 20)
    assert np.mean(hits) >= 0.9


def test_clusters_are_pruned(spark, monkeypatch):
    """Of clustered vectors, a small share of the leaves holds the answers."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 16)) * 4
    x = centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 16)) * 0.5
    v = A.cut(A.valid_vectors(spark.createDataFrame([(i, e.tolist(), 0, "") for i, e in enumerate(x)], SCHEMA), "vec_id", "embedding"), "t")
    seen = []
    whole = A.calibrated
    monkeypatch.setattr(A, "calibrated", lambda rows, queries, tree, *a: seen.append((whole(rows, queries, tree, *a), tree.n_leaves)) or seen[-1][0])
    got = A.search(v, v.where("vec_id % 20 = 0")).toPandas()
    (visits, _), leaves = seen[0]
    assert leaves > 30 and visits < leaves / 3
    hits = [len({i for i, _ in exact(np.arange(6000), x, q, 20)} & set(got[got.query_id == q].vec_id)) / 20 for q in range(0, 6000, 20)]
    assert np.mean(hits) >= 0.9


def test_copies_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(60)] + [(100 + i, rng.normal(size=3).tolist()) for i in range(40)]
    rows += [(500, None), (501, [0.0, 0.0, 0.0]), (502, [1.0, None, 2.0]), (503, [float("nan"), 1.0, 1.0]), (504, [float("inf"), 1.0, 1.0]), (505, []), (None, [1.0, 1.0, 1.0]), (506, [1.0, 2.0])]
    v = A.cut(A.valid_vectors(spark.createDataFrame([(i, e, 1, "x") for i, e in rows], SCHEMA), "vec_id", "embedding"), "t")
    assert v.where("vec_id >= 500").count() == 1  # of another dimension: left out by the search
    got = A.search(v, v.where("vec_id % 20 = 0"), k=20, block_rows=8, sample=50).toPandas()
    assert set(got.query_id) == {0, 20, 40, 100, 120}
    mine = got[got.query_id == 20].sort_values("rank")
    same = [r for r in mine.itertuples() if r.score == 14.0]
    assert [r.vec_id for r in same] == [i for i in range(60) if i != 20][: len(same)]
    assert not set(got.vec_id) & set(range(500, 510))


def test_few_rows(spark):
    v = A.cut(A.valid_vectors(spark.createDataFrame([(0, [1.0], 0, ""), (1, [2.0], 0, ""), (2, [-1.0], 0, "")], SCHEMA), "vec_id", "embedding"), "t")
    assert [(r.vec_id, r.rank) for r in A.search(v, v.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    none = A.cut(A.valid_vectors(spark.createDataFrame([], SCHEMA), "vec_id", "embedding"), "t")
    assert A.search(none, none).count() == 0
