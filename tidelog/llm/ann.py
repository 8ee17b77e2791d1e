"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample (``sample`` vectors) on the driver; its nodes are means of their sample
vectors, with their spread. Leaves are as many as the root of the number of rows, ``max_leaves`` at most. Every row is
then sent down to a leaf. A query walks the tree with a priority queue over nodes: the node that promises the largest inner
product (its mean's, and ``hope`` times its spread) is opened next, a leaf that leaves the queue is visited, and the walk
ends when it has seen ``visits`` leaves and at least enough rows to fill its answer. ``hope`` and ``visits`` are calibrated: a
bounded set of queries is answered exactly against all rows, and visits are widened until the leaves hold ``recall`` of
those answers, under the hope that needs the fewest visits.

The tree and the rows per leaf are all that is broadcast. Neighbouring leaves are dealt in groups of about
``block_rows`` rows, a larger leaf in as many blocks, and so are the queries that visit a group, so neither a hot leaf nor a vector
that a third of the rows share makes a large group. A query's answer is cut to k in each of them. Products of matrices choose candidates;
scores are then summed in double precision over the components in order, the same way in every block: equal vectors score
equal, and ties go to the smaller vec_id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, partitions, ship_code, table


class Tree:
    """Nodes of the k-means tree: mean and spread of each, children of each; leaves are numbered by ``leaf``, neighbours next to each other."""

    def __init__(self, sample: np.ndarray, branching: int, leaf_rows: int, max_leaves: int, seed: int = 7) -> None:
        self.means, self.children = [sample.mean(0) if len(sample) else np.zeros(sample.shape[1])], [[]]
        spread = [self._spread(sample)]
        rng = np.random.default_rng(seed)
        # the largest node is split first, until all are small or the leaves are as many as allowed
        queue, tie = [(-len(sample), 0, 0, np.arange(len(sample)))], 0
        open_leaves = 1
        while queue:
            size, _, node, rows = heapq.heappop(queue)
            parts = self._split(sample, rows, branching, rng) if -size > leaf_rows and open_leaves + branching <= max_leaves + 1 else []
            if len(parts) < 2:
                continue
            open_leaves += len(parts) - 1
            for part in parts:
                tie += 1
                self.means.append(sample[part].mean(0))
                spread.append(self._spread(sample[part]))
                self.children.append([])
                self.children[node].append(len(self.means) - 1)
                heapq.heappush(queue, (-len(part), tie, len(self.means) - 1, part))
        self.leaf, self.n_leaves, stack = [-1] * len(self.means), 0, [0]
        while stack:  # depth first
            node = stack.pop()
            stack += self.children[node][::-1]
            if not self.children[node]:
                self.leaf[node] = self.n_leaves
                self.n_leaves += 1
        self.means = np.asarray(self.means)
        self.squares = (self.means**2).sum(1)
        self.spread = np.asarray(spread)

    @staticmethod
    def _spread(own: np.ndarray) -> float:
        """Root of the mean squared distance to the mean, along one direction."""
        return float(np.sqrt(own.var(0).mean())) if len(own) else 0.0

    @staticmethod
    def _split(x: np.ndarray, rows: np.ndarray, k: int, rng: np.random.Generator) -> list[np.ndarray]:
        own = x[rows]
        means = own[rng.choice(len(rows), min(k, len(rows)), replace=False)]
        for _ in range(8):
            to = (own @ means.T - (means**2).sum(1) / 2).argmax(1)
            means = np.asarray([own[to == j].mean(0) for j in range(len(means)) if (to == j).any()])
        to = (own @ means.T - (means**2).sum(1) / 2).argmax(1)
        return [rows[to == j] for j in range(len(means)) if (to == j).any()]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: the nearest child's, level by level."""
        out = np.empty(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
                continue
            to = (x[rows] @ self.means[kids].T - self.squares[kids] / 2).argmax(1)
            todo += [(kid, rows[to == j]) for j, kid in enumerate(kids) if (to == j).any()]
        return out

    def walk(self, q: np.ndarray, hope: float) -> Iterator[int]:
        """Leaves, best bin first."""
        promise = self.means @ q + hope * float(np.sqrt(q @ q)) * self.spread
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not kids:
                yield self.leaf[node]
            for s, kid in zip(promise[kids].tolist(), kids, strict=True):
                heapq.heappush(queue, (-s, kid))


def _cut_to_k(query: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, ties to the smaller id."""
    order = np.lexsort((ids[row], -score, query))
    query, row, score = query[order], row[order], score[order]
    start = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
    place = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query))))
    keep = place < k
    return query[keep], row[keep], score[keep]


def nearest_rows(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, leaf: np.ndarray | None = None, asked: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, row's place, score) of the k rows x nearest to each of q, its own id left out; with leaf (of each row, ascending) and
    asked (of each query), among the rows of the asked leaves."""
    wide = 1e-9 * np.sqrt((q**2).sum(1)) * float(np.sqrt((x**2).sum(1)).max()) if len(x) else np.zeros(len(q))
    start = np.array([0]) if leaf is None else np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]]))
    of = [[] for _ in start]
    if leaf is None:
        of = [list(range(len(q)))]
    else:
        slot = {int(v): i for i, v in enumerate(leaf[start])}
        for i, leaves in enumerate(asked):
            for v in leaves:
                if v in slot:
                    of[slot[v]].append(i)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for a, b, own in zip(start, np.append(start[1:], len(x)), of, strict=True):
        for at in range(0, len(own), 256):
            at_q = np.asarray(own[at : at + 256])
            s = q[at_q] @ x[a:b].T
            s[q_ids[at_q, None] == ids[a:b]] = -np.inf
            if b - a > k:
                least = -np.partition(-s, k - 1, axis=1)[:, k - 1] - wide[at_q]
                i, j = np.nonzero(s >= np.maximum(least, np.finfo(float).min)[:, None])
            else:
                i, j = np.nonzero(s > -np.inf)
            query, row = at_q[i], a + j
            score = np.zeros(len(query))
            for c in range(q.shape[1]):
                score += q[query, c] * x[row, c]
            out.append(_cut_to_k(query, row, score, ids, k))
    return _cut_to_k(*(np.concatenate(c) for c in zip(*out, strict=True)), ids, k)


def _matrix(col: pd.Series) -> np.ndarray:
    return np.asarray(col.to_list(), dtype=np.float64)


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part: v is array<double>, not null, of finite components, not all 0, vec_id not null."""
    v = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return v.where(finite & F.exists("v", lambda x: x != 0))


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 20, recall: float = 0.95, sample: int = 20_000, branching: int = 8, max_leaves: int = 2048, calibrate: int = 256, block_rows: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of vectors found nearest to each of queries, its own id left out.

    Both are (vec_id, v) as valid_vectors gives them, in written tables, of one dimension; rows whose dimension is not
    the most common one have no part. Rows that repeat an id are one candidate each, but one query (the smallest vector). Fewer than k other rows: all of them.
    Either table empty: no rows.
    """
    spark = vectors.sparkSession
    ship_code(spark)
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    out_schema = "query_id long, rank int, vec_id long, score double"
    dims = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return spark.createDataFrame([], out_schema)
    d, n = dims["d"], dims["count"]
    vectors, queries = vectors.where(F.size("v") == d), queries.where(F.size("v") == d)
    # an eighth more than needed passes a hash filter, so that the bounded sort holds a sample's rows only
    some = vectors if n <= sample else vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 1.125 * sample / n)))
    got = some.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toPandas()
    leaves = min(max_leaves, max(branching, int(n**0.5)))
    tree = Tree(_matrix(got.v) if len(got) else np.zeros((0, d)), branching, max(2, len(got) // leaves), leaves)
    tree_b = spark.sparkContext.broadcast(tree)

    def to_leaf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(leaf=tree_b.value.assign(_matrix(b.v)))

    rows = cut(vectors.mapInPandas(to_leaf, "vec_id long, v array<double>, leaf long"), "ann-rows")
    held = np.zeros(tree.n_leaves, np.int64)
    for r in rows.groupBy("leaf").count().collect():  # at most one row a leaf
        held[r["leaf"]] = r["count"]
    visits, hope = calibrated(rows, queries, tree, k, recall, calibrate)
    # neighbouring leaves make a group until it has block_rows rows; a larger leaf is a group of several blocks
    group = np.zeros(tree.n_leaves, np.int64)
    total, at = 0, 0
    for i, m in enumerate(held.tolist()):
        if total and total + m > block_rows:
            total, at = 0, at + 1
        total += m
        group[i] = at
    blocks = np.maximum(1, -(-np.bincount(group, weights=held).astype(np.int64) // block_rows))
    state = spark.sparkContext.broadcast((tree, held, group, visits, hope))

    def groups_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, held, group, visits, hope = state.value
        for b in batches:
            out = []
            for query_id, v in zip(b.vec_id, b.v, strict=True):
                seen, asked = 0, {}
                for count, leaf in enumerate(tree.walk(np.asarray(v, np.float64), hope)):
                    if count >= visits and seen > k:
                        break
                    seen += int(held[leaf])
                    if held[leaf]:
                        asked.setdefault(int(group[leaf]), []).append(leaf)
                out += [(query_id, v, g, sorted(leaves)) for g, leaves in asked.items()]
            yield pd.DataFrame(out, columns=["query_id", "v", "grp", "leaves"])

    spread = queries.repartition(partitions(spark), "vec_id")
    asked = cut(spread.mapInPandas(groups_of, "query_id long, v array<double>, grp long, leaves array<long>"), "ann-asked")
    q_held = np.zeros(len(blocks), np.int64)
    for r in asked.groupBy("grp").count().collect():  # at most one row a group of leaves
        q_held[r["grp"]] = r["count"]
    q_blocks = np.maximum(1, -(-q_held // block_rows))
    dealt = spark.createDataFrame([(g, int(b), int(c)) for g, (b, c) in enumerate(zip(blocks, q_blocks, strict=True))], "grp long, n_blocks long, n_q_blocks long")
    of_leaf = spark.createDataFrame([(i, int(g)) for i, g in enumerate(group)], "leaf long, grp long").join(dealt, "grp")
    # both tables have max_leaves rows at most
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    mine = rows.join(F.broadcast(of_leaf), "leaf").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("n_blocks"))).withColumn("q_block", upto("n_q_blocks"))
    theirs = asked.join(F.broadcast(dealt), "grp").withColumn("q_block", F.pmod(F.xxhash64("query_id"), F.col("n_q_blocks"))).withColumn("block", upto("n_blocks"))
    keys = ["grp", "block", "q_block"]
    mine, theirs = mine.select(*keys, "vec_id", "v", "leaf"), theirs.select(*keys, "query_id", "v", "leaves")

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        right = right.sort_values(["leaf", "vec_id"])
        ids, q_ids = right.vec_id.to_numpy(), left.query_id.to_numpy()
        query, row, score = nearest_rows(q_ids, _matrix(left.v), ids, _matrix(right.v), k, right.leaf.to_numpy(), left.leaves.tolist())
        return pd.DataFrame({"query_id": q_ids[query], "vec_id": ids[row], "score": score})

    found = theirs.groupBy(*keys).cogroup(mine.groupBy(*keys)).applyInPandas(nearest, "query_id long, vec_id long, score double")
    # a query's blocks are merged in two steps, the second over at most 16 * k rows
    found = _top(found, [F.col("query_id"), F.pmod("vec_id", F.lit(16))], k)
    return _top(found, [F.col("query_id")], k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _top(found: DataFrame, by: list, k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def calibrated(rows: DataFrame, queries: DataFrame, tree: Tree, k: int, recall: float, calibrate: int) -> tuple[int, float]:
    """(visits, hope): the fewest leaves that hold ``recall`` of the exact answers of a bounded set of queries."""
    spark = rows.sparkSession
    some = queries.orderBy(F.xxhash64(F.lit(3), "vec_id"), "vec_id").limit(calibrate).toPandas()
    if not len(some):
        return 1, 0.0
    q_ids, q = some.vec_id.to_numpy(), _matrix(some.v)
    q_b = spark.sparkContext.broadcast((q_ids, q))

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q_ids, q = q_b.value
        kept = pd.DataFrame({"query": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "leaf": np.zeros(0, np.int64), "score": np.zeros(0)})
        for b in batches:
            if len(b):
                query, row, score = nearest_rows(q_ids, q, b.vec_id.to_numpy(), _matrix(b.v), k)
                kept = pd.concat([kept, pd.DataFrame({"query": query, "vec_id": b.vec_id.to_numpy()[row], "leaf": b.leaf.to_numpy()[row], "score": score})], ignore_index=True)
                own = _cut_to_k(kept["query"].to_numpy(), np.arange(len(kept)), kept.score.to_numpy(), kept.vec_id.to_numpy(), k)
                kept = kept.iloc[own[1]].reset_index(drop=True)
        yield kept

    near = rows.mapInPandas(exact, "query long, vec_id long, leaf long, score double")
    near = _top(near, [F.col("query")], k).select("query", "leaf").toPandas()  # at most calibrate * k rows
    if not len(near):
        return 1, 0.0
    choices = []
    for hope in (0.0, 1.0, 2.0):
        place = np.full((len(q), tree.n_leaves), tree.n_leaves)
        for i in range(len(q)):
            place[i, list(tree.walk(q[i], hope))] = np.arange(tree.n_leaves)
        at = np.sort(place[near["query"].to_numpy(), near.leaf.to_numpy()])
        choices.append((int(at[min(len(at) - 1, int(np.ceil(recall * len(at))))]) + 1, hope))
    return min(choices)


def op1_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = cut(valid_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "ann-vectors")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


__all__ = ["Tree", "calibrated", "drop_cut", "nearest_rows", "op1_nearest_vectors", "search", "valid_vectors"]
