"""N-gram Jaccard self-join by vertical partitioning, down to the connected components of its links.

Documents are sets of 5-word shingles; two link when 100 * |intersection| >= threshold * |union|. Shingles are ordered
by a 64-bit number, and that global order is cut into fragments. Every overlap is counted in each fragment separately
and summed, for nodes first and then for pairs:

1. Texts with the same words are one node, told by a 128-bit hash of their words; copies never meet as pairs.
2. In each fragment, a node's shingles that also occur in a node of another component are counted. Summed, that bounds a
   node's largest overlap with any other component from above, and a link needs an overlap of threshold % of the set, so
   nodes below it can't have a link to find and leave. At first every node is its own component, and nearly all leave.
3. The others are hashed to a few min-hash buckets of like sizes; in each, every node is paired with one hub only, the one
   with the fewest shingles of its own. Each fragment counts the overlap of each of these pairs, the counts are summed per
   pair and decide. Links join components, and step 2 runs again with the new components: inside a large group of near
   copies nothing is left to find.
4. What remains is joined exactly. A node's rarest shingles (as many as a link can't do without) make its pairs with nodes of
   other components. Two nodes that were compared with the same hub are paired by a shingle of the hub only if their
   overlaps with it allow a link; otherwise they must share a shingle that the hub hasn't, and all of these make pairs. So
   texts near a large group of near copies, but outside of it, don't meet its members. Fragments again count the overlap of
   every pair, summed per pair.

No link between different texts that would join two components is lost: only pairs already known to be connected are
never compared. In step 2's first run fragments carry 32 bits of each shingle besides the fragment's number, where a
collision can only keep a node longer, and 64 bits later. Shingles that are in a great share of texts (found by a sample,
which decides the way they take and nothing else) aren't dealt to a fragment's task; their labels are aggregated with
partial results. The number of fragments follows the size of the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordnum as W
from .common import cut, drop_cut, release, ship_code, table
from .components import connected_components

#: Shingles that one fragment holds, about.
FRAGMENT = 2_000_000
#: Fragments in which a pair's overlap is counted, at least, and shingles of one set in one of them, about.
PAIR_FRAGMENTS, PAIR_PART = 4, 250_000
#: A shingle is frequent if one in so many of the sampled texts has it; one text in SAMPLE, by hash, is sampled.
FREQUENT, SAMPLE = 200, 64
SETS = "k1 long, k2 long, n long, shingles binary"


def document_keys(docs: DataFrame, *, sampled: bool = False) -> DataFrame:
    """docs's doc_id (and _tidelog_row, if it has one) with n_words, n_shingles (size of the set), k1 and k2 (hashes of the words; null
    for texts without words) and, if sampled, the shingles of one text in SAMPLE."""

    ship_code(docs.sparkSession)
    own = ["doc_id"] + (["_tidelog_row"] if "_tidelog_row" in docs.columns else [])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, raw in W.steps(frames):
            numbers, bounds = W.words_of(raw)
            doc, values = W.sorted_sets(*W.shingles_of(numbers, bounds))
            n = np.bincount(doc, minlength=len(raw))
            out = pd.DataFrame({c: frame[c].astype("Int64").to_numpy(dtype=object, na_value=None) for c in own})
            out["n_words"], out["n_shingles"] = np.diff(bounds), n.astype(np.int64)
            first, second = W.sequence_keys(numbers, bounds)
            for c, k in (("k1", first), ("k2", second)):
                out[c] = pd.array(W.signed(k), dtype="Int64")
                out.loc[n == 0, c] = pd.NA
            if sampled:
                at = np.searchsorted(doc, np.arange(len(raw) + 1))
                take = (n > 0) & (first % np.uint64(SAMPLE) == 0)
                out["sample"] = [values[at[i] : at[i + 1]].tobytes() if x else None for i, x in enumerate(take)]
            yield out

    schema = ", ".join(f"{c} long" for c in [*own, "n_words", "n_shingles", "k1", "k2"]) + (", sample binary" if sampled else "")
    return docs.select(*[F.col(c).cast("long").alias(c) for c in own], "text").mapInPandas(run, schema)


def frequent_shingles(sample: DataFrame) -> np.ndarray:
    """Shingles that many of the texts in sample (k1, sample) have, ascending: at most FREQUENT times a text's shingles."""
    texts = sample.where("sample IS NOT NULL").groupBy("k1").agg(F.first("sample").alias("sample"))
    n = texts.count()
    if n < 2 * FREQUENT // 10:
        return np.zeros(0, np.uint64)

    def unpacked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"x": np.frombuffer(b"".join(f["sample"]), np.int64)})

    often = texts.select("sample").mapInPandas(unpacked, "x long").groupBy("x").count().where(F.col("count") >= max(2, n // FREQUENT))
    return np.sort(W.unsigned(often.select("x").toPandas().x.to_numpy(np.int64)))


def _within(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of values are in the ascending array some."""
    if not len(some):
        return np.zeros(len(values), bool)
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values


def _fragment_of(x: np.ndarray, fragments: int) -> np.ndarray:
    """Fragments are equal ranges of the order; fragments is a power of two."""
    bits = fragments.bit_length() - 1
    return (x >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(x), np.int64)


def _low(x: np.ndarray, fragments: int) -> np.ndarray:
    """32 bits after the fragment's."""
    return ((x << np.uint64(fragments.bit_length() - 1)) >> np.uint64(32)).astype(np.uint32)


def _fragments(shingles: float) -> int:
    return 1 << max(3, int(np.ceil(np.log2(max(1.0, shingles / FRAGMENT)))))


def _split_rows(node: np.ndarray, label: np.ndarray | None, doc: np.ndarray, values: np.ndarray, fragments: int, wide: bool) -> pd.DataFrame:
    """One row a fragment: the nodes (and their labels, if these are others) that have shingles in it, how many, and those."""
    fragment = _fragment_of(values, fragments)
    order = np.argsort(fragment, kind="stable")  # within a fragment by document
    fragment, doc, values = fragment[order], doc[order], values[order]
    cuts = np.flatnonzero(np.diff(fragment)) + 1
    rows = []
    for at, to in zip([0, *cuts], [*cuts, len(fragment)], strict=True):
        if to > at:
            own = doc[at:to]
            new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            count = np.diff(np.concatenate([new, [len(own)]])).astype(np.uint32)
            part = values[at:to] if wide else _low(values[at:to], fragments)
            rows.append((int(fragment[at]), W.signed(node)[own[new]].tobytes(), b"" if label is None else W.signed(label)[own[new]].tobytes(), count.tobytes(), part.tobytes()))
    return pd.DataFrame(rows, columns=["fragment", "nodes", "labels", "counts", "shingles"])


PARTS = "fragment int, nodes binary, labels binary, counts binary, shingles binary"


def text_parts(docs: DataFrame, fragments: int, frequent: np.ndarray) -> DataFrame:
    """PARTS of all texts, every node (k1) its own label; a task sends a node once. Rows of fragments below 0 count the
    nodes' frequent shingles."""
    known = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent: set[int] = set()
        for _, raw in W.steps(frames):
            numbers, bounds = W.words_of(raw)
            node, _ = W.sequence_keys(numbers, bounds)
            fresh = np.zeros(len(raw), bool)
            for i, x in enumerate(node.tolist()):
                if bounds[i + 1] > bounds[i] and x not in sent:
                    fresh[i] = True
                    sent.add(x)
            doc, values = W.sorted_sets(*W.shingles_of(numbers, bounds), fresh)
            often = _within(values, known.value)
            yield _split_rows(node, None, doc[~often], values[~often], fragments, False)
            if often.any():
                n = np.bincount(doc[often], minlength=len(raw))
                own = np.flatnonzero(n)
                own = own[np.argsort(node[own] % np.uint64(fragments))]
                to = (node[own] % np.uint64(fragments)).astype(np.int64)
                rows = [(-1 - int(to[part[0]]), W.signed(node)[own[part]].tobytes(), b"", n[own[part]].astype(np.uint32).tobytes(), b"") for part in np.split(np.arange(len(own)), np.flatnonzero(np.diff(to)) + 1)]
                yield pd.DataFrame(rows, columns=["fragment", "nodes", "labels", "counts", "shingles"])

    return docs.select("text").mapInPandas(run, PARTS)


def set_parts(sets: DataFrame, fragments: int, frequent: np.ndarray) -> DataFrame:
    """PARTS of sets (node, label, shingles) with whole shingles, without the frequent ones."""
    known = sets.sparkSession.sparkContext.broadcast(frequent)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 512):
                f = frame.iloc[at : at + 512]
                own = [np.frombuffer(x, np.uint64) for x in f.shingles]
                doc, values = np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate(own)
                keep = ~_within(values, known.value)
                yield _split_rows(W.unsigned(f.node), W.unsigned(f.label), doc[keep], values[keep], fragments, True)

    return sets.select("node", "label", "shingles").mapInPandas(run, PARTS)


def _read_parts(pdf: pd.DataFrame, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, label, shingle) of a fragment, without repeats, by shingle."""
    count = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["counts"]])
    node = np.repeat(np.concatenate([np.frombuffer(x, np.int64) for x in pdf["nodes"]]), count)
    label = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["labels"]])
    label = np.repeat(label, count) if len(label) else node
    value = np.concatenate([np.frombuffer(x, np.uint64 if wide else np.uint32) for x in pdf["shingles"]])
    order = np.lexsort((node, value)) if len(value) else np.zeros(0, np.int64)
    node, label, value = node[order], node[order] if label is node else label[order], value[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (node[1:] != node[:-1])
    return node[keep], label[keep], value[keep]


def _foreign(node: np.ndarray, label: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each row's shingle also occurs with another label, how many nodes have it)."""
    if not len(value):
        return np.zeros(0, bool), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    low, high = np.minimum.reduceat(label, start), np.maximum.reduceat(label, start)
    n = np.diff(np.concatenate([start, [len(value)]]))
    return np.repeat(low != high, n), np.repeat(n, n)


def text_shared(docs: DataFrame, fragments: int, frequent: np.ndarray) -> DataFrame:
    """(k1, shared): shingles of each text that texts of another k1 have, too, counted in each fragment and summed."""

    def packed(node: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        """One row for each share of the nodes, so that a fragment's counts travel as few rows."""
        to = (node.view(np.uint64) % np.uint64(fragments)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cuts = np.flatnonzero(np.diff(to[order])) + 1
        rows = [(int(to[x[0]]), node[x].tobytes(), n[x].astype(np.uint32).tobytes()) for x in np.split(order, cuts) if len(x)]
        return pd.DataFrame(rows, columns=["share", "nodes", "counts"])

    def unpacked(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([np.frombuffer(x, np.int64) for x in pdf["nodes"]]), np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["counts"]]).astype(np.int64)

    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf.fragment.iloc[0] < 0:  # a node that several tasks sent has as many frequent shingles in each of them
            node, n = unpacked(pdf)
            node, first = np.unique(node, return_index=True)
            return packed(node, n[first])
        node, label, value = _read_parts(pdf, False)
        return packed(*np.unique(node[_foreign(node, label, value)[0]], return_counts=True))

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        node, n = unpacked(pdf)
        node, of = np.unique(node, return_inverse=True)
        return pd.DataFrame({"k1": node, "shared": np.bincount(of, weights=n, minlength=len(node)).astype(np.int64)})

    partial = text_parts(docs, fragments, frequent).groupBy("fragment").applyInPandas(counted, "share long, nodes binary, counts binary")
    return partial.groupBy("share").applyInPandas(summed, "k1 long, shared long")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """SETS of docs's texts: sorted shingles, k1 and k2 hashes of the words; texts without words are left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, raw in W.steps(frames):
            numbers, bounds = W.words_of(raw)
            first, second = W.sequence_keys(numbers, bounds)
            doc, values = W.sorted_sets(*W.shingles_of(numbers, bounds))
            at = np.searchsorted(doc, np.arange(len(raw) + 1))
            f = pd.DataFrame({"k1": W.signed(first), "k2": W.signed(second), "n": np.diff(at), "shingles": [values[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]})
            yield f[f.n > 0]

    return docs.select("text").mapInPandas(run, SETS)


def _frequent_labels(sets: DataFrame, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, nodes that have each): the frequent shingles that sets of more than one label have."""
    if not len(frequent):
        return frequent, np.zeros(0, np.int64)
    known = sets.sparkSession.sparkContext.broadcast(frequent)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            own = [np.frombuffer(x, np.uint64) for x in f.shingles]
            if own:
                x = pd.DataFrame({"x": np.concatenate(own), "label": np.repeat(f.label.to_numpy(), [len(v) for v in own])})
                got = x[_within(x.x.to_numpy(), known.value)].groupby("x").label.agg(["min", "max", "size"]).reset_index()
                yield pd.DataFrame({"x": W.signed(got.x.to_numpy(np.uint64)), "low": got["min"], "high": got["max"], "n": got["size"]})

    got = sets.select("label", "shingles").mapInPandas(run, "x long, low long, high long, n long").groupBy("x").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).where("low <> high").select("x", "n").toPandas()
    x = W.unsigned(got.x.to_numpy(np.int64))
    order = np.argsort(x)
    return x[order], got.n.to_numpy(np.int64)[order]


def foreign_shingles(sets: DataFrame, frequent: np.ndarray, fragments: int) -> DataFrame:
    """(node, shingles, counts): shingles of each of sets (node, label, shingles) that nodes of other labels have, and how many nodes have
    each, a row for each fragment of the node."""
    often, nodes = _frequent_labels(sets, frequent)
    state = sets.sparkSession.sparkContext.broadcast((often, nodes))

    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        node, label, value = _read_parts(pdf, True)
        keep, count = _foreign(node, label, value)
        keep = np.flatnonzero(keep)
        keep = keep[np.argsort(node[keep], kind="stable")]
        node, value, count = node[keep], value[keep], count[keep].astype(np.uint32)
        cuts = np.flatnonzero(np.diff(node)) + 1
        rows = [(int(node[at]), value[at:to].tobytes(), count[at:to].tobytes()) for at, to in zip([0, *cuts], [*cuts, len(node)], strict=True) if to > at]
        return pd.DataFrame(rows, columns=["node", "shingles", "counts"])

    def hot(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often, nodes = state.value
        for f in frames:
            rows = []
            for node, x in zip(f.node, f.shingles, strict=True):
                own = np.frombuffer(x, np.uint64)
                own = own[_within(own, often)]
                if len(own):
                    rows.append((node, own.tobytes(), nodes[np.searchsorted(often, own)].astype(np.uint32).tobytes()))
            yield pd.DataFrame(rows, columns=["node", "shingles", "counts"])

    schema = "node long, shingles binary, counts binary"
    out = set_parts(sets, fragments, frequent).groupBy("fragment").applyInPandas(counted, schema)
    return out.unionByName(sets.select("node", "shingles").mapInPandas(hot, schema)) if len(often) else out


def pair_parts(sets: DataFrame, fragments: int) -> DataFrame:
    """(node, fragment, part): the shingles of sets (node, shingles), cut vertically."""
    bounds = np.array([i << (64 - (fragments.bit_length() - 1)) for i in range(1, fragments)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fragment, sizes, values = [], [], [], []
            for node, x in zip(batch["node"].to_pylist(), batch["shingles"].to_pylist(), strict=True):
                own = np.frombuffer(x, np.int64)
                at = np.concatenate([[0], np.searchsorted(own.view(np.uint64), bounds), [len(own)]])
                n = np.diff(at)
                some = np.flatnonzero(n)
                nodes.append(np.full(len(some), node, np.int64))
                fragment.append(some.astype(np.int32))
                sizes.append(n[some])
                values.append(own)
            if nodes:
                offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(offsets, np.concatenate(values))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(fragment)), lists], ["node", "fragment", "part"])

    return sets.select("node", "shingles").mapInArrow(run, "node long, fragment int, part array<long>")


def overlaps(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with overlap: of each pair, the overlaps in the fragments of parts (pair_parts), summed."""
    left = parts.select(F.col("node").alias("a"), "fragment", F.col("part").alias("x"))
    right = parts.select(F.col("node").alias("b"), "fragment", F.col("part").alias("y"))
    partial = pairs.select("a", "b").join(left, "a").join(right, ["b", "fragment"]).select("a", "b", F.size(F.array_intersect("x", "y")).alias("partial"))
    return pairs.join(partial.groupBy("a", "b").agg(F.sum("partial").alias("overlap")), ["a", "b"])


def _near(n: str, m: str, overlap, threshold: int):
    """Whether sets of n and m elements with that overlap link."""
    return 100 * overlap >= threshold * (F.col(n) + F.col(m) - overlap)


def hub_pairs(sets: DataFrame, round_: int, threshold: int, keys: int = 4) -> DataFrame:
    """(a, b, n, m): in each bucket of sets (node, label, n, shared, shingles), every node a and the hub b, of another label, if their
    figures allow a link. Buckets are of a min-hash and of like sizes; the hub has the fewest shingles of its own, by hash if
    round_ is odd."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for x in f.shingles:
                own = np.frombuffer(x, np.uint64)
                # sizes that may link lie in the same class of size for one key or the other
                size = np.log(len(own)) / np.log(1.6)
                out.append([int(W.signed(W.mix(W.mix(own, 100 + round_ * keys + k).min(keepdims=True), int(size + k % 2 / 2)))[0]) for k in range(keys)])
            yield f[["node", "label", "n", "shared"]].assign(keys=out)

    buckets = sets.select("node", "label", "n", "shared", "shingles").mapInPandas(run, "node long, label long, n long, shared long, keys array<long>").select("node", "label", "n", "shared", F.posexplode("keys").alias("k", "key"))
    buckets = cut(buckets, "join-buckets")
    own = (F.col("n") - F.col("shared")) / F.col("n") if round_ % 2 == 0 else F.lit(0.0)
    place = F.struct(own.alias("own"), F.xxhash64("node", F.lit(round_)).alias("h"), "node", "label", "n", "shared")
    hubs = buckets.groupBy("k", "key").agg(F.min(place).alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1").select("k", "key", "hub")
    near = buckets.join(hubs, ["k", "key"]).where("label <> hub.label")
    most = F.least("shared", "hub.shared")
    near = near.where(100 * most >= threshold * (F.col("n") + F.col("hub.n") - most))
    return near.select(F.col("node").alias("a"), F.col("hub.node").alias("b"), "n", F.col("hub.n").alias("m")).distinct()


def exact_pairs(sets: DataFrame, foreign: DataFrame, hubs: DataFrame, threshold: int, buckets: int = 128, block: int = 250_000, crowded: int = 50_000) -> DataFrame:
    """(a, b, n, m): every pair of sets (node, label, n, shared, shingles) of different labels that may link, and some that don't.

    foreign: foreign_shingles of sets. hubs: (node, hub, with_hub, hub_shingles), the overlap of some nodes with one that they
    were compared with, and its set.

    A node's shingles are ordered by how many nodes have them, those that no other label has first; two nodes that link share a
    shingle among the first n - (least overlap) + 1 of both. Of nodes of one hub h, such a shingle in h makes a pair only if
    least(|x & h|, |y & h|) would do as their overlap. If it wouldn't, they must share a shingle outside of h, so all
    of those are dealt out, too.
    """

    def dealt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for node, label, n, shared, hub, with_hub, of_hub, parts in zip(f.node, f.label, f.n, f.shared, f.hub, f.with_hub, f.hub_shingles, f.parts, strict=True):
                value = np.concatenate([np.frombuffer(x["shingles"], np.uint64) for x in parts])
                count = np.concatenate([np.frombuffer(x["counts"], np.uint32) for x in parts])
                first = n - -(-threshold * n // 100) + 1 - (n - len(value))
                order = np.lexsort((value, count))
                chosen = np.arange(len(order)) < first
                inside = np.zeros(len(order), bool)
                if of_hub is not None:
                    inside = _within(value[order], np.frombuffer(of_hub, np.uint64))
                    chosen |= ~inside
                for v, i in zip(W.signed(value[order][chosen]).tolist(), inside[chosen].tolist(), strict=True):
                    out.append((v, i, node, label, n, shared, hub if of_hub is not None else node, with_hub if of_hub is not None else 0))
            yield pd.DataFrame(out, columns=["shingle", "inside", "node", "label", "n", "shared", "hub", "with_hub"])

    def runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the run of equal values that each place lies in."""
        m = len(columns[0])
        new = np.ones(m, bool)
        if m:
            new[1:] = np.any([c[1:] != c[:-1] for c in columns], 0)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], m)
        return np.repeat(begin, end - begin), np.repeat(end, end - begin)

    def meetings(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, j) of each of rows and the places from low to high, a bounded number at a time."""
        n = high - low
        total, at = np.concatenate([[0], np.cumsum(n)]), 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(total, total[at] + block, "right")) - 1)
            i = np.repeat(np.arange(at, to), n[at:to])
            yield rows[i], low[i] + np.arange(len(i)) - (total[i] - total[at])
            at = to

    def paired(pdf: pd.DataFrame) -> pd.DataFrame:
        names, of = np.unique(pdf.node.to_numpy(np.int64), return_inverse=True)
        # a node that has too little of its hub for any partner by way of it meets only others than its hub's
        idle = (pdf.inside & (100 * pdf.with_hub < threshold * pdf.n)).to_numpy()
        side = np.where(pdf.inside, pdf.hub, -1)
        found = np.zeros(0, np.int64)

        def take(order: np.ndarray, meet) -> None:
            nonlocal found
            value, label, n, shared, hub, with_hub = (pdf[c].to_numpy(np.int64)[order] for c in ("shingle", "label", "n", "shared", "hub", "with_hub"))
            inside, at = pdf.inside.to_numpy(bool)[order], of[order]
            for i, j in meet(value, label, order):
                most = np.minimum(shared[i], shared[j])
                by_hub = inside[i] & inside[j] & (hub[i] == hub[j])
                most[by_hub] = np.minimum(most, np.minimum(with_hub[i], with_hub[j]))[by_hub]
                ok = (label[i] != label[j]) & (100 * most >= threshold * (n[i] + n[j] - most))
                if ok.any():
                    x, y = at[i[ok]], at[j[ok]]
                    found = np.union1d(found, np.minimum(x, y) * len(names) + np.maximum(x, y))

        def busy(value: np.ndarray, label: np.ndarray, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            yield from meetings(np.arange(len(value)), runs(value, label)[1], runs(value)[1])

        def rest(value: np.ndarray, label: np.ndarray, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            rows = np.flatnonzero(idle[order])
            begin, end = runs(value)
            own, own_end = runs(value, side[order])
            yield from meetings(rows, begin[rows], own[rows])
            yield from meetings(rows, own_end[rows], end[rows])

        some = np.flatnonzero(~idle)
        take(some[np.lexsort((pdf.label.to_numpy()[some], pdf.shingle.to_numpy()[some]))], busy)
        if idle.any():
            take(np.lexsort((side, pdf.shingle.to_numpy())), rest)
        size = np.zeros(len(names), np.int64)
        size[of] = pdf.n
        a, b = found // max(1, len(names)), found % max(1, len(names))
        return pd.DataFrame({"a": names[a], "b": names[b], "n": size[a], "m": size[b]})

    whole = foreign.groupBy("node").agg(F.collect_list(F.struct("shingles", "counts")).alias("parts")).join(sets.select("node", "label", "n", "shared"), "node")
    whole = whole.join(hubs, "node", "left")
    rows = whole.select("node", "label", "n", "shared", "hub", "with_hub", "hub_shingles", "parts").mapInPandas(dealt, "shingle long, inside boolean, node long, label long, n long, shared long, hub long, with_hub long")
    # the rows of a shingle's most common label are dealt to several tasks if they are many, those of others to all of these
    rows = cut(rows, "join-prefixes")
    crowd = rows.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > crowded).groupBy("shingle").agg(F.max(F.struct("m", "label")).alias("most"))
    rows = rows.join(crowd, "shingle", "left")
    salts = F.ceil(F.col("most.m") / crowded).cast("int")
    salt = F.when(F.col("most").isNull(), F.array(F.lit(0))).when(F.col("label") == F.col("most.label"), F.array(F.pmod(F.hash("node"), salts))).otherwise(F.sequence(F.lit(0), salts - 1))
    rows = rows.withColumn("salt", F.explode(salt)).drop("most").withColumn("bucket", F.pmod(F.xxhash64("shingle", "salt"), F.lit(buckets)))
    return rows.groupBy("bucket").applyInPandas(paired, "a long, b long, n long, m long").distinct()


def linked(docs: DataFrame, *, threshold: int = 80, rounds: int = 1) -> tuple[DataFrame, DataFrame]:
    """(keys, nodes) of docs (doc_id, text, perhaps _tidelog_row): keys as document_keys gives them; nodes: k1, k2, label of each text, equal for
    texts of one component."""
    keys = cut(document_keys(docs, sampled=True), "join-keys")
    total = keys.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    frequent = frequent_shingles(keys.select("k1", "sample"))
    texts = keys.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"))
    shared = text_shared(docs, _fragments(total), frequent)
    left = cut(texts.join(shared, "k1").where(F.col("shared") * 100 >= F.col("n") * threshold).select("k1", "k2", "doc_id", "shared"), "join-left")
    one = docs.select("doc_id", "text").join(left.select("doc_id"), "doc_id", "left_semi").unionByName(docs.select("doc_id", "text").where("doc_id IS NULL"))
    sets = shingle_sets(one).dropDuplicates(["k1", "k2"]).join(left.select("k1", "k2", "shared"), ["k1", "k2"])
    sets = cut(sets.withColumn("node", F.monotonically_increasing_id()), "join-sets")
    longest = sets.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    parts = cut(pair_parts(sets, max(PAIR_FRAGMENTS, 1 << int(np.ceil(np.log2(max(1, longest / PAIR_PART)))))), "join-pair-parts")
    links: list[DataFrame] = []
    met: list[DataFrame] = []
    labels = None
    current = cut(sets.select("node", F.col("node").alias("label"), "n", "shared", "shingles"), "join-current")
    for r in range(rounds + 1):
        if r or r == rounds:  # what the components found so far leave
            relabelled = current.drop("label")
            relabelled = relabelled.withColumn("label", F.col("node")) if labels is None else relabelled.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
            relabelled = cut(relabelled, "join-relabelled")
            fragments = _fragments(relabelled.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
            foreign = cut(foreign_shingles(relabelled, frequent, fragments), "join-foreign")
            counted = foreign.groupBy("node").agg(F.sum(F.length("shingles") / 8).cast("long").alias("shared"))
            drop_cut(current)
            current = cut(relabelled.drop("shared").join(counted, "node").where(F.col("shared") * 100 >= F.col("n") * threshold), "join-current")
            drop_cut(relabelled)
            release(docs.sparkSession)
        if current.isEmpty():
            break
        if r < rounds:
            pairs = hub_pairs(current, r, threshold)
        else:
            pairs = exact_pairs(current, foreign.join(current.select("node"), "node", "left_semi"), _nearest_hubs(met, sets), threshold, 16 * fragments)
        met.append(cut(overlaps(cut(pairs, "join-pairs"), parts), "join-overlaps"))
        links.append(met[-1].where(_near("n", "m", F.col("overlap"), threshold)).select("a", "b"))
        if not links[-1].isEmpty():
            joined = links[0]
            for x in links[1:]:
                joined = joined.unionByName(x)
            labels = cut(connected_components(joined).select("node", "component"), "join-labels")
    for table_ in (parts, current, *met):
        drop_cut(table_)
    known = texts.join(sets.select("k1", "k2", "node"), ["k1", "k2"], "left")
    if labels is not None:
        known = known.join(labels, "node", "left").withColumn("node", F.coalesce("component", "node"))
    return keys, known.select("k1", "k2", "node")


def _nearest_hubs(met: list[DataFrame], sets: DataFrame) -> DataFrame:
    """(node, hub, with_hub, hub_shingles): of the hubs that a node was compared with, the one that has most of it; a hub is its own."""
    every = sets.select(F.col("node").alias("a"), F.col("node").alias("b"), F.col("n").alias("m"), F.col("n").alias("overlap")).where("a < 0")
    for x in met:
        every = every.unionByName(x.select("a", "b", "m", "overlap"))
    itself = every.select(F.col("b").alias("a"), "b", "m", F.col("m").alias("overlap")).distinct()
    # hubs that many nodes have met come first, so that neighbours have the same one
    n = every.groupBy("b").agg(F.count(F.lit(1)).alias("met"))
    best = every.unionByName(itself).join(n, "b").groupBy("a").agg(F.max(F.struct("met", "b", "overlap")).alias("h"))
    best = best.select(F.col("a").alias("node"), F.col("h.b").alias("hub"), F.col("h.overlap").alias("with_hub"))
    return best.join(sets.select(F.col("node").alias("hub"), F.col("shingles").alias("hub_shingles")), "hub").select("node", "hub", "with_hub", "hub_shingles")


def jaccard_components(docs: DataFrame, *, threshold: int = 80, rounds: int = 1) -> DataFrame:
    """(doc_id, n_shingles, component_id) of docs (doc_id, text): one row each, other columns aren't read. If docs has a column
    ``_tidelog_row`` (long, unique), it is returned, too, with ``first``: whether the row is the one that stays of its component, by (doc_id,
    null last, _tidelog_row).

    component_id is the smallest doc_id that links reach, its own included. Null, empty and blank texts have no shingles
    and link with nothing: component_id is their own doc_id. Rows that repeat a doc_id come each, with its own n_shingles;
    rows with a null doc_id link as others do and never name a component that has a doc_id. An empty table gives none.
    """
    keys, nodes = linked(docs, threshold=threshold, rounds=rounds)
    # texts that link with nothing have no number: their hashes name them
    label = [F.coalesce("node", "k1").alias("l1"), F.when(F.col("node").isNull(), F.col("k2")).alias("l2")]
    named = nodes.select("k1", "k2", *label)
    rows = keys.join(named, ["k1", "k2"], "left")
    same = (F.col("l1") == F.col("f1")) & F.col("l2").eqNullSafe(F.col("f2"))
    if "_tidelog_row" not in docs.columns:
        firsts = rows.where("k1 IS NOT NULL").groupBy("l1", "l2").agg(F.min("doc_id").alias("component_id"))
        firsts = firsts.select(F.col("l1").alias("f1"), F.col("l2").alias("f2"), "component_id")
        return rows.join(firsts, same, "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "_tidelog_row")
    firsts = rows.where("k1 IS NOT NULL").groupBy("l1", "l2").agg(F.min(place).alias("stays"))
    firsts = firsts.select(F.col("l1").alias("f1"), F.col("l2").alias("f2"), "stays")
    out = rows.join(firsts, same, "left")
    return out.select("doc_id", "n_shingles", F.coalesce("stays.doc_id", "doc_id").alias("component_id"), "_tidelog_row", F.coalesce(F.col("stays._tidelog_row") == F.col("_tidelog_row"), F.lit(True)).alias("first"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


__all__ = ["document_keys", "drop_cut", "exact_pairs", "hub_pairs", "jaccard_components", "linked", "op6_ngram_join", "overlaps", "shingle_sets"]
