"""Versioned memories: recall, supersession, conflicts, lineage, rollups, and the measures that grade retrieval."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import intent, intent_boost, rule_facts, subjects, time_decay
from ..functions.vector import knn
from .fusion import CHANNEL_WEIGHTS, K, ranked
from .text_index import bm25

DAY = 86_400
#: Weight and half life (seconds) of each kind of memory.
TYPE_WEIGHTS = {"fact": 1.0, "instruction": 1.2, "event": 0.8, "task": 1.0, "concept": 1.5}
HALF_LIVES = {"fact": 365 * DAY, "instruction": 730 * DAY, "event": 30 * DAY, "task": 7 * DAY, "concept": 90 * DAY}
CONFLICT_PENALTY = 0.5
#: The polarity of a fact that contradicts another one.
CONFLICTING = "conflicting"
#: A JSON number.
NUMBER = r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
#: Version of a tombstone.
TOMBSTONE = 2**63 - 1


def _by_kind(values: dict, kind: Column) -> Column:
    out = F.lit(None).cast("double")
    for k, v in values.items():
        out = F.when(kind == k, F.lit(float(v))).otherwise(out)
    return out


def current(memories: DataFrame, *, score: str | None = None) -> DataFrame:
    """Of each (namespace, key) the highest version, ties by score, then memory_id; events and memories without a key all stay;
    what a tombstone heads is gone."""
    w = Window.partitionBy("namespace", "key").orderBy(F.desc("version"), *([F.desc(score)] if score else []), "memory_id")
    loose = (F.col("type") == "event") | F.col("key").isNull()
    keyed = memories.where(~loose).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return keyed.unionByName(memories.where(loose)).where("NOT tombstoned")


def recall(memories: DataFrame, channels: DataFrame, *, now: Column, query_intent: str | Column = "identity", namespace: str | None = None, min_confidence: float | None = None, since=None, k: int = 10) -> DataFrame:
    """The k best memories: weighted RRF over channels (channel, memory_id, rank from 0), times type weight, decay, confidence and
    intent boost, halved where a column ``polarity`` says ``conflicting``; then superseded and tombstoned ones go. Boosts read the columns
    ``object`` (a number?) and ``due_at``, where memories have them."""
    weight = _by_kind(CHANNEL_WEIGHTS, F.col("channel"))
    fused = channels.groupBy("memory_id").agg(F.sum(weight / (K + F.col("rank"))).alias("rrf"))
    m = memories
    if namespace is not None:
        m = m.where(F.col("namespace") == namespace)
    if min_confidence is not None:
        m = m.where(F.col("confidence") >= min_confidence)
    if since is not None:
        m = m.where(F.col("created_at") >= F.lit(since).cast("timestamp"))
    kind = F.col("type")
    number = F.coalesce(F.col("object").cast("string").rlike(NUMBER), F.lit(False)) if "object" in m.columns else None
    boost = intent_boost(F.lit(query_intent) if isinstance(query_intent, str) else query_intent, kind, F.col("text"), object_is_number=number, due_at=F.col("due_at") if "due_at" in m.columns else None)
    if "polarity" in m.columns:
        boost = boost * F.when(F.col("polarity") == CONFLICTING, F.lit(CONFLICT_PENALTY)).otherwise(F.lit(1.0))
    score = F.col("rrf") * _by_kind(TYPE_WEIGHTS, kind) * time_decay(F.col("valid_from"), now, _by_kind(HALF_LIVES, kind)) * F.col("confidence") * boost
    scored = m.join(fused, "memory_id").withColumn("score", score)
    return current(scored, score="score").orderBy(F.desc("score"), "memory_id").limit(k)


def channels(memories: DataFrame, question: str, *, predicate: str | None = None, vector: list[float] | None = None, limit: int = 200) -> DataFrame:
    """(channel, memory_id, rank) of the memories that a question finds: by BM25 of their texts, by what it is about (subject or key),
    by a SQL predicate (latest first) and by the nearest vectors, where these are given."""
    lists = [ranked(bm25(memories, "memory_id", "text", re.findall(r"[^\W_]+", question)), "bm25", "score", ["memory_id"], limit=limit)]
    about = subjects(F.lit(question))
    own = [F.array_contains(about, F.lower(F.col(c).cast("string"))).cast("int") for c in ("subject", "key") if c in memories.columns]
    hits = F.coalesce(own[0], F.lit(0))
    for h in own[1:]:
        hits = hits + F.coalesce(h, F.lit(0))
    lists.append(ranked(memories.select("memory_id", hits.alias("s")).where("s > 0"), "key_match", "s", ["memory_id"], limit=limit))
    if predicate is not None:
        lists.append(ranked(memories.where(predicate).select("memory_id", F.unix_micros("created_at").alias("s")), "sql", "s", ["memory_id"], limit=limit))
    if vector is not None:
        near = knn(memories, vector, limit, tie=["memory_id"]).select("memory_id", "distance")
        lists.append(ranked(near, "vector", "distance", ["memory_id"], ascending=True, limit=limit))
    out = lists[0]
    for x in lists[1:]:
        out = out.unionByName(x)
    return out.select(F.col("mode").alias("channel"), "memory_id", "rank")


def ask(memories: DataFrame, question: str, *, now: Column, predicate: str | None = None, vector: list[float] | None = None, k: int = 10, **filters) -> DataFrame:
    """The k best memories for a question: its channels, fused and weighed by recall() under the question's intent."""
    found = channels(memories, question, predicate=predicate, vector=vector)
    return recall(memories, found, now=now, query_intent=intent(F.lit(question)), k=k, **filters)


#: What a rule's find says of a turn's role, with the words between the two, and how sure rules are.
RULE_PREDICATES = {"email": ("has_email", "has email"), "phone": ("has_phone", "has phone"), "url": ("mentioned_url", "mentioned"), "date": ("mentioned_date", "mentioned")}
RULE_CONFIDENCE = 0.6


def extract(turns: DataFrame) -> DataFrame:
    """What the rules find in turns (role, text, ...): one row a find, turns' columns but text kept, with type (``fact``, a date ``event``),
    subject (the role), predicate, object, text, key (subject|predicate, null for events) and confidence. Finds are trimmed; dates
    that no calendar has are left out."""
    names = [c for c in turns.columns if c not in ("role", "text")]
    found = turns.select(*names, F.col("role").alias("subject"), F.explode(rule_facts(F.col("text"))).alias("f"))
    found = found.where((F.col("f.kind") != "date") | F.col("f.value").try_cast("timestamp").isNotNull())
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in RULE_PREDICATES.items() for x in (k, v[i])]), F.col("f.kind"))
    dated = F.col("f.kind") == "date"
    out = found.select(*names, F.when(dated, "event").otherwise("fact").alias("type"), "subject", pick(0).alias("predicate"), F.col("f.value").alias("object"), F.concat_ws(" ", "subject", pick(1), F.col("f.value")).alias("text"))
    return out.withColumn("key", F.when(F.col("type") == "fact", F.concat_ws("|", "subject", "predicate"))).withColumn("confidence", F.lit(RULE_CONFIDENCE))


def forget(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """Tombstones for the memories of ids (memory_id), to be appended."""
    return memories.join(ids.select("memory_id").distinct(), "memory_id", "left_semi").withColumn("version", F.lit(TOMBSTONE)).withColumn("tombstoned", F.lit(True))


def conflicts(facts: DataFrame) -> DataFrame:
    """(namespace, subject, predicate, n_objects, n_facts) where facts give several objects; null and empty ones don't count.

    Groups are counted, not paired: a subject of any number of facts is one row.
    """
    filled = facts.where("object IS NOT NULL AND object NOT IN ('', '\"\"', '[]', '{}', 'null')")
    return filled.groupBy("namespace", "subject", "predicate").agg(F.countDistinct("object").alias("n_objects"), F.count(F.lit(1)).alias("n_facts")).where("n_objects > 1")


def mark_conflicts(facts: DataFrame) -> DataFrame:
    """facts with polarity ``conflicting`` where conflicts() finds several objects, null elsewhere."""
    keys = ["namespace", "subject", "predicate"]
    both = facts.join(conflicts(facts).select(*keys, F.lit(CONFLICTING).alias("polarity")), keys, "left")
    return both.select(*facts.columns, "polarity")


def resolve_conflicts(facts: DataFrame, strategy: str) -> DataFrame:
    """surface_both (all), latest_wins (version, then confidence) or highest_confidence_wins (the other way round)."""
    order = {"latest_wins": ["version", "confidence"], "highest_confidence_wins": ["confidence", "version"]}
    if strategy == "surface_both":
        return facts
    w = Window.partitionBy("namespace", "subject", "predicate").orderBy(*[F.desc(c) for c in order[strategy]], "memory_id")
    return facts.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


#: Different vectors of one group that a task compares with as many others.
DEDUP_BLOCK = 2048


def _similar(entries: DataFrame, threshold: float, kind: str) -> DataFrame:
    """(h1, h2, c, id): for each class of vectors the two best entries, of different ids, of each block of the classes at least that similar, itself included.

    entries: task (string), g, i, j, block, h1, h2, vec, dims, c, id: a class's two best, of different ids, in each task that compares its block.
    All pairs of blocks are compared, as matrices; products within 1e-9 of the threshold are summed anew in order, as an expression sums them.
    """

    def best(pdf):  # refers to nothing of this package, which executors may not have
        import numpy as np
        import pandas as pd

        out = []
        pdf = pdf.sort_values(["g", "dims", "h1", "h2"], kind="stable").reset_index(drop=True)
        # from the surest on; of equally sure ones the smallest id; without a confidence last
        order = pdf.assign(x=-pdf.c).sort_values(["x", "id"], kind="stable", na_position="last").index.to_numpy()
        rank = np.empty(len(pdf), np.int64)
        rank[order] = np.arange(len(pdf))
        who = pd.factorize(pdf.id)[0]
        none = len(pdf)
        h1, h2, g, dims = pdf.h1.to_numpy(), pdf.h2.to_numpy(), pdf.g.to_numpy(), pdf.dims.to_numpy()
        new = lambda *cs: np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cs], axis=0)])
        first = np.flatnonzero(new(g, dims, h1, h2))
        n = np.diff(np.append(first, len(pdf)))
        last = first + n - 1
        one = np.where(rank[last] < rank[first], last, first)  # of a class's one or two rows the better one
        two = np.where(n > 1, first + last - one, -1)
        rank1, rank2, code = rank[one], np.where(two >= 0, rank[two], none), who[one]
        blocks = np.stack([pdf[c].to_numpy()[first] for c in ("block", "i", "j")])
        part = np.append(np.flatnonzero(new(g[first], dims[first])), len(first))
        for p, q in zip(part[:-1], part[1:], strict=True):
            v = np.stack(pdf.vec.to_numpy()[first[p:q]]).astype(np.float64)
            with np.errstate(all="ignore"):
                size = np.zeros(q - p)
                for k in range(v.shape[1]):
                    size = size + v[:, k] * v[:, k]
                size = np.sqrt(size)
                unit = v / size[:, None]
            own, i, j = blocks[:, p:q]
            sides = [(np.flatnonzero(own == i), np.flatnonzero(own == j))]
            if i[0] != j[0]:
                sides.append(sides[0][::-1])
            for left, right in sides:
                step = max(1, 4_000_000 // max(1, len(right)))
                for at in range(0, len(left), step):
                    a = left[at : at + step]
                    with np.errstate(all="ignore"):
                        cos = unit[a] @ unit[right].T
                        x, y = np.nonzero(~(cos < threshold - 1e-9))
                        close = np.flatnonzero(~(cos[x, y] >= threshold + 1e-9))
                        keep = np.ones(len(x), bool)
                        for z in range(0, len(close), 100_000):
                            c = close[z : z + 100_000]
                            l, r = a[x[c]], right[y[c]]  # noqa: E741
                            dot = np.zeros(len(c))
                            for k in range(v.shape[1]):
                                dot = dot + v[l, k] * v[r, k]
                            under = size[l] * size[r]
                            keep[c] = (under != 0) & ~(dot / under < threshold)  # NaN is large
                    x, y = x[keep], p + right[y[keep]]
                    if not len(x):
                        continue
                    start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
                    top = np.minimum.reduceat(rank1[y], start)
                    held = who[order[top]]
                    other = np.minimum.reduceat(np.where(code[y] != np.repeat(held, np.diff(np.append(start, len(x)))), rank1[y], rank2[y]), start)
                    owner = first[p + a[x[start]]]
                    some = other < none
                    place = np.concatenate([order[top], order[other[some]]])
                    owner = np.concatenate([owner, owner[some]])
                    out.append(pd.DataFrame({"h1": h1[owner], "h2": h2[owner], "c": pdf.c.to_numpy()[place], "id": pdf.id.to_numpy()[place]}))
        return pd.concat(out) if out else pdf.iloc[:0][["h1", "h2", "c", "id"]]

    return entries.groupBy("task").applyInPandas(best, f"h1 long, h2 long, c double, id {kind}")


def semantic_dedup(facts: DataFrame, *, threshold: float = 0.97, vector: str = "embedding") -> DataFrame:
    """facts with decision: drop (a fact of the same subject and predicate is at least that similar, and surer, or as sure with a smaller
    memory_id), supersede (such a one is less sure) or keep.

    Equal vectors of a subject and predicate are one class, told by 128 bits. Of it the two best facts take part, so copies are never
    paired; classes are compared block by block, all with all. No task holds more than two blocks of a group.
    """
    keys = ["namespace", "subject", "predicate"]
    vec = F.transform(vector, lambda x: x.cast("double"))
    c = F.col("confidence").cast("double")
    # a null confidence is neither more nor less; NaN is the largest
    f = facts.select(F.to_json(F.struct(*keys)).alias("g"), F.col("memory_id").alias("id"), F.when(F.isnan(c), F.lit(float("inf"))).otherwise(c).alias("c"), vec.alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull()) & (F.size("vec") > 0))
    f = f.withColumn("h1", F.xxhash64("g", "vec")).withColumn("h2", F.xxhash64(F.lit("2"), "vec", "g"))
    ids = f.groupBy("h1", "h2", "id").agg(F.max("c").alias("c"), F.first("g").alias("g"), F.first("vec").alias("vec"))
    rank = F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.col("c").desc_nulls_last(), "id"))
    top = ids.withColumn("_rn", rank).where("_rn <= 2").drop("_rn")
    blocks = top.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / F.lit(2 * DEDUP_BLOCK)).alias("blocks"))  # two rows a class at most
    entries = top.join(blocks, "g").withColumn("block", F.pmod("h1", "blocks")).withColumn("dims", F.size("vec"))
    entries = entries.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("i", F.least("block", "_o")).withColumn("j", F.greatest("block", "_o")).drop("_o")
    many = 8 * int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = F.concat(F.lit("small "), F.pmod(F.xxhash64("g"), F.lit(many)).cast("string"))
    entries = entries.withColumn("task", F.when(F.col("blocks") == 1, small).otherwise(F.concat_ws(" ", "i", "j", "g"))).drop("blocks")
    near = _similar(entries, threshold, facts.schema["memory_id"].dataType.simpleString())
    near = near.withColumnRenamed("id", "_id").withColumnRenamed("c", "_c")
    pairs = f.select("h1", "h2", "id", "c").join(near, ["h1", "h2"]).where("id <> _id")
    beaten = F.coalesce((F.col("_c") > F.col("c")) | ((F.col("_c") == F.col("c")) & (F.col("_id") < F.col("id"))), F.lit(False))
    verdict = pairs.groupBy(F.col("id").alias("memory_id")).agg(F.max(beaten).alias("_beaten"))
    return facts.join(verdict, "memory_id", "left").select(*facts.columns, F.when(F.col("_beaten").isNull(), "keep").when(F.col("_beaten"), "drop").otherwise("supersede").alias("decision"))


def dedup_report(decided: DataFrame, *, namespace: str | None = None) -> DataFrame:
    d = decided if namespace is None else decided.where(F.col("namespace") == namespace)
    count = lambda x: F.count(F.when(F.col("decision") == x, 1)).alias(f"{x}s")
    return d.agg(F.count(F.lit(1)).alias("records"), F.countDistinct("namespace", "subject", "predicate").alias("groups"), count("keep"), count("drop"), count("supersede"))


def lineage(memories: DataFrame) -> DataFrame:
    """(memory_id, topic, parent_offset): one row a source record."""
    return memories.select("memory_id", F.col("source.topic").alias("topic"), F.explode("source.offsets").alias("parent_offset"))


def descendants(memories: DataFrame) -> DataFrame:
    """(topic, parent_offset, n, memory_ids): what each source record led to."""
    return lineage(memories).groupBy("topic", "parent_offset").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("memory_id")).alias("memory_ids"))


def provenance(memories: DataFrame) -> DataFrame:
    """(memory_id, source) of the latest version of each; tombstoned ones are left out."""
    w = Window.partitionBy("memory_id").orderBy(F.desc("version"))
    return memories.withColumn("_rn", F.row_number().over(w)).where("_rn = 1 AND NOT tombstoned").select("memory_id", "source")


def rollups(events: DataFrame, n: int, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, batch, first, last, n): every n events of a key are one rollup; what is left over waits."""
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = events.withColumn("batch", F.floor((F.row_number().over(w) - 1) / n))
    return numbered.groupBy(*keys, "batch").agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("n") == n)


def tasks(states: DataFrame) -> DataFrame:
    """The latest state of each task, by due date (without one last), then id."""
    w = Window.partitionBy("task_id").orderBy(F.desc("version"))
    return states.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn").orderBy(F.col("due_at").asc_nulls_last(), "task_id")


def ranking_metrics(results: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg, precision, mrr) of results (query_id, doc_id, rank from 1) against relevant (query_id, doc_id), gains 0 or 1.
    Queries without a relevant document have no row."""
    rel = relevant.select("query_id", "doc_id").distinct()
    hits = results.where(F.col("rank") <= k).join(rel.withColumn("rel", F.lit(1)), ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    got = hits.groupBy("query_id").agg(F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum("rel").alias("found"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"))
    n = rel.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return n.join(got, "query_id", "left").select("query_id", zero(F.col("dcg") / ideal).alias("ndcg"), zero(F.col("found") / F.lit(k)).alias("precision"), zero(1 / F.col("first")).alias("mrr"))


def extraction_metrics(matched: DataFrame) -> DataFrame:
    """precision, recall, f1, type_accuracy and cite_accuracy of matched (expected_id, extracted_id, type_ok, cite_ok): one row a
    greedy match, an expected one without a match (extracted_id null) or an extracted one without (expected_id null)."""
    both = F.col("expected_id").isNotNull() & F.col("extracted_id").isNotNull()
    c = lambda x: F.count(F.when(x, 1))
    hit, got, want = c(both), F.count("extracted_id"), F.count("expected_id")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    out = matched.agg(zero(F.try_divide(hit, got)).alias("precision"), zero(F.try_divide(hit, want)).alias("recall"), zero(F.try_divide(c(both & F.col("type_ok")), hit)).alias("type_accuracy"), zero(F.try_divide(c(both & F.col("cite_ok")), hit)).alias("cite_accuracy"))
    return out.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))
