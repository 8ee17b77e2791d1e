"""Fusion of ranked results and ranking by profiles."""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 60
#: Weights of the memory channels.
CHANNEL_WEIGHTS = {"bm25": 1.0, "vector": 1.0, "key_match": 2.0, "hyde": 0.5, "sql": 1.5}
#: Weights and boosts of the built-in profiles.
PROFILES = {
    "default": {
        "weights": {"rrf_score": 100.0, "freshness": 5.0, "source_count": 10.0, "text_rank": 3.0, "vector_rank": 3.0, "sql_rank": 3.0, "text_score": 1.0, "vector_score": 1.0},
        "boosts": [{"feature": "source_count", "op": "gt", "threshold": 1.0, "multiplier": 1.2}],
    },
    "freshness": {"weights": {"rrf_score": 50.0, "freshness": 50.0, "source_count": 5.0, "text_rank": 2.0, "vector_rank": 2.0, "sql_rank": 2.0}, "boosts": []},
    "relevance": {
        "weights": {"rrf_score": 100.0, "freshness": 1.0, "source_count": 15.0, "text_rank": 10.0, "vector_rank": 10.0, "text_score": 5.0, "vector_score": 5.0},
        "boosts": [{"feature": "source_count", "op": "gt", "threshold": 1.0, "multiplier": 1.5}],
    },
}
MODES = ("text", "vector", "sql")


def load_profiles(folder: str) -> dict[str, dict]:
    """The built-in profiles and those of a folder's JSON files, by file name."""
    return PROFILES | {p.stem: {"boosts": []} | json.loads(p.read_text()) for p in sorted(Path(folder).glob("*.json"))}


def ranked(hits: DataFrame, mode: str, score: str, keys: list[str], *, ascending: bool = False, limit: int | None = None, base: int = 0, by: list[str] | None = None) -> DataFrame:
    """(keys, mode, rank, score): position of each hit in its list, from ``base``, ties by keys; a list for each of ``by``."""
    order = [F.asc(score) if ascending else F.desc(score), *keys]
    cols = [*keys, F.col(score).cast("double").alias("score")]
    top = hits.select(*dict.fromkeys([*(by or []), *keys]), F.col(score).cast("double").alias("score")) if by else hits.select(*cols)
    order = [F.asc("score") if ascending else F.desc("score"), *keys]
    if limit is not None and not by:
        top = top.orderBy(*order).limit(limit)  # a bounded top-k before the one ordered list
    if limit is None and not by:
        return _whole_ranks(top, order, ascending, base).withColumn("mode", F.lit(mode))
    w = Window.partitionBy(*(by or [F.lit(mode)])).orderBy(*order)
    top = top.withColumn("rank", F.row_number().over(w) - 1 + base)
    if limit is not None:
        top = top.where(F.col("rank") < limit + base)
    return top.withColumn("mode", F.lit(mode))


def _whole_ranks(hits: DataFrame, order: list, ascending: bool, base: int) -> DataFrame:
    """hits with rank over all of them: ranges of the score, between approximate quantiles, are ranked each by a task, after the
    rows of the ranges before."""
    ranges = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted({b for b in hits.approxQuantile("score", [i / ranges for i in range(1, ranges)], 0.01) if b == b and abs(b) != math.inf})
    up = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: F.col("score") > b)) if bounds else F.lit(0)
    at = F.when(F.col("score").isNull(), F.lit(-1 if ascending else len(bounds) + 1)).otherwise(up if ascending else F.lit(len(bounds)) - up)
    rows = hits.withColumn("_range", at)
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1 + base
    ranks = rows.withColumn("_place", place).join(sizes.select("_range", before.alias("_before")), "_range")
    return ranks.withColumn("rank", (F.col("_before") + F.col("_place")).cast("int")).drop("_range", "_place", "_before")


def merged(lists: list[DataFrame], keys: list[str]) -> DataFrame:
    """One row a candidate of ranked lists: rank and score of each mode that has it, null elsewhere, and source_count."""
    rows = lists[0]
    for x in lists[1:]:
        rows = rows.unionByName(x)
    at = lambda m, c: F.min(F.when(F.col("mode") == m, F.col(c)))
    return rows.groupBy(*keys).agg(*[at(m, c).alias(f"{m}_{n}") for m in MODES for c, n in (("rank", "pos"), ("score", "raw"))], F.countDistinct("mode").alias("source_count"))


def rrf(lists: list[DataFrame], keys: list[str], *, k: int = K, weights: dict[str, float] | None = None) -> DataFrame:
    """(keys, score): sum of weight / (k + rank) over the lists (keys, mode, rank)."""
    rows = lists[0]
    for x in lists[1:]:
        rows = rows.unionByName(x)
    w = F.lit(1.0)
    if weights:
        w = F.lit(0.0)
        for m, v in weights.items():
            w = F.when(F.col("mode") == m, F.lit(float(v))).otherwise(w)
    return rows.groupBy(*keys).agg(F.sum(w / (k + F.col("rank"))).alias("score"))


def score_fusion(both: DataFrame, vector: str, text: str, method: str, *, vector_weight: float = 0.5, text_weight: float = 0.5, boost: float = 1.5) -> DataFrame:
    """both with score: ``rank_fusion`` (weighted sum), ``vector_rerank`` (the vector's, else the text's), ``vector_boost`` (the
    text's, times boost where the vector search has it, too)."""
    v, t = F.col(vector), F.col(text)
    score = {
        "rank_fusion": F.coalesce(v, F.lit(0.0)) * vector_weight + F.coalesce(t, F.lit(0.0)) * text_weight,
        "vector_rerank": F.coalesce(v, t),
        "vector_boost": F.when(t.isNotNull() & v.isNotNull(), t * boost).otherwise(F.coalesce(t, v)),
    }[method]
    return both.withColumn("score", score)


def features(candidates: DataFrame, *, now: Column, timestamp: str | None = "timestamp", k: int = K) -> DataFrame:
    """candidates (from merged) with the features that profiles weigh; absent ones are null."""
    finite = lambda c: F.when(F.isnan(c) | (F.abs(c) == math.inf), F.lit(0.0)).otherwise(c)
    out = candidates.withColumn("rrf_score", sum((F.coalesce(1.0 / (k + F.col(f"{m}_pos")), F.lit(0.0)) for m in MODES), F.lit(0.0)))
    for m in MODES:
        out = out.withColumn(f"{m}_rank", 1.0 / (1.0 + F.col(f"{m}_pos")))
    for m in ("text", "vector"):
        out = out.withColumn(f"{m}_score", finite(F.col(f"{m}_raw")))
    if timestamp:
        hours = (F.unix_millis(now) - F.unix_millis(timestamp)) / 3_600_000.0
        out = out.withColumn("freshness", 1.0 / (1.0 + F.greatest(hours, F.lit(0.0))))
    return out


def rank(candidates: DataFrame, profile: str = "default", *, profiles: dict[str, dict] | None = None) -> DataFrame:
    """candidates (from features) with final_score and an explanation; an unknown profile is the default one."""
    known = profiles or PROFILES
    p = known.get(profile, known["default"])
    used = [f for f in p["weights"] if f in candidates.columns]
    value = lambda f: F.col(f).cast("double")
    score = sum((F.coalesce(value(f) * p["weights"][f], F.lit(0.0)) for f in used), F.lit(0.0))
    for b in p.get("boosts", []):
        if b["feature"] in candidates.columns:
            score = score * F.when(boost_holds(value(b["feature"]), b["op"], b["threshold"]), F.lit(b["multiplier"])).otherwise(F.lit(1.0))
    score = F.when(F.isnan(score) | (F.abs(score) == math.inf), F.lit(0.0)).otherwise(score)
    parts = F.concat_ws(", ", *[F.when(F.col(f).isNotNull(), F.format_string(f"{f}=%.4f*%.2f", value(f), F.lit(p["weights"][f]))) for f in used])
    return candidates.withColumn("final_score", score).withColumn("explanation", F.concat(F.format_string("score=%.6f [", F.col("final_score")), parts, F.lit("]")))


def boost_holds(value: Column, op: str, threshold: float) -> Column:
    test = {"gt": value > threshold, "gte": value >= threshold, "lt": value < threshold, "lte": value <= threshold, "eq": F.abs(value - threshold) < 2.220446049250313e-16}[op]
    return F.coalesce(test, F.lit(False))


def hot_wins(hot: DataFrame, cold: DataFrame, keys: list[str]) -> DataFrame:
    """Hot hits and the cold ones with other keys."""
    return hot.unionByName(cold.join(hot.select(*keys), keys, "left_anti"))


def best_of(hits: DataFrame, keys: list[str], score: str, *, ascending: bool = False, limit: int | None = None) -> DataFrame:
    """One row a key, the one of the best score, best first."""
    best = (F.min_by if ascending else F.max_by)(F.struct(*[c for c in hits.columns if c not in keys]), score)
    out = hits.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*").orderBy(F.asc(score) if ascending else F.desc(score), *keys)
    return out if limit is None else out.limit(limit)


def with_envelopes(ids: DataFrame, envelopes: DataFrame, keys: list[str]) -> DataFrame:
    """Hits that are ids only, with their records; those without one go."""
    return ids.join(envelopes, keys)
