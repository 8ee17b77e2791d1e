"""From a request over topics and modes to one ranked result, as one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS
from ..functions.vector import ASCENDING, knn
from ..model import KEY
from ..operators import dsl, fusion, text_index

#: Each backend is asked for so many times k, and fusion keeps so many times k.
OVERFETCH, FUSED = 3, 2
DEFAULT_TIMEOUT_MS, LEAST_TIMEOUT_MS = 5000, 100


class PlanError(ValueError):
    """A request that no topic can answer."""


@dataclass
class Topic:
    """A topic's frame (the envelope's columns and more) and what it can do."""

    df: DataFrame
    text: str | None = None
    vector: str | None = None
    sql: bool = True

    def modes(self) -> set[str]:
        return {m for m, ok in (("text", self.text), ("vector", self.vector), ("sql", self.sql)) if ok}


@dataclass
class Request:
    """What is asked: words, a vector, a predicate in the query language; filters hold for every mode."""

    topics: list[str]
    modes: list[str] = field(default_factory=lambda: ["text"])
    words: str | None = None
    vector: list[float] | None = None
    metric: str = "cosine"
    predicate: dict[str, Any] | None = None
    k: int = 10
    profile: str = "default"
    timestamp_gte: Any = None
    timestamp_lte: Any = None
    partitions: list[int] | None = None
    grouped: bool = False
    timeout_ms: int = DEFAULT_TIMEOUT_MS


def filtered(df: DataFrame, r: Request) -> DataFrame:
    df = dsl.log_query(df, times=(r.timestamp_gte, r.timestamp_lte))
    return df if r.partitions is None else df.where(F.col("_partition").isin(r.partitions))


def nodes(topics: dict[str, Topic], r: Request) -> list[tuple[str, str]]:
    """(topic, mode) of what is run; modes a topic lacks are skipped, none left is an error."""
    asked = {"text": r.words, "vector": r.vector, "sql": r.predicate}
    out = [(t, m) for t in r.topics if t in topics for m in r.modes if m in topics[t].modes() and asked[m] is not None]
    if not out:
        raise PlanError("no topic can answer the request")
    return out


def _hits(topic: Topic, mode: str, r: Request) -> DataFrame:
    df = filtered(topic.df, r)
    n = r.k * OVERFETCH
    if mode == "vector":
        found = knn(df, r.vector, n, r.metric, vector=topic.vector, tie=KEY).withColumn("score", F.col("distance"))
        return fusion.ranked(found, mode, "score", KEY, ascending=ASCENDING[r.metric])
    if mode == "text":
        keyed = df.withColumn("_id", F.struct(*KEY))
        words = [w for w in dsl.analysed(r.words) if w not in STOP_WORDS]
        found = text_index.bm25(keyed, "_id", topic.text, words).select("_id.*", "score")
        return fusion.ranked(found, mode, "score", KEY, limit=n)
    found = df.where(dsl.compile_query(df, r.predicate)).withColumn("score", F.lit(1.0))
    return fusion.ranked(found, mode, "score", KEY, limit=n)


def run(topics: dict[str, Topic], r: Request, *, now: Column, reranker: Callable[[DataFrame], DataFrame] | None = None, profiles: dict | None = None) -> DataFrame:
    """The k best candidates with features, final_score, explanation and position; grouped: the k best of each topic.

    Every backend's list is part of one plan; a re-ranker, if any, has the last word.
    """
    lists = [_hits(topics[t], m, r) for t, m in nodes(topics, r)]
    both = fusion.merged(lists, KEY)
    stamps = [topics[t].df.select(*KEY, F.col("_timestamp").alias("timestamp")) for t in dict.fromkeys(t for t, _ in nodes(topics, r))]
    every = stamps[0]
    for s in stamps[1:]:
        every = every.unionByName(s)
    both = every.join(F.broadcast(both), KEY)  # at most OVERFETCH * k candidates a backend
    scored = fusion.rank(fusion.features(both, now=now), r.profile, profiles=profiles)
    scored = scored.orderBy(F.desc("rrf_score"), *KEY).limit(r.k * FUSED * (len(r.topics) if r.grouped else 1))
    if reranker:
        scored = reranker(scored).withColumn("final_score", F.col("rerank_score"))
    by = ["_topic"] if r.grouped else None
    from pyspark.sql import Window

    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("final_score"), *KEY)
    return scored.withColumn("position", F.row_number().over(w)).where(F.col("position") <= r.k)


def collect(df: DataFrame, timeout_ms: int = DEFAULT_TIMEOUT_MS) -> list:
    """Rows of a result, or TimeoutError after timeout_ms (at least LEAST_TIMEOUT_MS): its jobs are cancelled."""
    import threading
    import uuid

    sc = df.sparkSession.sparkContext
    tag = f"request-{uuid.uuid4().hex}"
    fired = threading.Event()

    def stop() -> None:
        fired.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(max(timeout_ms, LEAST_TIMEOUT_MS) / 1000, stop)
    sc.addJobTag(tag)
    timer.start()
    try:
        return df.collect()
    except Exception as e:
        if fired.is_set():
            raise TimeoutError(f"no answer in {timeout_ms} ms") from e
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)
