"""Quality rules: heuristics, then an n-gram log-likelihood ratio of trusted against raw text.

Every word and every pair of neighbouring words of a text falls into one of
``buckets`` hash buckets. Two multinomials over the buckets are estimated with
add-one smoothing: *target* from trusted documents, *raw* from every document.
A document's score is the mean over its n-grams of log(target/raw), and a
document is kept when the score reaches a threshold taken from the trusted
documents' own scores. Log ratios are rounded to 1e-6 and summed as integers, so
no result depends on the order of a sum.

Everything runs as DataFrame expressions. Only the two count vectors (``buckets``
numbers each) reach the driver, whatever the size of the input.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, cut, drop_cut, let, settings, table, words

#: The join that finds trusted texts is by shuffle whatever the size of the tables, and texts go into the shuffle only if a Bloom filter has their id.
TRUSTED_TEXTS = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": str(1 << 40)}
#: Log ratios are integers in this unit.
UNIT = 1_000_000


def _repeat_words(hashes: Column) -> Column:
    """How many words lie in a 5-word window that occurs at least twice; hashes: of the words."""

    def covered(p: Column) -> Column:
        """Length of the union of [x, x + 4] over the ascending positions p."""
        gaps = F.transform(p, lambda x, i: F.when(i + 1 < F.size(p), F.least(F.lit(5), F.get(p, i + 1) - x)).otherwise(F.lit(5)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(s: Column) -> Column:
        """Positions whose window is equal to a neighbour in the sorted array s of (window, position)."""
        same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
        hits = F.filter(s, lambda x, i: ((i > 0) & same(F.get(s, i - 1), x)) | same(F.get(s, i + 1), x))
        return F.sort_array(F.transform(hits, lambda x: x["i"]))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(let(pairs, repeated), covered))

    return let(hashes, lambda w: F.when(F.size(w) < 6, F.lit(0).cast("long")).otherwise(let(windows(w), count)))


def _grams(hashes: Column, buckets: int) -> Column:
    """Bucket of each word and of each pair of neighbouring words."""
    b = F.lit(buckets)
    one = lambda w: F.transform(w, lambda x: F.pmod(x, b).cast("int"))
    two = lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda x, y: F.pmod(F.xxhash64(x, y), b).cast("int"))
    return let(hashes, lambda w: F.when(F.size(w) < 2, one(w)).otherwise(F.concat(one(w), two(w))))


def _word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def fit(docs: DataFrame, trusted: DataFrame, *, buckets: int = 16384, keep_z: float = 3.0) -> tuple[Column, int]:
    """(weights, threshold) of the log-likelihood ratio.

    trusted: doc_id of trusted documents, all of which are used. The raw model counts all documents. The threshold is the trusted scores'
    mean less ``keep_z`` standard deviations. Without any words or trusted documents the weights are 0 and
    the threshold is 0: every document passes.
    """
    ids = trusted.select("doc_id").where("doc_id IS NOT NULL")
    with settings(docs.sparkSession, TRUSTED_TEXTS):
        own = cut(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").select("text"), "rules-trusted")

    def counts(d: DataFrame) -> list[int]:
        n = [0] * buckets
        for r in d.select(F.explode(_grams(_word_hashes(F.col("text")), buckets)).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect():  # at most one row a bucket
            n[r["b"]] = r["n"]
        return n

    raw, target = counts(docs), counts(own)
    n_raw, n_target = sum(raw) + buckets, sum(target) + buckets
    units = [round(UNIT * (math.log((t + 1) / n_target) - math.log((r + 1) / n_raw))) if n_target > buckets else 0 for t, r in zip(target, raw, strict=True)]
    weights = F.split(F.lit(",".join(map(str, units))), ",").cast("array<int>")
    scores = own.select(_mean_units(_grams(_word_hashes(F.col("text")), buckets), weights).alias("s")).where("s IS NOT NULL")
    x = scores.agg(F.count("s").alias("n"), F.sum("s").alias("a"), F.sum(F.col("s").cast("decimal(38,0)") * F.col("s")).alias("q")).first()
    drop_cut(own)
    if not x["n"]:
        return weights, 0
    mean = x["a"] / x["n"]
    return weights, math.floor(mean - keep_z * math.sqrt(max(0.0, float(x["q"]) / x["n"] - mean * mean)))


def _mean_units(grams: Column, weights: Column) -> Column:
    """Mean weight of the n-grams, in whole units; null without any."""
    total = lambda g: F.aggregate(g, F.lit(0).cast("long"), lambda a, b: a + F.get(weights, b))
    return let(grams, lambda g: F.when(F.size(g) > 0, F.floor(total(g) / F.size(g)).cast("long")))


def quality_rules(docs: DataFrame, trusted: DataFrame, *, buckets: int = 16384, keep_z: float = 3.0, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """docs (doc_id, text, ...) with the rules' figures and the verdict added; other columns are left alone.

    Added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, score (double, mean
    log ratio of an n-gram, null without words), kept. A null or blank text has no words, fails the base rules and
    isn't kept. Columns of docs that bear an added name are replaced; names that begin with _tidelog_ are reserved. Equal rows get equal verdicts, each its own
    row; an empty table gives an empty one.
    """
    weights, threshold = fit(docs, trusted, buckets=buckets, keep_z=keep_z)
    text = F.coalesce(F.col("text"), F.lit(""))
    rest = [c for c in docs.columns if c not in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")]

    def figures(w: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            let(hashes, lambda h: F.struct(_repeat_words(h).alias("r"), _mean_units(_grams(h, buckets), weights).alias("s"))).alias("h"),
        )

    out = docs.select(*rest, let(words(F.col("text")), figures).alias("_tidelog_f"))
    out = out.select(*rest, *[F.col(f"_tidelog_f.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")], F.col("_tidelog_f.h.r").alias("n_repeat_words"), F.col("_tidelog_f.h.s").alias("_tidelog_s"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return out.select(*rest, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (F.col("_tidelog_s") / UNIT).alias("score"), (~failed & F.coalesce(F.col("_tidelog_s") >= threshold, F.lit(False))).alias("kept"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").where("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id")
    return quality_rules(docs, trusted).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 6).alias("score"))
