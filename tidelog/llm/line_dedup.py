"""Line dedup by content-defined chunks of lines.

A text's lines are hashed, and a rolling hash over each line's hash and the one before it says whether a chunk ends
there, so boundaries move with the lines and not with their numbers. A chunk of at least ``min_lines`` lines with a word
that occurs again anywhere in the corpus is kept at its first place, by (doc_id, null last, then the text's hash, then
position), and removed from the others.

Chunks are first matched by a 64-bit hash, so that texts aren't moved to find the few that repeat; those are then grouped
by their very text, which is the comparison of bytes. Groups are reduced to their first place before a shuffle, and the
join that tells the others has rows of one small table on one side, so AQE can split a hot chunk's rows. All of it is
DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, let, table

#: First digits of the rolling hash that end a chunk: 5 of 16, 3.2 lines a chunk on average.
ENDS = "01234"


def chunks(text: Column) -> Column:
    """array<struct<text, lines>> of a text: its chunks in order, lines counting those with a word; joined by line ends they
    are the text."""

    def ends(h: Column) -> Column:
        rolled = lambda i: F.md5(F.concat(F.when(i > 0, F.get(h, i - 1)).otherwise(F.lit("")), F.get(h, i)))
        return F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: (i == F.size(h) - 1) | F.contains(F.lit(ENDS), F.substr(rolled(i), F.lit(1), F.lit(1))))

    def cut_up(lines: Column) -> Column:
        def parts(e: Column) -> Column:
            begin = lambda k: F.when(k > 0, F.get(e, k - 1) + 1).otherwise(F.lit(0))
            return F.transform(e, lambda x, k: let(F.slice(lines, begin(k) + 1, x - begin(k) + 1), lambda own: F.struct(F.array_join(own, "\n").alias("text"), F.size(F.filter(own, lambda z: z.rlike(WORD))).alias("lines"))))

        return let(let(F.transform(lines, lambda z: F.md5(z.cast("binary"))), ends), parts)

    return let(F.split(F.coalesce(text, F.lit("")), "\n"), cut_up)


def repeated_chunks(docs: DataFrame, *, min_lines: int = 2) -> DataFrame:
    """(doc_id, _h, idx): the chunks of docs (doc_id, text) that are to go; _h is the text's hash, idx counts from 0."""
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"))
    seen = d.select("doc_id", "_h", F.posexplode(F.transform(chunks(F.col("text")), lambda c: F.when(c["lines"] >= min_lines, F.xxhash64(c["text"])))).alias("idx", "key")).where("key IS NOT NULL")
    again = seen.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    maybe = seen.join(again, "key").groupBy("doc_id", "_h").agg(F.collect_set("idx").alias("at"))
    both = d.join(maybe.hint("shuffle_hash").select(F.col("doc_id").alias("_d"), F.col("_h").alias("_g"), "at"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_g")))
    rows = both.select("doc_id", "_h", F.explode(let(chunks(F.col("text")), lambda c: F.transform("at", lambda i: F.struct(i.alias("idx"), F.get(c, i)["text"].alias("text"))))).alias("c")).select("doc_id", "_h", "c.idx", "c.text")
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "_h", "idx")
    first = rows.groupBy("text").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("text", "first")
    return rows.join(first, "text").where(place != F.col("first")).select("doc_id", "_h", "idx")


def dedup_lines(docs: DataFrame, *, min_lines: int = 2) -> DataFrame:
    """docs (doc_id, text, ...) with the repeated chunks taken out of text; n_lines and removed_lines (long) are added.

    Rows stay, also those whose text becomes empty. A null text stays null, with 0 lines. Rows equal in doc_id and text
    are one document that comes twice: they fare alike. An extra column named n_lines or removed_lines is replaced;
    names that begin with _tidelog_ are reserved. An empty table gives an empty one.
    """
    gone = repeated_chunks(docs, min_lines=min_lines).groupBy("doc_id", "_h").agg(F.collect_set("idx").alias("_tidelog_gone"))
    gone = gone.select(F.col("doc_id").alias("_tidelog_id"), F.col("_h").alias("_tidelog_hash"), "_tidelog_gone").hint("shuffle_hash")
    names = [c for c in docs.columns if c not in ("n_lines", "removed_lines")]
    both = docs.select(*names).join(gone, F.col("doc_id").eqNullSafe(F.col("_tidelog_id")) & (F.xxhash64("text") == F.col("_tidelog_hash")), "left")
    left = let(chunks(F.col("text")), lambda c: F.array_join(F.transform(F.filter(c, lambda x, i: ~F.array_contains("_tidelog_gone", i)), lambda x: x["text"]), "\n"))
    out = both.withColumn("_tidelog_text", F.when(F.col("_tidelog_gone").isNull(), F.col("text")).otherwise(left))
    count = lambda c: F.when(F.coalesce(F.length(c), F.lit(0)) == 0, 0).otherwise(F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1).cast("long")
    out = out.withColumn("n_lines", count(F.col("text"))).withColumn("removed_lines", F.col("n_lines") - count(F.col("_tidelog_text")))
    return out.select(*[F.col("_tidelog_text").alias("text") if c == "text" else F.col(c) for c in names], "n_lines", "removed_lines")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "removed_lines", "text")


OP4_SQL = r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, text FROM documents),
h AS (SELECT doc_id, ls, text, list_transform(ls, lambda x: md5(x)) AS hs FROM l),
e AS (SELECT doc_id, ls, text, list_filter(range(1, len(ls) + 1), lambda i: i = len(ls) OR contains('01234', substr(md5(coalesce(CASE WHEN i > 1 THEN hs[i - 1] END, '') || hs[i]), 1, 1))) AS es FROM h),
c AS (SELECT doc_id, unnest(range(1, len(es) + 1)) AS idx, ls, es FROM e),
p AS (SELECT doc_id, idx, list_slice(ls, CASE WHEN idx > 1 THEN es[idx - 1] + 1 ELSE 1 END, es[idx]) AS own FROM c),
t AS (SELECT doc_id, idx, array_to_string(own, chr(10)) AS part, len(list_filter(own, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS n, len(own) AS lines FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id, idx) AS k FROM t),
g AS (SELECT doc_id, string_agg(part, chr(10) ORDER BY idx) FILTER (NOT (n >= 2 AND k > 1)) AS part FROM r GROUP BY doc_id),
o AS (SELECT d.doc_id, d.text AS was, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(g.part, '') END AS text FROM documents d JOIN g USING (doc_id))
SELECT doc_id, CAST(CASE WHEN coalesce(was, '') = '' THEN 0 ELSE len(was) - len(replace(was, chr(10), '')) + 1 END AS BIGINT) AS n_lines,
CAST(CASE WHEN coalesce(was, '') = '' THEN 0 ELSE len(was) - len(replace(was, chr(10), '')) + 1 END - CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(text) - len(replace(text, chr(10), '')) + 1 END AS BIGINT) AS removed_lines, text FROM o
"""
