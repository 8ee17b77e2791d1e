"""Mixing sources to target weights, as shards of fixed-length blocks.

Each source is one stream of words, its documents in the order of a hash of doc_id, cut into blocks of
``block_words`` words (the last may be shorter). The mix has as many slots as the sources' quotas say; slots lie in
output shards of ``shard_slots``. Every shard draws a multinomial count for each source, one draw a slot, with the quotas
as weights. Draws of all shards miss a source's quota by about its root, so the last draws beyond a quota go to the sources
that lack some: each source gets exactly its quota, and no draw can take a document more often than the cap allows. The
shards' counts number a source's slots, and a slot's number goes through the source's own permutation of block numbers,
pass by pass; blocks are joined by that number.

Permutations are swap-or-not shuffles (Hoang, Morris, Rogaway 2012): additions and hashes of 64-bit integers only,
so any slot finds its block alone, with no sort, no state and no collected table. All of it is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANK_CHARS, cut, drop_cut, let, partitions, release, table, words

SEED = 20_240_607
ROUNDS = 12
#: Documents of one source that are put in order by one task, about.
BUCKET_DOCS = 512
#: Slots that one task draws, about.
TASK_SLOTS = 100_000
#: Rows that one task may put in order.
TASK_ROWS = 10_000


def running(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """df with, for each column c of sums, the sum of c over the rows before in order, named sums[c]; order tells all rows apart.

    More than TASK_ROWS rows are dealt to ranges of the order, which are summed first, so no task holds all rows; there are no more ranges
    than the rows need, as the driver keeps something of every task. Sums are exact if the columns are.
    """
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = df.count()
    if n <= TASK_ROWS:
        return df.withColumns({name: before(c, Window.orderBy(*order)) for c, name in sums.items()})
    ranges = min(partitions(df.sparkSession), -(-n // TASK_ROWS))
    d = cut(df.repartitionByRange(ranges, *order).withColumn("_p", F.spark_partition_id()), "mix-ranges")
    per = d.groupBy("_p").agg(*[F.sum(c).alias(c) for c in sums])
    per = per.select("_p", *[before(c, Window.orderBy("_p")).alias(f"_all_{c}") for c in sums])  # as many rows as ranges
    inside = Window.partitionBy("_p").orderBy(*order)
    d = d.withColumns({f"_own_{c}": before(c, inside) for c in sums}).join(per, "_p")
    return d.select(*df.columns, *[(F.col(f"_all_{c}") + F.col(f"_own_{c}")).alias(name) for c, name in sums.items()])


def targets(sources: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, sid, source_size, target) from (source, source_size); sid numbers the sources in order.

    Sources in code-point order, null last, weigh ``weights``, repeating, and share ``share`` times the sum of sizes;
    a target stops at ``cap`` times its source's size and the excess is shared anew by weight until none is above.
    That is target = min(cap * size, level * weight) for the one level at which the targets add up: going up by
    cap * size / weight, sources are full until the level of the rest falls below their ratio. One row a source.
    """
    cycle = F.array(*[F.lit(str(w)).cast("decimal(18,6)") for w in weights])
    t = running(sources.select("source", "source_size", F.lit(1).cast("long").alias("_one")), [F.col("source").asc_nulls_last()], {"_one": "sid"})
    t = t.withColumn("_w", F.get(cycle, F.pmod("sid", F.lit(len(weights))).cast("int")))
    t = running(t, [F.col("source_size") / F.col("_w").cast("double"), F.col("sid")], {"source_size": "_full", "_w": "_gone"})
    every = t.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("_w"), F.lit(0)).alias("w")).first()
    total = min(share, cap) * every["size"]
    t = t.withColumn("_weight", F.col("_w").cast("double")).withColumn("_cap", cap * F.col("source_size"))
    level = (F.lit(total) - cap * F.col("_full")) / (F.lit(every["w"]) - F.col("_gone")).cast("double")
    common = t.where(level * F.col("_weight") <= F.col("_cap")).agg(F.max(level)).first()[0]
    target = F.col("_cap") if common is None else F.least(F.col("_cap"), F.lit(common) * F.col("_weight"))
    return t.select("source", "sid", "source_size", target.cast("double").alias("target"))


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """The image of x, a number from 0 to n - 1, under the permutation of n numbers that key names."""

    def round_(a: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), r, *key), n) - a, n)
        swap = lambda p: F.xxhash64(F.lit(SEED + 1), r, F.greatest(a, p), *key).bitwiseAND(F.lit(1)) == 1
        return let(partner, lambda p: F.when(swap(p), p).otherwise(a))

    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), x.cast("long"), round_)


def place(docs: DataFrame) -> DataFrame:
    """(_id, sid, doc_id, size, start): where a document's words lie in its source's stream; documents without words left out.

    docs: _id, sid, doc_id, size. Prefix sums in two levels, so that a source with a third of all rows is still many tasks'
    work: documents fall into hash buckets of each source, the buckets' sums come first.
    """
    n = docs.count()
    buckets = max(1, n // BUCKET_DOCS)
    h = F.xxhash64(F.lit(SEED), "doc_id", "size")
    d = docs.where("size > 0").withColumn("_h", h).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    sums = cut(d.groupBy("sid", "_b").agg(F.sum("size").alias("_s")), "mix-sums")
    first = running(sums, [F.col("sid"), F.col("_b")], {"_s": "_first"})
    base = first.groupBy("sid").agg(F.min("_first").alias("_base"))
    inside = Window.partitionBy("sid", "_b").orderBy("_h", "_id").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = d.join(first.join(base, "sid").select("sid", "_b", (F.col("_first") - F.col("_base")).alias("_first")), ["sid", "_b"])
    return d.select("_id", "sid", "doc_id", "size", (F.col("_first") + F.col("_at")).alias("start"))


def shard_counts(quotas: DataFrame, shard_slots: int, seed: int = SEED) -> DataFrame:
    """(shard, sid, first, n): how many slots each shard has of each source, and the number of the first in its source.

    quotas: sid, quota. A shard's counts are multinomial draws; where the draws of all shards give a source more than its
    quota, the last of them go to sources that got less, in order.
    """
    spark = quotas.sparkSession
    q = running(quotas.where("quota > 0").select("sid", "quota"), [F.col("sid")], {"quota": "_lo"})
    total = int(q.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0])
    cells = 4096
    width = total // cells + 1
    lists = q.select("sid", "quota", "_lo", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor((F.col("_lo") + F.col("quota") - 1) / width))).alias("_cell"))
    slots = spark.range(0, total, 1, max(partitions(spark), total // TASK_SLOTS))
    drawn = slots.select(F.floor(F.col("id") / shard_slots).alias("shard"), F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "id"), F.lit(max(total, 1))).alias("_x"))
    drawn = drawn.withColumn("_cell", F.floor(F.col("_x") / width)).join(lists, "_cell").where("_x >= _lo AND _x < _lo + quota")
    counts = cut(drawn.groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("n")), "mix-draws")
    release(spark)
    c = running(counts, [F.col("sid"), F.col("shard")], {"n": "_before"})
    got = c.groupBy("sid").agg(F.sum("n").alias("drawn"), F.min("_before").alias("_base"))
    c = c.join(got.join(quotas.select("sid", "quota"), "sid"), "sid")
    c = c.withColumn("first", F.col("_before") - F.col("_base")).withColumn("keep", F.greatest(F.lit(0), F.least(F.col("n"), F.col("quota") - F.col("first"))))
    c = cut(c.select("shard", "sid", "first", "n", "keep"), "mix-counts")
    # the draws that are too many, one by one, and what others lack, one by one: both about the root of all slots
    over = running(c.where("keep < n").select("shard", "sid", (F.col("n") - F.col("keep")).alias("m")), [F.col("sid"), F.col("shard")], {"m": "_at"})
    over = over.select("shard", F.explode(F.sequence(F.col("_at"), F.col("_at") + F.col("m") - 1)).alias("k"))
    got = c.groupBy("sid").agg(F.sum("n").alias("drawn"))
    lack = quotas.where("quota > 0").join(got, "sid", "left").select("sid", F.coalesce("drawn", F.lit(0)).alias("drawn"), "quota").where("quota > drawn")
    lack = running(lack.withColumn("m", F.col("quota") - F.col("drawn")), [F.col("sid")], {"m": "_at"})
    lack = lack.select("sid", "drawn", F.posexplode(F.sequence(F.col("_at"), F.col("_at") + F.col("m") - 1)).alias("i", "k"))
    moved = over.join(lack, "k").select("shard", "sid", (F.col("drawn") + F.col("i")).alias("first"), F.lit(1).cast("long").alias("n"))
    return c.where("keep > 0").select("shard", "sid", "first", F.col("keep").alias("n")).unionByName(moved)


def draw(sources: DataFrame, shard_slots: int, seed: int = SEED) -> DataFrame:
    """(shard, sid, block, pass) for sources (sid, blocks, quota): the plan of the mix, one row a slot."""
    counts = cut(shard_counts(sources.select("sid", "quota"), shard_slots, seed), "mix-plan")
    release(counts.sparkSession)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counts = counts.join(sources.select("sid", "source", "blocks"), "sid").repartition(max(partitions(counts.sparkSession), total // TASK_SLOTS), "shard", "sid")
    j = counts.select("shard", "sid", "source", "blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("_j"))
    j = j.withColumn("pass", F.floor(F.col("_j") / F.col("blocks"))).withColumn("block", F.pmod("_j", F.col("blocks")))
    return j.select("shard", "sid", permuted(F.col("block"), F.col("blocks"), F.lit(seed), F.coalesce("source", F.lit("")), F.col("source").isNull(), F.col("pass")).alias("block"), "pass")


def mix(docs: DataFrame, *, block_words: int = 64, shard_slots: int = 4096, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sizes, sources, blocks, slots) of a mix of docs (doc_id, text, source, ...).

    sizes: _id, doc_id, source, sid, size (words; 0 for null or blank text), one row a document row. sources: source, sid,
    source_size, target, blocks, quota. blocks: sid, block, _id, doc_id, size, first (word in the document), n (words).
    slots: shard, sid, block, pass.
    A block appears in ``quota / blocks`` slots, rounded up or down, never above ``cap`` up. A null source is a source. Rows
    that repeat a doc_id are documents of their own. Sources without words get a target and quota of 0; an empty table
    gives four empty ones. Columns other than doc_id, text and source aren't read.
    """
    own = [c for c in docs.columns if c == "_tidelog_id"]  # goes along
    sized = docs.select(F.monotonically_increasing_id().alias("_id"), *own, "doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))
    sizes = cut(sized, "mix-sizes")
    release(docs.sparkSession)
    sources = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights=weights, share=share, cap=cap)
    n_blocks = F.ceil(F.col("source_size") / block_words)
    sources = sources.withColumn("blocks", n_blocks).withColumn("quota", F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")), F.floor(cap * F.col("blocks")))).otherwise(0).cast("long"))
    sources = cut(sources, "mix-sources")
    sizes = sizes.alias("d").join(sources.select(F.col("source").alias("_s"), "sid"), F.col("d.source").eqNullSafe(F.col("_s"))).drop("_s")
    at = place(sizes)
    b = F.col("block")
    blocks = at.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))))
    begin, end = F.greatest("start", b * block_words), F.least(F.col("start") + F.col("size"), (b + 1) * block_words)
    blocks = blocks.select("sid", "block", "_id", "doc_id", "size", (begin - F.col("start")).alias("first"), (end - begin).alias("n"))
    return sizes, sources, blocks, draw(sources, shard_slots, seed)


def taken_words(sizes: DataFrame, blocks: DataFrame, slots: DataFrame) -> DataFrame:
    """sizes with taken: the words of each document that the slots' blocks hold, repeats counted."""
    times = slots.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("_times"))
    per = blocks.join(times, ["sid", "block"]).groupBy("_id").agg(F.sum(F.col("n") * F.col("_times")).alias("taken"))
    return sizes.join(per, "_id", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, sources, blocks, slots = mix(table(spark, sf_dir, "documents"))
    got = taken_words(sizes, blocks, slots)
    return got.join(sources.select("sid", "source_size", "target"), "sid").select("doc_id", "size", "source_size", "target", "taken")


def mixed_runs(blocks: DataFrame, slots: DataFrame) -> DataFrame:
    """(_id, runs): of each document in the mix, the words that its blocks in slots hold: array<struct<first, end>>, where a pass takes
    neighbouring blocks as one run."""
    hits = blocks.join(slots.select("sid", "block", "pass"), ["sid", "block"])
    per = hits.groupBy("_id", "pass").agg(F.sort_array(F.collect_list(F.struct("first", (F.col("first") + F.col("n")).alias("end")))).alias("s"))

    def runs(s: Column) -> Column:
        begins = F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["end"] < x["first"]))
        ends = F.filter(s, lambda x, i: (i == F.size(s) - 1) | (F.get(s, i + 1)["first"] > x["end"]))
        return F.zip_with(begins, ends, lambda x, y: F.struct(x["first"].alias("first"), y["end"].alias("end")))

    return per.select("_id", let(F.col("s"), runs).alias("r")).groupBy("_id").agg(F.flatten(F.collect_list("r")).alias("runs"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: docs's rows as often as the slots take them, with the part of the text that the blocks hold.

    A pass over a source that takes all of its blocks gives whole documents, unchanged. One that takes some gives the runs of
    neighbouring blocks in a document as rows of its doc_id, white space between the words as it was, n_chars, if there, following
    text. Documents without words stay as they are. Extra columns are kept; names that begin with _tidelog_ are reserved.
    """
    kept = cut(docs.withColumn("_tidelog_id", F.monotonically_increasing_id()), "mix-docs")
    sizes, _, blocks, slots = mix(kept, **options)
    runs = mixed_runs(blocks, slots).select(F.col("_id").alias("_tidelog_key"), F.col("runs").alias("_tidelog_runs"))
    runs = sizes.select(F.col("_id").alias("_tidelog_key"), "_tidelog_id", F.col("size").alias("_tidelog_size")).join(runs, "_tidelog_key", "left").drop("_tidelog_key")
    size = F.col("_tidelog_size")
    whole = lambda r: (r["first"] == 0) & (r["end"] == size)
    spaced = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    part = lambda w, r: F.rtrim(F.array_join(F.slice(w, (r["first"] + 1).cast("int"), (r["end"] - r["first"]).cast("int")), ""), F.lit(BLANK_CHARS))
    cut_up = lambda w: F.transform("_tidelog_runs", lambda r: F.when(whole(r), F.col("text")).otherwise(part(w, r)))
    some = F.exists("_tidelog_runs", lambda r: ~whole(r))
    texts = F.when(size == 0, F.array(F.col("text"))).when(some, let(spaced, cut_up)).otherwise(F.transform("_tidelog_runs", lambda r: F.col("text")))
    out = kept.join(runs.where("_tidelog_size = 0 OR _tidelog_runs IS NOT NULL"), "_tidelog_id").withColumn("_tidelog_text", F.explode(texts))
    same = F.col("text").eqNullSafe(F.col("_tidelog_text"))
    own = {"text": F.col("_tidelog_text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(same, F.col("n_chars")).otherwise(F.length("_tidelog_text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[own.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


__all__ = ["draw", "drop_cut", "mix", "mix_documents", "mixed_runs", "op5_mix_sources", "permuted", "place", "running", "shard_counts", "taken_words", "targets"]
