"""Full-text search: a persisted index of postings, exact BM25, phrases, and the same by a scan of the texts.

An index is three Parquet tables below one folder. ``postings`` (term, id, tf, positions, dl) lies in folders by a hash bucket of
the term and is sorted by term within a file, so that a search reads the folders of its terms and, there, the row groups that
may hold them. ``terms`` (term, df) lies in the same buckets; ``parts`` (docs, tokens) has a row for each batch added, of which the corpus' figures
are the sums. A document's length comes with each posting, so that no second table is joined. Batches are appended; the index sink
of a stream adds one for each epoch, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, raw_tokens, stem, stem_word

BUCKETS = 64


def analysed_terms(words: list[str]) -> list[str]:
    """Stems of the words that are no stop words, each once."""
    return list(dict.fromkeys(stem_word(w.lower()) for w in words if w.lower() not in STOP_WORDS))


def postings(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, term, tf, positions, dl) of analysed texts; dl is the number of a text's terms. Each distinct word is stemmed once."""
    kept = F.filter(raw_tokens(F.col(text)), lambda t: ~t.isin(*STOP_WORDS))
    rows = docs.select(F.col(id_col), F.posexplode(kept).alias("pos", "word")).groupBy(id_col, "word").agg(F.collect_list("pos").alias("p"))
    words = rows.select("word").distinct().select("word", stem(F.col("word")).alias("term"))
    per = rows.join(words, "word").groupBy(id_col, "term").agg(F.sort_array(F.flatten(F.collect_list("p"))).alias("positions"))
    dl = docs.select(id_col, F.size(kept).alias("dl"))
    return per.join(dl, id_col).select(id_col, "term", F.size("positions").alias("tf"), "positions", "dl")


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


class TextIndex:
    """The index in a folder: add(), then bm25(), match() and phrase(). id_col is one column; ids aren't checked for repeats."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "id", *, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.id_col, self.buckets = spark, path.rstrip("/"), id_col, buckets

    def exists(self) -> bool:
        """Whether a batch is there as a whole: its row in parts is written last."""
        batches = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/parts/epoch=*")
        return bool(batches.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(batches))

    def add(self, docs: DataFrame, text: str, *, epoch: int = 0) -> TextIndex:
        """Index the documents of docs (id_col, text) as one batch; a batch of the same epoch is replaced."""
        write = lambda df, name, *by: df.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch", *by).parquet(f"{self.path}/{name}")
        rows = postings(docs, self.id_col, text).withColumn("bucket", _bucket(F.col("term"), self.buckets))
        # a common term's postings go to several files
        write(rows.repartition("bucket", F.pmod(F.xxhash64(self.id_col), F.lit(4))).sortWithinPartitions("bucket", "term"), "postings", "bucket")
        own = self._table("postings").where(F.col("epoch") == epoch)
        write(own.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df")).repartition("bucket").sortWithinPartitions("bucket", "term"), "terms", "bucket")
        kept = F.filter(raw_tokens(F.col(text)), lambda t: ~t.isin(*STOP_WORDS))
        write(docs.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.size(kept)), F.lit(0)).alias("tokens")), "parts")
        return self

    def sink(self, text: str):
        """A sink for sinks.fan_out: each epoch is one batch, replaced if it comes again."""
        return lambda batch, epoch: self.add(batch, text, epoch=epoch) and None

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _of(self, name: str, terms: list[str]) -> DataFrame:
        """Rows of the terms: the bucket prunes folders, the term row groups."""
        if not terms:
            return self._table(name).where("false")
        buckets = [r[0] for r in self.spark.range(1).select(F.explode(F.array(*[_bucket(F.lit(t), self.buckets) for t in terms]))).collect()]
        return self._table(name).where(F.col("bucket").isin(sorted(set(buckets))) & F.col("term").isin(terms))

    def statistics(self) -> DataFrame:
        """(docs, tokens, terms): one row."""
        return self._table("parts").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).crossJoin(F.broadcast(self._table("terms").agg(F.countDistinct("term").alias("terms"))))  # two single rows

    def bm25(self, words: list[str], *, k1: float = 1.2, b: float = 0.75, boost: float = 1.0) -> DataFrame:
        """(id, score) of the documents with any of the words' terms."""
        terms = analysed_terms(words)
        figures = self._table("parts").agg(F.sum("docs").alias("n"), (F.sum("tokens") / F.sum("docs")).alias("avgdl")).first()
        n, avgdl = (figures["n"] or 0), (figures["avgdl"] or 1.0)
        df = {r["term"]: r["df"] for r in self._of("terms", terms).groupBy("term").agg(F.sum("df").alias("df")).collect()}  # a row a term of the query
        idf = F.lit(0.0)
        for t, d in df.items():
            idf = F.when(F.col("term") == t, F.log(F.lit(1 + (n - d + 0.5) / (d + 0.5)))).otherwise(idf)
        tf = F.col("tf")
        score = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.lit(float(avgdl))))
        return self._of("postings", terms).groupBy(self.id_col).agg((F.sum(score) * boost).alias("score"))

    def match(self, words: list[str], *, every: bool = False) -> DataFrame:
        """Ids of documents with any, or every, of the words' terms."""
        terms = analysed_terms(words)
        hits = self._of("postings", terms).groupBy(self.id_col).agg(F.count_distinct("term").alias("_n"))
        return hits.where(F.col("_n") >= (len(terms) if every else 1)).select(self.id_col)

    def phrase(self, words: list[str]) -> DataFrame:
        """Ids of documents with the analysed words one after another."""
        return phrase(self._of("postings", analysed_terms(words)), self.id_col, words)


def bm25(docs: DataFrame, id_col: str, text: str, query: list[str], *, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of documents with any of the query's terms, without an index: all texts are read and analysed once.

    Only query terms are counted: no postings are shuffled. The corpus figures (number, mean length, documents per term) are one
    aggregated row, attached to each document; lengths are of analysed texts.
    """
    terms = analysed_terms(query)
    kept = F.filter(raw_tokens(F.col(text)), lambda t: ~t.isin(*STOP_WORDS))
    # stems keep a word's beginning, so few words are stemmed
    some = F.transform(F.filter("_t", lambda t: F.greatest(F.lit(False), *[t.startswith(q[: max(1, len(q) - 2)]) for q in terms])), stem)
    ts = docs.select(F.col(id_col), kept.alias("_t")).select(id_col, F.size("_t").alias("dl"), some.alias("_s"))
    times = lambda q: F.size(F.filter("_s", lambda x: x == q))
    d = ts.select(id_col, "dl", *[times(q).alias(f"tf{i}") for i, q in enumerate(terms)])
    df = [F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(terms))]
    corpus = d.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *df)
    both = d.crossJoin(F.broadcast(corpus))  # one row
    score: Column = F.lit(0.0)
    for i in range(len(terms)):
        tf, n_t = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - n_t + 0.5) / (n_t + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return both.select(id_col, score.alias("score")).where("score > 0")


def phrase(posting: DataFrame, id_col: str, words: list[str]) -> DataFrame:
    """Ids of documents with the analysed words one after another, from postings."""
    terms = [stem_word(w.lower()) for w in words if w.lower() not in STOP_WORDS]
    ends = posting.where(F.col("term").isin(terms)).select(id_col, "term", F.explode("positions").alias("pos"))
    wanted = [ends.where(F.col("term") == w).select(id_col, (F.col("pos") - i).alias("at")).distinct() for i, w in enumerate(terms)]
    if not wanted:
        return posting.where("false").select(id_col)
    out = wanted[0]
    for w in wanted[1:]:
        out = out.join(w, [id_col, "at"])
    return out.select(id_col).distinct()


def field_types(values: DataFrame, column: str = "_value") -> DataFrame:
    """(path, type) that a text index would give a JSON document's fields: date, keyword (short, no space), text, numbers, booleans."""
    v = values.select(F.try_parse_json(F.col(column).cast("string")).alias("v")).where("v IS NOT NULL")
    rows = v.sparkSession.sql("SELECT e.key AS path, e.value AS value FROM {v} AS t, LATERAL variant_explode(t.v) AS e", v=v)
    kind = F.schema_of_variant("value")
    s = F.try_variant_get("value", "$", "string")
    t = (
        F.when((kind == "STRING") & s.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"), "date")
        .when((kind == "STRING") & (F.length(s) <= 256) & ~s.contains(" "), "keyword")
        .when(kind == "STRING", "text")
        .when(kind == "BIGINT", "i64")
        .when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), "f64")
        .when(kind == "BOOLEAN", "bool")
        .otherwise("json")
    )
    return rows.groupBy("path").agg(F.min(t).alias("first"), F.max(t).alias("last")).select("path", F.when(F.col("first") == F.col("last"), F.col("first")).otherwise("text").alias("type"))
