"""Quality classifier: labelled neighbours in a latent-semantic space vote, weighted by cosine similarity.

Terms are byte trigrams, hashed to ``terms`` buckets, counted over the whole text. Counts are damped by a logarithm,
weighted by inverse document frequency and scaled to length 1; a truncated singular value decomposition of the labelled
rows' vectors gives the latent space. The model is fitted on the driver from at most ``bound`` labelled rows, of each of
which one vector of fixed length arrives, so it has one size at any scale: the projection and the labelled vectors are
broadcast, and every document is compared exactly, in blocks, with all of them. A document's score is the share of label
1 among its ``k`` nearest by similarity to the power ``sharpness``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship_code, table

#: Bytes of text that one step holds as numbers.
STEP_BYTES = 2_000_000
#: Texts that one product of matrices takes; a smaller step is filled up, so that a score doesn't depend on its neighbours.
STEP_ROWS = 256


class Model(NamedTuple):
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float


def term_counts(texts: list[str], terms: int) -> np.ndarray:
    """Counts of hashed byte trigrams, one row a text; a space stands before and after each text."""
    out = np.zeros((len(texts), terms), np.float32)
    for i, text in enumerate(texts):
        raw = (" " + (text or "") + " ").encode("utf-8", "replace")
        for at in range(0, max(1, len(raw) - 2), STEP_BYTES):
            b = np.frombuffer(raw[at : at + STEP_BYTES + 2], np.uint8).astype(np.uint32)
            if len(b) >= 3:
                code = b[:-2] * np.uint32(65536) + b[1:-1] * np.uint32(256) + b[2:]
                code = (code * np.uint32(2654435761)) >> np.uint32(32 - (terms - 1).bit_length())
                out[i] += np.bincount(code, minlength=terms)
    return out


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts, out=counts)
    x *= idf
    return _unit(x)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return np.divide(x, norm, out=x, where=norm > 0)


def _steps(texts: list[str], rows: int) -> Iterator[slice]:
    yield from (slice(at, at + rows) for at in range(0, len(texts), rows))


def fit(docs: DataFrame, labels: DataFrame, *, bound: int = 4000, terms: int = 4096, latent: int = 64) -> Model | None:
    """Model of at most ``bound`` labelled rows: those of docs (doc_id, text) whose ids labels (doc_id, label) holds, by the
    smallest hash of doc_id. Labels other than 0 and 1, null ids and null texts are left out, an id with both labels too.
    None without a row of each label."""
    ship_code(docs.sparkSession)
    own = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_other")).where("label = _other")
    some = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).select("doc_id", F.col("label").cast("int").alias("label"))
    picked = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(some), "doc_id")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in _steps(b.text, STEP_ROWS):
                x = term_counts(b.text[s].tolist(), terms)
                yield pd.DataFrame({"doc_id": b.doc_id[s], "label": b.label[s], "x": [r.tobytes() for r in np.log1p(x).astype(np.float16)]})

    got = picked.mapInPandas(counted, "doc_id long, label int, x binary").toPandas()
    got = got.sort_values(["doc_id", "x"]).drop_duplicates("doc_id")  # repeated rows count once
    labels_ = got.label.to_numpy(np.float32)
    if not len(got) or labels_.min() == labels_.max():
        return None
    x = np.empty((len(got), terms), np.float32)
    for i, r in enumerate(got.x):
        x[i] = np.frombuffer(r, np.float16)
    del got
    idf = np.log((1 + len(x)) / (1 + np.count_nonzero(x, axis=0))).astype(np.float32) + 1
    x *= idf
    _unit(x)
    rng = np.random.default_rng(11)
    latent = min(latent, *x.shape)
    y = x @ rng.standard_normal((x.shape[1], min(latent + 16, min(x.shape)))).astype(np.float32)
    for _ in range(4):  # randomised subspace iteration
        y = x @ (x.T @ np.linalg.qr(y)[0])
    basis = np.linalg.qr(y)[0]
    axes = np.linalg.svd(basis.T @ x, full_matrices=False)[2][:latent].T
    return Model(idf, axes.astype(np.float32), _unit(x @ axes).astype(np.float32), labels_, float(labels_.mean()))


def voters(sim: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row of sim, ties to the smaller column, columns ascending."""
    least = -np.partition(-sim, k - 1, axis=1)[:, k - 1 : k]
    above, tie = sim > least, sim == least
    some = above | (tie & (np.cumsum(tie, axis=1) <= k - above.sum(1, keepdims=True)))
    return np.nonzero(some)[1].reshape(len(sim), k)


def score_texts(model: Model, texts: list[str], k: int, sharpness: float) -> np.ndarray:
    out = np.empty(len(texts))
    axes, vectors, idf = model.axes.astype(np.float64), model.vectors.astype(np.float64), model.idf.astype(np.float64)
    for s in _steps(texts, STEP_ROWS):
        x = np.zeros((STEP_ROWS, len(idf)))
        n = len(texts[s])
        x[:n] = term_counts(texts[s], len(idf))
        sim = np.round(_unit(_weighted(x, idf) @ axes) @ vectors.T, 9)[:n]
        near = voters(sim, min(k, sim.shape[1]))
        w = np.maximum(np.take_along_axis(sim, near, 1), 0) ** sharpness
        total = w.sum(1)
        out[s] = np.where(total > 0, (w * model.labels[near]).sum(1) / np.where(total > 0, total, 1), model.prior)
    return np.clip(out, 0, 1)


def score_documents(docs: DataFrame, model: Model | None, *, k: int = 15, sharpness: float = 4.0) -> DataFrame:
    """docs with score and predicted added; text alone is read. All columns and rows are kept as they are (columns named score
    or predicted are replaced); null texts count as empty, and a text without a neighbour of positive similarity scores
    the share of label 1 in the model. Similarities are rounded to 9 digits; of equally near neighbours those of smaller doc_id vote. Without a model every score is 0.5."""
    kept = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    names = [f.name for f in kept]
    if model is None:
        return docs.select(*names, F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    ship_code(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(score_texts(shared.value, t.fillna("").tolist(), k, sharpness))

    return docs.select(*names, F.round(scored("text"), 9).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def remainder(doc_id: str = "doc_id"):
    """crc32 of doc_id as text, modulo 3; rows that leave 1 are held out."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3))


def learnable(labels: DataFrame) -> DataFrame:
    """(doc_id, label) of the quality labels that may be learned from."""
    return labels.where(remainder() != 1).select("doc_id", F.col("quality").alias("label"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, learnable(table(spark, sf_dir, "labels")))
    out = score_documents(docs, model)
    return out.select("doc_id", F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), "score", "predicted")
