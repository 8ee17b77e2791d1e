import math
import re
import zlib

import numpy as np
import pytest

from tidelog.llm import quality_classifier as C
from tidelog.llm import quality_rules as R

DOCS = "doc_id long, text string, kept string, score int, n_words string"


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {p + k for v in at.values() if len(v) > 1 for p in v for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


ODD = [None, "", " \n\t", "a", "a b c d e", "a b c d e a b c d e", "x " * 12, "l one\nl one\n\n\nl one ", "#*$%&|<> é b", "q\x0bw\x0ce\rr", "\n".join(["one two three four five six"] * 9), "z y x w v u " * 40]


def test_rules_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()
    rows = [(r.doc_id, r.text) for r in docs] + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "a b"), (None, "a b")]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOCS)
    got = R.quality_rules(df, df.where("doc_id < 20").select("doc_id"), buckets=512).collect()
    assert len(got) == len(rows) and [c for c in got[0].asDict() if c == "kept"] == ["kept"]
    text = {r[0]: r[1] for r in rows}
    for r in got:
        n, chars, symbols, dup, repeat = base(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat), text[r.doc_id]
        assert r.base_failed == (n < 10 or 100 * repeat > 20 * n)
        assert not (r.kept and r.base_failed)


def test_log_ratio_by_hand(spark):
    rows = [(1, "good good"), (2, "bad good"), (3, "bad")]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOCS)
    out = {r.doc_id: r for r in R.quality_rules(df, df.where("doc_id = 1").select("doc_id"), buckets=1 << 14, min_words=0).collect()}
    b = 1 << 14
    ratio = lambda t, r: math.log((t + 1) / (3 + b)) - math.log((r + 1) / (7 + b))
    assert out[1].score == pytest.approx((2 * ratio(2, 3) + ratio(1, 1)) / 3, abs=2e-6)
    assert out[3].score == pytest.approx(ratio(0, 2), abs=2e-6)
    assert out[1].score > out[2].score > out[3].score


def test_trusted_texts_alone_are_shuffled(spark, sf, monkeypatch):
    """The plan is the same for small tables, and ids are looked up before texts go into a shuffle."""
    plans, whole = [], R.cut

    def cut(df, name):
        plans.append((df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().sparkPlan().toString()))
        return whole(df, name)

    monkeypatch.setattr(R, "cut", cut)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    R.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1"), buckets=64)
    assert "might_contain" in plans[0][0] and "SortMergeJoin" in plans[0][1] and "Broadcast" not in plans[0][1]
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before


def test_rules_without_anything(spark):
    none = spark.createDataFrame([], DOCS)
    assert R.quality_rules(none, none.select("doc_id")).count() == 0
    one = spark.createDataFrame([(1, "a b c d e f g h i j k", "", 0, "")], DOCS)
    assert R.quality_rules(one, none.select("doc_id")).first().kept


def test_all_trusted_documents_count(spark):
    """Where all documents are trusted, however many, both models are one and no score is other than 0."""
    df = spark.range(20_500).selectExpr("id AS doc_id", "concat('w', id % 50, ' v', id % 7) AS text")
    assert [r.score for r in R.quality_rules(df, df.select("doc_id"), buckets=512).select("score").distinct().collect()] == [0.0]


def test_classifier_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = C.op8_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    bad = [r for r in held if not r.quality]
    assert sum(not r.predicted for r in bad) >= 0.8 * len(bad)


def test_classifier_edges(spark):
    rows = [(i, "fine plain words here" if i % 2 else "$$$ ### @@@", "", 0, "") for i in range(20)] + [(None, None, "", 0, ""), (3, "fine plain words here", "", 0, ""), (50, "", "", 0, ""), (51, "x" * 3_000_000, "", 0, "")]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(1, 0), (None, 1), (2, 7)], "doc_id long, label int")
    model = C.fit(df, labels, bound=100, terms=256, latent=4)
    out = C.score_documents(df, model).collect()
    assert len(out) == len(rows) and set(out[0].asDict()) == {"doc_id", "text", "kept", "score", "n_words", "predicted"}
    assert all(r.predicted == 1 for r in out if r.text and r.text.startswith("fine"))
    assert all(r.predicted == 0 for r in out if r.text and r.text.startswith("$"))
    assert C.fit(df, labels.where("label = 1")) is None
    assert C.score_documents(df.limit(0), model).count() == 0


def test_votes_as_by_brute_force(spark, sf):
    """Scores are those of a plain vote, text by text, and don't depend on what else is in a batch."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = C.fit(docs, C.learnable(spark.read.parquet(f"{sf}/labels.parquet")))
    texts = [r.text or "" for r in docs.orderBy("doc_id").limit(60).collect()] + ["", "x", "é" * 5000]
    got = C.score_texts(model, texts, 15, 4.0)
    vectors = model.vectors.astype(float)
    for i, text in enumerate(texts):
        raw = (" " + text + " ").encode()
        counts = np.zeros(len(model.idf))
        for k in range(len(raw) - 2):
            code = raw[k] << 16 | raw[k + 1] << 8 | raw[k + 2]
            counts[(code * 2654435761 % 2**32) >> (32 - (len(counts) - 1).bit_length())] += 1
        x = np.log1p(counts) * model.idf.astype(float)
        z = x / max(1e-300, np.sqrt((x * x).sum())) @ model.axes.astype(float)
        sims = [round(float(v), 9) for v in vectors @ (z / max(1e-300, np.sqrt((z * z).sum())))]
        near = sorted(range(len(sims)), key=lambda j: (-sims[j], j))[:15]
        w = [max(0.0, sims[j]) ** 4 for j in near]
        want = sum(a * model.labels[j] for a, j in zip(w, near, strict=True)) / sum(w) if sum(w) else model.prior
        assert abs(got[i] - want) < 1e-6, i
    for step in (1, 7):
        again = np.concatenate([C.score_texts(model, texts[a : a + step], 15, 4.0) for a in range(0, len(texts), step)])
        assert (np.round(again, 9) == np.round(got, 9)).all()


def test_ties_go_to_the_smaller_row():
    sim = np.array([[0.5, 0.9, 0.5, 0.5, 0.1], [0.2] * 5, [0.0, 0.1, 0.2, 0.3, 0.4]])
    assert C.voters(sim, 3).tolist() == [[0, 1, 2], [0, 1, 2], [2, 3, 4]]
