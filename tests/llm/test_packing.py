import numpy as np
import pytest

from tidelog.llm import packing as K

DOCS = "doc_id long, text string, doc_id_ int, length string"


@pytest.fixture(scope="module")
def fast():
    return K.FastIds(K.tokenizer_file(), K.tokenizer_file("byte_bpe_50k.tiktoken"))


ODD = ["a  b", "a \n b", "  x", "x  ", " ", "\n\n", "a\n\n b", "a b c", "don't 's x's", "<|endoftext|> hi", "a\r\nb", "1 2  3\n", "\t\ta b", "a\t b", "a b \n c", "é  x", "a\xa0b c", "\x1ca b", "x, y. z.. ,", "中文 字", "a\n", "q" * 200 + " " + "r" * 200]


@pytest.mark.parametrize("text", ODD)
def test_ids_are_the_tokenizers(fast, text):
    assert fast(text) == fast.slow(text)
    assert K.FastIds(K.tokenizer_file())(text) == fast.slow(text)


def test_ids_of_documents(fast, spark, sf):
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(120).collect():
        assert fast(r.text) == fast.slow(r.text)


def test_sum_of_squares_by_brute_force():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 20, 300)
    where, offset = K.sum_of_squares(lengths, 20)
    gaps, at = {}, {}
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        room = sorted({g for g in gaps.values() if g >= n})
        s = int(where[i])
        if room:
            def squares(g):
                left = list(gaps.values())
                left.remove(g)
                left.append(g - n)
                return sum(left.count(x) ** 2 for x in set(left) if x)

            assert squares(gaps[s]) == min(map(squares, room))
        else:
            assert s not in gaps
        assert offset[i] == 20 - gaps.get(s, 20)
        gaps[s] = gaps.get(s, 20) - n
    assert min(gaps.values()) >= 0


def test_packing_is_whole(spark, fast):
    long = "word and more " * 900
    rows = [(1, "a b", 0, "x"), (1, "a b", 0, "x"), (None, None, 1, None), (2, "", 2, "y"), (3, long, 3, "z"), (4, "é " * 1023, 4, "")]
    pieces, places = K.pack_documents(spark.createDataFrame(rows, DOCS), K.tokenizer_file())
    seqs = K.sequences(pieces, places).collect()
    assert all(len(s.ids) <= 4096 for s in seqs)
    want = sorted(fast.slow(r[1] or "") + b"\x02\0\0\0" for r in rows)
    assert sorted(len(w) for w in want)[-1] // 4 > 1024
    got = K.pack_rows(spark.createDataFrame(rows, DOCS), K.tokenizer_file()).collect()
    assert sum(r.length for r in got) == sum(len(w) // 4 for w in want)
    three = sorted((r for r in got if r.doc_id == 3), key=lambda r: r.piece)
    assert [r.length for r in three][1:] == [1024] * (len(three) - 1) and three[0].length <= 1024
    assert [r.start for r in three] == list(np.cumsum([0] + [r.length for r in three])[:-1])
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 1024


def test_empty(spark):
    assert K.pack_rows(spark.createDataFrame([], DOCS), K.tokenizer_file()).count() == 0


def test_query_wastes_little(spark, sf):
    got = K.op2_best_fit_packing(spark, sf)
    n, total = got.selectExpr("count(distinct sequence_id)", "sum(length)").first()
    assert n <= 1.03 * total / 1024 + 1
