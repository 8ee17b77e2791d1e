import random
import re

import pytest

from tidelog.llm import components as G
from tidelog.llm import ngram_join as J
from tidelog.llm import wordnum as W


def brute(docs):
    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(docs)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                up[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [(d, len(sets[i]), least.get(top(i))) for i, (d, _) in enumerate(docs)]


def family(seed):
    random.seed(seed)
    words = [f"w{i}" for i in range(400)]
    common = [random.choices(words, k=30) for _ in range(3)]
    docs = []
    for g in range(25):
        base = random.choices(words, k=random.randint(8, 80)) + (random.choice(common) if g % 3 == 0 else [])
        for _ in range(random.randint(1, 9)):
            w = list(base)
            for _ in range(random.randint(0, 4)):
                w[random.randrange(len(w))] = random.choice(words)
            docs.append((len(docs), " ".join(w)))
    return docs


ODD = [(900, "a b c"), (901, "A b\x0bC"), (902, "x"), (903, ""), (904, " \n"), (905, None), (905, "x"), (None, "A B c"), (None, None), (7, "long " * 3000)]


@pytest.mark.parametrize("rounds", [0, 2])
def test_components(spark, rounds):
    docs = family(3) + ODD
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, node int, n_shingles string")
    got = [tuple(r) for r in J.jaccard_components(df, rounds=rounds).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(brute(docs), key=key)


def test_words_of_a_pattern_differ(spark):
    """The Thue-Morse word and its complement, as letters and as words, and words that differ in one late letter."""
    x = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    y = x.translate(str.maketrans("ab", "ba"))
    keys = W.sequence_keys(*W.words_of([" ".join(x).encode(), " ".join(y).encode()]))
    assert all(k[0] != k[1] for k in keys)
    texts = [x, y, "q" * 70_000, "q" * 69_999 + "r", "abcdefgh" * 3, "abcdefgh" * 2 + "abcdefgi"]
    got = J.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r.component_id == r.doc_id for r in got)


def test_steps_do_not_matter(monkeypatch):
    rng = random.Random(2)
    text = " ".join("x" * rng.randint(1, 90) + str(rng.randint(0, 99)) for _ in range(3000)).encode()
    whole = W.words_of([text, b"", b"a b"])
    monkeypatch.setattr(W, "STEP_BYTES", 500)
    cut = W.words_of([text, b"", b"a b"])
    assert (whole[0] == cut[0]).all() and whole[1].tolist() == cut[1].tolist() == [0, 3000, 3000, 3002]


def test_near_misses_of_a_large_group(spark, monkeypatch):
    """Texts that have nearly enough of a large group in common, but don't link, aren't compared with its members."""
    random.seed(8)
    base = [f"w{i}" for i in range(200)]

    def edited(n, own):
        w = list(base)
        for k, at in enumerate(random.sample(range(200), n)):
            w[at] = f"{own}x{k}"
        return " ".join(w)

    docs = [(i, edited(random.randint(0, 3), i)) for i in range(2000)] + [(2000 + i, edited(random.randint(8, 11), 2000 + i)) for i in range(500)]
    docs += [(3000, " ".join(base[:150])), (3001, " ".join(base[:155])), (3002, " ".join(base[:110])), (3003, " ".join(base[:115]))]
    pairs = []
    whole = J.overlaps
    monkeypatch.setattr(J, "overlaps", lambda p, parts: pairs.append(p.count()) or whole(p, parts))
    got = {r.doc_id: r.component_id for r in J.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for i, t in docs if (w := t.split())}
    link = lambda x, y: 100 * len(x & y) >= 80 * len(x | y)
    of_base = frozenset(tuple(base[k : k + 5]) for k in range(196))
    group = min(i for i, s in sets.items() if link(s, of_base))
    for i, s in sets.items():
        if link(s, of_base):
            assert got[i] == group
    assert got[3003] == got[3002] == 3002 and got[3001] == got[3000]
    assert sum(pairs) < 20_000, pairs


def test_frequent_shingles_and_crowds(spark, monkeypatch):
    """Another way for frequent shingles and for shingles of many nodes gives the same components."""
    docs = family(4)
    monkeypatch.setattr(J, "SAMPLE", 1)
    monkeypatch.setattr(J, "FREQUENT", 20)
    whole = J.exact_pairs
    monkeypatch.setattr(J, "exact_pairs", lambda *a, **k: whole(*a, **k, crowded=3, block=50))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert len(J.frequent_shingles(J.document_keys(df, sampled=True))) > 10
    got = sorted(tuple(r) for r in J.jaccard_components(df, rounds=0).collect())
    assert got == sorted(brute(docs))


def test_empty(spark):
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_connected_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (5, 5), (200, 7)]
    got = {r.node: r.component for r in G.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 200: 0, 100: 100, 101: 100}
