import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from matchlake.llm import lm
from matchlake.llm.elias_fano import Arrays, EliasFano, NgramTrie

SF = "/root/testdata/sf0.001"


def brute(rows, order):
    docs = [(i, [*(t or "").encode().lower().split(), None]) for i, t in rows]
    train = [d for i, d in docs if i is None or crc32(str(i).encode()) % 7 != 2]
    grams, contexts = Counter(), Counter()
    for d in train:
        padded = ["<s>"] * (order - 1) + d
        for k in range(len(d)):
            for n in range(order):
                g = tuple(padded[k + order - 1 - n : k + order])
                grams[g] += 1
                contexts[g[:-1]] += 1
    total, v = sum(map(len, train)), len({w for d in train for w in d})

    def p(g):
        if len(g) == 1:
            return (grams[g] + 1) / (total + v + 1)
        n = contexts[g[:-1]]
        m = lm.mass(len(g), n)
        return (grams[g] + m * p(g[1:])) / (n + m)

    out = []
    for i, d in docs:
        padded = ["<s>"] * (order - 1) + d
        score = sum(math.log10(p(tuple(padded[k : k + order]))) for k in range(len(d)))
        base = sum(math.log10((grams[(w,)] + 1) / (total + v + 1)) for w in d)
        held = i is not None and crc32(str(i).encode()) % 7 == 2
        out.append((i, held, len(d), sum(grams[(w,)] > 0 for w in d), total, base, score))
    return out


def same(spark, rows, order):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    got = sorted(map(tuple, lm.scored(df, order=order).collect()), key=repr)
    want = sorted(brute([r[:2] for r in rows], order), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], abs=1e-6)
        assert g[6] == pytest.approx(w[6], abs=order * g[2] * lm.STEP)  # codes round each order's probability


@pytest.mark.parametrize("order", [2, 3, 4])
def test_as_counted_by_hand(spark, order, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 20_000)
    rows = [(r.doc_id, r.text, "x") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    same(spark, rows + rows[:20], order)


def test_odd_texts(spark):
    same(spark, [(1, None, "a"), (2, "", "b"), (None, "a b a", None), (4, "a a a", "c"), (4, "a a a", "c"), (9, "x " * 30_000, "d"), (10, "Zq", "e")], 3)
    assert lm.scored(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_hot_contexts_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(lm, "HOT", 5)
    same(spark, [(k, f"the w{k % 5} the w{k % 3}", "x") for k in range(60)], 3)


def test_held_out_texts_score_above_single_words(spark):
    out = lm.scored(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out and n_tokens > 50").toPandas()
    assert (out.score > out.base_score).mean() > 0.8


def test_sequences():
    r = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 5), (1, 0), (10, 20), (1000, 2**40), (50_000, 60_000), (1000, 2**62)):
        v = np.sort(r.integers(0, max(top, 1), n).astype(np.uint64))
        e = EliasFano(Arrays(), v).mapped()
        asked = np.concatenate([v, r.integers(0, top + 5, 1000).astype(np.uint64)])
        at, found = e.successor(asked, np.zeros(len(asked), dtype=int), np.full(len(asked), n))
        assert (found == np.isin(asked, v)).all() and (at == np.searchsorted(v, asked)).all()
        if n:
            assert (e[np.arange(n)] == v).all()
            asked = np.concatenate([asked[-300:], r.choice(v, 300)])
            first = r.integers(0, n + 1, len(asked))
            behind = np.maximum(first, r.integers(0, n + 1, len(asked)))
            at, found = e.successor(asked, first, behind)
            for x, a, b, k, f in zip(asked, first, behind, at, found):
                want = a + np.searchsorted(v[a:b], x)
                assert f == (want < b and v[want] == x) and (not f or v[k] == x and a <= k < b)


def built(seed=2):
    """A trie of pairs and triples of words over 60 numbers, and what it was made of."""
    r = np.random.default_rng(seed)
    words = np.sort(r.choice(10_000, 60, replace=False).astype(np.uint64))
    rows = np.unique(r.integers(0, 60, (900, 3)) // np.array([2, 1, 1]), axis=0)
    last, back, word = rows.T
    n = r.integers(1, 5, len(rows)).astype(np.uint64)

    def per(*columns):
        total = Counter()
        for k, x in zip(zip(*columns), n):
            total[k] += int(x)
        return np.array([total[k] for k in zip(*columns)], dtype=np.uint64)

    code = lm.coded(r.uniform(1e-4, 1e-2, 60))
    totals, counts = [per(last), per(last, back)], [per(last, word), n]
    return NgramTrie(words, code, [last, back], word, totals, counts, lm.mass, lm.coded, lm.decoded), words, code, rows, totals, counts


def by_hand(words, code, rows, totals, counts, floor):
    """What gives the code of one n-gram, without a trie."""
    pairs, triples, one, two = {}, {}, {}, {}
    for (a, b, w), t1, t2, c1, c2 in zip(rows.tolist(), *totals, *counts):
        below = lm.decoded(code[w : w + 1])[0]
        m1, m2 = lm.mass(2, float(t1)), lm.mass(3, float(t2))
        p = (float(c1) + m1 * below) / (float(t1) + m1)
        pairs[a, w], triples[a, b, w] = p, (float(c2) + m2 * p) / (float(t2) + m2)
        one[a], two[a, b] = m1 / (float(t1) + m1), m2 / (float(t2) + m2)
    as_code = lambda p: int(lm.coded(np.array([p]))[0])

    def looked_up(last, back, word):
        if (last, back, word) in triples:
            return as_code(triples[last, back, word])
        more = as_code(two[last, back]) if (last, back) in two else 0
        if (last, word) in pairs:
            return more + as_code(pairs[last, word])
        more += as_code(one[last]) if last in one else 0
        return more + (int(code[word]) if word < len(words) else floor)

    return looked_up


def test_the_trie_backs_off():
    """All triples of known words and an unknown one, most of them never put in."""
    trie, words, code, rows, totals, counts = built()
    asked = np.array([(a, b, w) for a in range(0, 61, 3) for b in range(0, 61, 2) for w in range(0, 61)])
    numbers = np.append(words, np.uint64(77_777))
    got = trie.score(numbers, [asked[:, 0], asked[:, 1]], asked[:, 2], 50_000)
    looked_up = by_hand(words, code, rows, totals, counts, 50_000)
    assert got.tolist() == [looked_up(*x) for x in asked.tolist()]
    assert trie.score(words[:0], [words[:0].astype(int)] * 2, words[:0].astype(int), 1).tolist() == []


@pytest.mark.parametrize("level", ["nodes", "followers"])
@pytest.mark.parametrize("order", [0, 1])
@pytest.mark.parametrize("part", ["values", "starts"])
def test_scores_hang_on_each_level(level, order, part):
    """A level or pointer that is spoiled changes what is found."""
    asked = lambda t, w, rows: t.score(w, [rows[:, 0], rows[:, 1]], rows[:, 2], 50_000)
    trie, words, _, rows, _, _ = built()
    before = asked(trie, words, rows)
    if (level, order, part) == ("nodes", 0, "starts"):
        return  # one range alone: its end is all that its pointers say
    sequence = getattr(getattr(trie, level)[order], part)
    if sequence.low_bits:
        sequence.low = sequence.low ^ np.uint64(0x5555555555555555)
    else:  # as many bits, in another order
        bits = np.unpackbits(sequence.high.view(np.uint8), bitorder="little")
        bits[: sequence.n] = bits[: sequence.n][::-1]
        sequence.high = np.packbits(bits, bitorder="little").view("<u2")
        sequence.ones = np.concatenate([[0], np.cumsum(np.bitwise_count(sequence.high).astype(np.int64))[:-1]])
        sequence.zeros = 16 * np.arange(len(sequence.ones)) - sequence.ones
    assert (asked(trie, words, rows) != before).any()


def test_without_the_trie_scores_are_others(spark, monkeypatch):
    """The queries' codes come out of the trie alone: an empty one leaves single words."""

    class Empty(NgramTrie):
        def __init__(self, words, code, contexts, word, totals, counts, *model):
            super().__init__(words, code, [c[:0] for c in contexts], word[:0], [t[:0] for t in totals], [c[:0] for c in counts], *model)

    texts = [f"the w{k % 5} the w{k % 3}" for k in range(30)]
    chunk = lm.Chunk(lm.packs(*lm.encoded([t.encode() for t in texts])), np.arange(30) % 7 == 2, 1, 3)
    made, n, v = lm.count_words(0, 1, [x for _, x in chunk.word_requests()])
    chunk.n, chunk.v = n, v
    chunk.words_answered({0: made[0]})
    chunk.grams_answered({k: lm.count_grams([x])[0] for k, x in chunk.gram_requests()})
    asked = dict(chunk.requests())
    by = {trie: chunk.scores({s: lm.score_grams(3, [x], 60_000, trie)[0] for s, x in asked.items()}) for trie in (NgramTrie, Empty)}
    assert by[Empty]["score"] == pytest.approx(by[Empty]["base_score"], abs=5 * lm.STEP)
    assert (by[NgramTrie]["score"] > by[Empty]["score"] + 1).all()


def test_the_default_takes_contexts_of_two_words(spark):
    rows = [(k, f"a{k % 2} b c{k % 2}") for k in range(60)]
    got = {r.doc_id: r.score for r in lm.scored(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, _, n, _, _, _, score in brute(rows, 3):
        assert got[i] == pytest.approx(score, abs=3 * n * lm.STEP)
