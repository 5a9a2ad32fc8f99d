"""Nearest vectors, source divergences, ranked search."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from matchlake.llm import ann, divergence, lexical, queries

SF = "/root/testdata/sf0.01"


def product(a, b):
    s = 0.0
    for x, y in zip(a, b):
        s += x * y
    return s


def brute_nearest(rows, k, every):
    """All pairs, in double precision."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    out = {}
    for i, q in zip(ids, x):
        if i % every == 0:
            s = q @ x.T
            near = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[int(i)] = [int(ids[j]) for j in near]
    return out


def found_nearest(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_nearest_of_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, got = brute_nearest(rows, 20, 20), found_nearest(queries.op11_nearest(spark, SF))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hit = sum(len(set(want[i]) & {v for v, _ in got[i]}) for i in want)
    assert hit >= 0.95 * 20 * len(want)
    by = dict(rows)
    assert all(s == product(by[i], by[v]) for i, own in got.items() for v, s in own)


@pytest.mark.parametrize("kind", ["random", "clusters", "norms"])
def test_recall_in_many_lists(spark, kind, monkeypatch):
    """Several tasks, a list that spans tasks, and vectors of very different lengths."""
    monkeypatch.setattr(ann, "PER_TASK", 700)
    monkeypatch.setattr(ann, "QUERIES", 40)
    r = np.random.default_rng(3)
    x = r.standard_normal((3000, 48))
    if kind == "clusters":
        x[:1800] = x[0] + 0.05 * r.standard_normal((1800, 48))
    if kind == "norms":
        x *= np.exp(r.standard_normal((3000, 1)))
    rows = [(int(i), [float(v) for v in row]) for i, row in enumerate(x)]
    got = found_nearest(ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("id") % 20 == 0, 20))
    want = brute_nearest(rows, 20, 20)
    hit = sum(len(set(want[i]) & {v for v, _ in got[i]}) for i in want)
    assert hit >= 0.9 * 20 * len(want), hit / (20 * len(want))


def test_tests_abandon_most_candidates_and_keep_the_near():
    r = np.random.default_rng(5)
    q, x = r.standard_normal((50, 64)), r.standard_normal((2000, 64))
    turn = ann.rotation(64)
    full = ann.distances(q, x)
    bound = np.sort(full, axis=1)[:, 9]
    a, b = ann.scan_list(q, x, q @ turn, x @ turn, bound)
    near = set(zip(*np.nonzero(full <= bound[:, None])))
    assert len(near - set(zip(a, b))) <= 0.01 * len(near)
    assert len(a) < 0.05 * full.size


def test_few_pairs_are_scored_one_by_one(monkeypatch):
    """A query's first list is bounded by products of matrices; and these abandon what gathered differences do."""
    r = np.random.default_rng(6)
    x, n = r.standard_normal((800, 64)), []
    q, top, turn = x[:200], (x * x).sum(axis=1).max(), ann.rotation(65)
    held = pa.table({"list": pa.array([0] * 800, pa.int32()), "ids": [[k] for k in range(800)], "vec": pa.array([v.tobytes() for v in x], pa.binary())})
    asked = pa.table({"digest": pa.array([b"%d" % k for k in range(200)], pa.binary()), "vec": pa.array([v.tobytes() for v in q], pa.binary()), "probed": pa.array([[0]] * 200, pa.list_(pa.int32()))})
    rq, rx = np.concatenate([q, np.zeros((200, 1))], axis=1) @ turn, ann.longer(x, top) @ turn
    within = (q * q).sum(axis=1) + top - 2 * np.sort(q @ x.T, axis=1)[:, -21]
    found = []
    for dense in (0, 1 << 40):
        monkeypatch.setattr(ann, "DENSE", dense)
        found.append(set(zip(*map(np.ndarray.tolist, ann.scan_list(q, x, rq, rx, within)))))
    assert found[0] == found[1] and 200 * 20 < len(found[0]) < 200 * 40
    exact = ann.exact
    monkeypatch.setattr(ann, "exact", lambda a, b: n.append(len(a)) or exact(a, b))
    digests, at, scores = ann._scanned(held, asked, top, 21)
    assert sum(n) < 200 * 40 and len(digests) == 200 * 21
    want = np.argsort(-(q @ x.T), axis=1)[:, :21]
    hits = {(int(d), int(a)) for d, a in zip(digests, at)}
    assert sum((i, int(k)) in hits for i, row in enumerate(want) for k in row) > 0.99 * 200 * 21


def test_copies_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    same = [(i, [1.0, 2.0, 2.0]) for i in range(200, 260)]
    rows = [*same, (0, [1.0, 0.0, 0.0]), (0, [1.0, 0.0, 0.0]), (1, [0.0, 0.0, 0.0]), (2, None), (3, []), (4, [1.0, None, 1.0]), (5, [nan, 1.0, 1.0]), (6, [inf, 1.0, 1.0]), (7, [1.0, 2.0]), (None, [3.0, 3.0, 3.0]), (40, [-1.0, -0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, score string, rank int")
    got = found_nearest(ann.nearest(df, F.col("id") % 20 == 0, 20))
    assert set(got) == {0, 40, 200, 220, 240}
    assert [v for v, _ in got[220]] == [i for i in range(200, 221) if i != 220]
    assert [v for v, _ in got[200]] == list(range(201, 221))
    assert got[0] == [(i, 1.0) for i in range(200, 220)]
    assert [v for v, _ in got[40]] == [0, *range(200, 219)] or [s for _, s in got[40]] == [-1.0] * 20
    few = spark.createDataFrame([(20, [1.0, 0.0]), (21, [0.5, 0.5])], "vec_id bigint, embedding array<float>")
    assert found_nearest(ann.nearest(few, F.col("id") % 20 == 0, 20)) == {20: [(21, 0.5)]}
    assert ann.nearest(few.where("false"), F.col("id") % 20 == 0, 20).count() == 0
    assert ann.nearest(few.where("vec_id = 20"), F.col("id") % 20 == 0, 20).count() == 0


def brute_divergence(rows, least=10, top=10):
    one = 10**9
    docs = [(lang or "", source or "", [t.translate(LOWER) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= least}
        counts = {s: Counter(t for d in mine if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in mine}}
        whole = sum(counts.values(), Counter())
        p = lambda c: {t: 1 + one * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        ps, q = {s: p(c) for s, c in counts.items()}, p(whole)
        for s in counts:
            pairs = [("pair", r, sum(f(ps[s][t], ps[r][t]) for t in kept)) for r in counts if r != s]
            terms = [("term", t, f(ps[s][t], q[t])) for t in kept if counts[s][t] and ps[s][t] > q[t]]
            for own, most in ((pairs, len(pairs)), (terms, top)):
                for rank, (part, item, value) in enumerate(sorted(own, key=lambda r: (-r[2], r[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def result(df):
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect())


def test_divergences_by_hand(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TERMS", 7)  # several tasks a language
    r = np.random.default_rng(2)
    words = ["Alpha", "beta", "Öl", "öl", "x9y", "don't", "漢字", "gamma", "delta", "ÉTÉ", "zz", "k", "Beta", "eta", "theta"]
    rows = [(" ".join(r.choice(words, int(n))), str(r.choice(["en", "de"])), str(r.choice(["a", "b", "c", "Z"]))) for n in r.integers(0, 30, 150)]
    rows += [(None, None, None), ("", "fr", "a"), ("one two", "fr", "b"), ("9 8 7 !", "en", "only digits"), ("word " * 30_000, "en", "a"), ("alpha beta", None, "a")] + [("same row here", "en", "b")] * 12
    df = spark.createDataFrame([(*x, 7, "clash") for x in rows], "text string, lang string, source string, value int, item string").repartition(5)
    assert result(divergence.divergences(df)) == brute_divergence(rows)
    assert divergence.divergences(df.where("false")).count() == 0


def test_spilled_stripes_add_up(monkeypatch):
    rows = [("en", f"s{k % 3}", f"w{'abcdefghijk'[k % 11]} w{'abcdefg'[k % 7]} w{'abcdefg'[k % 7]}".encode()) for k in range(200)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 30])], names=["lang", "source", "text"]) for i in range(0, 200, 30)]

    def total():
        out = Counter()
        for b in (held := list(divergence.folded(iter(batches)))):
            for r in b.to_pylist():
                for c in r["counts"]:
                    out[r["term"], c["source"], "docs"] += c["docs"]
                    out[r["term"], c["source"], "n"] += c["n"]
        return out, len(held)

    whole, one = total()
    monkeypatch.setattr(divergence, "SPILL", 12)
    spilled, many = total()
    assert whole == spilled and one == 1 and many > 5


def test_divergence_counts_beyond_64_bits():
    """Weights of counts that no 64-bit product holds."""
    n = divergence.whole_numbers(np.array([10**12, 3 * 10**12]), 4 * 10**12)
    counts = np.array([[10**12, 0], [0, 3 * 10**12]]).astype(n.dtype)
    p = divergence.weights(counts, n[None, :], 2)
    assert p[0, 0] == 1 + 10**9 * (10**12 + 2) // (10**12 + 4)
    assert divergence.apart(p[:, 0], p[:, 1])[0] == (int(p[0, 0]) - int(p[0, 1])) ** 2 // (int(p[0, 0]) + int(p[0, 1]))


def brute_search(docs, items, k=10):
    terms = lambda t: [x.translate(LOWER) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    own = [(i, Counter(w), len(w)) for i, w in ((i, terms(t)) for i, t in docs) if w]
    n, length = len(own), sum(x[2] for x in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        w = Counter(terms(text))
        scored = []
        for i, c, size in own:
            m = 100 - 75 + (75 * size * n) // length
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in w.items() if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def lines(rows):
    return sorted(tuple(-1 if v is None else v for v in r) for r in rows)


def test_search_by_hand(spark, monkeypatch):
    r = np.random.default_rng(4)
    words = [f"w{k}" for k in range(40)] + ["Été", "漢字", "UPPER", "x_y", "it's"]
    text = lambda n: " ".join(r.choice(words, int(n)))
    docs = [(int(i), text(n)) for i, n in enumerate(r.integers(1, 60, 200))]
    docs += [(500, None), (501, "  .. "), (502, "w1 " * 20_000), (None, "w1 w2 w3"), (None, "w1 w2 w3"), (503, "w1 w2 w3"), (503, "w1 w2 w3"), (504, "unheard")]
    items = [(int(i), text(n)) for i, n in enumerate(r.integers(1, 25, 8))] + [(90, None), (91, "nowhere"), (92, "w1 w1 w1 UPPER upper"), (93, "unheard")]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id bigint, text string, rank int, term string").repartition(3)
    it = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute_search(docs, items)
    assert lines(tuple(x) for x in lexical.ranked(df, it).collect()) == lines(want)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 200)  # several blocks of items
    assert lines(tuple(x) for x in lexical.ranked(df, it).collect()) == lines(want)
    assert lexical.ranked(df.where("false"), it).count() == 0
    assert lexical.ranked(df, it.where("false")).count() == 0


@pytest.mark.parametrize("width, items, step", [(1024, 2000, 32), (4, 1, 3)])
def test_sketches_bound_scores_and_spare_most_documents(width, items, step, monkeypatch):
    monkeypatch.setattr(lexical, "WIDTH", width)
    monkeypatch.setattr(lexical, "ITEMS", items)
    monkeypatch.setattr(lexical, "STEP", step)
    r = np.random.default_rng(8)
    asked = lexical.Asked([(0, b"a b c"), (1, b"d d e f")])
    weight = np.array([900, 700, 500, 400, 300, 200])
    docs = [sorted(r.choice(6, int(r.integers(1, 4)), replace=False).tolist()) for _ in range(3000)]
    part = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array([60] * 3000), pa.array(docs, pa.list_(pa.int32())), pa.array([[1] * len(d) for d in docs], pa.list_(pa.int64()))], names=["id", "n", "terms", "tf"])
    best = [lexical.Best(10) for _ in asked.items]
    scored = lexical.searched(part, asked, weight, 3000, 180_000, best)
    assert scored < (0.3 if width > 6 else 0.8) * 2 * 3000
    impact = 10**9 // (1000 + 8 * 100)
    for j, (_, own, times) in enumerate(asked.items):
        exact = sorted(((-sum(int(weight[t]) * int(k) * impact for t, k in zip(own, times) if t in d), i) for i, d in enumerate(docs)))[:10]
        assert [(s, i) for s, _, i in best[j].rows] == exact
