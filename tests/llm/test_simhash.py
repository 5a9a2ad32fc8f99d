import re

import numpy as np
import pytest
import xxhash

from matchlake.llm import simhash


def fingerprint(text, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w)] if len(w) < size else [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(v >> k & 1 for v in h) > len(h))


def classes(ids, fps, most):
    """The smallest id that each reaches, by all pairs."""
    p = {i: i for i in ids}

    def find(i):
        while p[i] != i:
            i = p[i]
        return i

    a = np.array(fps, dtype=np.uint64)
    for x, y in zip(*np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= most)):
        u, v = find(ids[x]), find(ids[y])
        p[max(u, v)] = min(u, v)
    return {i: find(i) for i in ids}


def test_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    fps = [fingerprint(r.text) for r in rows]
    want = classes([r.doc_id for r in rows], fps, 4)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert len(got) == len(rows)
    for r, f in zip(rows, fps):
        assert got[r.doc_id].fp % (1 << 64) == f
        assert got[r.doc_id].component_id == want[r.doc_id]


@pytest.mark.parametrize("split", [1500, 7])
def test_links_of_crowded_buckets(spark, monkeypatch, split):
    """Chains and dense clusters of fingerprints, with buckets dealt out over several tasks."""
    monkeypatch.setattr(simhash, "SPLIT_AT", split)
    r = np.random.default_rng(3)
    flips = lambda x, k: x ^ int(sum(1 << int(b) for b in r.choice(64, k, replace=False)))
    centre = int(r.integers(0, 1 << 62))
    fps = {0, centre, *(flips(centre, k) for k in (1, 2, 3, 4) for _ in range(25))}
    chain = int(r.integers(0, 1 << 62))
    for k in range(12):
        chain = flips(chain, 4)
        fps.add(chain)
    fps |= {flips(int(r.integers(0, 1 << 62)), 3) for _ in range(40)}
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)), i) for i, f in enumerate(fps)], "fp bigint, node bigint")
    found = {x.node: x.root for x in simhash.components(simhash.ball_links(df)).collect()}
    want = classes(list(range(len(fps))), fps, 4)
    assert {i: found.get(i, i) for i in want} == want


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \t\n", None), (4, "one two", "x"), (4, "one two", "x"), (5, "ONE two", "y"), (6, "w " * 50_000, "z"), (None, "lone", "n")]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string, component_id string")).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r.component_id for r in out}
    assert (got[1], got[2], got[3], got[4], got[5], got[6], got[None]) == (1, 1, 1, 4, 4, 6, None)
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, component_id string")).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in kept) == [(0, "n"), (1, "a"), (4, "x"), (6, "z")]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 200), (200, 300)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got.get(k, k) for k in range(41)} == {0} and {got.get(k, k) for k in range(100, 160)} == {100} and got[300] == 200
    assert simhash.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_links_over_rows_without_an_id(spark, monkeypatch):
    prints = [(1, 0), (None, 15), (2, 255), ((1 << 62) + 3, 0x7FFF << 40), (None, (0x7FFF << 40) + 1), (None, 0x5555 << 44)]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *a: spark.createDataFrame(prints, "doc_id bigint, fp bigint"))
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).collect())
    assert got == sorted([("1", "1"), ("None", "1"), ("2", "1"), (str((1 << 62) + 3), str((1 << 62) + 3)), ("None", str((1 << 62) + 3)), ("None", "None")])


def test_the_query_itself(spark):
    """Its own columns, against all pairs."""
    from matchlake.llm import queries

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    fps = [fingerprint(r.text) for r in rows]
    want = classes([r.doc_id for r in rows], fps, 4)
    got = sorted(tuple(r) for r in queries.op10_simhash(spark, "/root/testdata/sf0.001").select("doc_id", "fingerprint", "component_id").collect())
    assert got == sorted((r.doc_id, f"{f:016x}", want[r.doc_id]) for r, f in zip(rows, fps))
