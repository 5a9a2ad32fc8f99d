"""Mixing, sharding, the pipeline, and the queries' SQL."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from matchlake.llm import mixing, quality, queries, sharding
from tests.llm.test_filters import base, contaminated
from tests.test_oracles import TABLES, rows

SF = "/root/testdata/sf0.001"


def test_targets_fill_up_by_weight(spark):
    sizes = {"b": 100, "a": 10, None: 1000, "c": 5, "": 0, "é": 300}
    df = spark.createDataFrame([(k is None, k or "", v) for k, v in sizes.items()], "no_source boolean, source string, source_size bigint")
    got = {None if r.no_source else r.source: r.target for r in mixing.targets(df).collect()}
    names = sorted(sizes, key=lambda k: (k is None, (k or "").encode()))
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(names)}
    left, want, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[k] for k in open_)
        full = {k for k in open_ if level * weight[k] >= 2 * sizes[k]}
        if not full:
            want |= {k: level * weight[k] for k in open_}
            break
        for k in full:
            want[k] = 2 * sizes[k]
            left -= want[k]
        open_ -= full
    assert got == pytest.approx(want)


def test_mix(spark):
    texts = [(k, " ".join("w" * 1 for _ in range(k % 40)), "hot" if k % 3 else f"s{k % 7}") for k in range(900)] + [(5000, None, "s0"), (5001, "", None), (5002, "a b", None), (5002, "a b", None)]
    df = spark.createDataFrame([(*t, "x") for t in texts], "doc_id int, text string, source string, size string")
    out = mixing.mixed(df).collect()
    words = sum(round(t) for t in {r.source: r.target for r in out}.values())
    assert len(out) == len(texts)
    by = defaultdict(list)
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        assert (r.position is None) == (r.taken == 0) and (r.position is None or 0 <= r.position <= words)
        by[r.source].append(r)
    for own in by.values():
        assert sum(r.size for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.5
    again = mixing.mixed(df.repartition(7)).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))
    assert mixing.mixed(df.limit(0)).count() == 0
    order = mixing.curriculum(df)
    assert order.columns == df.columns
    assert order.count() == sum((r.position is not None) + (r.again is not None) for r in out)


def test_moment_inverts_the_schedule(spark):
    from pyspark.sql import functions as F

    for slope in (0.0, 1.0, -1.0, 0.3):
        for share in (0.0, 0.1, 0.5, 0.99, 1.0):
            t = spark.range(1).select(mixing.moment(F.lit(slope), F.lit(share))).first()[0]
            assert t + slope / 2 * (t * t - t) == pytest.approx(share, abs=1e-9)


def test_shares_follow_the_schedule(spark):
    """In each tenth of the training words come from the sources as their schedules say at that time."""
    texts = [(k, " ".join(["w"] * (1 + k % 9)), f"s{k % 3}") for k in range(9000)]
    out = mixing.mixed(spark.createDataFrame(texts, "doc_id int, text string, source string")).collect()
    target = {r.source: r.target for r in out}
    slope = dict(zip(sorted(target), mixing.SLOPES))
    whole = sum(target.values())
    given = lambda t: {s: target[s] * (t + slope[s] / 2 * (t * t - t)) for s in target}
    got = defaultdict(Counter)
    for r in out:
        first = min(r.size, r.taken)
        for at, n in ((r.position, first), (r.again, r.taken - first)):
            if at is not None:
                got[min(9, int(10 * at / whole))][r.source] += n
    time = [0.0]
    for k in range(1, 11):  # when a tenth more has been given, by bisection
        a, b = time[-1], 1.0
        for _ in range(60):
            mid = (a + b) / 2
            a, b = (mid, b) if sum(given(mid).values()) < k * whole / 10 else (a, mid)
        time.append(b)
    for k in range(10):
        for s in target:
            want = given(time[k + 1])[s] - given(time[k])[s]
            assert abs(got[k][s] - want) <= 30, (k, s)
    assert max(got[9][s] - got[0][s] for s in target) > whole / 100


@pytest.mark.parametrize("n, hot", [(0, 0), (5, 0), (700, 0), (700, 300), (3000, 1100)])
def test_shards(spark, n, hot):
    rows = [(k, "hot" if k < hot else f"t{k // 3}" if k % 2 else f"alone{k}", "x") for k in range(n)]
    if n > 100:
        rows += [(None, None, "x"), (None, "", "x"), (7, "ü", "x"), (7, "ü", "x")]
    out = sharding.balanced_shards(spark.createDataFrame(rows, "doc_id int, text string, shard string")).collect()
    assert len(out) == len(rows)
    held = Counter(r.shard for r in out)
    counts = [held[s] for s in range(16)]
    assert max(counts) - min(counts) <= 1
    assert sorted((r.shard, r.slot) for r in out) == [(s, k) for s in range(16) for k in range(held[s])]
    text = {r[0]: r[1] for r in rows}
    if n > 100:
        group = defaultdict(Counter)
        for r in out:
            if r.doc_id is not None:
                group[text[r.doc_id]][r.shard] += 1
        small = [c for t, c in group.items() if t != "hot" and sum(c.values()) > 1]
        assert sum(len(c) == 1 for c in small) >= 0.9 * len(small)
        if hot:
            fewest = math.ceil(hot / (len(rows) / 16))
            assert sum(k for _, k in group["hot"].most_common(fewest + 3)) >= 0.8 * hot


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def passes(rows, labels):
    """The rows that the quality rules keep, counted by hand. rows: (id, text, lang)."""
    scored = {}
    for i, text, lang in rows:
        n, chars, symbols, dup, again = base(text)
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        upper = sum("A" <= c <= "Z" for c in text or "")
        share = {"symbol_share": symbols / chars if chars else 0, "dup_line_share": dup / len(lines) if lines else 0, "repeat_share": again / n if n else 0, "upper_share": upper / chars if chars else 0}
        steps = [sum(x >= share[r] for x in grid) for r, grid in quality.STEPS.items()]
        scored[i] = (n < 20 or 100 * again > 30 * n, steps, lang, text)
    worst = {}
    for i, q in labels:
        if q is not None:
            worst[i] = min(q, worst.get(i, 1))
    texts = {}
    for i, q in worst.items():
        if i in scored and not scored[i][0]:
            key = scored[i][2:]
            texts[key] = (min(q, texts.get(key, (1, 0))[0]), scored[i][1])
    last, place = {}, {}
    langs = {x[2] for x in scored.values()}
    for lang in langs:
        own = [(hashlib.md5(t.encode()).hexdigest() < "8", steps) for (x, t), (q, steps) in texts.items() if x == lang and q >= 1]
        moves = [(sum(orders and steps[r] <= k for orders, steps in own), k, r) for r in range(len(quality.STEPS)) for k in range(quality.N_STEPS)]
        place[lang] = {(r, k): m for m, (_, k, r) in enumerate(sorted(moves))}
        tried = [min(place[lang].get((r, k), quality.N_MOVES) for r, k in enumerate(steps)) for orders, steps in own if not orders]
        n, last[lang] = len(tried), -1
        for m in range(quality.N_MOVES):
            lost = sum(x <= m for x in tried)
            if lost >= n * 0.05 or sum(math.comb(n, j) * 0.05**j * 0.95 ** (n - j) for j in range(lost + 1)) > 0.05 / len(langs):
                break
            last[lang] = m
    return {i for i, (failed, steps, lang, _) in scored.items() if not failed and min(place[lang].get((r, k), quality.N_MOVES) for r, k in enumerate(steps)) > last[lang]}


def training_order(rows):
    """(position, id) of each use of each row, by hand. rows: (id, text, source)."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    whole = Counter()
    for i, _, s in rows:
        whole[s] += size[i]
    names = sorted(whole, key=lambda k: (k is None, (k or "").encode()))
    weight, slope = ({s: v[k % 3] for k, s in enumerate(names)} for v in ((3, 1, 2), (0.0, 1.0, -1.0)))
    full = set()
    while True:
        open_ = [s for s in names if s not in full]
        level = (1.5 * sum(whole.values()) - sum(2 * whole[s] for s in full)) / sum(weight[s] for s in open_) if open_ else math.inf
        more = {s for s in open_ if 2 * whole[s] <= level * weight[s]}
        if not more:
            break
        full |= more
    target = {s: 2.0 * whole[s] if s in full else level * weight[s] for s in names}
    given = lambda t: sum(round(target[s]) * (t + slope[s] / 2 * (t * t - t)) for s in names)
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    out = []
    for s in names:
        at = 0
        for i, _, _ in sorted((r for r in rows if r[2] == s), key=lambda r: md5(f"{r[0]} {md5(r[1] or '')}")):
            for k in range(2):
                start = at + k * whole[s]
                if size[i] and start < round(target[s]):
                    c, a = min(1.0, start / target[s]), slope[s] / 2
                    t = c if a == 0 else (math.sqrt((1 - a) ** 2 + 4 * a * c) - (1 - a)) / (2 * a)
                    out.append((given(t), i))
            at += size[i]
    return sorted(out)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_pipeline(spark):
    """All five stages by hand; of the last, that shards are even and that their slots follow the training order."""
    import corpus_pipeline
    from tests.llm.test_near_text import labels as near

    table = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    docs = {r.doc_id: r for r in table("documents").collect()}
    kept = passes([(r.doc_id, r.text, r.lang) for r in docs.values()], [(r.doc_id, r.quality) for r in table("labels").collect()])
    assert 0 < len(kept) < len(docs)
    same, pairs = near([(i, docs[i].text) for i in kept])
    single = {i for i in kept if same[i] == i}
    assert pairs and len(single) < len(kept)
    items = [tuple(r) for r in table("benchmark").collect()]
    clean = {i for i in single if not contaminated(docs[i].text, items)[1]}
    order = training_order([(i, docs[i].text, docs[i].source) for i in clean])
    out = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for _, i in order)
    held = defaultdict(list)
    for r in sorted(out, key=lambda r: r.slot):
        held[r.shard].append(r)
    counts = [len(held[s]) for s in range(16)]
    assert max(counts) - min(counts) <= 1
    places = defaultdict(list)
    for k, (_, i) in enumerate(order):
        places[i].append(k)
    for s in range(16):
        assert [r.slot for r in held[s]] == list(range(counts[s]))
        at = -1
        for r in held[s]:  # each row may be any use of its document that is still ahead
            at = next(k for k in places[r.doc_id] if k > at)


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_tables(spark, stage):
    """Null ids and texts, repeated rows, clashing columns, and no rows at all."""
    import corpus_pipeline

    name, f = corpus_pipeline.STAGES[stage]
    clash = ("text_hash", "found", "_id", "_many", "shard", "size", "kept", "position", "_row", "place")
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, long, "en", "a"), (1, long, "en", "a"), (2, None, None, None), (None, long + " x", "en", "a"), (None, None, "de", None), (3, "", "en", "b"), (4, " ".join(f"v{k}" for k in range(50)), None, "b"), (None, " ".join(f"u{k}" for k in range(50)), "fr", None)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint" + "".join(f", {c} string" for c in clash)
    df = spark.createDataFrame([(*r, len(r[1] or ""), *clash) for r in rows], schema)
    out = f(spark, df, SF)
    if name != "sharding":
        assert out.columns == df.columns
    got = out.collect()
    ids = Counter(r.doc_id for r in got)
    if name == "quality_rules":
        assert len(got) == 5 and ids == {1: 2, None: 2, 4: 1}
    if name == "near_dedup":  # the first text and that of one more word are alike; so are null and empty ones
        assert ids == {1: 1, 2: 1, 4: 1, None: 1}
    if name in ("decontamination", "sharding"):
        assert len(got) == len(rows)
    if name == "mixing":
        assert ids[2] == ids[3] == 0 and ids[1] >= 2
    empty = f(spark, df.limit(0), SF)
    assert empty.count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_shards_of_documents(spark):
    """The query's columns, counted by hand."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    out = queries.op6_sharding(spark, SF)
    assert out.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows)
    for r in rows:
        raw = (r.text or "").encode()
        assert (got[r.doc_id]["size"], got[r.doc_id].text_crc32, got[r.doc_id].law, got[r.doc_id].grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    held = Counter(r.shard for r in got.values())
    assert max(held[s] for s in range(16)) - min(held[s] for s in range(16)) <= 1
    assert sorted((r.shard, r.slot) for r in got.values()) == [(s, k) for s in range(16) for k in range(held[s])]
