"""Duplicates as classes against all pairs of records; links as components."""

import random

import pytest

from matchlake.operators import dupes, linking
from matchlake.plans import audits
from matchlake.plans import proxies as V
from matchlake.plans.registry import QUERIES

ROW = "id string, sig string, durationSec int, channel string, publishedAt string, has_override boolean, has_fuse boolean, dhash bigint"


def made(n, seed):
    """Records of few different values, so that many agree in all and many in all but some."""
    r = random.Random(seed)
    return [(f"r{k:04}", r.choice("ab") if r.random() < 0.9 else None, r.choice([0, 50, 50, 51, 60, 64, 200]), r.choice("xy"), r.choice("12"), r.random() < 0.1, r.random() < 0.4, r.choice([0, 0, 7, 1023, (1 << 40) - 1, None])) for k in range(n)]


def over_records(df):
    """The same over all pairs of records."""
    pairs = dupes.match_pairs(df.drop("dhash"))
    return dupes.flags(dupes.precedence(dupes.tier(dupes.with_hash_distance(pairs, df.where("dhash is not null").select("id", "dhash")))))


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("min_tier", ["A", "B"])
def test_classes_do_what_pairs_do(spark, seed, min_tier):
    df = spark.createDataFrame(made(120, seed), ROW)
    classes = dupes.collapsed(df)
    judged = dupes.flags(dupes.precedence(dupes.tier(dupes.with_ham(dupes.class_pairs(classes)))))
    of = dupes.members(df, classes)
    line = lambda r: (r.drop.id, r.keep.id, r.tier, r.ham, r.delta)
    want = dupes.actionable(over_records(df), min_tier).collect()
    got = dupes.actionable_members(judged, classes, of, min_tier).collect()
    assert sorted(map(str, map(line, got))) == sorted(map(str, map(line, want))) and len(got) > 20
    assert {(r.tier, r.n) for r in dupes.tier_counts(judged).collect()} == {(r.tier, r.n) for r in dupes.tier_counts(over_records(df)).collect()}
    assert of.count() == df.where("sig is not null and durationSec > 0").count()


def test_links_are_counted_without_pairs(spark):
    rows = made(150, 3)
    df = spark.createDataFrame(rows, ROW)
    got = {r["class"]: (r.n, r.links, r.cross) for r in dupes.link_counts(df).collect()}
    of = {r.id: r["class"] for r in dupes.members(df, dupes.collapsed(df, dupes.LENGTH), dupes.LENGTH).collect()}
    for i, sig, dur, channel, *_ in rows:
        if sig is not None and dur > 0:
            own = [o for o in rows if o[0] != i and o[1] == sig and o[2] > 0 and abs(o[2] - dur) <= 90]
            assert got[of[i]][1:] == (len(own), sum(o[3] != channel for o in own))


def test_a_signature_of_a_third_of_all_records(spark):
    """Pairs of classes grow with the classes; each record is a member of one; copies of one slug are a star."""
    n_pairs = []
    for n in (2000, 4000):
        df = spark.range(n).selectExpr(
            "lpad(id, 8, '0') as id", "if(id % 3 = 0, 'hot', concat('s', id)) as sig", "cast(100 + id % 7 as int) as durationSec", "cast(id % 2 as string) as channel",
            "cast(id % 5 as string) as publishedAt", "false as has_override", "id % 4 = 0 as has_fuse", "cast(null as bigint) as dhash",
        )
        classes = dupes.collapsed(df)
        n_pairs.append(dupes.class_pairs(classes).count())
        assert dupes.members(df, classes).count() == n
        action = dupes.actionable_members(dupes.flags(dupes.precedence(dupes.tier(dupes.with_ham(dupes.class_pairs(classes))))), classes, dupes.members(df, classes))
        assert action.count() == action.selectExpr("drop.id").distinct().count() > n // 4
    assert n_pairs[1] <= 2.2 * n_pairs[0] and n_pairs[1] < 100_000
    handles = spark.range(10_000).selectExpr("lpad(id, 6, '0') as id", "if(id % 2 = 0, 'Same Name', 'same-name') as handle")
    stars = dupes.entity_pairs(handles)
    assert {(r.kind, r.n) for r in stars.selectExpr("kind").groupBy("kind").count().withColumnRenamed("count", "n").collect()} == {("slug", 9_999), ("leet", 9_999)}
    named = dupes.entity_classes(stars)
    assert named.count() == 10_000 and [tuple(r) for r in named.select("class", "kinds").distinct().collect()] == [("000000", "slug+leet")]


def test_components(spark):
    r = random.Random(4)
    links = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(500, 500), (7, 3)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)]
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        u, v = find(a), find(b)
        root[max(u, v)] = min(u, v)
    got = linking.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {x.id: x["class"] for x in got} == {x: find(x) for x in root if find(x) != x} and len(got) == len({x.id for x in got})
    assert linking.components(spark.createDataFrame([], "a string, b string")).count() == 0


def alike(rows):
    """All pairs of made records (a, b, delta, intra), by loops."""
    own = sorted(r for r in rows if r[1] is not None and r[2] > 0)
    return sorted((a[0], b[0], abs(a[2] - b[2]), a[3] == b[3]) for k, a in enumerate(own) for b in own[k + 1 :] if a[1] == b[1] and abs(a[2] - b[2]) <= 90)


def test_pairs_of_records_that_agree_are_listed(spark, monkeypatch):
    rows = made(60, 5)
    monkeypatch.setattr(V, "copies", lambda *_: spark.createDataFrame(rows, ROW))
    assert sorted(tuple(r) for r in audits.dupe_pairs(spark, "").collect()) == alike(rows)
    assert sorted(tuple(r) for r in audits.dupe_pairs_cross(spark, "").collect()) == [p for p in alike(rows) if not p[3]]


def test_tiers_of_records_that_agree(spark, monkeypatch):
    """Of two that differ in their channel alone the smaller id stays, also where a smaller one of the other's class stays before it."""
    rows = [("1", "s", 60, "x", "1", False, False, 0), ("2", "s", 60, "y", "1", False, False, 0), ("3", "s", 60, "x", "1", False, False, 0), *(r for r in made(40, 6))]
    df = spark.createDataFrame(rows, ROW)
    monkeypatch.setattr(V, "copies", lambda *_: df.drop("dhash"))
    monkeypatch.setattr(V, "copy_hashes", lambda *_: df.select("id", "dhash"))
    line = lambda r: (r.keep.id, r.drop.id, r.tier, r.rule, r.ham, r.delta, ",".join(r["flags"]))
    got = sorted(map(str, map(tuple, audits.dupe_tiers(spark, "").collect())))
    assert got == sorted(map(str, map(line, over_records(df).collect())))
    assert str(("2", "3", "A", "id-tiebreak", 0, 0, "")) in got and len(got) == len(alike(rows))


#: Three handles of one slug, one of them not its smallest id; one an edit away, and one with digits behind.
NAMES = [("1", "Foo Bar", True), ("2", "foo-bar", False), ("3", "FooBar", False), ("4", "Foo Baz", False), ("5", "foobar22", False)]


@pytest.fixture
def named(spark, monkeypatch):
    monkeypatch.setattr(V, "handles", lambda *_: spark.createDataFrame(NAMES, "id string, handle string, featured boolean"))


def test_each_handle_of_a_slug_is_linked_to_its_typos(spark, named):
    assert {(r.a, r.b) for r in QUERIES["entity_dupes_typo"](spark, "").collect()} == {("1", "4"), ("2", "4"), ("3", "4")}


def test_each_handle_of_a_slug_is_linked_to_its_affixes(spark, named):
    assert {(r.a, r.b) for r in QUERIES["entity_dupes_affix"](spark, "").collect()} == {("1", "5"), ("2", "5"), ("3", "5")}


def test_all_pairs_of_handles_are_ranked(spark, monkeypatch):
    names = [(i, f"{h} Of The North", f) for i, h, f in NAMES[:4]]
    monkeypatch.setattr(V, "handles", lambda *_: spark.createDataFrame(names, "id string, handle string, featured boolean"))
    got = {tuple(sorted((r.canonical, r.other))): r.kinds for r in audits.entity_ranked(spark, "").collect()}
    assert got == {(a, b): "typo" if b == "4" else "slug+leet" for a in "123" for b in "234" if a < b}
