"""As-of sweeps, keyword dictionaries, hash trees, free numbers."""

import random
import re

from pyspark.sql import functions as F

from matchlake.functions import text as X
from matchlake.operators import asof, periods, quality, resolve


def test_as_of_over_pieces(spark):
    r = random.Random(2)
    starts = sorted(r.sample(range(1000), 60))
    rows = [(k, r.choice([None, 500, r.randrange(-50, 1100)])) for k in range(2000)]  # a key that a third of the rows share
    s = spark.createDataFrame([(x, f"s{x}") for x in starts] + [(None, "never")], "start int, name string")
    got = {x.id: (x.key, x["_at"] and x["_at"].name) for x in asof.as_of(spark.createDataFrame(rows, "id int, key int"), "key", s, "start").collect()}
    for k, key in rows:
        before = [x for x in starts if key is not None and x <= key]
        assert got[k] == (key, f"s{before[-1]}" if before else None)
    assert len(got) == 2000 and asof.as_of(spark.createDataFrame(rows, "id int, key int"), "key", s.where("false"), "start").where("_at is not null").count() == 0


def test_many_windows_are_swept_not_broadcast(spark, monkeypatch):
    day = F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int") * 3), "yyyy-MM-dd")
    end = F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int") * 3 + 2), "yyyy-MM-dd")
    windows = spark.range(12_000).select(F.concat(F.lit("v"), "id").alias("version"), day.alias("start"), end.alias("end"))
    df = spark.range(9_000).select("id", F.date_format(F.date_add(F.lit("1999-12-30").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("publishedAt"))
    swept = periods.with_patch(df, windows)
    plan = swept._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan
    got = swept.collect()
    monkeypatch.setattr(periods, "MOST", 1 << 30)
    want = periods.with_patch(df, windows).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 9_000
    assert sum(x.patchVersion is None for x in got) == 2 + sum((k - 2) % 3 == 2 for k in range(2, 9_000))


def test_dictionary_as_each_alias_in_turn(spark):
    aliases = [("Red", "r"), ("red dot", "rd"), ("c++", "cpp"), ("a.b", "ab"), ("été", "e"), ("dot-com", "dc"), ("x_1", "x1"), ("+x", "px"), ("dots", "d2"), ("rock", "k1"), ("ROCK", "k2"), ("a  b", "two"), ("", "none")]
    texts = ["a red dot.", "redder", "c++x", "c++ x", "see a.b!", "aXb", "été", "xétéy", "the dot-com boom", "x_1", "x_11", "q+x", "+x", "Rock", None, "", "...", "a  b", "a b", "red " * 3000]
    rows = [(k, t) for k, t in enumerate(texts)]
    al = spark.createDataFrame([(a, i, k) for k, (a, i) in enumerate(aliases)], "alias string, key string, ord int")
    df = spark.createDataFrame(rows, "id int, text string")
    got = {x.id: x.key for x in resolve.keyword_ids(df, al).collect()}
    boundary = lambda a: rf"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])"  # noqa: E731, ARG005
    tried = sorted([x for x in enumerate(aliases) if x[1][0]], key=lambda x: (-len(x[1][0]), x[0]))
    for k, t in rows:
        want = next((i for _, (a, i) in tried if t and re.search(rf"(?:{boundary(a)}){re.escape(a.lower())}(?:{boundary(a)})", t.lower())), None)
        assert got.get(k) == want, (t, got.get(k), want)
    assert {x.id: x.key for x in df.select("id", X.scan_alias(F.col("text"), [("red", "r"), ("red dot", "rd")]).alias("key")).where("key is not null").collect()} == {k: v for k, v in got.items() if v in ("r", "rd")}
    assert resolve.keyword_ids(df, al.where("false")).count() == 0


def test_trees_add_up_and_find_changes(spark):
    old = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("id"), (F.col("id") % 7).alias("v"), F.when(F.col("id") % 3 > 0, "x").alias("w"))
    new = old.where("id <> 'k17'").withColumn("v", F.when(F.col("id") == "k42", 99).otherwise(F.col("v"))).unionByName(spark.createDataFrame([("new", 1, None)], "id string, v int, w string"))
    a, b = quality.hash_tree(old), quality.hash_tree(new)
    parts = quality.hash_tree(old.where("v < 3")).unionByName(quality.hash_tree(old.where("v >= 3"))).groupBy("node").agg(F.sum("rows").alias("rows"), F.sum("hash").alias("hash"))
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, a.collect()))
    ranges = quality.changed_ranges(a, b)
    assert 1 <= ranges.count() <= 3
    assert {(r.id, r.change) for r in quality.changed_keys(old, new, ranges).collect()} == {("k17", "removed"), ("k42", "changed"), ("new", "added")}
    assert quality.changed_ranges(a, quality.hash_tree(old.repartition(7))).count() == 0
    assert quality.changed_ranges(a, quality.hash_tree(old.where("false"))).count() == a.where("length(node) = 3").count()
    assert quality.fingerprint(old).first() == quality.fingerprint(old.repartition(3)).first()


def test_smallest_free_numbers(spark):
    taken = [("a",), ("a-2",), ("a-3",), ("a-5",), ("b-2",), ("c",), ("c-3",), ("d",), ("d-02",), ("d-1",)]
    got = resolve.mint_ids(spark.createDataFrame([(x,) for x in "abcdea"], "slug string"), spark.createDataFrame(taken, "id string"))
    assert {(r.slug, r.id) for r in got.collect()} == {("a", "a-4"), ("b", "b"), ("c", "c-2"), ("d", "d-2"), ("e", "e")}
