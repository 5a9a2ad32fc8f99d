"""Tables in versions, and statistics kept by counters of days."""

import hashlib
import sys
import unicodedata
from pathlib import Path

from pyspark.sql import functions as F

from matchlake.functions import text as X
from matchlake.operators import maintained, stats
from matchlake.sources import versions
from tests.test_audits import frame, rec


def files(folder):
    return {p: hashlib.md5(p.read_bytes()).hexdigest() for p in Path(folder).rglob("*.parquet")}


def newer(old, new):
    """New rows replace old ones by id; a null value deletes."""
    return old.join(new, "id", "left_anti").unionByName(new.where("v is not null"))


def test_a_batch_touches_its_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.create(spark.range(1000).select(F.col("id"), (F.col("id") * 2).alias("v")), path, ["id"], buckets=16)
    before = files(path)
    change = spark.createDataFrame([(5, 7), (2000, 1), (8, None)], "id long, v long")
    assert versions.upsert(spark, path, "a", change, newer) == 1
    after = files(path)
    assert before.items() <= after.items()  # byte for byte
    assert len({p.parent.name for p in set(after) - set(before)}) <= 3
    assert versions.upsert(spark, path, "a", change, newer) == 1 and files(path) == after  # again: nothing
    want = {k: 2 * k for k in range(1000)}
    assert dict(map(tuple, versions.read(spark, path, 0).collect())) == want
    want.update({5: 7, 2000: 1})
    del want[8]
    assert dict(map(tuple, versions.read(spark, path).collect())) == want
    assert versions.upsert(spark, path, "none", change.limit(0), newer) == 2 and set(files(path)) == set(after)


def test_empty_tables_and_emptied_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, 1), (None, 2)], "id long, v long")
    versions.create(rows.limit(0), path, ["id"], buckets=4)
    assert versions.read(spark, path).count() == 0
    versions.upsert(spark, path, "fill", rows, lambda old, new: old.unionByName(new))
    assert {tuple(r) for r in versions.read(spark, path).collect()} == {(1, 1), (None, 2)}
    versions.upsert(spark, path, "clear", rows, lambda old, new: old.limit(0))
    assert versions.read(spark, path).count() == 0 and versions.read(spark, path, 1).count() == 2


def test_an_attempt_lost_before_its_manifest_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.create(spark.range(10), path, ["id"], buckets=4)
    versions._write(spark.range(100, 110), path, ["id"], 4)
    assert versions.read(spark, path).count() == 10
    assert versions.upsert(spark, path, "a", spark.range(100, 110), lambda old, new: old.unionByName(new)) == 1
    assert versions.read(spark, path).count() == 20


def test_counters_equal_a_full_count(spark, tmp_path):
    path = str(tmp_path / "c")
    team = lambda p, c, f: ([p], c, f)
    old = [rec(str(k), team("p", ["a", "b"], "f"), team("q", ["c", "d"], None), day=f"2026-01-{k % 20 + 1:02d}") for k in range(40)]
    maintained.start(frame(spark, *old), path, buckets=8)
    held = files(path)
    gone, moved, new = old[3], old[4], rec("99", team("z", ["a"], "g"), team("q", ["b", "a"], "f"), season=None, day="2026-02-01")
    after = rec("4", team("p", ["a", "b"], "f"), team("q", ["c", "d"], None), season=1, day="2026-01-09")
    for _ in range(2):
        maintained.apply(spark, path, "run", maintained.delta(frame(spark, gone, moved), frame(spark, after, new)))
    end = frame(spark, *(r for r in old if r[0] not in ("3", "4")), after, new)
    one = spark.range(1).select(F.col("id").cast("string"))
    want = {tuple(r) for r in stats.contract_stats(end, one, one).where("name not in ('totals.characters', 'totals.players')").collect()}
    assert {tuple(r) for r in maintained.totals(versions.read(spark, path)).collect()} == want
    assert held.items() <= files(path).items()
    assert not versions.read(spark, path).where("n <= 0").count()


def test_every_character_decomposes_as_unicode_says(spark):
    points = [k for k in range(1, sys.maxunicode + 1) if not 0xD800 <= k < 0xE000]
    names = ["".join(map(chr, points[k : k + 64])) for k in range(0, len(points), 64)] + [f"A{chr(k)}b{chr(k)}" for k in range(1, 0x3400)]
    got = spark.createDataFrame([(n,) for n in names], "name string").select("name", X.unicode_slug(F.col("name"))).collect()
    want = lambda s: "".join(x for x in unicodedata.normalize("NFKD", s).lower() if x.isascii() and x.isalnum())
    assert [(n, s) for n, s in got if s != want(n)] == []
    plan = spark.createDataFrame([("é",)], "name string").select(X.unicode_slug(F.col("name")))._jdf.queryExecution().toString()
    assert "Python" not in plan
