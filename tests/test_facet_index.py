"""The facet index against the predicates on records."""

import random
from collections import Counter

from pyspark.sql import functions as F

from matchlake.operators import facet_index, query
from tests.test_audits import frame, rec

ASKED = [
    {}, {"sources": ["x", "g"], "groups": {"g": ["y"]}}, {"patches": ["S0", "1.2"]}, {"patches": ["Beta"]}, {"fuses": ["f", "g"]}, {"chars": ["a", "b"]}, {"chars": ["a", "a", "c"]},
    {"chars": ["a", "b"], "same_side": True}, {"players": ["p1", "p2"]}, {"q": "P1 p"}, {"q": "nobody"}, {"chars": ["zz"]},
    {"sources": ["x"], "patches": ["S1"], "fuses": ["f"], "chars": ["a", "b"], "players": ["p0", "p3"], "q": "p"},
]


def test_same_as_browse(spark, tmp_path):
    rnd = random.Random(7)
    team = lambda: (rnd.sample([f"p{k}" for k in range(6)], rnd.randint(0, 2)), rnd.sample("abcd", rnd.randint(0, 3)), rnd.choice(["f", "g", None]))
    made = [rec(str(k), team(), team(), season=rnd.choice([0, 1, None]), version=rnd.choice(["1.1", "1.2", None]), channel=rnd.choice(["x", "y", None]), day=rnd.choice(["2026-01-01", "2026-01-02", None])) for k in range(300)]
    df = frame(spark, *made, made[5], made[5]).withColumn("value", F.lit("clash"))
    facet_index.build(df, str(tmp_path / "i"))
    for asked in ASKED:
        got, want = facet_index.browse(spark, str(tmp_path / "i"), **asked), query.browse(df, **asked)
        assert got.columns == want.columns
        assert Counter(r.id for r in got.collect()) == Counter(r.id for r in want.collect()), asked


def test_blocks_without_an_answer_are_not_read(spark, tmp_path):
    none = rec("0", ([], [], None), ([], [], None))
    k = F.col("k")
    df = spark.range(100_000).withColumnRenamed("id", "k").join(frame(spark, none)).withColumns({"id": k.cast("string"), "publishedAt": F.lpad(k.cast("string"), 6, "0"), "channel": F.when(k == 70_000, "one").otherwise("c")}).drop("k")
    facet_index.build(df, str(tmp_path / "i"))
    got = facet_index.browse(spark, str(tmp_path / "i"), sources=["one"])
    assert [r.id for r in got.collect()] == ["70000"]
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()


def test_an_empty_table(spark, tmp_path):
    facet_index.build(frame(spark, rec("0", ([], [], None), ([], [], None))).limit(0), str(tmp_path / "i"))
    assert facet_index.browse(spark, str(tmp_path / "i"), chars=["a"]).count() == 0 and facet_index.browse(spark, str(tmp_path / "i")).count() == 0
