"""Title, name and date rules on literal cases."""

import pytest
from pyspark.sql import functions as F

from matchlake.functions import text as X
from matchlake.operators import merge, periods, titles

BRAND = "ARENA"


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("x")).first()[0]


@pytest.mark.parametrize(
    "title, left, right",
    [
        ("ARENA ▰ Nimbus (Fox-Crane) vs Pebble (Crane-Otter) ▰ Weekly Finals", "Nimbus", "Pebble"),
        ("FRESH BUILD ARENA ▰ A (x-y) vs B (z-w)", "A", "B"),
        ("Maple Grove (Heron-Fox) vs Tide77 (Crane-Fox) ▰ ARENA best of the week", "Maple Grove", "Tide77"),
        ("  ARENA ▰  A　(x-y)  vs  B (z) ▰ end", "A", "B"),
        ("ARENA ▰ no match here", None, None),
        ("", None, None),
    ],
)
def test_titles(spark, title, left, right):
    row = titles.parse_titles(spark.createDataFrame([("i", title)], "id string, title string"), BRAND).first()
    assert ((row.segs[0].players, row.segs[1].players) if row.segs else (None, None)) == (left, right)
    assert (row.fail_stage is None) == (left is not None)


@pytest.mark.parametrize(
    "seg, players",
    [
        ("RANK 7 NA Quartz", ["Quartz"]),
        ("Rank 2 Duo! Fern & Moss", ["Fern", "Moss"]),
        ("RANK 4 DUO ASIA! Y", ["Y"]),
        ("Cobalt J #8 Rank", ["Cobalt J"]),
        ("Linden-Basalt", ["Linden-Basalt"]),
        ("A -B + C", ["A", "B", "C"]),
        ("RANK 1 RANK 2 Y #3 rank", ["Y"]),
        ("Birch30 + Aster41", ["Birch30", "Aster41"]),
    ],
)
def test_players(spark, seg, players):
    assert one(spark, seg, lambda c: X.split_players(X.strip_accolades(c))) == players


@pytest.mark.parametrize(
    "text, season, patch",
    [
        ("(Season 3)\nPatch: 2nd July 2021", 3, "2021-07-02"),
        ("Season 9 then (Season 4)", 4, None),
        ("Patch: 30th feb 2021", None, "2021-03-02"),
        ("patch : mid-season\nmore", None, "mid-season"),
        ("", None, None),
    ],
)
def test_labels(spark, text, season, patch):
    assert (one(spark, text, X.labeled_season), one(spark, text, X.patch_label)) == (season, patch)


def osa(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_one_edit(spark):
    words = ["", "a", "ab", "ba", "abc", "acb", "bac", "abcd", "abdc", "heron", "hern", "heeron", "heorn", "otter", "ottera", "fox"]
    rows = [(a, b) for a in words for b in words]
    got = spark.createDataFrame(rows, "a string, b string").select(X.within_one_edit(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [osa(a, b) <= 1 for a, b in rows]


@pytest.mark.parametrize("iso, sec", [("PT9M4S", 544), ("PT1H", 3600), ("P1DT2S", 0), ("", 0), ("PT", 0)])
def test_duration(spark, iso, sec):
    assert one(spark, iso, X.iso_duration) == sec


@pytest.mark.parametrize("name, slug", [("Éric Ü.", "ericu"), ("ＡＢＣ", "abc"), ("日本", ""), ("x_Y-9", "xy9"), (None, None)])
def test_unicode_slug(spark, name, slug):
    assert one(spark, name, X.unicode_slug) == slug


def dims(spark):
    s = spark.createDataFrame([(0, "2020-03-10", "2020-09-15", None), (1, "2020-09-15", None, None)], periods.SEASONS)
    p = spark.createDataFrame([("3.0", "2020-03-10"), ("3.2", "2020-05-12"), ("4.0", "2020-09-15"), ("4.5", "2021-01-19")], "version string, start string")
    return s, p


@pytest.mark.parametrize(
    "day, label, season, patch, graced",
    [
        ("2020-03-09", None, None, None, False),
        ("", None, None, None, False),
        ("2020-03-10", None, 0, "3.0", False),
        ("2020-09-14", None, 0, "3.2", False),
        ("2020-09-15", None, 1, "4.0", False),
        ("2020-09-16", 0, 0, None, True),
        ("2020-09-17", 0, 1, "4.0", False),
        ("2021-01-19T10:00:00Z", None, 1, "4.5", False),
    ],
)
def test_periods(spark, day, label, season, patch, graced):
    s, p = dims(spark)
    w = periods.patch_windows(p, s)
    df = spark.createDataFrame([("i", day, label)], "id string, publishedAt string, labeled int")
    row = periods.null_contradicting_patch(periods.with_patch(periods.with_grace(df, s), w), w).first()
    assert (row.season, row.patchVersion, row.graced) == (season, patch, graced)


def test_override_presence(spark):
    df = spark.createDataFrame([("a", 1, [1, 2]), ("b", 1, [1]), ("c", 1, [1]), ("d", 1, [1])], "id string, season int, xs array<int>")
    ov = spark.createDataFrame([("a", {"season": None}), ("b", {}), ("c", {"xs": "[7]", "season": "3"}), ("d", {"exclude": "true", "season": "9"})], "id string, patch map<string,string>")
    got = {r.id: (r.season, r.xs) for r in merge.apply_overrides(df, ov).collect()}
    assert got == {"a": (None, [1, 2]), "b": (1, [1]), "c": (3, [7]), "d": (1, [1])}
    assert {r.id for r in merge.drop_excluded(df, ov).collect()} == {"a", "b", "c"}
