"""Readers and writers, by round trips to a temporary folder."""

import json

import pytest

from matchlake.operators import periods, titles
from matchlake.sources import io, keyed


def put(path, value):
    path.write_text(json.dumps(value, ensure_ascii=False))
    return str(path)


def test_raw_in_channel_order(spark, tmp_path):
    row = lambda i: {"id": i, "title": "t", "description": "", "publishedAt": "2026-01-01", "thumbnail": "", "durationSec": 1, "viewCount": 2}
    a, b = put(tmp_path / "a.json", [row("x"), row("y")]), put(tmp_path / "b.json", [row("z")])
    got = io.read_raw(spark, {"one": a, "two": b}).orderBy("ord").collect()
    assert [(r.channel, r.id, r.viewCount) for r in got] == [("one", "x", 2), ("one", "y", 2), ("two", "z", 2)]


def test_keyed_and_overrides(spark, tmp_path):
    f = put(tmp_path / "f.json", {"//": {"id": "comment"}, "b": {"id": "b", "aliases": ["x"]}, "a": {"id": "a", "active": True}})
    assert [r.id for r in io.read_keyed_json(spark, f, io.FUSE).orderBy("ord").collect()] == ["b", "a"]
    o = put(tmp_path / "o.json", {"v": {"season": None, "teams": [{"fuse": None}], "exclude": False}})
    patch = io.read_overrides(spark, o).first().patch
    assert patch == {"season": None, "teams": '[{"fuse":null}]', "exclude": "false"}


@pytest.mark.parametrize("size", [1, 3, 7, 64, 1000, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_keyed_in_ranges(spark, tmp_path, size, indent):
    """Ranges that begin in strings, escapes, numbers and nested values."""
    odd = {"a": {"x": 'quote " brace } \\ end\\'}, '\\"{': {"x": "\\\\"}, "é,": {"x": None, "y": [1, {"z": "],"}]}, "": {"x": ""}, "last": {"x": "{[" * 20}}
    if size > 3:
        odd |= {f"k{n}": {"x": "v" * (n % 50), "n": [n] * (n % 4)} for n in range(300)}
    path = tmp_path / "o.json"
    path.write_text(json.dumps(odd, ensure_ascii=False, indent=indent))
    if path.stat().st_size / size > 400:
        pytest.skip("more ranges than a test needs")
    rows = keyed.keyed_entries(spark, str(path), size)
    assert [(r.key, json.loads(r.value)) for r in rows.orderBy("ord").collect()] == list(odd.items())


def test_keyed_reads_many_tasks_and_files(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for n in range(3):
        put(folder / f"{n}.json", {f"{n}-{k}": {"id": str(k)} for k in range(2000)})
    (folder / "empty.json").write_text(" {\n} ")
    rows = io.read_keyed_json(spark, str(folder), "id string", range_bytes=4096)
    assert rows.count() == 6000 and rows.select("key").distinct().count() == 6000
    (tmp_path / "twice.json").write_text('{"a": {"id": "1"}, "b": {"id": "2"}, "a": {"id": "3"}}')
    assert [(r.key, r.id) for r in io.read_keyed_json(spark, str(tmp_path / "twice.json"), "id string").orderBy("ord").collect()] == [("a", "3"), ("b", "2")]


@pytest.mark.parametrize("text", ["", "[1]", '{"a": 1', '{"a": "b}', '{"a" 1}', '{"a": 1,}', '{a: 1}', "7", '{"a": }'])
def test_malformed_keyed_objects_fail(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception):
        keyed.keyed_entries(spark, str(tmp_path / "bad.json"), 4).collect()


def test_five_channels_become_records(spark, tmp_path):
    """Rows of each channel, in channel order, through to records."""
    title = "ARENA ▰ Ana (Vi/Jinx) vs Ben (Ekko/Ahri) ▰ High Level"
    row = lambda i: {"id": i, "title": title, "description": "", "publishedAt": "2026-01-01", "thumbnail": "", "durationSec": 1, "viewCount": 2}
    paths = {f"c{k}": put(tmp_path / f"{k}.json", [row(f"{k}a"), row(f"{k}b")]) for k in range(7)}
    raw = io.read_raw(spark, paths)
    names = spark.createDataFrame([(0, "vi", "Vi", None), (1, "jinx", "Jinx", None), (2, "ekko", "Ekko", None), (3, "ahri", "Ahri", None)], "ord int, id string, name string, aliases array<string>")
    seasons = spark.createDataFrame([(0, "2025-01-01", None, None)], periods.SEASONS)
    records, found = titles.build_records(raw, names, names.where("false"), [], seasons, spark.createDataFrame([], periods.PATCHES), "ARENA")
    assert [r.id for r in records.orderBy("ord").collect()] == [f"{k}{x}" for k in range(7) for x in "ab"]
    assert {(r.id, r.n) for r in found.collect()} == {("ana", 14), ("ben", 14)}


def test_registry_and_missing(spark, tmp_path):
    c = put(tmp_path / "c.json", [{"id": "vi", "name": "Vi", "extra": {"aliases": ["v"]}}])
    assert io.read_registry(spark, c, io.CHARACTERS).first().extra.aliases == ["v"]
    assert io.read_or_empty(spark, str(tmp_path / "none"), "id string").count() == 0
    (tmp_path / "bad.json").write_text("{]")
    with pytest.raises(Exception):
        io.read_required(spark, str(tmp_path / "bad.json"), "id string").collect()
    with pytest.raises(Exception):
        io.read_registry(spark, str(tmp_path / "nowhere.json"), io.CHARACTERS).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", None, 1), ("b", "x", 2)], "id string, note string, n int")
    io.write_records(df, str(tmp_path / "r"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "r")).collect())) == [("a", None, 1), ("b", "x", 2)]
    io.emit(df, str(tmp_path / "e"))
    lines = sorted(r[0] for r in spark.read.text(str(tmp_path / "e")).collect())
    assert lines == ['{"id":"a","n":1}', '{"id":"b","note":"x","n":2}']


@pytest.mark.parametrize("most", [10_000, 0])
def test_judged_titles_have_the_reasons_of_their_records(spark, monkeypatch, most):
    """Reasons without resolving players, with odd tokens held by tasks and joined."""
    monkeypatch.setattr(titles, "MOST", most)
    sides = ["Ana (Vi/Jinx)", "Ben + Cy (Ekko/Ahri)", "Ana (Vi)", "Ana (Vi-Jinx-Ahri)", "Ana (Vi/Nobody)", "Ana (Vi/Jinxx)", "Ana (nerfed Vi/Jinx)", " & (Vi/Jinx)", "Rank 1 NA Ana (Nobody/Ekkko/Nobody)", "Ana ()"]
    made = [f"ARENA ▰ {x} vs {sides[(k + s) % len(sides)]} ▰ High Level" for s in (0, 3, 4) for k, x in enumerate(sides)] + ["no shape", "", None, "ARENA ▰ Ana (Vi/Jinx) beats Ben (Ekko/Ahri)"]
    raw = spark.createDataFrame([(k, f"i{k}", "c", t, "", "2026-01-01", "", 1, 2) for k, t in enumerate(made)], "ord bigint, id string, channel string, title string, description string, publishedAt string, thumbnail string, durationSec int, viewCount bigint")
    names = spark.createDataFrame([(0, "vi", "Vi", None), (1, "jinx", "Jinx", None), (2, "ekko", "Ekko", None), (3, "ahri", "Ahri", None)], "ord int, id string, name string, aliases array<string>")
    seasons = spark.createDataFrame([(0, "2025-01-01", None, None)], periods.SEASONS)
    records, _ = titles.build_records(raw, names, names.where("false"), [], seasons, spark.createDataFrame([], periods.PATCHES), "ARENA")
    got = {r.id: (r.reasons, r.parseConfidence) for r in titles.judged(raw, names, "ARENA").collect()}
    want = {r.id: (r.reasons, r.parseConfidence) for r in records.collect()}
    assert got == want and len(got) == len(made)
    said = str(want)
    assert all(x in said for x in ("unresolved character", "fuzzy character", "no players parsed", "0 character(s)", "3 character(s)", "team-split", "'high'"))
    assert {r.id: r.reasons for r in titles.low_confidence(titles.judged(raw, names, "ARENA")).collect()} == {k: w for k, (w, c) in want.items() if c == "low"}
