"""Counting rules, duplicate audits and votes on literal cases."""

import pytest

from matchlake.operators import dupes, evidence, merge, query, resolve, stats, upsert

TEAM = "struct<side:string,players:array<struct<id:string,displayName:string>>,characters:array<string>,fuse:string>"
RECORD = f"id string, season int, patchVersion string, channel string, durationSec int, publishedAt string, teams array<{TEAM}>, allCharacters array<string>, allPlayers array<string>, fusesUnordered boolean"


def rec(i, left, right, season=0, **kw):
    """left, right: (players, characters, fuse)."""
    team = lambda side, t: (side, [(p, p) for p in t[0]], t[1], t[2])
    chars = list(dict.fromkeys([*left[1], *right[1]]))
    who = list(dict.fromkeys([*left[0], *right[0]]))
    return (i, season, kw.get("version"), kw.get("channel", "c"), kw.get("dur", 10), kw.get("day", "2026-01-01"), [team("left", left), team("right", right)], chars, who, False)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), RECORD)


def table(df, *keys):
    return {tuple(r[k] for k in keys): r.n for r in df.collect()}


def test_counting(spark):
    df = frame(spark, rec("1", (["p"], ["b", "a"], "f"), (["p", "q"], ["a", "b"], None)), rec("2", (["p"], ["a", "b", "c"], None), (["q"], ["a", "d"], "f"), season=None))
    assert table(stats.matchups(df), "a", "b") == {("a|b", "a|b"): 2}  # a mirror counts twice
    assert table(stats.pair_usage(df), "pair") == {("a|b",): 2, ("a|d",): 1}  # not the side of three
    assert table(stats.character_usage(df), "character") == {("a",): 2, ("b",): 2, ("c",): 1, ("d",): 1}
    assert table(stats.player_characters(df), "player", "character")[("p", "a")] == 3  # both sides count
    assert table(stats.fuse_usage(df, True), "era", "fuse") == {("S0", "f"): 1, ("Beta", "f"): 1}
    assert {r.id for r in query.browse(df, chars=["b", "d"]).collect()} == {"2"}
    assert query.browse(df, chars=["b", "d"], same_side=True).count() == 0
    assert {r.id for r in query.browse(df, fuses=["f"], patches=["Beta"]).collect()} == {"2"}


COPY = "id string, sig string, durationSec int, channel string, publishedAt string, has_override boolean, has_fuse boolean"


@pytest.mark.parametrize(
    "channels, delta, ham, tier",
    [("xx", 0, 20, "C"), ("xy", 1, 30, "A"), ("xx", 5, 8, "A"), ("xx", 6, 8, "B"), ("xy", 2, None, "B"), ("xy", 15, 12, "B"), ("xy", 16, 12, "C"), ("xx", 1, None, "A"), ("xx", 30, 8, "B"), ("xx", 31, 8, "C"), ("xy", 90, None, "C")],
)
def test_tiers(spark, channels, delta, ham, tier):
    df = spark.createDataFrame([("a", "s", 100, channels[0], "1", False, False), ("b", "s", 100 + delta, channels[1], "2", False, False)], COPY)
    hashes = spark.createDataFrame([("a", 0), *([("b", (1 << ham) - 1)] if ham is not None else [])], "id string, dhash bigint")
    got = dupes.tier(dupes.with_hash_distance(dupes.match_pairs(df), hashes)).collect()
    assert [(r.delta, r.ham, r.tier) for r in got] == [(delta, ham, tier)]


def test_clusters_point_at_one_survivor(spark):
    rows = [(f"r{k}", "s", 100, "xyz"[k % 3] + str(k), str(k), False, False) for k in range(9)]
    rows += [("zero1", "s", 0, "a", "1", False, False), ("zero2", "s", 0, "b", "2", False, False), ("far", "s", 300, "a", "1", False, False), ("none", None, 100, "q", "0", False, False)]
    rows += [("o1", "t", 50, "a", "5", True, False), ("o2", "t", 50, "b", "1", False, True), ("o3", "t", 50, "c", "0", False, False)]
    df = spark.createDataFrame(rows, COPY)
    none = spark.createDataFrame([], "id string, dhash bigint")
    judged = dupes.flags(dupes.precedence(dupes.tier(dupes.with_hash_distance(dupes.match_pairs(df), none))))
    out = {r.id: r.dupeOf for r in dupes.exclusions(dupes.actionable(judged)).collect()}
    assert out == {f"r{k}": "r0" for k in range(1, 9)} | {"o2": "o1", "o3": "o1"}
    rules = {(r.keep.id, r.drop.id): (r.rule, r.flags) for r in judged.collect()}
    assert rules[("o1", "o2")] == ("hand-authored-override", ["reverse-direction"])
    assert rules[("o2", "o3")][0] == "fuse-detected"


def test_aliases_and_ids(spark):
    reg = spark.createDataFrame([(0, "akali", "Akali", ["ak"]), (1, "ahri", "Ahri", ["ak"]), (2, "yasuo", "Yasuo", None)], "ord int, id string, name string, aliases array<string>")
    al = resolve.alias_dim(reg)
    tok = spark.createDataFrame([(t,) for t in ("AK", "Akalai", "Ysuo", "nerfed Ahri", "pj1", "ahri akali", "yausо")], "token string")
    got = {r.token: (r.character, r.how, r.notes) for r in resolve.resolve_characters(tok, al).collect()}
    assert got["AK"] == ("ahri", "exact", []) and got["Akalai"] == ("akali", "fuzzy", []) and got["Ysuo"] == ("yasuo", "fuzzy", [])
    assert got["nerfed Ahri"] == ("ahri", "words", ["nerfed"]) and got["pj1"][1] == got["ahri akali"][1] == "none"
    names = spark.createDataFrame([("LethalAF", 1), ("lethalaf", 2), ("LethalAF", 3), ("日本", 4), ("中", 5), ("Known", 6)], "token string, ord int")
    seed = spark.createDataFrame([(0, "lethalaf", "Someone", []), (1, "k1", "known", [])], "ord int, id string, name string, aliases array<string>")
    out, found = resolve.resolve_players(names, seed)
    assert {(r.token, r.player, r.display) for r in out.collect()} == {("LethalAF", "lethalaf-2", "LethalAF"), ("lethalaf", "lethalaf-2", "LethalAF"), ("日本", "player", "日本"), ("中", "player", "日本"), ("Known", "k1", "known")}
    assert {(r.id, r.n) for r in found.collect()} == {("lethalaf-2", 3), ("player", 2)}


READ = "video string, side string, frame int, dy double, class string, share double, sat_frac double, struct double"


def test_votes(spark):
    strong = [("v", "left", f, 0.0, "free", 0.9, 0.3, 4.0) for f in range(3)] + [("v", "left", 9, 0.0, "juggernaut", 0.99, 0.3, 2.0)]
    flash = [("v", "left", 10, 0.0, "other", 0.9, 0.5, 1.0), ("v", "left", 11, 0.0, "__hbar", 0.9, 0.3, 1.0), ("v", "left", 11, 0.0, "free", 0.3, 0.3, 1.0)]
    dark = [("v", "right", 1, 0.0, "free", 0.9, 0.01, 4.0)]
    got = {r.side: r for r in evidence.vote_side(spark.createDataFrame(strong + flash + dark, READ)).collect()}
    assert (got["left"].fuse, got["left"].frames, got["left"].dist, got["left"].margin) == ("free", 3, 10, 64)
    assert (got["right"].fuse, got["right"].dist, got["right"].sat_frac) == (None, 999, 0.01)


def test_detections_and_patches(spark):
    df = frame(spark, rec("1", (["p"], ["a", "b"], "x"), (["q"], ["c", "d"], None)), rec("2", (["p"], ["a", "b"], "x"), (["q"], ["c", "d"], "y")))
    det = spark.createDataFrame([("1", "l", "r", "ok-unordered"), ("2", "l", "r", "low")], "id string, left string, right string, status string")
    got = {r.id: ([t.fuse for t in r.teams], r.fusesUnordered) for r in merge.merge_detections(df, det).collect()}
    assert got == {"1": (["l", "r"], True), "2": (["x", "y"], False)}


def test_attempts_once_a_day(spark):
    log = spark.createDataFrame([("a", ["2026-01-01"])], "id string, days array<string>")
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    twice = upsert.log_attempts(upsert.log_attempts(log, ids, "2026-01-02"), ids, "2026-01-02")
    assert {r.id: r.days for r in twice.collect()} == {"a": ["2026-01-01", "2026-01-02"], "b": ["2026-01-02"]}


def test_gaps_in_order(spark):
    rows = [("c", "s1", "2020-01-01"), ("b", "beta", "2021-01-01"), ("a", "s0", "2020-05-01"), ("d", "s0", "2020-04-01"), ("e", "odd", "2019-01-01"), ("f", "s1", "2020-01-01")]
    got = evidence.order_gaps(spark.createDataFrame(rows, "id string, era string, publishedAt string")).collect()
    assert [r.id for r in got] == ["b", "d", "a", "c", "f", "e"]


def test_hand_written_names(spark):
    """Aliases name their entries; other names are exact, take free ids, and are registered once."""
    team = "teams array<struct<players:array<string>,characters:array<string>,fuse:string>>"
    rows = [("m1", [([" Ann ", "Bo"], ["x"], None), (["New One"], [], "F")]), ("m2", [(["new one"], ["x"], None), (["New-One", ""], None, None)]), ("m3", None), ("m4", [])]
    registry = spark.createDataFrame([(1, "ann-id", "Ann A", ["ann"]), (2, "newone", "Other", ["other"])], "ord int, id string, name string, aliases array<string>")
    out, new = resolve.resolve_manual(spark.createDataFrame(rows, f"id string, {team}"), registry)
    got = {r.id: [[(p.id, p.displayName) for p in t.players] for t in r.teams or []] for r in out.collect()}
    assert got["m1"] == [[("ann-id", "Ann A"), ("bo", "Bo")], [("newone-2", "New One")]]
    assert got["m2"] == [[("newone-2", "New One")], [("newone-3", "New-One")]] and got["m3"] == got["m4"] == []
    assert sorted((r.id, r.name, r.featured, r.aliases[0]) for r in new.collect()) == [("bo", "Bo", True, "bo"), ("newone-2", "New One", True, "new one"), ("newone-3", "New-One", True, "new-one")]


def test_near_hashes(spark):
    import random

    r = random.Random(1)
    base = r.getrandbits(56)
    hashes = {f"h{k:02d}": base ^ sum(1 << b for b in r.sample(range(56), k)) for k in range(16)} | {"copy": base, "far": r.getrandbits(56)}
    got = {(x.a, x.b): x.ham for x in dupes.near_hashes(spark.createDataFrame(list(hashes.items()), "id string, dhash bigint")).collect()}
    least = {}
    for i in sorted(hashes):
        least.setdefault(hashes[i], i)
    reps = sorted(least.values())
    want = {(a, b): bin(hashes[a] ^ hashes[b]).count("1") for a in reps for b in reps if a < b and bin(hashes[a] ^ hashes[b]).count("1") <= 12}
    assert got == want | {("copy", "h00"): 0}
