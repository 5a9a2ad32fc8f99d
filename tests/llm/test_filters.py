"""Quality rules, decontamination, URL filters."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from matchlake.llm import decontaminate, quality, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {p for i in range(len(w) - 7) if at[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


TEXTS = [
    None, "", " \n\t ", "a b c", "x\ny\nx\n\n\nx", "a b c d e f g h " * 3, "a b c d e f g h i a b c d e f g h j", "é " * 30, "|".join("ab"), "# * $ % & | < > !",
    " ".join(f"w{k}" for k in range(40)), " ".join(f"w{k % 9}" for k in range(4000)), "line one here\nline one here\n" + "z " * 9, "q" * 20_000,
]


def test_features_as_counted_by_hand(spark):
    rows = [(k, t, "en", "clash") for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string, kept string")
    got = {r.doc_id: r for r in quality.features(df).collect()}
    for k, t in enumerate(TEXTS):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(t), t
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)


@pytest.mark.parametrize("n, k, p", [(10, 0, 0.1), (400, 1, 0.01), (5000, 12, 0.0125), (200_000, 2300, 0.0125), (50, 5, 0.05), (1, 0, 0.5)])
def test_binomial_tail(spark, n, k, p):
    got = spark.range(1).select(quality.binomial_tail(F.lit(k), F.lit(n), p)).first()[0]
    log = lambda j: math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log(1 - p)
    want = sum(math.exp(log(j)) for j in range(k + 1)) if k < n * p else 1.0
    assert got == pytest.approx(want, rel=1e-7)


def test_cutoffs_limit_false_rejections(spark):
    """Plenty of labels: junk goes, and of the good texts no more than the risk."""
    prose = " ".join(f"word{k}" for k in range(30))
    good = [(k, f"{prose} n{k}" + (" # # #" if k % 500 == 0 else ""), "en" if k % 2 else None) for k in range(6000)]
    junk = [(10_000 + k, " ".join(f"w{j}###" for j in range(30)) + f" {k}", "en") for k in range(50)]
    labels = spark.createDataFrame([(i, 1) for i, *_ in good] + [(i, 0) for i, *_ in junk] + [(1, 1), (77_777, 1), (5, None)], "doc_id int, quality int")
    docs = spark.createDataFrame(good + junk, "doc_id int, text string, lang string")
    out = quality.judged(docs, labels).toPandas()
    assert not out[out.doc_id >= 10_000].kept.any()
    assert (~out[out.doc_id < 10_000].kept).mean() <= quality.RISK
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == out.kept.sum()


def test_few_labels_reject_nothing_more(spark):
    docs = spark.createDataFrame([(k, "w " * 0 + " ".join(f"a{j}#" for j in range(30)), "en") for k in range(5)], "doc_id int, text string, lang string")
    out = quality.judged(docs, spark.createDataFrame([(1, 1)], "doc_id int, quality int"))
    assert out.where("kept").count() == 5
    assert quality.judged(docs.limit(0), spark.createDataFrame([], "doc_id int, quality int")).count() == 0


def test_copies_prove_nothing_and_small_strata_admit_nothing(spark):
    text = lambda k, tail="": " ".join(f"w{k}x{j}" for j in range(25)) + tail
    junk = " ".join(f"w{j}###" for j in range(30))
    copies = [(k, text(0), "en") for k in range(300)]
    few = [(1000 + 100 * s + k, text(1000 + 100 * s + k), f"l{s}") for s in range(5) for k in range(50)]
    many = [(6000 + k, text(6000 + k), None) for k in range(400)]
    bad = [(5000, junk, "en"), (5001, junk, "l1"), (5002, junk, None)]
    rows = [*copies, *few, *many, *bad]
    labels = spark.createDataFrame([(i, 1) for i, *_ in copies + few + many] + [(7, 1), (7, 1)], "doc_id int, quality int")
    out = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id int, text string, lang string"), labels).collect()}
    assert out[0].holdout <= 1 and out[1000].holdout <= 50 and 150 < out[6000].holdout < 250  # 300 copies are one text, and a half of the texts is tried
    assert [out[i].kept for i in (0, 1000, 6000, 5000, 5001, 5002)] == [True, True, True, True, True, False]
    assert out[5001].last_move == -1 and out[5002].last_move == quality.N_MOVES - 1


def test_a_rule_that_good_texts_break_stops_no_other(spark):
    """Half of the good texts shout; the cutoffs of the other rules still tighten, and each language loses no more than the risk."""
    text = lambda k, up: " ".join((f"W{k}X{j}" if up else f"w{k}x{j}") for j in range(25))
    good = [(k, text(k, k % 2 == 0) + (" #" * 3 if k % 60 == 0 else ""), ("de", "en", "fr")[k % 3]) for k in range(3000)]
    junk = [(9000 + k, text(9000 + k, False) + " #" * 20, ("de", "en", "fr")[k % 3]) for k in range(9)]
    docs, labels = spark.createDataFrame(good + junk, "doc_id int, text string, lang string"), [(i, 1) for i, *_ in good]
    for turn in range(3):  # other labels each time
        some = spark.createDataFrame([x for x in labels if (x[0] * 7919 + turn * 31) % 10 < 6], "doc_id int, quality int")
        out = quality.judged(docs, some).toPandas()
        kept = out[out.doc_id < 9000].groupby("lang").kept.mean()
        assert (kept >= 1 - quality.RISK).all()
        assert not out[out.doc_id >= 9000].kept.any()


def contaminated(text, items, n=10):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, ids = norm(text), set(), set()
    for i, t in items:
        x = norm(t)
        size = min(n, len(x))
        for a in range(len(x) - size + 1 if x else 0):
            for b in range(len(w) - size + 1):
                if w[b : b + size] == x[a : a + size]:
                    hit |= set(range(b, b + size))
                    ids.add(str(i))
    return len(w), len(hit), sorted(ids)


def test_contamination_by_hand(spark, monkeypatch):
    long = " ".join(f"Test{k}" for k in range(25))
    items = [(1, long), (2, "short Item"), (30, "Élan vital"), (4, None), (5, "--"), (6, long), (None, "nameless one here")]
    texts = [None, "", "...", long.upper(), "a " + " ".join(long.split()[3:15]) + " b", "a short, item! b SHORT item", "ÉLAN vital élan-VITAL", " ".join(long.split()[:9]), "nameless one here", "x " * 20_000 + "short item", "shortitem short itemx"]
    bench = spark.createDataFrame(items, "item_id int, text string")
    docs = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)], "doc_id int, text string, found string")
    assert decontaminate.clean(docs, bench).columns == docs.columns
    for states in (4_000_000, 700):  # one automaton, and over six
        monkeypatch.setattr(decontaminate, "BLOCK_STATES", states)
        for r in decontaminate.contamination(docs, bench).collect():
            n, h, ids = contaminated(texts[r.doc_id], items)
            assert (r.found.n_words, r.found.n_hit, r.found.items) == (n, h, [i for i in ids if i != "None"]), texts[r.doc_id]
            for s in r.found.spans:
                assert texts[r.doc_id][s.start : s.end].strip() == texts[r.doc_id][s.start : s.end] != ""
    kept = {r.doc_id for r in decontaminate.clean(docs, bench).collect()}
    assert kept == {k for k, t in enumerate(texts) if not contaminated(t, items)[1]}
    assert decontaminate.contamination(docs, bench.limit(0)).where("found.n_hit > 0").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_an_automaton_is_built_once_a_block(monkeypatch):
    """Whatever the rows, a worker builds the automaton of a block once, and holds one at a time."""

    class Items:
        def __init__(self, k):
            self.value = f"block {k}", [(k, b"word%d one two" % k)]

    built = []
    make = decontaminate.automaton
    monkeypatch.setattr(decontaminate, "automaton", lambda items, size: built.append(items) or make(items, size))
    for k in range(6):
        own = Items(k)
        for _ in range(50):
            runs, ids = decontaminate.hits([b"x", b"word%d" % k, b"one", b"two"], decontaminate.Kept.of(own, 10))
            assert runs == [(1, 4)] and ids == {k}
    assert len(built) == 6


def test_states_are_bounded_by_the_estimate():
    words = " ".join(f"w{k % 977}x{k % 13}" for k in range(4000))
    a = decontaminate.automaton([(1, words.encode())], 10)
    assert a.get_stats()["nodes_count"] <= (len(words) + 16) * 10


def test_urls(spark):
    cases = {
        None: ("", "", None), "no scheme": ("", "", None), "http://A.Example.COM/en/7?q=/x": ("a.example.com", "/en/7", "example.com/en/7"), "https://x.com/en/8": ("x.com", "/en/8", "com/en/"),
        "http://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/"), "http://example.net/de/8#a": ("example.net", "/de/8", "example.net/de/8"), "http://h?u=/p": ("h", "", None), "a://b://c/d": ("b:", "//c/d", None),
        "http://Ünï.org/es/": ("Ünï.org", "/es/", "org/es/"), "://": ("", "", None),
    }
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(cases)], "page_id int, url string, verdict string")
    none = spark.createDataFrame([], "page_id int, bad int")
    got = {r.page_id: r for r in urls.judged(pages, none).collect()}
    for k, (u, want) in enumerate(cases.items()):
        assert (got[k].host, got[k].path, got[k].rule) == want, u
        assert got[k].verdict == ("block" if want[2] in ("com/en/", "example.net/de/8", "org/es/") else "allow")
    assert urls.judged(pages.limit(0), none).count() == 0


def test_reputation_shrinks(spark):
    """A host with much evidence is blocked, a lone bad page isn't, and neither is a host without labels."""
    rows = [(f"http://bad.site.com/{k}", 1) for k in range(300)] + [(f"http://h{k % 20}.good.com/{k}", 0) for k in range(2000)] + [("http://one.good.com/", 1), ("http://new.good.com/", None)]
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(rows)], "page_id int, url string")
    bad = spark.createDataFrame([(k, b) for k, (_, b) in enumerate(rows) if b is not None], "page_id int, bad int")
    got = {r.host: r.verdict for r in urls.judged(pages, bad, rules=()).collect()}
    assert got["bad.site.com"] == "block" and got["one.good.com"] == got["new.good.com"] == got["h3.good.com"] == "allow"
