import random
from itertools import combinations

from matchlake.llm import near_text


def sets(text, size=5):
    w = (text or "").lower().split()
    return {" ".join(w)} if 0 < len(w) <= size else {" ".join(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()


def near(x, y):
    return len(x & y) / len(x | y) >= 0.8 if x | y else True


def labels(rows):
    own = {i: sets(t) for i, t in rows if i is not None}
    p = {i: i for i in own}

    def find(i):
        while p[i] != i:
            i = p[i]
        return i

    pairs = [(a, b) for a, b in combinations(sorted(own), 2) if near(own[a], own[b])]
    for a, b in pairs:
        u, v = find(a), find(b)
        p[max(u, v)] = min(u, v)
    return {i: find(i) for i in own}, pairs


def made(n=150):
    r = random.Random(5)
    rows = []
    for k in range(n):
        w = [f"w{r.randrange(3000)}" for _ in range(r.randrange(60, 300))]
        rows.append((2 * k, " ".join(w)))
        for at in r.sample(range(10, len(w) - 10), max(1, len(w) // 60)):
            w[at] = "changed"
        rows.append((2 * k + 1, " ".join(w)))
    return rows


def test_pairs_of_similarity_08_are_linked(spark):
    rows = [*made(), (900, None), (901, ""), (902, "one two"), (903, "ONE  two"), (None, "lone")]
    want, pairs = labels(rows)
    out = near_text.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    got = {r.doc_id: r.component_id for r in out}
    assert len(pairs) > 100 and len(out) == len(rows)
    assert all(got[i] >= c for i, c in want.items())  # no link is false
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)
    assert got[900] == got[901] == 900 and got[902] == got[903] == 902


def test_stage_keeps_one_of_each(spark):
    import corpus_pipeline

    rows = made(40)
    want, _ = labels(rows)
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()
    assert {r.doc_id for r in kept} == set(want.values())
    assert near_text.keep_one(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def families(n, seed=9, near=0):
    """Texts of one template whose similarity lies mostly below 0.8, and near copies of some."""
    r = random.Random(seed)
    base = [f"t{k}" for k in range(200)]
    rows = []
    for k in range(n):
        w = list(base)
        for at in r.sample(range(200), 5):
            w[at] = f"x{r.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    for k in range(near):
        w = rows[k][1].split()
        for at in r.sample(range(200), 4):
            w[at] = f"y{r.randrange(10**6)}"
        rows.append((n + k, " ".join(w)))
    return rows


def test_pairs_of_a_template_grow_with_its_texts(spark, monkeypatch):
    plain, made_pairs = near_text.compared, []

    def counting(*args):
        out = near_text.cut(plain(*args))
        made_pairs.append(out.count())
        return out

    monkeypatch.setattr(near_text, "compared", counting)
    for n in (600, 1200):
        made_pairs.clear()
        near_text.near_duplicates(spark.createDataFrame(families(n), "doc_id bigint, text string")).count()
        # one a text in each of the first rounds, two in the next; all pairs that meet were 74,128 of 600 texts
        rounds = near_text.ROUNDS + near_text.HALVES
        assert sum(made_pairs) <= (near_text.ROUNDS + near_text.HALVES * near_text.NEAREST) * n and len(made_pairs) <= rounds + 1, (n, made_pairs)


def test_near_copies_within_a_template_are_found(spark):
    rows = families(500, near=120)
    want, pairs = labels(rows)
    got = {r.doc_id: r.component_id for r in near_text.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(pairs) > 60
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.97 * len(pairs), (sum(got[a] == got[b] for a, b in pairs), len(pairs))
    assert all(got[i] >= c for i, c in want.items())


def test_any_ids_and_links_over_rows_without_one(spark):
    r = random.Random(1)
    w = [f"w{k}" for k in range(400)]
    chain = []
    for _ in range(3):
        chain.append(" ".join(w))
        for at in r.sample(range(400), 6):
            w[at] = f"z{r.randrange(10**6)}"
    big = 1 << 62
    far = " ".join(f"other{k}" for k in range(50))
    assert near(sets(chain[0]), sets(chain[1])) and near(sets(chain[1]), sets(chain[2])) and not near(sets(chain[0]), sets(chain[2]))
    rows = [(big + 7, chain[0]), (None, chain[1]), (big + 5, chain[2]), (-big, far), (None, far + " more"), (None, "no near text at all"), (3, "two texts of one id"), (3, chain[0] + " end")]
    out = near_text.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = sorted((str(r.doc_id), str(r.component_id)) for r in out.collect())
    assert got == sorted([(str(big + 7), "3"), ("None", "3"), (str(big + 5), "3"), (str(-big), str(-big)), ("None", str(-big)), ("None", "None"), ("3", "3"), ("3", "3")])
    kept = near_text.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["3", str(-big), "None"])


def test_lower_similarity(spark):
    r = random.Random(11)
    rows = []
    for k in range(120):
        w = [f"w{r.randrange(5000)}" for _ in range(200)]
        rows.append((2 * k, " ".join(w)))
        for at in r.sample(range(200), 9):
            w[at] = "changed"
        rows.append((2 * k + 1, " ".join(w)))
    own = [(sets(rows[2 * k][1]), sets(rows[2 * k + 1][1])) for k in range(120)]
    want = [k for k, (x, y) in enumerate(own) if len(x & y) / len(x | y) >= 0.6]
    got = {x.doc_id: x.component_id for x in near_text.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), least=0.6).collect()}
    assert len(want) > 60 and sum(got[2 * k + 1] == 2 * k for k in want) >= 0.98 * len(want)


def test_what_the_turns_leave_is_compared_in_full(spark, monkeypatch):
    """All pairs that meet, also without any of the turns' pairs, where texts of one smallest hash are dealt out."""
    r = random.Random(21)
    shared, rows = [f"s{k}" for k in range(60)], []
    for f in range(8):
        own = shared + [f"w{r.randrange(10**6)}" for _ in range(60)]
        for k in range(3):
            rows.append((f * 3 + k, " ".join(own[:-1] + [f"x{f}{k}"])))
    plain = near_text.compared
    monkeypatch.setattr(near_text, "compared", lambda *args: plain(*args).where("false"))
    monkeypatch.setattr(near_text, "SPLIT_AT", 4)
    monkeypatch.setattr(near_text, "REST_PAIRS", 50)
    got = {x.doc_id: x.component_id for x in near_text.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: i // 3 * 3 for i, _ in rows}


def test_the_rest_of_a_template_grows_with_its_texts(spark, monkeypatch):
    """Texts of a template just below the similarity: when all pairs that meet were compared, 300 texts left 890."""
    plain, left = near_text.rest, []

    def counting(*args):
        out = near_text.cut(plain(*args))
        left.append(out.count())
        return out

    monkeypatch.setattr(near_text, "rest", counting)
    for n in (300, 600):
        left.clear()
        near_text.near_duplicates(spark.createDataFrame(families(n), "doc_id bigint, text string")).count()
        assert sum(left) <= n, (n, left)


def test_the_rest_loses_no_pair(spark, monkeypatch):
    """Against all pairs, where shingles of many are dealt out, at two similarities, over texts of many sizes, and labels that leave pairs within them out."""
    monkeypatch.setattr(near_text, "SPLIT_AT", 7)
    monkeypatch.setattr(near_text, "REST_PAIRS", 50)
    r = random.Random(3)
    rows = [t for _, t in families(60, near=40) + made(25)]
    for t in rows[:40]:
        w = t.split()
        rows.append(" ".join(w[: len(w) - r.randrange(1, 40)]))
    rows = list(dict.fromkeys(rows)) + ["", "one two", "one two three"]
    own = [sets(t) for t in rows]
    texts = spark.createDataFrame([(i, bytearray(t.encode())) for i, t in enumerate(rows)], "node bigint, text binary")
    labels = spark.createDataFrame([(i, i // 4 * 4) for i in range(0, len(rows), 3)], "node bigint, root bigint")
    label = {i: i // 4 * 4 if i % 3 == 0 else i for i in range(len(rows))}
    made_sets = near_text.cut(near_text.sets_of(texts, labels))
    for least in (0.8, 0.6):
        pairs = near_text.rest(near_text.cut(near_text.prefixes(made_sets, near_text.frequencies(made_sets), least)), least)
        got = {(x.a, x.b) for x in pairs.collect()}
        want = {(a, b) for b, a in combinations(range(len(rows)), 2) if own[a] and len(own[a] & own[b]) / len(own[a] | own[b]) >= least and label[a] != label[b]}
        assert len(want) > 60 and want <= got and all(label[a] != label[b] for a, b in got)
        found = near_text.verified(pairs, made_sets.select("node", "text"), least, near_text.set_of)
        assert {(x.a, x.b) for x in found.collect()} == want
