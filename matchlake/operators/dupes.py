"""Duplicate matches and duplicate entities.

Matches block on their signature and a duration bucket; entities on slugs, words, deletion variants and prefixes. Every
candidate join is an equi-join.

Pairs are listed of records (match_pairs; entity_pairs with all_pairs), which is the square of a group, or of classes. Records that agree in all columns that decide about a pair are one class: pairs are those
of classes, named by their smallest ids, with the number of record pairs each stands for, and a table of members gives the
records. A class of more than one has a pair of its own. What is done with single records (which to drop, for whom) follows from
the classes and is the same as over all pairs. As classes, entities of one key are a star around the smallest id.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions import pixels as P
from matchlake.functions import text as X
from matchlake.operators.checkpoints import cut
from matchlake.operators.linking import components, followed

#: What pairs hang on: how long and where, and what tiers and precedence look at besides.
LENGTH = ("sig", "durationSec", "channel")
DECIDING = (*LENGTH, "publishedAt", "has_override", "has_fuse", "dhash")
WINDOW_SEC = 90
TIERS = ("A", "B", "C")
#: What a kind of evidence weighs, and the order in which kinds are tried.
WEIGHTS = {"slug": 5, "leet": 4, "sponsor": 3, "initials": 3, "typo": 2, "affix": 1}


def signature(teams: Column) -> Column:
    """Players and characters of both sides, whatever their order; null unless both sides have both."""
    side = lambda t: F.concat_ws("|", F.array_join(F.array_sort(F.transform(t["players"], lambda p: F.coalesce(X.empty_to_null(X.slug(p["displayName"])), p["id"]))), ","), F.array_join(F.array_sort(t["characters"]), ","))
    full = (F.size(teams) == 2) & F.forall(teams, lambda t: (F.size(t["players"]) > 0) & (F.size(t["characters"]) > 0))
    return F.when(full, F.array_join(F.array_sort(F.transform(teams, side)), " ~ "))


def collapsed(df: DataFrame, by: tuple[str, ...] = DECIDING) -> DataFrame:
    """A row a class of records that may have duplicates and agree in these columns: id, the smallest, and n, how many."""
    return df.where("durationSec > 0 and sig is not null").groupBy(*by).agg(F.min("id").alias("id"), F.count("*").alias("n"))


def members(df: DataFrame, classes: DataFrame, by: tuple[str, ...] = DECIDING) -> DataFrame:
    """(id, class) of records."""
    own = classes.select(F.col("id").alias("class"), *(F.col(c).alias(f"_{c}") for c in by))
    return df.join(own, reduce(and_, (df[c].eqNullSafe(own[f"_{c}"]) for c in by))).select("id", "class")


def link_counts(df: DataFrame, window_sec: int = WINDOW_SEC) -> DataFrame:
    """(class, n, links, cross): the records of one signature, length and channel, and how many partners each of them has, and how many in other channels.

    Lengths are swept in their order within a signature, with a moving sum; that is over a row a length and channel, however many records there are."""
    own = collapsed(df, LENGTH)
    sweep = lambda *by: F.sum("n").over(Window.partitionBy(*by).orderBy("durationSec").rangeBetween(-window_sec, window_sec))
    seen = own.select(F.col("id").alias("class"), "n", sweep("sig").alias("_all"), sweep("sig", "channel").alias("_here"))
    return seen.select("class", "n", (F.col("_all") - 1).alias("links"), (F.col("_all") - F.col("_here")).alias("cross"))


def class_pairs(classes: DataFrame, window_sec: int = WINDOW_SEC, scope: str = "all") -> DataFrame:
    """match_pairs of classes with `pairs`, the record pairs that each stands for; a class of several records is paired with itself."""
    between = match_pairs(classes, window_sec, scope).withColumn("pairs", F.col("a.n") * F.col("b.n"))
    if scope == "cross":
        return between
    own = F.struct(*classes.columns)
    within = classes.where("n > 1").select(own.alias("a"), own.alias("b"), (F.col("durationSec") * 0).alias("delta"), F.lit(True).alias("intra"), F.floor(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    return between.unionByName(within)


def with_ham(pairs: DataFrame) -> DataFrame:
    """Pairs of classes with ham, how far their hashes lie apart."""
    return pairs.withColumn("ham", P.hamming(F.col("a.dhash"), F.col("b.dhash")))


def match_pairs(df: DataFrame, window_sec: int = WINDOW_SEC, scope: str = "all") -> DataFrame:
    """Pairs of records (id, sig, durationSec, channel, publishedAt, has_override, has_fuse) of one signature and about one length; a.id < b.id."""
    width = window_sec + 1
    rows = df.where("durationSec > 0 and sig is not null").withColumn("bucket", F.floor(F.col("durationSec") / width))
    a = rows.select("sig", "bucket", F.struct(*df.columns).alias("a"))
    b = rows.select("sig", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"), F.struct(*df.columns).alias("b"))
    delta = F.abs(F.col("a.durationSec") - F.col("b.durationSec"))
    pairs = a.join(b, ["sig", "bucket"]).where((F.col("a.id") < F.col("b.id")) & (delta <= window_sec)).select("a", "b", delta.alias("delta"), (F.col("a.channel") == F.col("b.channel")).alias("intra"))
    return pairs if scope == "all" else pairs.where(F.col("intra") if scope == "intra" else ~F.col("intra"))


def with_hash_distance(pairs: DataFrame, hashes: DataFrame) -> DataFrame:
    """pairs with ham, null where a hash (id, dhash) is unknown."""
    a, b = (hashes.select(F.col("id").alias(f"_{k}"), F.col("dhash").alias(f"_h{k}")) for k in "ab")
    out = pairs.join(a, F.col("a.id") == F.col("_a"), "left").join(b, F.col("b.id") == F.col("_b"), "left")
    return out.withColumn("ham", P.hamming(F.col("_ha"), F.col("_hb"))).drop("_a", "_b", "_ha", "_hb")


def near_hashes(hashes: DataFrame, radius: int = 12, bits: int = 56, bands: int = 7) -> DataFrame:
    """(a, b, ham) within so many bits between the least ids of distinct hashes (id, dhash), and from these to the other ids of their hash (0).

    Hashes so near agree in some band but for radius // bands bits, so each stands for all such values of its bands: an equi-join,
    verified. It loses no pair; how much it saves hangs on the radius, as wide ones leave every band several values.
    """
    own = hashes.groupBy("dhash").agg(F.min("id").alias("id"))
    width = bits // bands
    flips = [sum(1 << k for k in c) for n in range(radius // bands + 1) for c in combinations(range(width), n)]
    band = lambda k: F.shiftrightunsigned("dhash", k * width).bitwiseAND(F.lit((1 << width) - 1))
    a = own.select(F.col("id").alias("a"), F.col("dhash").alias("_a"), F.posexplode(F.array(*(band(k) for k in range(bands)))).alias("band", "v"))
    b = own.select(F.col("id").alias("b"), F.col("dhash").alias("_b"), F.posexplode(F.array(*(band(k) for k in range(bands)))).alias("band", "w"))
    b = b.select("b", "_b", "band", F.explode(F.transform(F.array(*map(F.lit, flips)), lambda x: F.col("w").bitwiseXOR(x.cast("bigint")))).alias("v"))
    ham = P.hamming(F.col("_a"), F.col("_b"))
    near = a.join(b, ["band", "v"]).where((F.col("a") < F.col("b")) & (ham <= radius)).select("a", "b", ham.alias("ham")).distinct()
    copies = hashes.join(own.select(F.col("id").alias("a"), "dhash"), "dhash").where("id <> a").select("a", F.col("id").alias("b"), F.lit(0).alias("ham"))
    return near.unionByName(copies)


def tier(pairs: DataFrame) -> DataFrame:
    """pairs with their tier. An unknown distance satisfies nothing and contradicts nothing."""
    ham, intra, delta = F.coalesce("ham", F.lit(99)), F.col("intra"), F.col("delta")
    against = intra & F.coalesce(F.col("ham") > 12, F.lit(False))
    close, fair = ham <= 8, ham <= 12
    first = ((delta <= 1) & ~against) | (intra & close & (delta <= 5))
    second = ((delta <= 2) & ~against) | (fair & (delta <= 15)) | (intra & close & (delta <= 30))
    return pairs.withColumn("tier", F.when(first, "A").when(second, "B").otherwise("C"))


def precedence(pairs: DataFrame) -> DataFrame:
    """pairs with keep, drop and rule: hand-written work, then detections, then the earlier, the longer, the smaller id."""
    wins = [
        ("hand-authored-override", F.col("a.has_override") != F.col("b.has_override"), F.col("a.has_override")),
        ("fuse-detected", F.col("a.has_fuse") != F.col("b.has_fuse"), F.col("a.has_fuse")),
        ("earlier-upload", F.col("a.publishedAt") != F.col("b.publishedAt"), F.col("a.publishedAt") < F.col("b.publishedAt")),
        ("longer-cut", F.col("a.durationSec") != F.col("b.durationSec"), F.col("a.durationSec") > F.col("b.durationSec")),
        ("id-tiebreak", F.lit(True), F.col("a.id") < F.col("b.id")),
    ]
    rule, first = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for name, differ, a_wins in reversed(wins):
        rule, first = F.when(differ, name).otherwise(rule), F.when(differ, a_wins).otherwise(first)
    out = pairs.withColumn("rule", rule).withColumn("_first", first)
    return out.withColumn("keep", F.when(F.col("_first"), F.col("a")).otherwise(F.col("b"))).withColumn("drop", F.when(F.col("_first"), F.col("b")).otherwise(F.col("a"))).drop("_first", "a", "b")


def flags(pairs: DataFrame, prefer_existing: bool = True) -> DataFrame:
    guarded = lambda c: F.col(f"{c}.has_fuse") | F.col(f"{c}.has_override")
    made = F.array(
        F.when(F.col("drop.publishedAt") < F.col("keep.publishedAt"), "reverse-direction"),
        F.when(F.lit(prefer_existing) & guarded("drop") & ~guarded("keep"), "blocked-by-prefer-existing"),
        F.when(F.col("drop.has_override"), "drop-has-override"),
    )
    return pairs.withColumn("flags", F.array_compact(made))


def strength() -> list[Column]:
    """The report's order: tier, distance (64 if unknown), difference in length; then ids, so that it is total."""
    return [F.col("tier"), F.coalesce("ham", F.lit(64)), F.col("delta"), F.col("keep.id"), F.col("drop.id")]


def actionable(pairs: DataFrame, min_tier: str = "B") -> DataFrame:
    """Unblocked pairs of an actionable tier: the strongest of each dropped record."""
    blocked = F.arrays_overlap("flags", F.array(F.lit("blocked-by-prefer-existing"), F.lit("drop-has-override")))
    open_ = pairs.where(F.col("tier").isin("A", "B") & (F.col("tier") <= min_tier) & ~blocked)
    w = Window.partitionBy("drop.id").orderBy(*strength())
    return open_.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def actionable_members(judged: DataFrame, classes: DataFrame, of: DataFrame, min_tier: str = "B") -> DataFrame:
    """What actionable gives over all pairs of records, from judged pairs of classes (with themselves too) and of (id, class).

    The strongest pair of a class's smallest id is that of the class. Any other record is also dropped for that smallest id, at no difference
    in length, unless an override forbids it; no pair with a class of a later smallest id is stronger than that."""
    best = actionable(judged.where("keep.id <> drop.id"), min_tier).select(F.col("drop.id").alias("class"), F.struct(F.col("tier"), F.coalesce("ham", F.lit(64)).alias("far"), F.col("delta"), F.col("keep.id").alias("keep"), F.col("ham")).alias("best"))
    own = F.struct(F.lit("A").alias("tier"), F.when(F.col("dhash").isNull(), 64).otherwise(0).alias("far"), (F.col("durationSec") * 0).alias("delta"), F.col("id").alias("keep"), F.when(F.col("dhash").isNotNull(), 0).alias("ham"))
    self_ = classes.where("n > 1 and not has_override").select(F.col("id").alias("class"), own.alias("own"))
    about = cut(best.join(self_, "class", "full"))
    rows = of.join(about, "class").select("id", F.least("best", F.when(F.col("id") != F.col("class"), F.col("own"))).alias("x")).where("x is not null")
    return rows.select(F.struct("x.keep").alias("keep"), F.struct("id").alias("drop"), "x.tier", "x.ham", "x.delta").withColumn("keep", F.struct(F.col("keep.keep").alias("id")))


def survivors(action: DataFrame) -> DataFrame:
    """(drop, survivor): keep pointers followed until a record that stays; precedence is a total order, so there are no cycles."""
    return followed(action.select(F.col("drop.id").alias("drop"), F.col("keep.id").alias("survivor")), "drop", "survivor")


def exclusions(action: DataFrame) -> DataFrame:
    """(id, dupeOf, evidence, exclude) to put into the overrides."""
    s = survivors(action)
    rows = action.select(F.col("drop.id").alias("drop"), F.concat(F.lit("Δdur "), "delta", F.lit("s, thumb hamming "), F.coalesce(F.col("ham").cast("string"), F.lit("n/a")), F.lit(" [tier "), "tier", F.lit("]")).alias("evidence"))
    return rows.join(s, "drop").select(F.col("drop").alias("id"), F.col("survivor").alias("dupeOf"), "evidence", F.lit(True).alias("exclude"))


def tier_counts(pairs: DataFrame) -> DataFrame:
    """(tier, n) of pairs; of classes: of the record pairs that they stand for."""
    return pairs.groupBy("tier").agg(F.sum("pairs").alias("n") if "pairs" in pairs.columns else F.count("*").alias("n"))


def _same(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """A star for each key: the smallest id with each other."""
    first = rows.where(F.col(key) != "").groupBy(key).agg(F.min("id").alias("a"))
    return rows.join(first, key).where("id <> a").select("a", F.col("id").alias("b"), F.lit(kind).alias("kind"))


def _all_same(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """All pairs of ids of one key."""
    a, b = (rows.where(F.col(key) != "").select(key, F.col("id").alias(x)) for x in "ab")
    return a.join(b, key).where("a < b").select("a", "b", F.lit(kind).alias("kind"))


def entity_classes(pairs: DataFrame) -> DataFrame:
    """(id, class, kinds): the entities that pairs link, directly or through others, by their smallest id, with the kinds of evidence within the class."""
    found = cut(components(pairs.select("a", "b")))
    order = F.create_map(*(F.lit(x) for k, n in enumerate(WEIGHTS) for x in (n, k)))
    label = F.col("b").alias("id"), "kind"  # every pair's b is in found, as its a is smaller
    kinds = pairs.select(*label).join(found, "id").groupBy("class").agg(F.array_sort(F.collect_set(F.struct(order[F.col("kind")].alias("o"), "kind"))).alias("k"))  # six kinds
    roots = found.select("class").distinct().select(F.col("class").alias("id"), "class")
    return found.unionByName(roots).join(kinds, "class").select("id", "class", F.array_join("k.kind", "+").alias("kinds"))


def entity_pairs(registry: DataFrame, kinds: tuple[str, ...] = tuple(WEIGHTS), all_pairs: bool = False) -> DataFrame:
    """(a, b, kind), a < b, from a registry (id, handle): each heuristic blocks by an equi-join. Handles of one slug, or one leet spelling, are a star around
    the smallest id; sponsors and initials are found between the smallest ids of equal words, typos and affixes between those of equal slugs. With all_pairs,
    all of these are between all ids."""
    rows = registry.select("id", "handle", X.slug(F.col("handle")).alias("slug"), X.handle_words(F.col("handle")).alias("words")).withColumn("leet", X.deleet(F.col("slug")))
    by_words = rows if all_pairs else rows.groupBy("slug", "words").agg(F.min("id").alias("id"))
    by_slug = rows if all_pairs else rows.groupBy("slug").agg(F.min("id").alias("id"))
    same = _all_same if all_pairs else _same
    made = {
        "slug": lambda: same(rows, "slug", "slug"),
        "leet": lambda: same(rows, "leet", "leet"),
        "sponsor": lambda: sponsors(by_words),
        "initials": lambda: initials(by_words),
        "typo": lambda: typos(by_slug),
        "affix": lambda: affixes(by_slug),
    }
    out = None
    for k in kinds:
        part = made[k]()
        out = part if out is None else out.unionByName(part)
    return out


def _long_words(words: Column) -> Column:
    return F.filter(words, lambda x: F.length(x) >= 3)


def sponsors(rows: DataFrame) -> DataFrame:
    """A handle and the same with words of its own before or behind, if they share a word of three letters: joined on the short one's slug as a word of the long one."""
    long = rows.select(F.col("id").alias("long"), F.col("words").alias("lw"), F.explode(F.array_distinct("words")).alias("slug"))
    short = rows.where("slug <> ''").select(F.col("id").alias("short"), F.col("words").alias("sw"), "slug")
    found = long.join(short, "slug").where((F.size("lw") > F.size("sw")) & F.arrays_overlap(_long_words(F.col("lw")), _long_words(F.col("sw"))))
    return found.select(F.least("long", "short").alias("a"), F.greatest("long", "short").alias("b"), F.lit("sponsor").alias("kind")).distinct()


def initials(rows: DataFrame) -> DataFrame:
    """Handles that differ in their first words, of which one is the other's initial: joined on that letter and the other words, one of which has three letters."""
    head = F.get("words", F.lit(0))
    keyed = rows.where((F.size("words") > 1) & (F.length(head) > 0)).select("id", F.length(head).alias("n"), F.substring(head, 1, 1).alias("letter"), F.slice("words", F.lit(2), F.size("words") - 1).alias("tail"))
    keyed = keyed.where(F.size(_long_words(F.col("tail"))) > 0)
    long = keyed.where("n > 1").select(F.col("id").alias("long"), "letter", "tail")
    found = long.join(keyed.where("n = 1").select(F.col("id").alias("short"), "letter", "tail"), ["letter", "tail"])
    return found.select(F.least("long", "short").alias("a"), F.greatest("long", "short").alias("b"), F.lit("initials").alias("kind"))


def typos(rows: DataFrame, least: int = 5) -> DataFrame:
    """Slugs one edit apart: those share a text with at most one letter deleted."""
    c = F.col("slug")
    deleted = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substr(c, i + 1)))
    v = rows.where(F.length("slug") >= least).select("id", "slug", F.explode(F.array_distinct(F.concat(F.array(c), deleted))).alias("v"))
    a, b = (v.select("v", F.col("id").alias(x), F.col("slug").alias(f"s{x}")) for x in "ab")
    near = a.join(b, "v").where("a < b and sa <> sb").select("a", "b", "sa", "sb").distinct()
    return near.where(X.within_one_edit(F.col("sa"), F.col("sb"))).select("a", "b", F.lit("typo").alias("kind"))


def affixes(rows: DataFrame, least: int = 4) -> DataFrame:
    """A slug and the same with up to three letters, or digits, behind."""
    c = F.col("slug")
    cuts = rows.where(F.length(c) > least).select(F.col("id").alias("long"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.struct(F.substring(c, F.lit(1), F.length(c) - k).alias("head"), F.right(c, k).alias("tail")))).alias("x"))
    found = cuts.where((F.length("x.head") >= least) & F.col("x.tail").rlike("^(?:[0-9]+|[a-z]{1,3})$")).select("long", F.col("x.head").alias("slug")).join(rows.select("slug", F.col("id").alias("short")), "slug")
    return found.select(F.least("long", "short").alias("a"), F.greatest("long", "short").alias("b"), F.lit("affix").alias("kind")).where("a <> b")


def rank_entity_pairs(pairs: DataFrame, counts: DataFrame, tops: DataFrame, featured: DataFrame, min_count: int = 0) -> DataFrame:
    """(canonical, other, kinds, shared, score) of pairs. counts: (player, n); tops: (player, character), four at most each; featured: (player, featured)."""
    order = F.create_map(*(F.lit(x) for k, n in enumerate(WEIGHTS) for x in (n, k)))
    weight = F.create_map(*(F.lit(x) for k, n in WEIGHTS.items() for x in (k, n)))
    grouped = pairs.distinct().groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct(order[F.col("kind")].alias("o"), "kind"))).alias("k"), F.max(weight[F.col("kind")]).alias("w"))
    top = tops.groupBy("player").agg(F.collect_set("character").alias("top"))
    about = counts.join(featured, "player", "full").join(top, "player", "left").select("player", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("featured", F.lit(False)).alias("f"), F.coalesce("top", F.array().cast("array<string>")).alias("t"))
    for x in "ab":
        grouped = grouped.join(about.select(F.col("player").alias(x), F.struct("n", "f", "t").alias(f"_{x}")), x, "left")
    n = lambda x: F.coalesce(F.col(f"_{x}.n"), F.lit(0))
    f = lambda x: F.coalesce(F.col(f"_{x}.f"), F.lit(False))
    a_first = F.when(n("a") != n("b"), n("a") > n("b")).otherwise(f("a") & ~f("b"))
    shared = F.coalesce(F.size(F.array_intersect("_a.t", "_b.t")), F.lit(0))
    out = grouped.select(
        F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("canonical"),
        F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("other"),
        F.array_join("k.kind", "+").alias("kinds"),
        shared.alias("shared"),
        ((F.col("w") + F.size("k") - 1 + shared) * 100 + F.least(n("a"), n("b"))).alias("score"),
        (n("a") + n("b")).alias("_all"),
    )
    return out.where(F.col("_all") >= min_count).drop("_all")
