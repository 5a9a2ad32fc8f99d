"""Resolution of character and player names against registries, with discovery of new players.

Order is explicit: aliases carry their registry ordinal, tokens their record, side and place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.functions import text as X
from matchlake.operators.numbering import numbered_within


def alias_dim(registry: DataFrame, name_col: str = "name") -> DataFrame:
    """(alias, id, ord) from a registry (ord, id, name, aliases): of equal aliases the last in registry order counts."""
    rows = registry.select("ord", "id", F.explode(F.array_distinct(F.transform(F.concat(F.array(name_col), F.coalesce("aliases", F.array().cast("array<string>"))), F.lower))).alias("alias"))
    return rows.groupBy("alias").agg(F.max_by("id", "ord").alias("id"), F.min("ord").alias("ord"))


def resolve_exact(tokens: DataFrame, aliases: DataFrame, out: str = "id") -> DataFrame:
    """tokens (token) with id (or as out says), null where no alias is the token. The alias table is a registry's: hundreds of rows, broadcast by size."""
    return tokens.join(aliases.select(F.col("alias").alias("_a"), F.col("id").alias(out)), F.lower("token") == F.col("_a"), "left").drop("_a")


def resolve_words(tokens: DataFrame, aliases: DataFrame) -> DataFrame:
    """(token, id, notes) of tokens of several words, just one of which is an alias; other long words are notes."""
    w = tokens.select("token").distinct().select("token", F.filter(F.split(F.lower("token"), "[^a-z0-9]+"), lambda x: x != "").alias("words")).where(F.size("words") > 1)
    hits = w.select("token", F.posexplode("words").alias("pos", "word")).join(aliases.select(F.col("alias").alias("word"), "id"), "word", "left")
    note = F.when(F.col("id").isNull() & F.col("word").rlike("^[a-z]{3,}$"), F.struct("pos", "word"))
    found = hits.groupBy("token").agg(F.collect_set("id").alias("ids"), F.array_sort(F.collect_list(note)).alias("notes"))
    return found.where(F.size("ids") == 1).select("token", F.get("ids", F.lit(0)).alias("id"), F.col("notes.word").alias("notes"))


def resolve_fuzzy(tokens: DataFrame, aliases: DataFrame, min_len: int = 3) -> DataFrame:
    """(token, id) within one edit of an alias; nearer ones first, then by registry order. Candidates share a deletion variant, so this is an equi-join."""
    t = tokens.select("token").distinct().withColumn("lower", F.lower("token")).where(F.length("lower") >= min_len)
    variants = lambda c: F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substr(c, i + 1)))))
    a = aliases.where(F.length("alias") >= min_len).select("alias", "id", "ord", F.explode(variants(F.col("alias"))).alias("v"))
    near = t.select("token", "lower", F.explode(variants(F.col("lower"))).alias("v")).join(a, "v").where(X.within_one_edit(F.col("lower"), F.col("alias")))
    best = F.min_by("id", F.struct((F.col("lower") != F.col("alias")).cast("int"), "ord", "alias"))
    return near.groupBy("token").agg(best.alias("id"))


def resolve_characters(tokens: DataFrame, aliases: DataFrame) -> DataFrame:
    """tokens with character, how (exact, words, fuzzy or none), confidence and notes. Only what is left goes to the next rule, and only distinct tokens do."""
    names = tokens.select("token").distinct()
    exact = resolve_exact(names, aliases)
    rest = exact.where("id is null").select("token")
    words = resolve_words(rest, aliases)
    fuzzy = resolve_fuzzy(rest.join(words, "token", "left_anti"), aliases)
    none = F.array().cast("array<string>")
    found = (
        exact.where("id is not null").select("token", F.col("id").alias("character"), F.lit("exact").alias("how"), none.alias("notes"))
        .unionByName(words.select("token", F.col("id").alias("character"), F.lit("words").alias("how"), "notes"))
        .unionByName(fuzzy.select("token", F.col("id").alias("character"), F.lit("fuzzy").alias("how"), none.alias("notes")))
    )
    out = tokens.join(found, "token", "left").withColumn("how", F.coalesce("how", F.lit("none"))).withColumn("notes", F.coalesce("notes", none))
    return out.withColumn("confidence", F.when(F.col("how").isin("exact", "words"), "high").otherwise("low"))


def keyword_ids(texts: DataFrame, aliases: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, key) of the texts that some alias stands in as a word or words: the longest alias's key, of equally long ones that of the smallest ord.
    texts: (id, text); aliases: (alias, key, ord), any number of them.

    A text is cut into runs of word characters and of others. An alias that stands there is some runs in a row, as many as it has itself, so all
    rows of runs up to the longest alias's number are joined with the aliases. Rows may not begin or end with the text's own outer runs of other characters, where no word begins or ends."""
    runs = r"[a-z0-9_]+|[^a-z0-9_]+"
    known = aliases.select(F.lower("alias").alias("alias"), "key", "ord").where("alias <> ''")
    most = known.agg(F.max(F.size(F.regexp_extract_all("alias", F.lit(runs), F.lit(0))))).first()[0] or 0
    inner = F.regexp_replace(F.lower(text_col), "^[^a-z0-9_]+|[^a-z0-9_]+$", "")
    cut_up = texts.select(id_col, F.regexp_extract_all(inner, F.lit(runs), F.lit(0)).alias("_r")).where(F.size("_r") > 0)
    from_ = F.explode(F.sequence(F.lit(1), F.size("_r"))).alias("_i")
    rows = cut_up.select(id_col, "_r", from_)
    rows = rows.select(id_col, F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size("_r") - F.col("_i") + 1)), lambda n: F.array_join(F.slice("_r", F.col("_i"), n), ""))).alias("alias")) if most else rows.select(id_col, F.lit("").alias("alias")).where("false")
    found = rows.distinct().join(known, "alias")
    return found.groupBy(id_col).agg(F.min_by("key", F.struct(-F.length("alias"), "ord")).alias("key"))


def taken_numbers(taken: DataFrame) -> DataFrame:
    """(slug, t): the numbers that ids (id) hold of their slugs, 1 for the slug itself."""
    suffix = F.regexp_extract("id", r"^(.*?)(?:-(\d+))?$", 2)
    number = F.when(suffix == "", 1).when(suffix.rlike("^([2-9]|[1-9][0-9]{1,17})$"), suffix.cast("bigint"))
    return taken.select(F.regexp_extract("id", r"^(.*?)(?:-(\d+))?$", 1).alias("slug"), number.cast("bigint").alias("t")).where("t is not null").distinct()


def mint_ids(slugs: DataFrame, taken: DataFrame) -> DataFrame:
    """(slug, id): the slug itself if no seed has it, else with the smallest free number from 2. taken: (id).

    The smallest free number follows a taken one, so the numbers after taken ones that are not taken themselves are all it can be."""
    own = slugs.select("slug").distinct()
    used = taken_numbers(taken).join(own, "slug", "left_semi")
    free = used.select("slug", (F.col("t") + 1).alias("t")).join(used, ["slug", "t"], "left_anti").groupBy("slug").agg(F.min("t").alias("n"))
    bare = used.where("t = 1").select("slug").join(free, "slug")
    return own.join(bare, "slug", "left").select("slug", F.when(F.col("n").isNull(), F.col("slug")).otherwise(F.concat(F.col("slug"), F.lit("-"), F.col("n"))).alias("id"))


def mint_names(names: DataFrame, taken: DataFrame) -> DataFrame:
    """(name, slug, id) of hand-written names (name, slug, ord) without an entry: names of one slug take successive free ids in order."""
    nth = numbered_within(names.where("slug is not null").select("name", "slug", "ord"), "slug", "ord", "name")
    used = taken_numbers(taken).join(names.select("slug").distinct(), "slug", "left_semi")
    # below the j-th taken number t lie t - j free ones: it moves up all names after so many, so that places among both are the numbers
    moves = numbered_within(used, "slug", "t").select("slug", (F.col("t") - F.col("_k")).alias("v"), F.lit(1).alias("move"), F.col("t").alias("tie"), F.lit(None).cast("string").alias("name"))
    both = nth.select("slug", F.col("_k").alias("v"), F.lit(0).alias("move"), F.lit(0).cast("bigint").alias("tie"), F.col("name").cast("string").alias("name")).unionByName(moves)
    placed = numbered_within(both, "slug", "v", "move", "tie").where("move = 0")
    return placed.select("name", "slug", F.when(F.col("_k") == 1, F.col("slug")).otherwise(F.concat(F.col("slug"), F.lit("-"), F.col("_k"))).alias("id"))


def resolve_manual(manual: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(manual with each player's id and display name in place of the name; new entries). An alias of the registry (ord, id, name, aliases) names its
    entry; any other name is exact, takes a free id, and is registered as featured. Distinct names are resolved once; blank ones go."""
    at = manual.select("id", F.posexplode_outer("teams").alias("side", "t")).select("id", "side", "t", F.posexplode_outer("t.players").alias("pos", "name"))
    at = at.withColumn("name", F.trim("name")).withColumn("key", F.lower("name"))
    names = at.where("key <> ''").groupBy("key").agg(F.min_by("name", F.struct("id", "side", "pos")).alias("name"), F.min(F.struct("id", "side", "pos")).alias("ord"))
    known = alias_dim(registry).select(F.col("alias").alias("key"), F.col("id").alias("_id"))
    found = names.join(known, "key", "left").join(registry.select(F.col("id").alias("_id"), F.col("name").alias("_name")), "_id", "left")
    slug = F.coalesce(X.empty_to_null(X.unicode_slug(F.col("name"))), F.lit("player"))
    fresh = found.where("_id is null").select("key", "name", slug.alias("slug"), "ord")
    minted = mint_names(fresh.select(F.col("key").alias("name"), "slug", "ord"), registry.select("id")).select(F.col("name").alias("key"), F.col("id").alias("_id"))
    new = fresh.join(minted, "key").select("key", F.col("_id").alias("id"), "name")
    entry = found.where("_id is not null").select("key", F.col("_id").alias("player"), F.col("_name").alias("displayName")).unionByName(new.select("key", F.col("id").alias("player"), F.col("name").alias("displayName")))
    named = at.join(entry, "key", "left").groupBy("id", "side").agg(
        F.first("t").alias("t"), F.array_sort(F.collect_list(F.when(F.col("player").isNotNull(), F.struct("pos", F.col("player").alias("id"), "displayName")))).alias("p")
    )
    players = F.transform("p", lambda x: F.struct(x["id"].alias("id"), x["displayName"].alias("displayName")))
    side = F.when(F.col("side") == 0, "left").otherwise("right")
    team = F.when(F.col("t").isNotNull(), F.struct("side", F.struct(side.alias("side"), players.alias("players"), F.col("t.characters").alias("characters"), F.col("t.fuse").alias("fuse")).alias("team")))
    teams = named.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(team)), lambda x: x["team"]).alias("teams"))
    return manual.drop("teams").join(teams, "id", "left"), new.select("id", "name", F.lit(True).alias("featured"), F.array("key").alias("aliases"))


def discover(names: DataFrame, registry_ids: DataFrame) -> DataFrame:
    """(slug, id, handle, aliases, n) of unresolved names (name, slug, ord): the handle is the most frequent spelling, of equals the first seen."""
    by_name = names.groupBy("slug", "name").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    found = by_name.groupBy("slug").agg(
        F.min_by("name", F.struct(-F.col("n"), "first")).alias("handle"),
        F.array_sort(F.collect_set(F.lower("name"))).alias("aliases"),
        F.sum("n").alias("n"),
    )
    return found.join(mint_ids(found, registry_ids), "slug")


def resolve_players(tokens: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tokens with player, display and slug; discovered). tokens: (token, ord, …); registry: (ord, id, name, aliases)."""
    known = alias_dim(registry)
    handles = registry.select(F.col("id").alias("_h"), F.col("name").alias("handle"))
    exact = resolve_exact(tokens.withColumn("token", F.trim("token")), known, "known")
    names = exact.where("known is null").select("token").distinct()
    # letters beyond ASCII are decomposed once for each distinct name
    slugs = names.where(~F.col("token").rlike("[^\\x00-\\x7F]")).select("token", X.slug(F.col("token")).alias("slug")).unionByName(names.where(F.col("token").rlike("[^\\x00-\\x7F]")).select("token", X.unicode_slug(F.col("token")).alias("slug")))
    slugs = slugs.withColumn("slug", F.coalesce(X.empty_to_null(F.col("slug")), F.lit("player")))
    rest = exact.where("known is null").join(slugs, "token").select(F.col("token").alias("name"), "slug", "ord")
    found = discover(rest, registry.select("id"))
    new = slugs.join(found.select("slug", F.col("id").alias("_new"), F.col("handle").alias("_name")), "slug").select("token", "slug", "_new", "_name")
    out = exact.join(new, "token", "left").join(handles, F.col("known") == F.col("_h"), "left")
    return out.withColumn("player", F.coalesce("known", "_new")).withColumn("display", F.coalesce("handle", "_name")).drop("known", "_new", "_name", "_h", "handle"), found


def relabel_players(df: DataFrame, registry: DataFrame) -> DataFrame:
    """df with the registry's handles as display names, teams and players in their order."""
    flat = df.select("id", F.posexplode("teams").alias("tp", "t")).select("id", "tp", "t", F.posexplode_outer("t.players").alias("pp", "p"))
    named = flat.join(registry.select(F.col("id").alias("_p"), F.col("name").alias("_n")), F.col("p.id") == F.col("_p"), "left")
    player = F.when(F.col("p").isNotNull(), F.struct(F.col("p.id").alias("id"), F.coalesce("_n", "p.displayName").alias("displayName")))
    teams = named.groupBy("id", "tp").agg(F.first("t").alias("t"), F.transform(F.array_sort(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("pp", player.alias("p"))))), lambda x: x["p"]).alias("ps"))
    rows = teams.select("id", F.struct("tp", F.struct(F.col("t.side").alias("side"), F.col("ps").alias("players"), F.col("t.characters").alias("characters"), F.col("t.fuse").alias("fuse")).alias("t")).alias("x"))
    back = rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]).alias("_teams"))
    return df.join(back, "id", "left").withColumn("teams", F.coalesce("_teams", "teams")).drop("_teams")


def prune_unreferenced(seed: DataFrame, discovered: DataFrame, df: DataFrame) -> DataFrame:
    """Seed entries, and those discovered entries that some record's teams or players name."""
    named = df.select(F.explode(F.array_union("allPlayers", F.flatten(F.transform("teams", lambda t: t["players"]["id"])))).alias("id")).distinct()
    return seed.unionByName(discovered.join(named, "id", "left_semi"), allowMissingColumns=True)
