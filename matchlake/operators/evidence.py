"""Evidence voting: from measurements of frames to an attribute of each side, its status, promotion and gaps.

readings: video, side (left, right), frame, dy, class, share, sat_frac, struct - one row for each class of each crop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions import pixels as P
from matchlake.functions import text as X
from matchlake.operators.numbering import numbered

#: The gates and bars of the vote.
NEGATIVE = "__hbar"
SAT, FLASH, LEAST_SHARE = (0.1, 0.75), (0.45, 0.85), 0.12
MOST_DIST, LEAST_MARGIN, MOST_STRUCT = 75, 5, 30
STRONG = (25, 15)
RARE, RARE_DIST = "juggernaut", 30
ORIENT_MARGIN, NO_SAT = 8, 0.05
CLEAR_DIST, CLEAR_MARGIN = 6, 15
VOTE_DEGREES = 22.0


def hue_shares(pixels: DataFrame, classes: DataFrame) -> DataFrame:
    """(video, class, share) and sat_frac from pixels (video, r, g, b) and class centres (class, hue): saturation-weighted votes within reach of the nearest centre. Centres are a few rows."""
    p = pixels.select("video", P.saturation(*map(F.col, "rgb")).alias("sat"), P.hue(*map(F.col, "rgb")).alias("h"), P.coloured(*map(F.col, "rgb")).alias("on"))
    every = p.groupBy("video").agg(F.sum(F.when(F.col("on"), F.col("sat")).otherwise(0.0)).alias("weight"), (F.count_if("on") / F.count("*")).alias("sat_frac"))
    centres = classes.agg(F.array_sort(F.collect_list(F.struct("class", "hue"))).alias("cs"))
    near = p.where("on").join(F.broadcast(centres)).withColumn("best", F.array_min(F.transform("cs", lambda c: F.struct(P.hue_distance(F.col("h"), c["hue"]).alias("d"), c["class"].alias("class")))))
    votes = near.where(F.col("best.d") < VOTE_DEGREES).groupBy("video", F.col("best.class").alias("class")).agg(F.sum("sat").alias("votes"))
    return votes.join(every, "video").select("video", "class", (F.col("votes") / F.col("weight")).alias("share"), "sat_frac")


def template_hue(pixels: DataFrame, key: str = "video") -> DataFrame:
    """(key, hue): saturation-weighted circular mean of coloured pixels."""
    rgb = [F.col(c) for c in "rgb"]
    rad, sat = F.radians(P.hue(*rgb)), P.saturation(*rgb)
    sums = pixels.where(P.coloured(*rgb)).groupBy(key).agg(F.sum(F.sin(rad) * sat).alias("y"), F.sum(F.cos(rad) * sat).alias("x"))
    return sums.select(key, F.pmod(F.degrees(F.atan2("y", "x")), F.lit(360.0)).alias("hue"))


def template_distance(hashes: DataFrame, templates: DataFrame) -> DataFrame:
    """(id, name, dist): the nearest template (name, dhash; a registry's few rows) of each hash."""
    t = F.broadcast(templates.agg(F.collect_list(F.struct("name", "dhash")).alias("ts")))
    best = F.array_min(F.transform("ts", lambda x: F.struct(P.hamming(F.col("dhash"), x["dhash"]).alias("dist"), x["name"].alias("name"))))
    return hashes.join(t).select("id", best.alias("b")).select("id", "b.name", "b.dist")


def plate_score(crops: DataFrame, wanted: DataFrame, templates: DataFrame) -> DataFrame:
    """(id, side, score) of sides (id, side, names): how far the two rows of its crops (id, side, frame, y, row, dhash) are at least from the templates
    (name, side, dhash; a registry's few rows) of its one or two names, in either order; null unless every name has a template, and a crop both rows."""
    named = wanted.select("id", "side", F.posexplode("names").alias("pos", "name")).join(F.broadcast(templates.select("name", "side", F.col("dhash").alias("t"))), ["name", "side"], "left")
    goal = named.groupBy("id", "side").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("ts"), F.count("t").alias("known"))
    goal = goal.select("id", "side", F.when((F.col("known") == F.size("ts")) & (F.size("ts") <= 2), F.col("ts.t")).alias("ts"))
    both = crops.groupBy("id", "side", "frame", "y").agg(F.max(F.when(F.col("row") == 0, F.col("dhash"))).alias("a"), F.max(F.when(F.col("row") == 1, F.col("dhash"))).alias("b"))
    far = lambda c, k: P.hamming(F.col(c), F.get("ts", F.lit(k)))
    score = F.when(F.size("ts") == 1, F.least(far("a", 0), far("b", 0)).cast("double")).otherwise(F.least((far("a", 0) + far("b", 1)) / 2, (far("a", 1) + far("b", 0)) / 2))
    found = both.where("a is not null and b is not null").join(goal.where("ts is not null"), ["id", "side"]).groupBy("id", "side").agg(F.min(score).alias("score"))
    return wanted.select("id", "side").join(found, ["id", "side"], "left")


def vote_side(readings: DataFrame) -> DataFrame:
    """(video, side, fuse, dist, margin, struct, sat_frac): gate crops, pick each one's class, the best of each frame, and let frames vote."""
    crop = Window.partitionBy("video", "side", "frame", "dy")
    own = F.when(F.col("class") != NEGATIVE, F.col("share"))
    r = readings.withColumns({"top": F.coalesce(F.max(own).over(crop), F.lit(0.0)), "neg": F.coalesce(F.max(F.when(F.col("class") == NEGATIVE, F.col("share"))).over(crop), F.lit(0.0))})
    ok = F.col("sat_frac").between(*SAT) & (F.col("neg") <= F.col("top")) & ~((F.col("sat_frac") > FLASH[0]) & (F.col("top") > FLASH[1]))
    cands = r.where(ok & (F.col("class") != NEGATIVE) & (F.col("share") >= LEAST_SHARE))
    by_struct = crop.orderBy("struct", F.desc("share"), "class")
    picked = cands.withColumns({"k": F.row_number().over(by_struct), "next": F.lead("struct").over(by_struct)}).where("k = 1")
    picked = picked.select("video", "side", "frame", "dy", F.col("class").alias("fuse"), F.round((1 - F.col("share")) * 100).cast("int").alias("dist"), F.coalesce(F.round(F.col("next") - F.col("struct")).cast("int"), F.lit(64)).alias("margin"), F.round("struct").cast("int").alias("struct"), "sat_frac")
    side = Window.partitionBy("video", "side")
    sane = (F.col("dist") <= MOST_DIST) & (F.col("struct") <= MOST_STRUCT)
    pool = picked.withColumn("sane", sane).withColumn("any", F.max("sane").over(side)).where("sane or not any")
    quality = F.col("struct") * 2 + F.col("dist") * 0.5 - F.least("margin", F.lit(30))
    frames = pool.withColumn("q", quality).withColumn("k", F.row_number().over(Window.partitionBy("video", "side", "frame").orderBy("q", "dy"))).where("k = 1")
    strong = (F.col("dist") <= STRONG[0]) & (F.col("struct") <= STRONG[1])
    voters = frames.withColumn("strong", strong).withColumn("n", F.count_if("strong").over(side)).where("strong or n < 2")
    tally = voters.groupBy("video", "side", "fuse").agg(F.count("*").alias("frames"), F.avg("q").alias("mean"), F.min_by(F.struct("dist", "margin", "struct", "sat_frac"), F.struct("q", "frame")).alias("b"))
    won = tally.withColumn("k", F.row_number().over(side.orderBy(F.desc("frames"), "mean", "fuse"))).where("k = 1").select("video", "side", "fuse", "frames", "b.*")
    seen = readings.groupBy("video", "side").agg(F.max("sat_frac").alias("max_sat"))
    return seen.join(won, ["video", "side"], "left").select("video", "side", "fuse", F.coalesce("frames", F.lit(0)).alias("frames"), F.coalesce("dist", F.lit(999)).alias("dist"), F.coalesce("margin", F.lit(0)).alias("margin"), F.coalesce("struct", F.lit(64)).alias("struct"), F.coalesce("sat_frac", "max_sat").alias("sat_frac"))


def side_confident(s: Column, rare: str = RARE) -> Column:
    good = s["fuse"].isNotNull() & (s["dist"] <= MOST_DIST) & (s["margin"] >= LEAST_MARGIN) & (s["struct"] <= MOST_STRUCT)
    return F.coalesce(good & ((s["fuse"] != rare) | (s["dist"] <= RARE_DIST)), F.lit(False))


def discriminating(df: DataFrame) -> DataFrame:
    """(id, only_left, only_right): characters of one side alone."""
    a, b = (F.get("teams", F.lit(k))["characters"] for k in (0, 1))
    return df.where(F.size("teams") == 2).select("id", F.array_except(a, b).alias("only_left"), F.array_except(b, a).alias("only_right"))


def orientation(df: DataFrame, scores: DataFrame) -> DataFrame:
    """(id, same_order): whether the title's order is the screen's, null if it can't be told. scores: (id, al, br, bl, ar), the distances of either side's characters on either screen side; null where templates lack."""
    d = discriminating(df).join(scores, "id", "left")
    none_a, none_b = F.size("only_left") == 0, F.size("only_right") == 0
    val = lambda c, none: F.when(none, 0.0).otherwise(F.col(c))
    h1, h2 = val("al", none_a) + val("br", none_b), val("bl", none_b) + val("ar", none_a)
    told = ~(none_a & none_b) & (F.abs(h1 - h2) >= ORIENT_MARGIN)
    return d.select("id", F.when(told, h1 < h2).alias("same_order"))


def detection_status(sides: DataFrame, orient: DataFrame) -> DataFrame:
    """(id, left, right, status) in title order, from vote_side's rows and orientation."""
    s = lambda k: F.max(F.when(F.col("side") == k, F.struct("fuse", "dist", "margin", "struct", "sat_frac")))
    v = sides.groupBy(F.col("video").alias("id")).agg(s("left").alias("l"), s("right").alias("r")).join(orient, "id", "left")
    sure = side_confident(F.col("l")) & side_confident(F.col("r"))
    alike = F.col("l.fuse") == F.col("r.fuse")
    dark = (F.coalesce(F.col("l.sat_frac"), F.lit(0.0)) < NO_SAT) & (F.coalesce(F.col("r.sat_frac"), F.lit(0.0)) < NO_SAT)
    status = F.when(sure, F.when(alike | F.col("same_order").isNotNull(), "ok").otherwise("ok-unordered")).when(dark, "none").otherwise("low")
    swap = sure & ~alike & F.coalesce(~F.col("same_order"), F.lit(False))
    return v.select("id", F.when(swap, F.col("r.fuse")).otherwise(F.col("l.fuse")).alias("left"), F.when(swap, F.col("l.fuse")).otherwise(F.col("r.fuse")).alias("right"), status.alias("status"))


def promote(df: DataFrame, det: DataFrame, overrides: DataFrame, sides: DataFrame, orient: DataFrame) -> DataFrame:
    """(id, outcome, fuse0, fuse1, unordered, screen_side, fuse) of low records with two teams and no override: outcome both, single and unordered promote; blocked-orientation is a queue; ambiguous is left."""
    low = det.where("status = 'low'").select("id").join(overrides.select("id"), "id", "left_anti").join(df.where(F.size("teams") == 2).select("id"), "id", "left_semi")
    s = lambda k: F.max(F.when(F.col("side") == k, F.struct("fuse", "dist", "margin", "struct")))
    v = low.join(sides.groupBy(F.col("video").alias("id")).agg(s("left").alias("l"), s("right").alias("r")), "id").join(orient, "id", "left")
    clear = lambda c: F.coalesce(F.col(f"{c}.fuse").isNotNull() & (F.col(f"{c}.dist") <= CLEAR_DIST) & (F.col(f"{c}.margin") >= CLEAR_MARGIN) & (F.col(f"{c}.struct") <= MOST_STRUCT), F.lit(False))
    v = v.withColumns({"okl": clear("l"), "okr": clear("r")})
    both = F.col("okl") & F.col("okr")
    order = F.when(both & (F.col("l.fuse") == F.col("r.fuse")), True).otherwise(F.col("same_order"))
    v = v.withColumn("order", order)
    outcome = F.when(~F.col("okl") & ~F.col("okr"), "ambiguous").when(F.col("order").isNull(), F.when(both, "unordered").otherwise("blocked-orientation")).when(both, "both").otherwise("single")
    lf, rf = F.when(F.col("okl"), F.col("l.fuse")), F.when(F.col("okr"), F.col("r.fuse"))
    straight = F.coalesce("order", F.lit(True))
    v = v.withColumn("outcome", outcome)
    done, stuck = F.col("outcome").isin("both", "single", "unordered"), F.col("outcome") == "blocked-orientation"
    return v.select(
        "id",
        "outcome",
        F.when(done, F.when(straight, lf).otherwise(rf)).alias("fuse0"),
        F.when(done, F.when(straight, rf).otherwise(lf)).alias("fuse1"),
        (F.col("outcome") == "unordered").alias("unordered"),
        F.when(stuck, F.when(F.col("okl"), "left").otherwise("right")).alias("screen_side"),
        F.when(stuck, F.coalesce(lf, rf)).alias("fuse"),
    )


def gap_buckets(df: DataFrame, det: DataFrame, attempts: DataFrame | None, run_ts: str, universe: DataFrame | None = None) -> DataFrame:
    """(id, bucket, era, channel, publishedAt, flags) of records without a fuse. attempts: (id, days); without a log, ids of the last run (universe) stand for those that were tried."""
    missing = df.where(~F.exists("teams", lambda t: t["fuse"].isNotNull()))
    tried = (attempts if attempts is not None else universe).select("id", F.lit(True).alias("_tried"))
    j = missing.join(det.select("id", F.col("status").alias("_st")), "id", "left").join(tried, "id", "left")
    bucket = F.when(F.col("_st").isNull(), F.when(F.col("_tried"), "unavailable").otherwise("pending")).when(F.col("_st").isin("low", "none"), F.col("_st")).otherwise("anomaly")
    j = j.withColumn("bucket", bucket)
    recent = F.unix_timestamp(F.lit(run_ts).cast("timestamp")) - F.unix_timestamp(F.col("publishedAt").cast("timestamp")) < 48 * 3600
    maybe = F.when((F.col("bucket") == "unavailable") & F.lit(attempts is None) & recent, "maybe-pending")
    return j.select("id", "bucket", F.lower(X.era_key(F.col("season"))).alias("era"), "channel", "publishedAt", F.array_compact(F.array(maybe, F.when(F.col("durationSec") == 0, "premiere"))).alias("flags"))


def era_rank(era: Column) -> Column:
    """Beta, then seasons; unknown last."""
    return F.when(era == "beta", 0).otherwise(F.coalesce(F.try_to_number(F.regexp_extract(era, r"^s(\d+)$", 1), F.lit("999")).cast("int") + 1, F.lit(999)))


def order_gaps(gaps: DataFrame) -> DataFrame:
    return gaps.orderBy(era_rank(F.col("era")), "publishedAt", "id")


def review_rows(gaps: DataFrame) -> DataFrame:
    """(id, row): numbers of reviewable gaps in order."""
    open_ = gaps.where(F.col("bucket").isin("low", "none")).select(era_rank(F.col("era")).alias("_era"), "publishedAt", "id")
    return numbered(open_, "_era", "publishedAt", "id").select("id", (F.col("_n") + 1).cast("int").alias("row"))


def filter_gaps(gaps: DataFrame, bucket: str = "all", era: str = "all") -> DataFrame:
    return gaps.where((F.lit(bucket) == "all") | (F.col("bucket") == bucket)).where((F.lit(era) == "all") | (F.col("era") == era))


def old_era_share(gaps: DataFrame) -> DataFrame:
    """(old, reviewable, percent) of gaps in Beta and the first season."""
    r = gaps.where(F.col("bucket").isin("low", "none"))
    return r.agg(F.count_if(F.col("era").isin("beta", "s0")).alias("old"), F.count("*").alias("reviewable")).withColumn("percent", F.round(100.0 * F.col("old") / F.col("reviewable")).cast("int"))


def sheet_drift(sheet: DataFrame, det: DataFrame) -> DataFrame:
    """(id, kind): listed (id) but no longer low or none, or low but not listed."""
    open_ = det.where(F.col("status").isin("low", "none"))
    stale = sheet.join(open_, "id", "left_anti").select("id", F.lit("stale").alias("kind"))
    return stale.unionByName(det.where("status = 'low'").join(sheet, "id", "left_anti").select("id", F.lit("absent").alias("kind")))


def review_queue(gaps: DataFrame, df: DataFrame, overrides: DataFrame) -> DataFrame:
    """(id, bucket, era, title, left, right, saved) of gaps (with frames) whose record has two teams; overrides: (id, left, right) that are saved."""
    r = df.where(F.size("teams") == 2).select("id", "title", F.get("teams", F.lit(0))["fuse"].alias("_l"), F.get("teams", F.lit(1))["fuse"].alias("_r"))
    o = overrides.select("id", F.col("left").alias("_ol"), F.col("right").alias("_or"), F.lit(True).alias("_o"))
    j = gaps.where("frames >= 1").join(r, "id").join(o, "id", "left")
    pick = lambda a, b: F.when(F.col("_o"), F.col(a)).otherwise(F.col(b))
    return j.select("id", "bucket", "era", "title", pick("_ol", "_l").alias("left"), pick("_or", "_r").alias("right"), (F.coalesce("_o", F.lit(False)) & (F.col("_ol").isNotNull() | F.col("_or").isNotNull())).alias("saved"))


def join_gaps(gaps: DataFrame, df: DataFrame) -> DataFrame:
    """gaps with the columns of their records; gaps without a record go."""
    return gaps.join(df.select("id", *(c for c in df.columns if c not in gaps.columns)), "id")


def orient_queue(queue: DataFrame, overrides: DataFrame) -> DataFrame:
    """queue (id, fuse) with the owner so far: the first team of an override (id, fuses) with that fuse, else null."""
    o = overrides.select("id", "fuses")
    at = F.array_position("fuses", F.col("fuse")) - 1
    return queue.join(o, "id", "left").select("id", "fuse", F.when(at >= 0, at).cast("int").alias("owner"))


def orphans(df: DataFrame, ref: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ref.select(key), key, "left_anti")


def backlog(df: DataFrame, done: DataFrame, limit: int | None = None) -> DataFrame:
    """Ids without a detection, in order."""
    left = df.select("id").join(done.select("id"), "id", "left_anti").orderBy("id")
    return left if limit is None else left.limit(limit)


def attempt_summary(attempts: DataFrame) -> DataFrame:
    """(id, n, last, persistent)."""
    return attempts.select("id", F.size("days").alias("n"), F.array_max("days").alias("last"), (F.size("days") >= 2).alias("persistent"))


def confusion(labels: DataFrame, det: DataFrame) -> DataFrame:
    """(truth, seen, n) over sides of labels (id, left, right); unordered detections count as multisets, by sorted places."""
    d = det.where(F.col("status").isin("ok", "ok-unordered")).select("id", F.col("left").alias("dl"), F.col("right").alias("dr"), "status")
    j = labels.join(d, "id")
    loose = F.col("status") == "ok-unordered"
    t, s = F.array("left", "right"), F.array("dl", "dr")
    pairs = F.explode(F.arrays_zip(F.when(loose, F.array_sort(t)).otherwise(t).alias("truth"), F.when(loose, F.array_sort(s)).otherwise(s).alias("seen")))
    return j.select(pairs.alias("x")).groupBy("x.truth", "x.seen").agg(F.count("*").alias("n"))


def histogram(df: DataFrame, col: str, width: int = 4) -> DataFrame:
    return df.groupBy((F.floor(F.col(col) / width) * width).alias("bin")).agg(F.count("*").alias("n"))


def distance_range(df: DataFrame, by: str, col: str = "dist") -> DataFrame:
    """(by, least, mean, most) of a distance."""
    return df.groupBy(by).agg(F.min(col).alias("least"), F.avg(col).alias("mean"), F.max(col).alias("most"))


def status_tally(df: DataFrame, col: str = "status") -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n"))


def last_growth_snapshot(detect_versions: DataFrame, record_versions: DataFrame) -> DataFrame:
    """The records (version, id) just before the newest version of detections (version, id) that has ids its predecessor lacks."""
    before = detect_versions.select((F.col("version") + 1).alias("version"), "id")
    grown = detect_versions.join(before, ["version", "id"], "left_anti").agg((F.max("version") - 1).alias("version"))
    return record_versions.join(F.broadcast(grown), "version")
