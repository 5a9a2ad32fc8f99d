"""Column expressions for titles, descriptions, names and dates. All run in the JVM."""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Not inside a word of ASCII letters, digits and underscores.
_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: What parts a title, and how its segments are written.
MARK = "▰"
TEAMS = r"(?is)^(.+?\([^)]*\))\s+vs\s+(.+\([^)]*\))$"
TEAM = r"(?s)^(.*?)\s*\(([^)]*)\)\s*$"
LEADING_RANK = rf"(?i)^\s*{MARK}?\s*rank\s*\d+(?:\s*(?:&|vs\.?)\s*(?:rank\s*)?\d+)?(?:\s*(?:na|eu|asia|jp|kr|world|challenger|duo))*\s*[-!:,]*\s+"
TRAILING_RANK = r"(?i)\s+(?:#\s*)?\d+\s+rank\s*$"
PLAYER_SEPARATOR = r"\s*&\s*|\s*\+\s*|\s+-\s*|\s*-\s+"
SHAPE = rf"(?i)^[^{MARK}]*(?:{MARK}\s*)?[^{MARK}]*?\([^)]*\)\s+vs\s+[^{MARK}]*?\([^)]*\)\s*(?:{MARK}[^{MARK}]*)?$"
CHARACTER_SEPARATOR = r"\s*[/-]\s*"
#: Of the segment that names the brand, and of what follows the match; {brand} is put in.
FIRST_SEGMENT = rf"(?i)^[^{MARK}]*?{_B}{{brand}}{_E}[^{MARK}]*{MARK}\s*"
LAST_SEGMENT = rf"\s*{MARK}[^{MARK}]*$"
#: How descriptions, durations and pictures are written.
SEASON_LABELS = (r"(?i)\(Season\s*(\d+)\)", r"(?i)Season\s*(\d+)")
PATCH_LABEL = r"(?i)Patch\s*:\s*([^\n\r]+)"
WRITTEN_DAY = r"(\d{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]+)\s+(\d{4})"
DURATION = r"PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?"
RESOLUTIONS = ("maxres", "standard", "high", "medium", "default")
PICTURE = ("https://i.ytimg.com/vi/", "/hqdefault.jpg")
#: Tags of tournament rounds, in the order in which they are tried.
ROUNDS = (
    (r"grand\s*finals?", "grand-finals"),
    (r"gf", "grand-finals"),
    (r"losers?\s*finals?", "losers-final"),
    (r"winners?\s*finals?", "winners-final"),
    (r"semi[-\s]?finals?", "semifinals"),
    (r"top\s*8", "top-8"),
    (r"top\s*16", "top-16"),
    (r"first\s*strike", "first-strike"),
)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
LONG_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def norm_ws(c: Column) -> Column:
    """White space, of Unicode too, as single blanks, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def strip_prefix(c: Column, brand: str) -> Column:
    """Without a first segment that names the brand, if no mark stands before its end."""
    return F.regexp_replace(c, FIRST_SEGMENT.replace("{brand}", brand), "")


def strip_suffix(c: Column) -> Column:
    return F.regexp_replace(c, LAST_SEGMENT, "")


def split_teams(c: Column) -> Column:
    """struct(left, right) of a title's core, null if it has no two teams."""
    left, right = (empty_to_null(F.regexp_extract(c, TEAMS, k)) for k in (1, 2))
    return F.when(left.isNotNull(), F.struct(left.alias("left"), right.alias("right")))


def extract_team(c: Column) -> Column:
    """struct(players, characters), raw, of one team's segment, null if it isn't one."""
    return F.when(c.rlike(TEAM), F.struct(F.regexp_extract(c, TEAM, 1).alias("players"), F.regexp_extract(c, TEAM, 2).alias("characters")))


def strip_accolades(c: Column, passes: int = 4) -> Column:
    """A player segment without ranks before or behind, stacked ones too, but never empty."""

    def once(s: Column, _: Column) -> Column:
        less = F.trim(F.regexp_replace(F.trim(F.regexp_replace(s, LEADING_RANK, "")), TRAILING_RANK, ""))
        return F.when(less == "", s).otherwise(less)

    return F.aggregate(F.sequence(F.lit(1), F.lit(passes)), F.trim(F.regexp_replace(F.trim(c), rf"^{MARK}\s*", "")), once)


def _tokens(c: Column, separator: str) -> Column:
    return F.filter(F.transform(F.split(c, separator), lambda x: F.trim(x)), lambda x: x != "")


def split_chars(c: Column) -> Column:
    return _tokens(c, CHARACTER_SEPARATOR)


def split_players(c: Column) -> Column:
    return _tokens(c, PLAYER_SEPARATOR)


def slug(c: Column) -> Column:
    """Lower-case ASCII letters and digits of a name; the whole rule for ASCII names."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


@functools.cache
def _decomposed() -> dict[str, str]:
    """What each character beyond ASCII leaves in a slug, if anything, by compatibility decomposition."""
    each = ((chr(k), unicodedata.normalize("NFKD", chr(k)).lower()) for k in range(128, sys.maxunicode + 1) if not 0xD800 <= k < 0xE000)
    slugs = ((c, "".join(x for x in d if x.isascii() and x.isalnum())) for c, d in each)
    return {c: d for c, d in slugs if d}


def unicode_slug(c: Column) -> Column:
    """slug after compatibility decomposition, so accented letters count as their base. Characters that leave one letter are translated; names with
    any that leave several are put together by characters."""
    table = _decomposed()
    several = "".join(x for x, d in table.items() if len(d) > 1)
    one = lambda s: F.translate(s, "".join(table), "".join(d[0] for d in table.values()))
    nth = lambda s, k: F.translate(s, several, "".join(table[x][k : k + 1] or " " for x in several))
    most = max(map(len, table.values()))
    whole = lambda x: F.when(F.instr(F.lit(several), x) > 0, F.concat(one(x), *(nth(x, k) for k in range(1, most)))).otherwise(one(x))
    by_character = F.array_join(F.transform(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), whole), "")
    return slug(F.when(F.translate(c, several, "") == c, one(c)).otherwise(by_character))


def deleet(c: Column) -> Column:
    return F.translate(c, "013457", "oieast")


def handle_words(c: Column) -> Column:
    """Slugs of a handle's words: parted by blanks, bars, slashes, or a hyphen between cases."""
    return F.filter(F.transform(F.split(c, r"[\s|/\\]+|(?<=[a-z])-(?=[A-Z])"), slug), lambda w: w != "")


def within_one_edit(a: Column, b: Column) -> Column:
    """At most one insertion, deletion, substitution or swap of neighbours apart."""
    swap = lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substr(a, i + 2)) == b
    swapped = F.when((F.length(a) == F.length(b)) & (F.length(a) > 1), F.exists(F.sequence(F.lit(1), F.length(a) - 1), swap)).otherwise(False)
    return (F.levenshtein(a, b, 1) >= 0) | swapped


def labeled_season(c: Column) -> Column:
    """The number behind "Season", in brackets first."""
    found = F.coalesce(*(empty_to_null(F.regexp_extract(c, p, 1)) for p in SEASON_LABELS))
    return found.cast("int")


def patch_label(c: Column) -> Column:
    """What follows "Patch:" on its line, as a day if it is one (days beyond the month roll over)."""
    label = F.trim(empty_to_null(F.regexp_extract(c, PATCH_LABEL, 1)))
    day = WRITTEN_DAY
    name = F.lower(F.regexp_extract(label, day, 2))
    names = [(n, k + 1) for k, n in [*enumerate(LONG_MONTHS), *enumerate(MONTHS)]] + [("sept", 9)]
    month = F.element_at(F.create_map(*(F.lit(x) for n, k in dict(names).items() for x in (n, k))), F.when(name != "", name).otherwise("-"))
    known = (name != "") & month.isNotNull()
    first = F.make_date(empty_to_null(F.regexp_extract(label, day, 3)).cast("int"), month, F.lit(1))
    date = F.date_add(first, empty_to_null(F.regexp_extract(label, day, 1)).cast("int") - 1)
    return F.when(known, F.date_format(date, "yyyy-MM-dd")).otherwise(label)


def round_tags(c: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(*(F.when(c.rlike(rf"(?i){_B}{p}{_E}"), F.lit(t)) for p, t in ROUNDS))))


def scan_alias(c: Column, aliases: list[tuple[str, str]]) -> Column:
    """The id of the longest alias (alias, id) that stands in a text as a word; earlier ones win ties."""
    escaped = lambda a: "".join(f"\\{x}" if x in r".*+?^${}()|[]\\" else x for x in a)
    tried = sorted(enumerate(aliases), key=lambda x: (-len(x[1][0]), x[0]))
    return F.coalesce(*(F.when(F.lower(c).rlike(_B + escaped(a.lower()) + _E), F.lit(i)) for _, (a, i) in tried), F.lit(None).cast("string"))


def same_pair(a: Column, b: Column) -> Column:
    """Both are the same two."""
    return (F.size(a) == 2) & (F.size(b) == 2) & (F.array_sort(a) == F.array_sort(b))


def match_type(most_players: Column, rounds: Column) -> Column:
    return F.when(most_players >= 2, "duo").when(F.size(rounds) > 0, "tournament").otherwise("ranked")


def iso_duration(c: Column) -> Column:
    """Seconds of PT#H#M#S; 0 if there are none."""
    part = lambda k: F.coalesce(empty_to_null(F.regexp_extract(c, DURATION, k)).cast("int"), F.lit(0))
    return part(1) * 3600 + part(2) * 60 + part(3)


def expected_shape(c: Column) -> Column:
    return norm_ws(c).rlike(SHAPE)


def era_key(season: Column) -> Column:
    return F.when(season.isNull(), "Beta").otherwise(F.concat(F.lit("S"), season.cast("string")))


def patch_token(version: Column, season: Column) -> Column:
    return F.coalesce(version, era_key(season))


def pair_key(characters: Column) -> Column:
    """a|b of exactly two, else null."""
    return F.when(F.size(characters) == 2, F.array_join(F.array_sort(characters), "|"))


def add_days(day: Column, n: int) -> Column:
    return F.date_format(F.date_add(day.cast("date"), n), "yyyy-MM-dd")


def picture(video: Column) -> Column:
    """The url that every video has."""
    return F.concat(F.lit(PICTURE[0]), video, F.lit(PICTURE[1]))


def thumbnail(thumbs: Column, video: Column) -> Column:
    """The url of highest resolution in map<string, struct<url>>."""
    ladder = [empty_to_null(F.try_element_at(thumbs, F.lit(k))["url"]) for k in RESOLUTIONS]
    return F.coalesce(*ladder, picture(video))
