"""Quality rules with risk-controlled thresholds.

Each rule scores a text; a text whose score lies above the rule's cutoff is rejected. Each rule has a cutoff of its own in
each stratum, found on a labelled holdout of distinct good texts that is split in two halves by a hash of the text. The
first half orders the moves (tighten one rule by one step) by how many of its texts the rule would then reject, so that a
rule that good texts often break comes late and stops no other. On the second half, which the order doesn't depend on, the
moves are tried in that order: one is admitted if the exact binomial test rejects, at level delta over the number of strata
(Bonferroni), that the false rejection rate of all rules together is above the risk, and the first that isn't ends the
sequence (so the moves before it need no further correction). With probability 1 - delta no stratum loses more than `risk`
of those of its good texts that pass the base rule; this holds for each stratum, whatever its size.

Cases: a null text has no words and fails the base rule; with too few labels for any move (about 90 good texts in its
second half are needed for four strata), a stratum keeps what passes the base rule; a null stratum is a stratum of its own; of contradicting labels of one id or text the worst counts; labels
without a text don't count; copies count once in the holdout; repeated rows each get a row; an empty table gives an empty
result. Extra columns stay.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import WORD, cut, words

#: Symbols that prose has few of.
SYMBOLS = "[#*$%&|<>]"
#: Words of a window, for repeats.
WINDOW = 8
MIN_WORDS, MAX_REPEATS = 20, 30
#: Rules and their cutoffs at each step, the loosest first.
STEPS = {
    "symbol_share": (0.5, 0.3, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2),
    "repeat_share": (0.29, 0.28, 0.27, 0.26, 0.25, 0.225, 0.2, 0.15, 0.1),
    "upper_share": (0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2),
}
N_STEPS = 9
N_MOVES = N_STEPS * len(STEPS)
RISK, DELTA = 0.05, 0.05


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def repeated_words(w: Column) -> Column:
    """How many words lie in windows that occur twice or more."""

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.when(k < F.size(at) - 1, F.least(F.lit(WINDOW), F.get(at, k + 1) - p)).otherwise(WINDOW))
        return F.aggregate(steps, F.lit(0), lambda s, x: s + x)

    def exact(s: Column) -> Column:
        again = F.transform(s, lambda x, k: F.when((x["w"] == F.get(s, k - 1)["w"]) | (x["w"] == F.get(s, k + 1)["w"]), x["i"]))
        return let(F.array_sort(F.array_compact(again)), covered)

    starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
    whole = F.transform(starts, lambda i: F.struct(F.array_join(F.slice(w, i + 1, WINDOW), " ").alias("w"), i.alias("i")))
    hashed = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(starts, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW)))))
    twice = let(hashed, lambda h: F.size(F.array_distinct(h)) < F.size(h))  # equal windows have equal hashes, so most texts are done here
    return F.when((F.size(w) > WINDOW) & twice, let(F.array_sort(whole), exact)).otherwise(0).cast("bigint")


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, the rules' scores, and each rule's first step that rejects (steps); without the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    made = docs.withColumns({"_w": words(F.col(text_col)), "_lines": lines})
    made = made.withColumns(
        {
            "n_words": F.size("_w").cast("bigint"),
            "word_chars": F.length(F.array_join("_w", "")).cast("bigint"),
            "n_symbols": F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("bigint"),
            "_n_lines": F.size("_lines"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "n_repeat_words": repeated_words(F.col("_w")),
            "_upper": F.length(F.regexp_replace(text, "[^A-Z]+", "")),
        }
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    made = made.withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATS * F.col("n_words")),
            "symbol_share": share("n_symbols", "word_chars"),
            "dup_line_share": share("n_dup_lines", "_n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "upper_share": share("_upper", "word_chars"),
        }
    )
    passed = lambda rule, grid: F.size(F.filter(F.array(*map(F.lit, grid)), lambda x: x >= F.col(rule)))
    steps = F.array(*(passed(rule, grid) for rule, grid in STEPS.items()))
    return made.withColumn("steps", steps).drop(text_col, "_w", "_lines", "_n_lines", "_upper")


def log_gamma(x: Column) -> Column:
    """For x of 1 or more: Stirling's series at x + 8, to about 1e-12."""
    y = x + 8.0
    below = sum((F.log(x + float(k)) for k in range(1, 8)), F.log(x + 0.0))
    return (y - 0.5) * F.log(y) - y + 0.5 * log(2 * pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5))) - below


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """The probability of k or fewer of n at rate p; 1 where k is not below n * p."""
    k, n = k.cast("double"), n.cast("double")
    at_k = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * log(p) + (n - k) * log(1 - p)
    odds = (1 - p) / p
    lower = F.aggregate(
        F.sequence(F.lit(0), k.cast("int")),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda s, j: F.struct((s["term"] * ((k - j) / (n - k + j + 1)) * odds).alias("term"), (s["sum"] + s["term"]).alias("sum")),
        lambda s: s["sum"],
    )
    return F.when(k < n * p, F.exp(at_k) * lower).otherwise(1.0)


def first_move(steps: Column, at: Column) -> Column:
    """The first of a stratum's moves that rejects a text, N_MOVES if none does; at: the place of each move, by rule and step."""
    by_rule = (F.when(F.get(steps, F.lit(r)) < N_STEPS, F.get(at, r * N_STEPS + F.get(steps, F.lit(r)))) for r in range(len(STEPS)))
    return F.coalesce(F.least(*by_rule), F.lit(N_MOVES))


def limits(scored: DataFrame, labels: DataFrame, id_col: str, stratum: str, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(_stratum, at, holdout, last_move): for each stratum the places of its moves, the good texts they were tried on, and the last admitted move, -1 if there is none."""
    worst = labels.where(F.col("quality").isNotNull()).groupBy(id_col).agg(F.min("quality").alias("_q"))
    one = [F.min("_q").alias("_q"), F.first("steps").alias("steps"), F.first("orders").alias("orders")]
    texts = cut(scored.where("not base_failed").join(worst, id_col).groupBy(F.col(stratum).alias("_s"), "text_hash").agg(*one).where("_q >= 1").select("_s", "steps", "orders"))
    every = cut(scored.select(F.col(stratum).alias("_stratum")).distinct())
    none = lambda n: F.array_repeat(F.lit(0).cast("bigint"), n)

    breaks = F.array(*(F.count_if(F.get("steps", F.lit(r)) <= k) for r in range(len(STEPS)) for k in range(N_STEPS)))
    ordering = texts.where("orders").groupBy("_s").agg(breaks.alias("breaks"))
    moves = F.array_sort(F.transform("breaks", lambda n, m: F.struct(n.alias("n"), (m % N_STEPS).alias("k"), m.alias("m"))))["m"]
    at = let(moves, lambda order: F.transform(F.sequence(F.lit(0), F.lit(N_MOVES - 1)), lambda m: (F.array_position(order, m) - 1).cast("int")))
    paths = every.join(ordering, F.col("_stratum").eqNullSafe(F.col("_s")), "left").select("_stratum", F.coalesce("breaks", none(N_MOVES)).alias("breaks")).select("_stratum", at.alias("at"))

    tested = texts.where("not orders").join(paths, F.col("_stratum").eqNullSafe(F.col("_s"))).select("_s", first_move(F.col("steps"), F.col("at")).alias("move"))
    lost = F.array(*(F.count_if(F.col("move") <= m) for m in range(N_MOVES)))
    tested = tested.groupBy("_s").agg(F.count("*").alias("n"), lost.alias("lost"))
    own = paths.join(tested, F.col("_stratum").eqNullSafe(F.col("_s")), "left").select("_stratum", "at", F.coalesce("n", F.lit(0)).alias("holdout"), F.coalesce("lost", none(N_MOVES)).alias("lost"))
    level = delta / max(1, every.count())
    admitted = F.transform("lost", lambda k: binomial_tail(k, F.col("holdout"), risk) <= level)
    last = F.when(F.array_contains(admitted, F.lit(False)), F.array_position(admitted, F.lit(False)) - 2).otherwise(N_MOVES - 1)
    return own.select("_stratum", "at", "holdout", last.cast("int").alias("last_move"))


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang", **how) -> DataFrame:
    """id, the features, kept (not base_failed, and rejected by no move up to its stratum's last), stratum, text_hash, the rules' scores, move (the first that rejects), and holdout and last_move of its stratum."""
    halves = {"text_hash": F.xxhash64(text_col), "orders": F.md5(text_col) < "8"}
    scored = cut(features(docs.select(id_col, text_col, stratum).withColumns(halves), text_col))
    found = limits(scored, labels, id_col, stratum, **how)
    out = scored.join(found, scored[stratum].eqNullSafe(found["_stratum"])).withColumn("move", first_move(F.col("steps"), F.col("at")))
    kept = ~F.col("base_failed") & (F.col("move") > F.col("last_move"))
    return out.withColumn("kept", kept).select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", stratum, "text_hash", *STEPS, "move", "holdout", "last_move")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang", **how) -> DataFrame:
    """docs without those that the rules reject."""
    good = judged(docs, labels, id_col, text_col, stratum, **how).where("kept").select(F.col(id_col).alias("_id"), "text_hash", F.col(stratum).alias("_stratum")).distinct()
    same = docs[id_col].eqNullSafe(good["_id"]) & (F.xxhash64(docs[text_col]) == good["text_hash"]) & docs[stratum].eqNullSafe(good["_stratum"])
    return docs.join(good, same, "left_semi")
