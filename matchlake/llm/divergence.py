"""Source divergence audit: how far the words of a language's sources lie apart, in exact integers.

In-mapper stripes: each task folds whole documents into a hash of stripes, (language, term) to each source's document and
occurrence counts, and spills the stripes when they hold too many entries; spilled stripes are merged by key. A merged stripe
has a term's counts in all sources, so each task of merged stripes directly emits the divergences that its terms add to.

A language keeps the terms that at least `least_docs` of its documents hold (V of them). Each of its (language, source) groups, and
the language as a whole, gives each kept term the weight p = 1 + floor(10^9 * (count + 2) / (N + 2 * V)), N the group's
occurrences of kept terms. Two weights differ by floor((p - q)^2 / (p + q)).

Cases: null text, language and source are empty strings; texts without terms, and sources that have no others, still make a
group; a language without kept terms has pairs of value 0 and no terms; a document is a row, so repeated rows count each;
equal values are ordered by item (UTF-8); an empty table gives an empty result; other columns are ignored. Texts are folded
whole, whatever their length: a task holds SPILL entries and the terms of one text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlake.llm.common import cut

#: A-Z lower-cased, other ASCII than letters made blanks; UTF-8 bytes beyond ASCII belong to terms.
_FOLD = bytes(ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(128)) + bytes(range(128, 256))
LEAST_DOCS, TOP, ONE = 10, 10, 1_000_000_000
#: Entries (a term and a source) that a task folds before it spills: about 60 MB.
SPILL = 200_000
#: Weights (terms times sources) that a task holds at once, and terms of a task of merged stripes.
CELLS, TERMS = 1_000_000, 20_000

_STRIPE = "lang string, term string, counts array<struct<source:string,docs:bigint,n:bigint>>"


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes (lang, term, counts by source) of batches of (lang, source, text); a stripe without a term names the language's sources."""
    stripes: dict = {}
    entries = 0

    def spilled() -> pa.RecordBatch:
        flat = [c for by in stripes.values() for c in by.values()]
        columns = [pa.array([s for by in stripes.values() for s in by], pa.string()), *(pa.array([c[k] for c in flat], pa.int64()) for k in (0, 1))]
        ends = np.cumsum([0, *map(len, stripes.values())]).astype(np.int32)
        counts = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, names=["source", "docs", "n"]))
        langs, terms = [lang for lang, _ in stripes], [None if term is None else term.decode() for _, term in stripes]
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(terms, pa.string()), counts], names=["lang", "term", "counts"])

    for b in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in b.columns)):
            stripes.setdefault((lang, None), {}).setdefault(source, [0, 0])
            for term, n in Counter(terms_of(text)).items():
                by = stripes.get((lang, term))
                if by is None:
                    by = stripes[lang, term] = {}
                c = by.get(source)
                if c is None:
                    by[source] = [1, n]
                    entries += 1
                else:
                    c[0] += 1
                    c[1] += n
            if entries >= SPILL:
                yield spilled()
                stripes, entries = {}, 0
    if stripes:
        yield spilled()


def merged(docs: DataFrame, least_docs: int, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, term, counts): the merged stripes of kept terms, and one without a term for each language."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    stripes = docs.select(empty(lang_col), empty(source_col), F.encode(empty(text_col), "UTF-8")).mapInArrow(folded, _STRIPE)
    summed = stripes.select("lang", "term", F.inline("counts")).groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    whole = summed.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts"))  # an entry a source
    return cut(whole.where((F.col("docs") >= least_docs) | F.col("term").isNull()).drop("docs"))


def whole_numbers(x: np.ndarray, most: int) -> np.ndarray:
    """x with room for ONE times most: as 64-bit integers where that fits, else as Python's."""
    return x if ONE * (most + 2) < 1 << 62 else x.astype(object)


def weights(counts: np.ndarray, total: np.ndarray, v: int) -> np.ndarray:
    return 1 + ONE * (counts + 2) // (total + 2 * v)


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def emitted(stripes: pa.Table, lang: pa.Table, top: int) -> Iterator[dict]:
    """What some merged stripes of one language add to its divergences: sums for pairs of sources, and each source's most telling terms of these."""
    name, v, groups = (lang.column(c)[0].as_py() for c in ("lang", "v", "groups"))
    sources = [g["source"] for g in groups]
    n = whole_numbers(np.array([g["n"] for g in groups], dtype=np.int64), sum(g["n"] for g in groups))
    at = {s: i for i, s in enumerate(sources)}
    rows = sorted(zip(stripes.column("term").to_pylist(), stripes.column("counts").to_pylist()), key=lambda r: r[0])
    pairs = np.zeros((len(sources), len(sources)), dtype=n.dtype)
    telling: list[list[tuple[int, str]]] = [[] for _ in sources]
    step = max(1, CELLS // len(sources))
    for lo in range(0, len(rows), step):
        part = rows[lo : lo + step]
        counts = np.zeros((len(part), len(sources)), dtype=np.int64)
        for i, (_, by) in enumerate(part):
            for c in by:
                counts[i, at[c["source"]]] = c["n"]
        counts = counts.astype(n.dtype)
        p = weights(counts, n[None, :], v)
        q = weights(counts.sum(axis=1), n.sum(), v)
        for s in range(len(sources)):
            if s + 1 < len(sources):
                pairs[s, s + 1 :] += apart(p[:, s + 1 :], p[:, s : s + 1]).sum(axis=0)
            over = np.flatnonzero((counts[:, s] > 0) & (p[:, s] > q))
            value = apart(p[over, s], q[over])
            first = sorted(range(len(over)), key=lambda i: (-value[i], i))[:top] if n.dtype == object else np.lexsort((over, -value))[:top]
            telling[s] = sorted(telling[s] + [(-int(value[i]), part[over[i]][0]) for i in first])[:top]
    for s, source in enumerate(sources):
        for r, other in enumerate(sources):
            if r != s:
                yield {"lang": name, "source": source, "part": "pair", "item": other, "value": int(pairs[min(r, s), max(r, s)])}
        for value, term in telling[s]:
            yield {"lang": name, "source": source, "part": "term", "item": term, "value": -value}


def divergences(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source lies from each other of its language, and the terms that set it most apart from its language."""
    stripes = merged(docs, least_docs, text_col, lang_col, source_col)
    kept = stripes.where("term is not null")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    totals = kept.select("lang", F.inline("counts")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = stripes.where("term is null").select("lang", F.inline("counts")).drop("n").join(totals, ["lang", "source"], "left")
    langs = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("groups"))  # an entry a source
    langs = cut(langs.join(sizes, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0))))
    parts = max(1, -(-(langs.agg(F.max("v")).first()[0] or 0) // TERMS))
    spread = langs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = kept.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int"))
    out = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def emit(own: pa.Table, lang: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(list(emitted(own, lang, top)), schema=out)

    added = dealt.groupBy("lang", "part").cogroup(spread.groupBy("lang", "part")).applyInArrow(emit, "lang string, source string, part string, item string, value bigint")
    added = cut(added.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")))

    def ranked(part: str) -> DataFrame:
        order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
        return added.where(F.col("part") == part).withColumn("rank", F.row_number().over(order))

    return ranked("pair").unionByName(ranked("term").where(F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
