"""Ranked lexical search: exact top documents of each item, by hashed max-sketches.

The score of a document is the sum, over an item's terms (repeats included), of the term's weight times its impact, which grows
with the term's occurrences and falls with the document's length; all in integers. One pass over the texts keeps, for each
document, its length and the occurrences of terms that some item asks for, and counts the corpus statistics.

A document's impacts then fold into a sketch: a term's hash names a coordinate, which holds the largest impact of its terms.
The items are looked up in the sketches of a batch of documents together, as a product of matrices: the sum of weights times
coordinates is an upper bound of the score, as no term's impact exceeds its coordinate. Each item takes the batch's documents
by descending bound, scores them exactly, and stops where the bound falls below the score of its last place. Each task keeps the
best of each item, and these are ranked.

Cases: null and wordless texts have no terms and are not counted; an item without terms, or whose terms no document holds, has
no results; fewer documents with a score above 0 than asked for give all; equal scores are ordered by id, documents without an
id last; repeated rows are documents, and items, of their own (items of equal id each have their ranks); empty tables give an empty result; other columns are ignored.
The items are held by each task, in blocks of BLOCK_BYTES; a search for more passes over the texts once a block.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlake.llm.common import cut

#: A-Z lower-cased, other ASCII than letters and digits made blanks; UTF-8 bytes beyond ASCII belong to terms.
_FOLD = bytes(ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))
#: Coordinates of a sketch; documents and items that are looked up together; documents scored exactly at a time.
WIDTH, DOCS, ITEMS, STEP = 1_024, 1_000, 2_000, 32
#: Text of the items that a task holds at once.
BLOCK_BYTES = 32_000_000
#: Numbers of what a task counts besides documents a term: documents, and terms.
_N, _L = -1, -2


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class Asked:
    """A block of items: the numbers of their terms, and each item's distinct terms with their repeats."""

    def __init__(self, rows: list[tuple[int, bytes | None]]):
        self.number: dict[bytes, int] = {}
        self.items: list[tuple[int, np.ndarray, np.ndarray]] = []
        for at, text in rows:
            own = Counter(self.number.setdefault(t, len(self.number)) for t in terms_of(text))
            if own:
                t = np.array(sorted(own), dtype=np.int64)
                self.items.append((at, t, np.array([own[i] for i in t.tolist()], dtype=np.int64)))


class Held:
    """The block that a worker holds: the last one asked for, so it is made once a worker and block."""

    name, asked = None, None

    @classmethod
    def of(cls, rows: Broadcast) -> Asked:
        name, items = rows.value
        if cls.name != name:
            cls.name, cls.asked = name, Asked(items)
        return cls.asked


def index(docs: DataFrame, rows: Broadcast, id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tf): of each document its length, and the asked terms that it holds with their occurrences; and rows without n: what a task counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, df = Held.of(rows).number, Counter()
        for b in batches:
            at, ns, terms, tfs = [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                words = terms_of(text)
                if not words:
                    continue
                df[_N] += 1
                df[_L] += len(words)
                own = sorted(Counter(k for k in map(number.get, words) if k is not None).items())
                if own:
                    ids = [k for k, _ in own]
                    df.update(ids)
                    at.append(i)
                    ns.append(len(words))
                    terms.append(ids)
                    tfs.append([n for _, n in own])
            yield batch(b.column(0).take(pa.array(at, pa.int64())), ns, terms, tfs)
        yield batch(pa.array([None], kind), [None], [list(df)], [list(df.values())])

    def batch(ids: pa.Array, ns: list, terms: list, tfs: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array(ns, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["id", "n", "terms", "tf"])

    kind = pa.int64()
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.encode(text_col, "UTF-8").alias("text"))
    return texts.mapInArrow(run, "id bigint, n bigint, terms array<int>, tf array<bigint>")


class Best:
    """The best documents of one item: the largest scores, of equal ones the smaller ids."""

    def __init__(self, k: int):
        self.k, self.rows, self.least = k, [], 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        self.rows += [(-s, i is None, i) for s, i in zip(scores.tolist(), ids) if s >= self.least]
        self.rows = sorted(self.rows, key=lambda r: (r[0], r[1], r[2] or 0))[: self.k]
        if len(self.rows) == self.k:
            self.least = -self.rows[-1][0]


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def sketches(row: np.ndarray, term: np.ndarray, impact: np.ndarray, n: int) -> np.ndarray:
    """The largest impact of each document's terms in each coordinate."""
    out = np.zeros((n, WIDTH), dtype=np.float32)
    np.maximum.at(out, (row, term % WIDTH), impact.astype(np.float32))
    return out


def searched(part: pa.RecordBatch, asked: Asked, weight: np.ndarray, docs: int, length: int, best: list[Best]) -> int:
    """Looks a batch of documents up for all items; what each finds goes to its best. Returns how many documents were scored exactly."""
    ids, n = part.column(0).to_pylist(), part.column(1).to_pylist()
    term, tf = (part.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
    row = np.repeat(np.arange(len(n)), np.diff(part.column(2).offsets.to_numpy()))
    m = np.array([25 + 75 * x * docs // length for x in n], dtype=np.int64)
    impact = impacts(tf, m[row])
    seen = sketches(row, term, impact, len(n))
    span = len(weight) + 1
    at = row * span + term  # ascending: a document's terms are in order
    scored = 0
    for lo in range(0, len(asked.items), ITEMS):
        block = asked.items[lo : lo + ITEMS]
        look = np.zeros((WIDTH, len(block)), dtype=np.float32)
        for j, (_, own, times) in enumerate(block):
            np.add.at(look[:, j], own % WIDTH, (weight[own] * times).astype(np.float32))
        bounds = (seen @ look).T * np.float32(1.0005)  # beyond what the sums of floats may lose
        for j, (_, own, times) in enumerate(block):
            mine, bound = best[lo + j], bounds[j]
            order = np.flatnonzero(bound >= mine.least)
            order = order[np.argsort(-bound[order], kind="stable")]
            for k in range(0, len(order), STEP):
                some = order[k : k + STEP]
                some = some[bound[some] >= mine.least]
                if not len(some):
                    break
                key = some[:, None] * span + own[None, :]
                place = np.minimum(np.searchsorted(at, key), len(at) - 1)
                score = (np.where(at[place] == key, impact[place], 0) * (weight[own] * times)[None, :]).sum(axis=1)
                mine.add(score, [ids[i] for i in some])
                scored += len(some)
    return scored


def found(indexed: DataFrame, rows: Broadcast, k: int) -> DataFrame:
    """(at, id, score): the best of each item (by its number) that each task has found, of one block."""
    counted = indexed.where("n is null").select(F.inline(F.arrays_zip("terms", "tf"))).groupBy("terms").agg(F.sum("tf").alias("n"))
    df = {r["terms"]: r["n"] for r in counted.collect()}  # the terms of one block of items
    docs, length = df.pop(_N, 0), df.pop(_L, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Held.of(rows)
        weight = np.zeros(len(asked.number), dtype=np.int64)
        for t, n in df.items():
            weight[t] = math.floor(1000 * math.log((2 * docs + 2) / (2 * n + 1)))
        best = [Best(k) for _ in asked.items]
        for b in batches:
            for lo in range(0, b.num_rows, DOCS):
                searched(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in b.slice(lo, DOCS).columns], names=b.schema.names), asked, weight, docs, length, best)
        rows_of = [(at, i, -s) for (at, _, _), x in zip(asked.items, best) for s, _, i in x.rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows_of], pa.int64()) for c in range(3)], names=["at", "id", "score"])

    return indexed.where("n is not null").mapInArrow(run, "at bigint, id bigint, score bigint")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(<item_col>, rank, <id_col>, score): the k documents of the highest scores of each item."""
    spark = docs.sparkSession
    own = cut(items.select(F.monotonically_increasing_id().alias("at"), F.col(item_col).alias("item"), F.encode(item_text, "UTF-8").alias("text")))
    n_blocks = (own.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_BYTES + 1
    parts = []
    for b in range(n_blocks):
        # the driver holds one block at a time
        rows = spark.sparkContext.broadcast((uuid.uuid4().hex, [(r["at"], r["text"]) for r in own.where(F.pmod(F.xxhash64("at"), F.lit(n_blocks)) == b).select("at", "text").collect()]))
        parts.append(cut(found(cut(index(docs, rows, id_col, text_col)), rows, k)))
        rows.unpersist()
    order = Window.partitionBy("at").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    top = reduce(DataFrame.union, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(own.select("at", "item"), "at").select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
