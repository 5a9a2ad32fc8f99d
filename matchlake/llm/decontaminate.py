"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to words (ASCII letters and digits, and everything beyond ASCII; A-Z lower-cased). The automaton
holds each window of consecutive words of each benchmark item; every text is scanned once, and what is hit is mapped
back to code points of the original.

Cases: null and wordless texts have no words and no hits; an item of fewer words than a window is one window; a wordless
item has none; equal windows of several items count for each of them; repeated document rows each get a row; an item
without an id marks words but isn't listed; an empty benchmark hits nothing. Texts are scanned whole, whatever their
length. Other columns of the documents stay. One item alone may exceed a block: its automaton is then as large as it needs.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchlake.llm.common import cut

#: What separates words: ASCII other than letters and digits. UTF-8 bytes beyond ASCII belong to words.
_BLANK = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(128)) + bytes(range(128, 256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: States of one automaton, each about 50 bytes with what it holds: 200 MB a worker. A benchmark that may need more is dealt out over
#: several automata, each with a pass over the texts of its own.
BLOCK_STATES = 4_000_000


def normal_words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().translate(_BLANK).split()


def windows(words: list[bytes], size: int) -> set[bytes]:
    """The windows of an item, each with a blank before and behind."""
    return {b" %b " % b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def automaton(items: list[tuple], size: int) -> ahocorasick.Automaton | None:
    """Windows to (number of words, ids of the items that have them)."""
    owners, lengths = defaultdict(set), {}
    for item_id, text in items:
        w = normal_words(text)
        for x in windows(w, size):
            owners[x].add(item_id)
            lengths[x] = min(size, len(w))
    if not owners:
        return None
    a = ahocorasick.Automaton()
    for x, ids in owners.items():
        a.add_word(x.decode("latin-1"), (lengths[x], tuple(ids)))
    a.make_automaton()
    return a


def hits(words: list[bytes], a: ahocorasick.Automaton | None) -> tuple[list[tuple[int, int]], set]:
    """Runs of words that lie in occurrences of windows (first, behind the last), and the items that occur."""
    norm = b" %b " % b" ".join(words)
    ends, ids = [], set()
    for end, (n, own) in a.iter(norm.decode("latin-1")) if a is not None else ():
        ends.append((end, n))
        ids.update(own)
    if not ends:
        return [], ids
    blanks = np.flatnonzero(np.frombuffer(norm, dtype=np.uint8) == 32)
    at = np.array(ends)
    last = np.searchsorted(blanks, at[:, 0])  # the blank that ends the window follows so many words
    return joined(zip((last - at[:, 1]).tolist(), last.tolist())), ids


def joined(runs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs (first, behind the last), those that touch or overlap made one."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def spans(text: bytes, runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Runs of words as code points of the original, end exclusive."""
    at = [m.span() for m in _WORD.finditer(text.decode())] if runs else []
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in runs]


class Kept:
    """The automaton that a worker holds: the last one asked for, so it is built once a worker and block, never once a row."""

    name, automaton = None, None

    @classmethod
    def of(cls, items: Broadcast, size: int) -> ahocorasick.Automaton | None:
        name, rows = items.value
        if cls.name != (name, size):
            cls.automaton = None
            cls.name, cls.automaton = (name, size), automaton(rows, size)
        return cls.automaton


_RUNS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_runs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def texts_of(b: pa.RecordBatch, at: int) -> Iterator[bytes]:
    for value in b.column(at):
        yield value.as_buffer().to_pybytes() if value.is_valid else b""


def block(items: DataFrame, k: int, n: int) -> Broadcast:
    """A name and block k of n of the items, which is bounded by BLOCK_STATES: the driver holds one at a time."""
    own = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
    return items.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [tuple(r) for r in own.collect()]))


def found_by_block(docs: DataFrame, items: DataFrame, n: int, text_col: str, window: int) -> DataFrame:
    """(_digest, _runs, _items) of the texts that windows occur in, whichever block they are of: a pass over the texts for each block, its hits kept."""

    def scan(own: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for digest, text in zip(b.column(0).to_pylist(), texts_of(b, 1)):
                    runs, ids = hits(normal_words(text), Kept.of(own, window))
                    if runs:
                        out.append({"_digest": digest, "_runs": [dict(zip(("start", "end"), x)) for x in runs], "_items": [x for x in ids if x is not None]})
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("_digest", pa.string()), ("_runs", _runs), ("_items", pa.list_(pa.string()))]))

        return run

    texts = docs.select(F.sha1(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")).alias("_digest"), text_col)
    schema = T.StructType([T.StructField("_digest", T.StringType()), T.StructField("_runs", _RUNS), T.StructField("_items", T.ArrayType(T.StringType()))])
    passes = []
    for k in range(n):
        own = block(items, k, n)
        passes.append(cut(texts.mapInArrow(scan(own), schema).groupBy("_digest").agg(F.first("_runs").alias("_runs"), F.first("_items").alias("_items"))))
        own.unpersist()
    return reduce(DataFrame.union, passes).groupBy("_digest").agg(F.flatten(F.collect_list("_runs")).alias("_runs"), F.flatten(F.collect_list("_items")).alias("_items"))  # a row a block at most


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, out: str = "found") -> DataFrame:
    """docs' columns and `found` (or as out says; such a column of docs is replaced): n_words, n_hit, the ids (as strings, sorted) of items that occur, and the spans hit."""
    docs = docs.drop(out)
    items = benchmark.select(F.col(item_col).cast("string").alias("id"), F.encode(item_text, "UTF-8").alias("text")).where("text is not null")
    n_bytes = items.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    n_blocks = n_bytes * window // BLOCK_STATES + 1  # a byte is in so many windows at most, and each of them may take a state for it
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", _runs)])
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", _RUNS)]))])
    columns, at = docs.columns, docs.columns.index(text_col)

    def row(text: bytes, words: list[bytes], runs: list[tuple[int, int]], ids: Iterable) -> dict:
        return {"n_words": len(words), "n_hit": sum(b - a for a, b in runs), "items": sorted({x for x in ids if x is not None}), "spans": spans(text, runs)}

    if n_blocks == 1:
        own = block(items, 0, 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for text in texts_of(b, at):
                    words = normal_words(text)
                    rows.append(row(text, words, *hits(words, Kept.of(own, window))))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, type=kind)], names=[*columns, out])

        return docs.mapInArrow(run, schema)

    found = found_by_block(docs, items, n_blocks, text_col, window)
    digest = F.sha1(F.encode(F.coalesce(docs[text_col], F.lit("")), "UTF-8"))
    wide = docs.join(found, digest == found["_digest"], "left").select(*(docs[c] for c in columns), found["_runs"], found["_items"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, runs, ids in zip(texts_of(b, at), b.column(len(columns)).to_pylist(), b.column(len(columns) + 1).to_pylist()):
                rows.append(row(text, normal_words(text), joined((r["start"], r["end"]) for r in runs or ()), ids or ()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array(rows, type=kind)], names=[*columns, out])

    return wide.mapInArrow(finish, schema)


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without those that hold a window of the benchmark."""
    out = "found"
    while out in docs.columns:
        out = f"_{out}"
    return contamination(docs, benchmark, out=out, **how).where(F.col(out)["n_hit"] == 0).drop(out)
