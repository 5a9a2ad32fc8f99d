"""JSON files whose top level is one object, read in byte ranges by several tasks.

A range can't be parsed on its own: whether its first byte lies in a string, and how deep, hangs on all before it. So each range is
first summed up (does it end in a string, how many levels up or down it goes), for a start outside and within a string; put one
after the other, a row a range, these give where each range starts from. Then a task reads the entries that begin in its range, and
reads on to the end of the last of them.

Cases: an empty file, or a top level other than an object, is malformed, as is one whose brackets or strings don't close, and fails
the read; so does an entry that is no `"key": value`. Of a key given twice the last value holds, in the place of the first. Entries
are strings of JSON; whoever reads them parses them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range, and what a task reads at a time beyond it.
RANGE, MORE = 32 << 20, 1 << 16
ENTRIES = "file string, pos bigint, key string, value string"
SUMS = "file string, start bigint, up bigint, up_in bigint, flips boolean, first bigint, blank boolean"


def opened(path: str):
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def files(path: str) -> list[tuple[str, int]]:
    """The file, or the JSON files of the folder, with their sizes, in order."""
    store, name = fs.FileSystem.from_uri(path)
    head = path[: len(path) - len(name)] if path.endswith(name) else ""
    info = store.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(name, recursive=True))
    return sorted((head + f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


def slashes_before(f, start: int) -> int:
    """How many backslashes stand right before a byte."""
    n = 0
    while start > n:
        size = min(MORE, start - n)
        block = f.read_at(size, start - n - size)
        rest = len(block) - len(block.rstrip(b"\\"))
        n += rest
        if rest < size:
            break
    return n


def quotes(b: np.ndarray, slashes: int) -> np.ndarray:
    """Which bytes are quotes that begin or end a string: those after an even number of backslashes."""
    at = np.arange(len(b))
    last = np.maximum.accumulate(np.where(b != 92, at, -1 - slashes))
    before = np.concatenate([[-1 - slashes], last[:-1]])  # the last byte before that is no backslash
    return (b == 34) & ((at - 1 - before) % 2 == 0)


def levels(b: np.ndarray, q: np.ndarray, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether each byte lies in a string or ends one, the depth after each byte)."""
    within = (np.cumsum(q) + inside) % 2 == 1
    plain = ~within & ~q
    step = plain & ((b == 123) | (b == 91))
    return within, depth + np.cumsum(step.astype(np.int64) - (plain & ((b == 125) | (b == 93))))


def summed(path: str, start: int, size: int) -> tuple:
    with opened(path) as f:
        data = f.read_at(size, start)
        b = np.frombuffer(data, dtype=np.uint8)
        q = quotes(b, slashes_before(f, start))
    ends = [levels(b, q, inside, 0)[1] for inside in (False, True)]
    text = data.lstrip(b" \t\r\n")
    return path, start, *(int(e[-1]) if len(e) else 0 for e in ends), bool(q.sum() % 2), text[0] if text else 0, not text


def entries(path: str, start: int, size: int, whole: int, inside: bool, depth: int) -> Iterator[tuple]:
    """(file, pos, key, value) of the entries whose comma, or opening bracket, stands in the range."""
    with opened(path) as f:
        data, slashes = f.read_at(size, start), slashes_before(f, start)
        own = len(data)
        while True:
            b = np.frombuffer(data, dtype=np.uint8)
            q = quotes(b, slashes)
            within, after = levels(b, q, inside, depth)
            plain = ~within & ~q
            marks = np.flatnonzero(plain & (((b == 44) & (after == 1)) | ((b == 123) & (after == 1)) | ((b == 125) & (after == 0))))
            begin = marks[(marks < own) & (b[marks] != 125)]
            if not len(begin):
                return
            if marks[-1] > begin[-1] or start + len(data) >= whole:
                break
            data += f.read_at(max(MORE, len(data)), start + len(data))
    ends = marks[np.searchsorted(marks, begin) + 1]
    for a, z in zip(begin, ends):
        text = data[a + 1 : z].decode().strip()
        if not text and b[a] == 123 and b[z] == 125:
            continue  # an object without entries
        try:
            key, at = json.JSONDecoder().raw_decode(text)
        except ValueError:
            key, at = None, 0
        rest = text[at:].lstrip()
        if not isinstance(key, str) or not rest.startswith(":") or not rest[1:].strip():
            raise ValueError(f"{path}: no entry at byte {start + a}: {text[:80]!r}")
        yield path, int(start + a), key, rest[1:].strip()


class Range(InputPartition):
    def __init__(self, *what):
        self.what = what


class KeyedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range = options["path"], int(options.get("rangebytes", RANGE))
        self.starts = json.loads(options["starts"]) if "starts" in options else None

    def partitions(self) -> list[Range]:
        if self.starts is not None:
            return [Range(*x) for x in self.starts]
        return [Range(p, at, min(self.range, size - at)) for p, size in files(self.path) for at in range(0, max(1, size), self.range)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if self.starts is None:
            yield summed(*partition.what)
        else:
            yield from entries(*partition.what)


class KeyedSums(DataSource):
    """A row a range: what the ranges do to strings and depth."""

    @classmethod
    def name(cls) -> str:
        return "keyed_json_ranges"

    def schema(self) -> str:
        return SUMS

    def reader(self, schema) -> KeyedReader:
        return KeyedReader(self.options)


class KeyedJson(DataSource):
    """The entries of id-keyed objects; `starts` says where the ranges start from."""

    @classmethod
    def name(cls) -> str:
        return "keyed_json"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> KeyedReader:
        return KeyedReader(self.options)


def keyed_entries(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """(ord, key, value) of an id-keyed object, or of all those of a folder's files, in their order; values are JSON."""
    spark.dataSource.register(KeyedSums)
    spark.dataSource.register(KeyedJson)
    sums = spark.read.format("keyed_json_ranges").option("rangeBytes", range_bytes).load(path).orderBy("file", "start").collect()  # a row a range
    whole = dict(files(path))
    starts, inside, depth, begun = [], False, 0, False
    for k, r in enumerate(sums):
        if not begun and not r.blank and r.first != ord("{"):
            raise ValueError(f"{r.file}: the top level is no object")
        starts.append((r.file, r.start, min(range_bytes, whole[r.file] - r.start), whole[r.file], inside, depth))
        depth += r.up_in if inside else r.up
        inside ^= r.flips
        begun |= not r.blank
        if k + 1 == len(sums) or sums[k + 1].file != r.file:
            if inside or depth or not begun:
                raise ValueError(f"{r.file}: {'a string' if inside else 'a bracket'} is left open, or there is no object")
            inside, depth, begun = False, 0, False
    rows = spark.read.format("keyed_json").option("starts", json.dumps(starts)).load(path)
    place = F.struct("file", "pos")
    return rows.groupBy("key").agg(F.min(place).alias("ord"), F.max_by("value", place).alias("value")).select("ord", "key", "value")
