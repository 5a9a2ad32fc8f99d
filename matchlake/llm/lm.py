"""Language-model scores from n-gram tries in Elias-Fano levels.

p(word | context) = (count(context word) + m p(word | shorter context)) / (count(context) + m), where m hangs on the context's
count alone, down to add-one counts of single words: a proper distribution that needs counts alone. Counts come from all
training documents.

The model is never in one place. Chunks of documents learn the totals of their words, and of grams that end in a hot word;
then they send their distinct n-grams, dealt out by the context's last word (and, where that is hot, by the word behind it;
where these two are hot together, by the word before too), so that a shard sees all counts of an n-gram and of its endings.
A shard puts what training documents have into one trie (elias_fano.NgramTrie): contexts from their last word backwards,
each level pointing to the next, with the quantised smoothed probabilities of the words behind them. All n-grams, those of
held-out documents too, are then looked up in it: the longest ending that is there, times the back-off weights of the
contexts that are. Codes go back to the chunks, which add them up to scores of their documents. A frequent n-gram is one
row a chunk, so no key is hot.

Cases: a null or empty text is its end token alone; rows with a null id train; repeated rows count each; words unseen in
training get the add-one floor; without training documents every word is unseen; an empty table gives an empty result.
Other columns are ignored. A chunk is cut at CHUNK_BYTES of text, but a document is never cut.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchlake.llm.common import cut, settings, shuffle_width
from matchlake.llm.elias_fano import NgramTrie, distinct, runs

ORDER = 3
#: m for contexts of one word, and for longer ones: so much, and so many times the context's count. Chosen on held-out texts.
MASS = ((5.0, 2.0), (2.0, 1.0))
#: Documents of these remainders of crc32(id as text) are held out.
FOLDS, HELD_OUT = 7, 2
CHUNK_BYTES = 12 << 20
#: Rows that a shard gets on average at most, and occurrences from which a word counts as hot.
PER_SHARD, HOT = 700_000, 300_000
#: A code is -log10 of a probability in steps of 1 / 4096, below 16.
STEP = 1 / 4096
#: Numbers of what precedes a text and of what ends it, as hashes of words.
PAD, END = 0, 1


def packs(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned integers, byte by byte of equal weight, compressed."""
    z = zstandard.ZstdCompressor(level=3)
    parts = []
    for a in arrays:
        body = z.compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()) if len(a) else b""
        parts.append(len(body).to_bytes(8, "little") + a.itemsize.to_bytes(1, "little") + len(a).to_bytes(8, "little") + body)
    return b"".join(parts)


def unpacks(raw: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(raw):
        size, width, n = int.from_bytes(raw[at : at + 8], "little"), raw[at + 8], int.from_bytes(raw[at + 9 : at + 17], "little")
        at += 17
        body = zstandard.ZstdDecompressor().decompress(raw[at : at + size]) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(body, dtype=np.uint8).reshape(width, n).T).view(f"<u{width}").ravel())
        at += size
    return out


def mixed(*keys: np.ndarray) -> np.ndarray:
    """A hash of each row of keys."""
    h = np.zeros(len(keys[0]), dtype=np.uint64)
    for k in keys:
        h = (h ^ k.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def coded(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.round(-np.log10(p) / STEP), 65535).astype(np.uint16)


def decoded(code: np.ndarray) -> np.ndarray:
    return 10.0 ** (-STEP * code.astype(np.float64))


def encoded(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the chunk's words, the number in these of each token, tokens of each text); more frequent words have smaller numbers."""
    voc: dict[bytes, int] = defaultdict(count(1).__next__)  # 0 is the end token
    tokens, lengths = [], []
    for t in texts:
        w = (t or b"").lower().split()
        ids = np.zeros(len(w) + 1, dtype=np.uint32)
        ids[:-1] = np.fromiter(map(voc.__getitem__, w), dtype=np.uint32, count=len(w))
        tokens.append(ids)
        lengths.append(len(ids))
    ids = np.concatenate(tokens)
    hashes = np.array([END, *map(xxhash.xxh64_intdigest, voc)], dtype=np.uint64)
    by_count = np.argsort(-np.bincount(ids, minlength=len(hashes)), kind="stable")
    rank = np.empty(len(hashes), dtype=np.uint32)
    rank[by_count] = np.arange(len(hashes), dtype=np.uint32)
    return hashes[by_count], rank[ids], np.array(lengths, dtype=np.uint32)


def mass(order: int, total: np.ndarray) -> np.ndarray:
    """What the shorter context counts for in n-grams of this order."""
    flat, share = MASS[min(order, len(MASS) + 1) - 2]
    return flat + share * total


def combined(columns: list[np.ndarray], sizes: list[int]) -> np.ndarray:
    """One number for each row of columns (below sizes), in the order of the first, second, ... column."""
    key, most = columns[0].astype(np.uint64), sizes[0]
    for c, n in zip(columns[1:], sizes[1:]):
        if most * n >= 1 << 64:
            at, of = distinct(key)
            key, most = of.astype(np.uint64), len(at)
        key = key * np.uint64(n) + c.astype(np.uint64)
        most *= n
    return key


class Chunk:
    """A chunk's tokens and, as answers come in, the totals of its words, those of grams that end in a hot word, and the codes of its tokens."""

    def __init__(self, state: bytes, held: np.ndarray, shards: int, order: int, n: int = 0, v: int = 0):
        self.hashes, self.tokens, lengths = unpacks(state)
        self.lengths = lengths.astype(np.int64)
        self.shards, self.order, self.n, self.v = shards, order, n, v
        self.train = np.repeat(~held, self.lengths)
        self.first = np.cumsum(self.lengths) - self.lengths

    def word_requests(self) -> Iterator[tuple[int, bytes]]:
        counts = np.bincount(self.tokens[self.train], minlength=len(self.hashes)).astype(np.uint64)
        at, bounds = dealt(mixed(self.hashes), self.shards, self.hashes)
        for s, a, b in bounds:
            yield s, packs(self.hashes[at[a:b]], counts[at[a:b]])

    def words_answered(self, answers: dict[int, bytes]) -> None:
        """Takes the numbers and totals of the chunk's words. What precedes a text is one more word, with a total of one for each training text."""
        at, bounds = dealt(mixed(self.hashes), self.shards, self.hashes)
        number, total = np.zeros(len(at), dtype=np.uint64), np.zeros(len(at), dtype=np.uint64)
        for s, a, b in bounds:
            number[at[a:b]], total[at[a:b]] = unpacks(answers[s])
        p = (total.astype(np.float64) + 1) / (self.n + self.v + 1)
        self.base, self.code, self.known = np.log10(p), coded(p), total > 0
        self.number, self.total = np.append(number, np.uint64(PAD)), np.append(total, total[np.flatnonzero(self.hashes == END)])
        if len(number) and number.max() < 1 << 32:
            self.number = self.number.astype(np.uint32)
        self.hot = self.total > HOT
        self.before = [self.tokens]  # each token, the word before it, the one before that, ...
        for _ in range(self.order - 1):
            back = np.empty_like(self.tokens)
            back[1:] = self.before[-1][:-1]
            back[self.first] = len(self.hashes)
            self.before.append(back)

    def hot_grams(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For 2 words up to the longest context: (tokens that end in a hot word, which distinct gram each is the end of, a hash of each such gram)."""
        out, at = [], np.flatnonzero(self.hot[self.tokens])
        for k in range(2, self.order):
            words = [c[at] for c in self.before[:k]]
            head, of = distinct(combined(words, [len(self.number)] * k))
            out.append((at, of, mixed(np.full(len(head), k, dtype=np.uint64), *(self.number[w[head]] for w in words))))
        return out

    def gram_requests(self) -> Iterator[tuple[int, bytes]]:
        for k, (at, of, hashes) in enumerate(self.hot_grams()):
            counts = np.bincount(of[self.train[at]], minlength=len(hashes)).astype(np.uint64)
            by, bounds = dealt(hashes, self.shards, hashes)
            for s, a, b in bounds:
                yield k * self.shards + s, packs(hashes[by[a:b]], counts[by[a:b]])

    def grams_answered(self, answers: dict[int, bytes]) -> None:
        """Takes the totals of the grams that end in a hot word, for each token."""
        self.gram_total = []
        for k, (at, of, hashes) in enumerate(self.hot_grams()):
            by, bounds = dealt(hashes, self.shards, hashes)
            own = np.zeros(len(hashes), dtype=np.uint64)
            for s, a, b in bounds:
                own[by[a:b]] = unpacks(answers[k * self.shards + s])[0]
            total = np.zeros(len(self.tokens), dtype=np.uint64)
            total[at] = own[of]
            self.gram_total.append(total)

    def placed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """(tokens in the order of their shards, contexts and words; which of these begin a distinct n-gram; one of each; (shard, from, to) of these).

        The shard hangs on the context's last word. Words behind a hot one are dealt out over several shards, and for a pair
        that is hot as well so are the words before it, so that no shard gets much more than HOT rows of one word.
        """
        last, pair = self.before[1], (self.gram_total[0] > HOT if self.order > 2 else np.zeros(len(self.tokens), dtype=bool))
        of_word = mixed(self.number) % np.uint64(self.shards)
        shard, hot = of_word[last], np.flatnonzero(self.hot[last])
        parts = self.total // np.uint64(HOT) + np.uint64(1)
        by = mixed(self.number[self.tokens[hot]])
        if self.order > 2:
            by = np.where(pair[hot], mixed(by, self.number[self.before[2][hot]]), by)
        shard[hot] = mixed(self.number[last[hot]], by % parts[last[hot]]) % np.uint64(self.shards)
        # a middle number for each shard and last word of a context, in this order, so that one sort does it all
        size = len(self.number)
        middle = shard * np.uint64(size) + last
        head, of = distinct(middle[hot])
        cold = np.arange(size)[~self.hot]
        entries = np.concatenate([of_word[cold] * np.uint64(size) + cold.astype(np.uint64), middle[hot][head]])
        at = np.argsort(entries)
        rank = np.empty(len(at), dtype=np.uint64)
        rank[at] = np.arange(len(at), dtype=np.uint64)
        number = np.zeros(size, dtype=np.uint64)
        number[cold] = rank[: len(cold)]
        m = number[last]
        m[hot] = rank[len(cold) :][of]
        key = combined([m, *self.before[2:], self.tokens], [max(1, len(at))] + [size] * (self.order - 1))
        order = np.argsort(key)
        new = runs(key[order])
        one = order[new]
        of_shard = shard[one].astype(np.int64)
        edge = np.flatnonzero(runs(of_shard))
        return order, new, one, [(int(of_shard[a]), int(a), int(b)) for a, b in zip(edge, np.append(edge[1:], len(one)))]

    def requests(self) -> Iterator[tuple[int, bytes]]:
        """For each shard its n-grams: the context's last words with their totals and how many rows each has; by row the words further back, the
        word, its code, how often the n-gram is seen, and for hot words the totals of the longer contexts and of the last two words."""
        order, new, one, bounds = self.placed()
        seen = np.add.reduceat(self.train[order].astype(np.uint32), np.flatnonzero(new)) if len(one) else one
        starts = np.zeros(len(self.tokens), dtype=bool)
        starts[self.first] = True
        for s, a, b in bounds:
            at = one[a:b]
            last = self.before[1][at]
            head = np.flatnonzero(runs(last))
            columns = [self.number[last[head]], self.total[last[head]], np.diff(np.append(head, b - a)).astype(np.uint32), self.number[self.tokens[at]], self.code[self.tokens[at]], seen[a:b]]
            for k in range(2, self.order):
                back = self.number[self.before[k][at]]
                total = np.where(starts[at], self.total[-1], self.gram_total[k - 2][np.maximum(at - 1, 0)])  # of the k words before
                columns += [np.diff(back, prepend=back.dtype.type(0)), np.where(self.hot[last], total, np.uint64(0))]
            if self.order > 2:
                columns.append(np.where(self.hot[last] & (self.gram_total[0][at] > HOT), self.gram_total[0][at], np.uint64(0)))
            yield s, packs(*columns)

    def scores(self, answers: dict[int, bytes]) -> dict[str, np.ndarray]:
        """Takes the codes of the n-grams, and adds up the texts'."""
        order, new, one, bounds = self.placed()
        codes = np.zeros(len(one), dtype=np.int64)
        for s, a, b in bounds:
            codes[a:b] = unpacks(answers[s])[0]
        own = np.empty(len(self.tokens), dtype=np.int64)
        own[order] = codes[np.cumsum(new) - 1] if len(one) else 0
        add = lambda x: np.add.reduceat(x, self.first) if len(self.first) else x
        return {
            "n_tokens": self.lengths,
            "n_known": add(self.known.astype(np.int64)[self.tokens]),
            "base_score": add(self.base[self.tokens]),
            "score": -STEP * add(own),
        }


def dealt(h: np.ndarray, shards: int, by: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(positions by shard and then by the last column; (shard, from, to) of those that get any)."""
    of = (h % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((by, of))
    edge = np.flatnonzero(runs(of[order]))
    return order, [(int(of[order[a]]), int(a), int(b)) for a, b in zip(edge, np.append(edge[1:], len(order)))]


def summed(asked: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(for each request, which of the distinct hashes it asks for; these; their totals)."""
    got = [unpacks(x) for x in asked]
    hashes, counts = (np.concatenate(x) for x in zip(*got))
    head, of = distinct(hashes)
    total = np.zeros(len(head), dtype=np.uint64)
    np.add.at(total, of, counts)
    return np.split(of, np.cumsum([len(g[0]) for g in got])[:-1]), hashes[head], total


def count_words(shard: int, shards: int, asked: list[bytes]) -> tuple[list[bytes], int, int]:
    """For each request the numbers and totals of its words; and the shard's training tokens and distinct training words."""
    each, hashes, total = summed(asked)
    number = np.empty(len(hashes), dtype=np.uint64)  # small for frequent words, so that their bytes pack well
    number[np.argsort(total)[::-1]] = np.arange(len(hashes), dtype=np.uint64) * np.uint64(shards) + np.uint64(shard + 1)
    return [packs(number[of], total[of]) for of in each], int(total.sum()), int((total > 0).sum())


def count_grams(asked: list[bytes]) -> list[bytes]:
    """For each request the totals of its grams."""
    each, _, total = summed(asked)
    return [packs(total[of]) for of in each]


def score_grams(order: int, asked: list[bytes], floor: int, trie=NgramTrie) -> list[bytes]:
    """For each request the codes of its n-grams, looked up in a trie of those that training texts have."""
    got, sizes = [], []
    for x in asked:
        last, total, n, word, code, seen, *rest = unpacks(x)
        backs = [np.repeat(last, n), *(np.cumsum(c, dtype=c.dtype) for c in rest[0 : 2 * (order - 2) : 2])]
        got.append((word, code, seen, np.repeat(total, n), *backs, *rest[1 : 2 * (order - 2) : 2], *rest[2 * (order - 2) :]))
        sizes.append(len(word))
    word, code, seen, total, *rest = (np.concatenate(x) for x in zip(*got))
    backs, sent, pair = rest[: order - 1], rest[order - 1 : 2 * order - 3], rest[2 * order - 3 :]
    head, of = distinct(np.concatenate([word, *backs]))
    words = np.concatenate([word, *backs])[head]
    word, *backs = np.split(of, order)
    own_code = np.full(len(words), floor, dtype=np.uint16)
    own_code[word] = code
    key = combined([*backs, word], [len(words)] * order)
    by = np.argsort(key)
    new = runs(key[by])
    one = by[new]
    count = np.add.reduceat(seen[by].astype(np.uint64), np.flatnonzero(new))
    asked_backs, asked_word = [b[one] for b in backs], word[one]

    train = count > 0
    rows, n = one[train], count[train]
    contexts, last = [b[train] for b in asked_backs], asked_word[train]
    totals, counts = [total[rows]], []
    node = contexts[0].astype(np.uint64)
    for k in range(1, order):
        if k > 1:  # contexts of k words are whole here, unless they end in a hot word
            node = combined([node, contexts[k - 1]], [len(words) if k == 2 else len(rows) + 1, len(words)])
            node = np.cumsum(runs(node)).astype(np.uint64)
            here = np.add.reduceat(n, np.flatnonzero(runs(node)))[node.astype(np.int64) - 1] if len(n) else n
            totals.append(np.maximum(here, sent[k - 2][rows]))
        if k == order - 1:
            counts.append(n)
        else:
            first, same = distinct(combined([node, last], [max(len(words), len(rows) + 1), len(words)]))
            here = np.zeros(len(first), dtype=np.uint64)
            np.add.at(here, same, n)
            counts.append(np.maximum(here[same], pair[0][rows]) if k == 1 else here[same])
    model = trie(words, own_code, contexts, last, totals, counts, mass, coded, decoded)
    codes = model.score(words, asked_backs, asked_word, floor)
    out = np.empty(len(by), dtype=np.uint32)
    out[by] = codes.astype(np.uint32)[np.cumsum(new) - 1]
    return [packs(x.astype(np.uint16) if len(x) and x.max() < 1 << 16 else x) for x in np.split(out, np.cumsum(sizes)[:-1])]


def chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(chunk, ids, held, state): documents by the chunk, in the order in which they are read."""
    kind = docs.schema[id_col].dataType
    text_id = F.col(id_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), text_id.alias("name"), F.encode(text_col, "UTF-8").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, id_type = TaskContext.get().partitionId(), 0, None

        def made(ids: list, held: list, texts: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{part}-{n}"]), pa.array([ids], type=pa.list_(id_type)), pa.array([held]), pa.array([packs(*encoded(texts))], type=pa.binary())], names=["chunk", "ids", "held", "state"])

        ids, held, texts, size = [], [], [], 0
        for b in batches:
            id_type = b.column(0).type
            for i, name, t in zip(*(c.to_pylist() for c in b.columns)):
                ids.append(i)
                held.append(name is not None and crc32(name.encode()) % FOLDS == HELD_OUT)
                texts.append(t)
                size += len(t or b"") + 16
                if size >= CHUNK_BYTES:
                    yield made(ids, held, texts)
                    ids, held, texts, size, n = [], [], [], 0, n + 1
        if ids:
            yield made(ids, held, texts)

    schema = T.StructType([T.StructField("chunk", T.StringType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("held", T.ArrayType(T.BooleanType())), T.StructField("state", T.BinaryType())])
    return rows.mapInArrow(run, schema)


def placed(df: DataFrame, width: int) -> DataFrame:
    """df dealt out by chunk and kept. Without adaptive planning Spark keeps track of how the kept rows are dealt out, so that later joins by chunk move the answers alone."""
    with settings(df.sparkSession, spark__sql__adaptive__enabled="false"):
        return cut(df.repartition(width, "chunk"))


_ANSWER = "chunk string, round int, shard int, answer binary, n bigint, v bigint"


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 of the model's probability of the text) of each row."""
    if order < 2:
        raise ValueError("n-grams have two words or more")
    # each step is kept; the shuffles that it took are done with, and go from the disk at once
    with settings(docs.sparkSession, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        return _scored(docs.select("*"), id_col, text_col, order)


def _scored(docs: DataFrame, id_col: str, text_col: str, order: int) -> DataFrame:
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    width = shuffle_width(spark)
    state = placed(chunks(docs, id_col, text_col), width)
    # a token takes two bytes or more
    tokens = state.select(F.sum(F.length("state"))).first()[0] or 0
    shards = max(width, tokens // (2 * PER_SHARD) + 1)

    def sent(rows: Iterator[tuple[int, bytes]], name: str) -> pa.Table:
        rows = list(rows)
        return pa.table({"shard": pa.array([s for s, _ in rows], type=pa.int32()), "chunk": pa.array([name] * len(rows), type=pa.string()), "asked": pa.array([x for _, x in rows], type=pa.binary())})

    def word_asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, held, raw in zip(b.column(0), b.column(1), b.column(2)):
                chunk = Chunk(raw.as_py(), np.array(held.as_py(), dtype=bool), shards, order)
                yield from sent(chunk.word_requests(), name.as_py()).to_batches()

    def answers_of(k: int, t: pa.Table, made: list[bytes], n: int = 0, v: int = 0) -> pa.Table:
        rest = [0] * (len(made) - 1)
        return pa.table({"chunk": t.column("chunk"), "round": pa.array([k] * len(made), pa.int32()), "shard": t.column("shard"), "answer": pa.array(made, pa.binary()), "n": pa.array([n, *rest], pa.int64()), "v": pa.array([v, *rest], pa.int64())})

    def word_answers(key: tuple, t: pa.Table) -> pa.Table:
        return answers_of(1, t, *count_words(key[0].as_py(), shards, t.column("asked").to_pylist()))

    asked = state.select("chunk", "held", "state").mapInArrow(word_asks, "shard int, chunk string, asked binary")
    answers = cut(asked.groupBy("shard").applyInArrow(word_answers, _ANSWER))
    n, v = (x or 0 for x in answers.agg(F.sum("n"), F.sum("v")).first())
    floor = int(coded(np.array([1 / (n + v + 1)]))[0])

    def answered(left: pa.Table, right: pa.Table) -> tuple[Chunk, dict]:
        """The chunk with what it has been told, and the last round's answers."""
        chunk = Chunk(left.column("state")[0].as_py(), np.array(left.column("held")[0].as_py(), dtype=bool), shards, order, n, v)
        told: dict[int, dict[int, bytes]] = defaultdict(dict)
        for r, s, a in zip(right.column("round").to_pylist(), right.column("shard").to_pylist(), right.column("answer").to_pylist()):
            told[r][s] = a
        chunk.words_answered(told.pop(1))
        return chunk, told

    def gram_asks(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        chunk, _ = answered(left, right)
        return sent(chunk.gram_requests(), key[0].as_py())

    def gram_answers(key: tuple, t: pa.Table) -> pa.Table:
        return answers_of(2, t, count_grams(t.column("asked").to_pylist()))

    def asks(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        chunk, told = answered(left, right)
        chunk.grams_answered(told[2])
        return sent(chunk.requests(), key[0].as_py())

    def codes(key: tuple, t: pa.Table) -> pa.Table:
        return answers_of(3, t, score_grams(order, t.column("asked").to_pylist(), floor))

    by_chunk = state.groupBy("chunk")
    if order > 2:
        asked = by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(gram_asks, "shard int, chunk string, asked binary")
        answers = answers.union(cut(asked.groupBy("shard").applyInArrow(gram_answers, _ANSWER)))
    asked = by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(asks, "shard int, chunk string, asked binary")
    answers = answers.union(cut(asked.groupBy("shard").applyInArrow(codes, _ANSWER)))

    def finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        chunk, told = answered(left, right)
        chunk.grams_answered(told[2])
        made = chunk.scores(told[3])
        return pa.table({id_col: left.column("ids").combine_chunks().flatten(), "held_out": left.column("held").combine_chunks().flatten(), **{c: pa.array(x) for c, x in made.items()}})

    out = by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(finish, f"`{id_col}` {id_type}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select(id_col, "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")
