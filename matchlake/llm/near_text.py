"""Near-duplicates by the Jaccard similarity of word shingles, found by ball hashing of several short fingerprints.

A text has PRINTS fingerprints: the smallest of its shingles' hashes under a permutation of its own, and BITS bits, each one
bit of the smallest hash under one more permutation. At similarity s the first agrees with probability s, and a bit differs
with (1 - s) / 2. Two texts are candidates if in any fingerprint the first agrees and the bits differ in 2 at most: each
stands for all values within one bit of its own, and texts that share such a value meet there (see simhash). At 0.8 a
fingerprint meets with probability 0.29, so a pair is missed with about 0.001; nearer pairs are missed less. For a lower
similarity fewer of the bits are compared, so that a fingerprint meets as often at that similarity.

Candidates are dropped if their sizes rule the similarity out, or if the bits of all fingerprints together (640) differ in more
places than texts of that similarity do with probability 0.999, and verified by the exact similarity of their shingles.

Texts that meet are not paired with each other, so the pairs grow with the texts and not with the square of a group. In each of
ROUNDS rounds, over some of the fingerprints each, those of a value are held against one of them, each text against one other in
all, and what these links join needs no further pair. Then, over half of the fingerprints each, a text that still meets other components is held against
the two of these that differ from it in the fewest bits, until a round links nothing. A value that more than NEIGHBOURS texts
share is sorted by bits drawn anew for each fingerprint and round, and a text looks at its neighbours there; a smallest hash that over SPLIT_AT texts
share is dealt out by such bits as well, so that no text is copied.

At last come all pairs that the rounds left. Texts that share any value with one of another component are joined by their shingles themselves, exactly: in one
order of all shingles, rare ones first, texts so alike have one in common among the first tenth or fifth of each (see rest). Texts that differ from a
template in more than that meet in what they have of their own, where they mostly are alone, and those that differ less are mostly linked by then. How rare a shingle is
is told by a table of fixed size: it sets how many pairs are made, not which links are found.

Cases: ids are integers, any of them; rows of one id are one document; texts of equal shingles collapse before the search, so copies cost
one entry; a null or empty text has no shingles, and all such are alike; fewer words than a shingle make one shingle; rows
without an id are compared like others and link what they are near, but name no component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlake.llm.common import cut, packed, settings
from matchlake.llm.simhash import components, named_components

SHINGLE, LEAST = 5, 0.8
PRINTS, BITS, ROUNDS = 20, 32, 2
#: Rounds of nearest ones that take all fingerprints together, and pairs of a text in each.
HALVES, NEAREST = 2, 2
#: Texts of one value, sorted, that a text is held against on either side in the rounds of nearest ones.
NEIGHBOURS = 256
#: Pairs of the rest that are looked at together, and the bits of the table (4 MB) that tells rare shingles of the rest from frequent ones.
REST_PAIRS, SLOT_BITS = 1_000_000, 22
#: Slots of the rest's texts, of each of which it is known whether an odd number of a text's shingles fall into it: 128 bytes.
ODD = 1024
#: Texts of a task on average, and texts that share a smallest hash beyond which they are dealt out to several tasks.
PER_TASK, SPLIT_AT = 50_000, 20_000
#: Distinct texts' fingerprints (0.4 kB each) and pairs of a task on average.
TEXTS_PER_TASK, PAIRS_PER_TASK = 20_000, 50_000
#: What names so many texts at most is broadcast: 16 MB.
BROADCAST_ROWS = 500_000
#: 64-bit words of all fingerprints' bits.
WORDS = PRINTS * BITS // 64

_R = np.random.default_rng(42)
_TIMES, _FLIP = (_R.integers(0, 1 << 32, PRINTS * (BITS + 1), dtype=np.uint32) for _ in range(2))
_TIMES |= np.uint32(1)
#: Where a few shingles' permuted hashes are computed.
_BUFFER = np.empty((64, len(_TIMES)), dtype=np.uint32)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def width(least: float) -> int:
    """How many bits of a fingerprint are compared: as many as let texts of this similarity meet as often as those of LEAST do over all."""

    def meets(b: int, s: float) -> float:
        p = (1 - s) / 2
        return s * sum(comb(b, k) * p**k * (1 - p) ** (b - k) for k in range(3))

    return max((b for b in range(3, BITS + 1) if meets(b, least) >= min(meets(BITS, LEAST), 0.99 * least)), default=2)


def farthest(least: float, bits: int) -> int:
    """In how many of so many bits texts of this similarity differ at most, with probability 0.999."""
    p = (1 - least) / 2
    return int(bits * p + 3.1 * (bits * p * (1 - p)) ** 0.5)


def ball(bits: int) -> np.ndarray:
    return np.array([0, *(1 << k for k in range(bits))], dtype=np.uint64)


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a UTF-8 text's shingles, sorted."""
    w = (text or b"").lower().split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    norm = b" ".join(w)
    digest = xxhash.xxh64_intdigest
    if len(w) <= size:
        return np.array([digest(norm)], dtype=np.uint64)
    ends = list(accumulate(map((1).__add__, map(len, w))))
    return np.unique(np.array([digest(norm[a : b - 1]) for a, b in zip([0, *ends[:-1]], ends[size - 1 :])], dtype=np.uint64))


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def short_prints(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the smallest hashes, the bits) of a text with these shingle hashes. A permutation flips bits of the hash and multiplies by an odd number."""
    least = np.full(len(_TIMES), 0xFFFFFFFF, dtype=np.uint32)
    low = (h ^ (h >> np.uint64(32))).astype(np.uint32)
    for a in range(0, len(low), len(_BUFFER)):
        part = low[a : a + len(_BUFFER)]
        x = _BUFFER[: len(part)]
        np.multiply(np.bitwise_xor(part[:, None], _FLIP[None, :], out=x), _TIMES[None, :], out=x)
        np.minimum(least, np.minimum.reduce(x, axis=0), out=least)
    bit = (least[PRINTS:] * np.uint32(0x9E3779B1)) >> np.uint32(31)
    return least[:PRINTS], np.packbits(bit.astype(np.uint8), bitorder="little").view("<u4")


def prints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, same, n, least, bits): a digest of each row's shingles, how many they are, and the fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t) for t in b.column(2).to_pylist()]
            made = [short_prints(h) for h in sets]
            least, bits = (pa.array([m[k].astype(np.int64) for m in made], type=pa.list_(pa.int64())) for k in (0, 1))
            same = pa.array([xxhash.xxh128_digest(h.tobytes()) for h in sets], type=pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), same, pa.array([len(h) for h in sets], pa.int64()), least, bits], names=[id_col, "text_hash", "same", "n", "least", "bits"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, F.xxhash64(text_col).alias("text_hash"), F.encode(text_col, "UTF-8").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, text_hash bigint, same binary, n bigint, least array<bigint>, bits array<bigint>")


def entries(reps: DataFrame, labels: DataFrame | None, turn: int, least: float, whole: bool = False) -> DataFrame:
    """(task, key, bits, s0.., node, n, label): what meets where in this turn's fingerprints of reps (node, n, least, bits), labelled by labels (node, root) or
    else by node. Smallest hashes of one label alone are left out; texts of one that many share are dealt out by some of their bits, drawn for the turn.
    The first turns carry 128 of the bits, the others all. With whole, none are carried, and what many share is dealt out by the values of its balls instead: each text goes to the
    task of each, so that all that meet do so in some task."""
    early = turn < ROUNDS
    ks = [k for k in range(PRINTS) if (k % ROUNDS == turn if early else k % HALVES == turn % HALVES)]
    words = range(0 if whole else 2 if early else WORDS)
    own = reps.withColumn("label", F.col("node")) if labels is None else reps.join(labels, "node", "left").withColumn("label", F.coalesce("root", "node"))
    each = own.select("node", "label", "n", "bits", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.get("least", F.lit(k)).alias("least"), F.get("bits", F.lit(k)).alias("bits")) for k in ks))).alias("x"))
    drawn_bits = np.random.default_rng([turn, 640]).permutation(PRINTS * BITS)[:16].tolist()
    digits = F.concat(*(F.shiftrightunsigned(F.get("bits", F.lit(b // BITS)), b % BITS).bitwiseAND(F.lit(1)).cast("string") for b in drawn_bits))
    packed = [F.shiftleft(F.get("bits", F.lit(2 * k)), 32).bitwiseOR(F.get("bits", F.lit(2 * k + 1))).alias(f"s{k}") for k in words]
    each = each.select("node", "label", "n", *packed, digits.alias("digits"), F.xxhash64("x.k", "x.least").alias("key"), F.col("x.bits").bitwiseAND(F.lit((1 << width(least)) - 1)).alias("bits"))
    keys = each.groupBy("key").agg(F.count("*").alias("size"), F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b")
    keys = keys.select("key", F.when(F.col("size") > SPLIT_AT, F.least(F.lit(16), F.ceil(F.log2(F.col("size") / SPLIT_AT)))).cast("int").alias("depth"))
    each = cut(each.join(keys, "key"))
    n_tasks = max(1, 2 ** ceil(log2(max(1, each.count() / PER_TASK))))
    if whole:
        near = F.transform(F.array(*(F.lit(int(v)) for v in ball(width(least)))), lambda v: F.xxhash64("key", F.col("bits").bitwiseXOR(v.cast("bigint"))).bitwiseOR(F.lit(-(1 << 63))))
        return each.withColumn("task", F.explode(F.when(F.col("depth").isNull(), F.array(F.pmod("key", F.lit(n_tasks)))).otherwise(near))).drop("depth", "digits")
    deep = F.xxhash64("key", F.substring("digits", F.lit(1), F.col("depth"))).bitwiseOR(F.lit(-(1 << 63)))
    return each.withColumn("task", F.when(F.col("depth").isNull(), F.pmod("key", F.lit(n_tasks))).otherwise(deep)).drop("depth", "digits")


def spread(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * _GOLD
    return (x ^ (x >> np.uint64(29))) * _GOLD


def drawn(sketch: np.ndarray, key: np.ndarray, turn: int) -> np.ndarray:
    """A number for each entry that texts of few differing bits often share the upper digits of: 64 of its bits, drawn for this round and, in 16 ways, for its key."""
    bits = np.unpackbits(np.ascontiguousarray(sketch).view(np.uint8).reshape(len(sketch), -1), axis=1)
    out = np.zeros(len(sketch), dtype=np.uint64)
    way = (spread(key.view(np.uint64)) >> np.uint64(60)).astype(np.int64)
    for w in np.unique(way):
        order = np.random.default_rng([turn, int(w)]).permutation(bits.shape[1])[:64]
        own = way == w
        out[own] = np.ascontiguousarray(np.packbits(bits[own][:, order], axis=1)).view(">u8").ravel()
    return out


def meetings(t: pa.Table, turn: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b: positions of entries of one task to be compared; which of an a's pairs come first). In the first ROUNDS turns one pair a text; then those
    of the fewest differing bits."""
    key, bits, node, label, n = (t.column(c).to_numpy() for c in ("key", "bits", "node", "label", "n"))
    sketch = np.stack([t.column(f"s{k}").to_numpy().view(np.uint64) for k in range(2 if turn < ROUNDS else WORDS)], axis=1)
    early = spread(node.astype(np.uint64) + np.uint64(turn * int(_GOLD) % (1 << 64))) >> np.uint64(1)
    none = np.zeros(0, dtype=np.int64)
    values, most = ball(width(least)), farthest(least, 64 * sketch.shape[1])
    value = (bits.astype(np.uint64)[:, None] ^ values[None, :]).ravel()
    owner = np.repeat(np.arange(len(bits)), len(values))
    at = spread(value ^ spread(key[owner].view(np.uint64)))
    # values of one text alone are most
    by = np.argsort(at)
    same = at[by][1:] == at[by][:-1]
    by = by[np.append(same, False) | np.insert(same, 0, False)]
    order = early if turn < ROUNDS else drawn(sketch, key, turn)
    by = by[np.lexsort((order[owner[by]], at[by]))]
    at, owner = at[by], owner[by]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else none
    size = np.diff(np.append(first, len(at)))

    def close(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs may be alike, and in how many bits they differ."""
        lo, hi = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        ok = np.flatnonzero((label[a] != label[b]) & (lo >= least * hi))
        far = np.bitwise_count(sketch[a[ok]] ^ sketch[b[ok]]).sum(axis=1, dtype=np.int64)
        return ok[far <= most], far[far <= most]

    if turn >= ROUNDS:
        found, step, here = [], 1, np.arange(len(at))
        while step <= NEIGHBOURS and len(here := here[here + step < len(at)]) and len(here := here[at[here] == at[here + step]]):
            a, b = owner[here], owner[here + step]
            ok, far = close(a, b)
            found.append(np.stack([np.minimum(a[ok], b[ok]), np.maximum(a[ok], b[ok]), far]))
            step += 1
        a, b, far = np.unique(np.concatenate(found, axis=1), axis=1) if found else (none, none, none)
        return np.append(a, b), np.append(b, a), np.append(far, far)
    pivot = np.repeat(owner[first], size)
    ok, _ = close(pivot, owner)
    a, b = owner[ok], pivot[ok]
    by = np.lexsort((early[b], a))  # each text against the earliest of those that it may be like
    by = by[np.append(True, a[by][1:] != a[by][:-1])] if len(by) else by
    a, b = a[by], b[by]
    return a, b, early[b].astype(np.int64)


def compared(live: DataFrame, turn: int, least: float) -> DataFrame:
    """Pairs of nodes (a, b), a > b, to be compared in this turn, of entries with labels: one for each text; after the first ROUNDS turns NEAREST for each."""
    most = 1 if turn < ROUNDS else NEAREST

    def meet(key: tuple, t: pa.Table) -> pa.Table:
        a, b, rank = meetings(t, turn, least)
        node = t.column("node").to_numpy()
        pair = np.unique(np.stack([node[a], rank, node[b]]), axis=1)  # by a, then rank
        first = np.flatnonzero(np.append(True, pair[0][1:] != pair[0][:-1])) if len(a) else np.zeros(0, dtype=np.int64)
        keep = np.arange(pair.shape[1]) - np.repeat(first, np.diff(np.append(first, pair.shape[1]))) < most
        return pa.table({"a": pair[0][keep], "b": pair[2][keep], "rank": pair[1][keep]})

    pairs = live.groupBy("task").applyInArrow(meet, "a bigint, b bigint, rank bigint")
    if turn < ROUNDS:
        pairs = pairs.groupBy("a").agg(F.min_by("b", "rank").alias("b"))
    else:
        pairs = pairs.distinct().withColumn("_k", F.row_number().over(Window.partitionBy("a").orderBy("rank", "b"))).where(F.col("_k") <= most)
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def unlinked(live: DataFrame, least: float) -> DataFrame:
    """(node) of entries (whole) that share a value with one of another label; the others can meet nothing that is new to them."""

    def meet(t: pa.Table) -> pa.Table:
        key, bits, node, label = (t.column(c).to_numpy() for c in ("key", "bits", "node", "label"))
        values = ball(width(least))
        owner = np.repeat(np.arange(len(bits)), len(values))
        at = spread((bits.astype(np.uint64)[:, None] ^ values[None, :]).ravel() ^ spread(key[owner].view(np.uint64)))
        by = np.argsort(at)
        at, owner = at[by], owner[by]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        mixed = np.minimum.reduceat(label[owner], first) != np.maximum.reduceat(label[owner], first)
        return pa.table({"node": np.unique(node[owner[np.repeat(mixed, np.diff(np.append(first, len(at))))]])})

    return live.groupBy("task").applyInArrow(meet, "node bigint").distinct()


def sets_of(texts: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(node, label, n, text) of texts (node, text): the shingles' hashes as bytes, for a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(h) for h in sets], pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())], names=["node", "label", "n", "text"])

    own = texts.withColumn("label", F.col("node")) if labels is None else texts.join(labels, "node", "left").withColumn("label", F.coalesce("root", "node"))
    return own.select("node", "label", "text").mapInArrow(run, "node bigint, label bigint, n bigint, text binary")


def set_of(packed_hashes: bytes) -> np.ndarray:
    return np.frombuffer(packed_hashes, dtype=np.uint64)


def slots(h: np.ndarray, bits: int) -> np.ndarray:
    return (spread(h) >> np.uint64(64 - bits)).astype(np.int64)


def frequencies(sets: DataFrame) -> np.ndarray:
    """How often shingles occur in sets, as binary digits of the count, by slots that shingles are hashed to: 0 none, 1 once. At most 2^SLOT_BITS bytes, however many shingles."""
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(SLOT_BITS, max(16, ceil(log2(max(total, 1)))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, dtype=np.int64)
        for b in batches:
            for h in b.column(0).to_pylist():
                np.add.at(seen, slots(set_of(h), bits), 1)
        for k, part in enumerate(seen.reshape(-1, 1 << 16)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([part.tobytes()], pa.binary())], names=["block", "counts"])

    def add(key: tuple, t: pa.Table) -> pa.Table:
        seen = sum(np.frombuffer(c, dtype=np.int64) for c in t.column("counts").to_pylist())
        return pa.table({"block": [key[0].as_py()], "digits": pa.array([np.frexp(seen)[1].astype(np.uint8).tobytes()], pa.binary())})

    out = np.zeros((1 << bits >> 16, 1 << 16), dtype=np.uint8)
    for block, digits in sets.select("text").mapInArrow(count, "block bigint, counts binary").groupBy("block").applyInArrow(add, "block bigint, digits binary").collect():
        out[block] = np.frombuffer(digits, dtype=np.uint8)
    return out.ravel()


def prefixes(sets: DataFrame, digits: np.ndarray, least: float) -> DataFrame:
    """(token, pos, n, node, label, odd): the first shingles of each set (node, label, n, text), rare ones first and all in one order, of which texts so alike have one
    in common; without those that one text alone has. odd: of ODD slots, which ones an odd number of the set's shingles fall into."""
    bits = len(digits).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, odd = [], []
            for node, label, packed_hashes in zip(*(b.column(c).to_pylist() for c in (0, 1, 2))):
                h = set_of(packed_hashes)
                often = digits[slots(h, bits)]
                order = np.lexsort((h, often))[: len(h) - ceil(least * len(h) - 1e-6) + 1]
                pos = np.flatnonzero(often[order] > 1)
                made.append(np.stack([h[order[pos]].view(np.int64), pos, *(np.full(len(pos), x) for x in (len(h), node, label))]))
                odd += [np.packbits(np.bincount(slots(h, ODD.bit_length() - 1), minlength=ODD).astype(np.uint8) & 1).tobytes()] * len(pos)
            if made:
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in np.concatenate(made, axis=1)), pa.array(odd, pa.binary())], names=["token", "pos", "n", "node", "label", "odd"])

    return sets.select("node", "label", "text").mapInArrow(run, "token bigint, pos bigint, n bigint, node bigint, label bigint, odd binary")


def rest(first: DataFrame, least: float) -> DataFrame:
    """All pairs of nodes (a, b), a > b, of different labels whose first shingles and odd slots (prefixes) leave room for so much in common.

    Texts of nx and ny shingles are so alike only if they share o = least / (1 + least) * (nx + ny). The first that they share, in the one order, stands before
    the o - 1 others in both: at nx - o in the one and ny - o in the other at most. So every pair so alike meets at that shingle and passes.
    A slot is odd in just one of them only if a shingle of just one of them falls into it, and of those there are nx + ny - 2 * o at most: no pair so alike is dropped."""
    rate = least / (1 + least)
    parts = F.ceil(F.col("count") / SPLIT_AT).cast("int").alias("parts")
    hot = cut(first.groupBy("token").count().where(F.col("count") > SPLIT_AT).select("token", parts))
    n_tasks = max(1, ceil(first.count() / PER_TASK))
    first = first.withColumn("task", F.xxhash64(F.pmod("token", F.lit(n_tasks))))
    if not hot.isEmpty():  # a shingle of many is dealt out: a task for any two parts of its texts
        dealt = first.join(F.broadcast(hot), "token", "left").withColumn("part", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        first = dealt.withColumn("task", F.when(F.col("parts").isNull(), F.col("task")).otherwise(F.xxhash64("token", F.least("part", "other"), F.greatest("part", "other"))))

    def meet(t: pa.Table) -> pa.Table:
        token, label, pos, n, node = (t.column(c).to_numpy() for c in ("token", "label", "pos", "n", "node"))
        by = np.lexsort((label, token))
        begins = np.flatnonzero(np.append(True, token[by][1:] != token[by][:-1]))
        # the smaller of two, or either of equal ones, has it among its very first; others need one that is smaller by enough
        early = pos <= n - np.ceil(2 * rate * n - 1e-6)
        smallest = np.repeat(np.minimum.reduceat(np.where(early, n, 1 << 62)[by], begins), np.diff(np.append(begins, len(by))))
        by = by[early[by] | ((n - pos)[by] / rate - n[by] + 1e-6 >= smallest)]
        token, label, pos, n, node = (x[by] for x in (token, label, pos, n, node))
        odd = np.frombuffer(b"".join(t.column("odd").take(by).to_pylist()), dtype=np.uint64).reshape(len(by), ODD // 64)
        ends = np.flatnonzero(np.append(token[1:] != token[:-1], True)) + 1 if len(by) else by
        runs = np.flatnonzero(np.append((token[1:] != token[:-1]) | (label[1:] != label[:-1]), True)) + 1 if len(by) else by
        # one is held against those of later labels: from where its label ends to where its shingle does
        here = np.arange(len(by))
        begin, end = runs[np.searchsorted(runs, here, side="right")], ends[np.searchsorted(ends, here, side="right")]
        count, made = end - begin, []
        here, begin, count = here[count > 0], begin[count > 0], count[count > 0]
        blocks = np.flatnonzero(np.diff(np.append(-1, np.cumsum(count) // REST_PAIRS)))
        for x, y in zip(blocks, np.append(blocks[1:], len(here))):
            c = count[x:y]
            a, b = np.repeat(here[x:y], c), np.repeat(begin[x:y] - np.append(0, np.cumsum(c)[:-1]), c) + np.arange(c.sum())
            common = np.ceil(rate * (n[a] + n[b]) - 1e-6)
            ok = (pos[a] <= n[a] - common) & (pos[b] <= n[b] - common) & (np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b]))
            a, b, common = a[ok], b[ok], common[ok]
            ok = np.bitwise_count(odd[a] ^ odd[b]).sum(axis=1, dtype=np.int64) <= n[a] + n[b] - 2 * common
            made.append(np.unique(np.stack([np.maximum(node[a[ok]], node[b[ok]]), np.minimum(node[a[ok]], node[b[ok]])]), axis=1))
        pair = np.unique(np.concatenate(made, axis=1), axis=1) if made else np.zeros((2, 0), dtype=np.int64)
        return pa.table({"a": pair[0], "b": pair[1]})

    return first.groupBy("task").applyInArrow(meet, "a bigint, b bigint").distinct()


def texts_of(docs: DataFrame, id_col: str, text_col: str, reps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of nodes: the text of the row that stands for it."""
    wanted = reps.join(nodes, "node", "left_semi").select("node", "nameless", F.coalesce("id", F.lit(0)).alias("id"), "text_hash")
    wanted = F.broadcast(wanted) if nodes.count() <= BROADCAST_ROWS else wanted
    rows = docs.select(F.col(id_col).isNull().alias("nameless"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.encode(text_col, "UTF-8").alias("text"))
    return rows.join(wanted, ["nameless", "id", "text_hash"]).groupBy("node").agg(F.first("text").alias("text"))


def verified(pairs: DataFrame, texts: DataFrame, least: float, of: Callable[[bytes | None], np.ndarray] = shingles) -> DataFrame:
    """Those of pairs (a, b) whose texts (node, text) are at least so similar; of gives a text's shingles."""
    a, b = (texts.select(F.col("node").alias(k), F.col("text").alias(f"t{k}")) for k in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, before, own = [], None, None
            for i, p, q in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3))):
                if i != before:  # pairs of one text mostly come together
                    before, own = i, of(p)
                keep.append(jaccard(own, of(q)) >= least)
            yield batch.select([0, 1]).filter(pa.array(keep, type=pa.bool_()))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def classes(docs: DataFrame, id_col: str, text_col: str, least: float) -> DataFrame:
    """(id, text_hash, component, component_id) of each row: the number of its component over links of at least this similarity, and the smallest id in it."""
    # each step is kept; the shuffles that it took are done with, and go from the disk at once
    with settings(docs.sparkSession, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        return _classes(docs.select("*"), id_col, text_col, least)


def _classes(docs: DataFrame, id_col: str, text_col: str, least: float) -> DataFrame:
    own = cut(prints(docs, id_col, text_col))
    stands = F.min(F.struct(F.col(id_col).isNull().alias("nameless"), F.col(id_col).cast("bigint").alias("id"), "text_hash")).alias("row")
    reps = own.groupBy("same").agg(stands, *(F.first(c).alias(c) for c in ("n", "least", "bits"))).select("same", "row.*", "n", "least", "bits")
    reps = cut(reps.withColumn("node", F.monotonically_increasing_id()))
    reps = packed(reps, reps.count(), TEXTS_PER_TASK)
    placed = cut(own.select(id_col, "text_hash", "same").join(reps.select("same", "node"), "same").drop("same"))
    # texts of one id are one document
    of_id = placed.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("node").alias("b"), F.max("node").alias("_last")).where("b <> _last")
    tried, labels = None, components(placed.join(of_id, id_col).where("node <> b").select(F.col("node").alias("a"), "b"))
    turn, linked = 0, True
    while turn < ROUNDS + HALVES or linked:
        pairs = compared(entries(reps, labels, turn, least), turn, least)
        pairs = cut(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        n_pairs = pairs.count()
        pairs = packed(pairs, n_pairs, PAIRS_PER_TASK)
        tried = pairs if tried is None else tried.union(pairs)
        linked = False
        if n_pairs:
            nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            links = cut(verified(pairs, texts_of(docs, id_col, text_col, reps, nodes), least))
            if n_links := links.count():
                linked = True
                labels = components(packed(links, n_links, PAIRS_PER_TASK).union(labels), n_links + labels.count())  # what earlier links joined is a star
        turn += 1
    # at last, all that the turns left
    nodes = None
    for half in range(HALVES):
        some = cut(unlinked(entries(reps, labels, ROUNDS + half, least, True), least))
        nodes = some if nodes is None else nodes.union(some).distinct()
    if n_nodes := (nodes := cut(nodes)).count():
        sets = cut(sets_of(texts_of(docs, id_col, text_col, reps, packed(nodes, n_nodes, TEXTS_PER_TASK)), labels))
        sets = packed(sets, n_nodes, TEXTS_PER_TASK)
        pairs = cut(rest(cut(prefixes(sets, frequencies(sets), least)), least).join(tried, ["a", "b"], "left_anti"))
        if n_pairs := pairs.count():
            links = cut(verified(packed(pairs, n_pairs, PAIRS_PER_TASK), sets.select("node", "text"), least, set_of))
            if n_links := links.count():
                labels = components(packed(links, n_links, PAIRS_PER_TASK).union(labels), n_links + labels.count())
    found = named_components(reps.select("node", "id"), labels)
    return cut(placed.join(found, "node").drop("node"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(id, component_id) for each row: component_id is the smallest id reachable over links of at least this similarity."""
    return classes(docs, id_col, text_col, least).select(id_col, "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """docs without near-duplicates: of each component the document of the smallest id stays, one without an id where none has any; of its rows, one."""
    found = classes(docs, id_col, text_col, least).where(F.col(id_col).eqNullSafe(F.col("component_id")))
    rows = found.groupBy("component", F.col(id_col).alias("_id"), "text_hash").agg((F.count("*") > 1).alias("_many"))
    chosen = rows.groupBy("component").agg(F.min_by(F.struct("_id", "text_hash", "_many"), "text_hash").alias("_one")).select("_one.*")
    kept = docs.join(chosen, docs[id_col].eqNullSafe(chosen["_id"]) & (F.xxhash64(docs[text_col]) == chosen["text_hash"]))
    names, many = docs.columns, chosen["_many"]
    lone = kept.where(~many).select(*(docs[c] for c in names))
    again = kept.where(many).select(chosen["_id"], chosen["text_hash"], F.struct(*(docs[c] for c in names)).alias("_row"))  # equal ids and texts, in full: the first of these
    return lone.unionByName(again.groupBy("_id", "text_hash").agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select("_row.*"))
