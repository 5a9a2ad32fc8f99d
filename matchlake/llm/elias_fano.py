"""A compact n-gram trie: Elias-Fano levels chained by pointers in a memory-mapped file, asked for many n-grams at a time."""

from __future__ import annotations

import tempfile

import numpy as np

#: The place of the set bit number r of 16 bits, at 16 * bits + r.
_SET = np.unpackbits(np.arange(1 << 16, dtype="<u2").view(np.uint8), bitorder="little").reshape(-1, 16)
_IN_16 = np.argsort(1 - _SET, axis=1, kind="stable").astype(np.uint8).ravel()


def select(bits: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The place of the set bit number r (from 0) of each 16 bits."""
    return _IN_16[(bits.astype(np.int64) << 4) | r].astype(np.int64)


def packed(bits: np.ndarray) -> np.ndarray:
    """0/1 bytes as words of 16 bits, with one word to spare."""
    out = np.packbits(bits, bitorder="little")
    return np.concatenate([out, np.zeros(-len(out) % 2 + 2, dtype=np.uint8)]).view("<u2")


def side_by_side(values: np.ndarray, width: int) -> np.ndarray:
    """Values of so many bits each as words of 64 bits, with one word to spare."""
    out = np.zeros((len(values) * width >> 6) + 2, dtype=np.uint64)
    if not width or not len(values):
        return out
    at = np.arange(len(values)) * width
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] = np.add.reduceat(values << shift, first)  # bits of one word don't overlap, so sums join them
    over = np.flatnonzero(shift + np.uint64(width) > 64)
    out[word[over] + 1] += values[over] >> (np.uint64(64) - shift[over])
    return out


class Arrays:
    """Arrays written behind each other to a file without a name, then mapped into memory."""

    def __init__(self):
        self.file = tempfile.TemporaryFile()
        self.places: list[tuple[int, np.dtype, int]] = []

    def put(self, a: np.ndarray) -> int:
        self.file.seek(0, 2)
        self.places.append((self.file.tell(), a.dtype, len(a)))
        self.file.write(np.ascontiguousarray(a).tobytes())
        self.file.write(bytes(-self.file.tell() % 8))
        return len(self.places) - 1

    def get(self, k: int) -> np.ndarray:
        offset, dtype, n = self.places[k]
        self.file.flush()
        return np.memmap(self.file, dtype=dtype, mode="r", offset=offset, shape=(n,)) if n else np.zeros(0, dtype)


class EliasFano:
    """A non-decreasing sequence: low bits side by side, high parts in unary, and how many ones come before each word of these."""

    def __init__(self, store: Arrays, values: np.ndarray):
        values = values.astype(np.uint64)
        n = self.n = len(values)
        top = int(values[-1]) if n else 0
        self.low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        self.most = top >> self.low_bits
        spread = np.zeros(n + self.most + 1, dtype=np.uint8)
        spread[(values >> np.uint64(self.low_bits)).astype(np.int64) + np.arange(n)] = 1
        high = packed(spread)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))[:-1]]).astype(np.int64 if n >> 31 else np.int32)
        low = side_by_side(values & np.uint64((1 << self.low_bits) - 1), self.low_bits)
        self._at, self._store = [store.put(x) for x in (high, ones, low)], store

    def mapped(self) -> EliasFano:
        self.high, self.ones, self.low = (np.asarray(self._store.get(k)) for k in self._at)
        self.zeros = 16 * np.arange(len(self.ones)) - self.ones
        return self

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), dtype=np.uint64)
        at = i.astype(np.int64) * self.low_bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        # a shift by 64 is split in two, of which the first is by 1 at least
        value = (self.low[word] >> shift) | (self.low[word + 1] << (np.uint64(63) - shift) << np.uint64(1))
        return value & np.uint64((1 << self.low_bits) - 1)

    def select1(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, "right") - 1
        return 16 * word + select(self.high[word], i - self.ones[word])

    def select0(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.zeros, i, "right") - 1
        return 16 * word + select(~self.high[word], i - self.zeros[word])

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        if len(i) * 4 > self.n:  # for so many at once, from one end to the other
            every = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little")) - np.arange(self.n)
            return ((every.astype(np.uint64) << np.uint64(self.low_bits)) | self.lows(np.arange(self.n)))[i]
        return ((self.select1(i) - i).astype(np.uint64) << np.uint64(self.low_bits)) | self.lows(i)

    def successor(self, x: np.ndarray, first: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first place in [first, behind) whose value is x or more, and whether it is x."""
        x = x.astype(np.uint64)
        h = np.minimum(x >> np.uint64(self.low_bits), np.uint64(self.most)).astype(np.int64)
        beyond = (x >> np.uint64(self.low_bits)) > np.uint64(self.most)
        end = self.select0(h) - h
        start = np.where(h > 0, self.select0(np.maximum(h - 1, 0)) - (h - 1), 0)
        start, end = np.where(beyond, behind, np.maximum(start, first)), np.minimum(end, behind)
        stop, want = end.copy(), x & np.uint64((1 << self.low_bits) - 1)
        open_ = np.flatnonzero(start < end)
        while len(open_):
            s, e = start[open_], end[open_]
            mid = (s + e) >> 1
            less = self.lows(mid) < want[open_]
            start[open_], end[open_] = np.where(less, mid + 1, s), np.where(less, e, mid)
            open_ = open_[start[open_] < end[open_]]
        found = start < stop
        at = np.flatnonzero(found)
        found[at] = self.lows(start[at]) == want[at]
        return start, found


class Ranges:
    """Increasing numbers in consecutive ranges. A number is stored plus all that the ranges before it end with, which makes the whole non-decreasing; pointers tell where each range starts."""

    def __init__(self, store: Arrays, number: np.ndarray, starts: np.ndarray):
        """starts: where each range starts, and the end of the last."""
        number = number.astype(np.uint64) + np.uint64(1)
        size = np.diff(starts)
        last = np.where(size > 0, number[np.maximum(starts[1:], 1) - 1] if len(number) else 0, 0).astype(np.uint64)
        before = np.cumsum(last) - last
        self.values = EliasFano(store, number + np.repeat(before, size))
        self.starts = EliasFano(store, starts)

    def mapped(self) -> None:
        self.values.mapped()
        self.starts.mapped()

    def find(self, of: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, found, where the range starts) of numbers in the ranges they are asked for in, by successor search within the pointers."""
        first, behind = (self.starts[of + k].astype(np.int64) for k in (0, 1))
        if not self.values.n:
            return first, np.zeros(len(first), dtype=bool), first
        before = np.where(first > 0, self.values[np.maximum(first - 1, 0)], np.uint64(0))
        place, found = self.values.successor(before + number.astype(np.uint64) + np.uint64(1), first, behind)
        return place, found, first


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each value of key stands, in the values' order; which of these each row has)."""
    order = np.argsort(key)
    new = runs(key[order])
    of = np.empty(len(key), dtype=np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


class NgramTrie:
    """Words, the contexts that were seen before them, and the words seen behind each, with codes of smoothed probabilities.

    A context is found from its last word backwards: each node points to the range of nodes one word longer, and to the
    range of its successors. A successor is stored as its rank among the successors of the node one word shorter, so an
    n-gram is looked up through all its endings, and one whose ending is missing needs no search. What is not found takes
    the code of its longest ending that is, plus the codes of the back-off weights of the contexts that were.
    """

    def __init__(self, words: np.ndarray, code: np.ndarray, contexts: list[np.ndarray], word: np.ndarray, totals: list[np.ndarray], counts: list[np.ndarray], mass, coded, decoded):
        """words: sorted numbers, with the codes of their own probabilities. The rest are seen n-grams, sorted by their contexts (places
        in words, the last one first) and word: totals of the contexts of 1, 2, ... words and counts of these with the word, a row each.
        mass(order, total), coded(p) and decoded(code) are the model's."""
        store = self.store = Arrays()
        self.words = Ranges(store, words, np.array([0, len(words)]))
        self.nodes, self.followers, self.levels = [], [], [(store.put(code), None)]
        node, place, rank, below = np.zeros(len(word), dtype=np.int64), word, word, decoded(code)[word] if len(word) else np.zeros(0)
        n_nodes = 1
        for k, (c, total, count) in enumerate(zip(contexts, totals, counts)):
            new = runs(node, c)
            head = np.flatnonzero(new)
            self.nodes.append(Ranges(store, c[head], np.searchsorted(node[head], np.arange(n_nodes + 1))))
            node, n_nodes = np.cumsum(new) - 1, len(head)
            weight = mass(k + 2, total[head].astype(np.float64))
            back = coded(weight / (total[head] + weight))
            # a node's word once, whatever the longer contexts; of the longest contexts, rows are distinct
            at, place = distinct(node * max(1, len(words)) + word) if k + 1 < len(contexts) else (np.arange(len(word)),) * 2
            starts = np.searchsorted(node[at], np.arange(n_nodes + 1))
            self.followers.append(Ranges(store, rank[at], starts))
            m = mass(k + 2, total[at].astype(np.float64))
            p = (count[at] + m * below[at]) / (total[at] + m)
            self.levels.append((store.put(coded(p)), store.put(back)))
            rank, below = place - starts[node], p[place]
        for r in (self.words, *self.nodes, *self.followers):
            r.mapped()
        self.codes = [(np.asarray(store.get(a)), np.asarray(store.get(b)) if b is not None else None) for a, b in self.levels]

    def score(self, numbers: np.ndarray, contexts: list[np.ndarray], word: np.ndarray, floor: int) -> np.ndarray:
        """The codes of n-grams of words (as places in numbers), sorted by their contexts; floor: the code of a word that isn't here."""
        codes = np.full(len(word), floor, dtype=np.int64)
        at_root, here, _ = self.words.find(np.zeros(len(numbers), dtype=np.int64), numbers)
        rank, known = at_root[word], here[word]
        codes[known] = self.codes[0][0][rank[known]]
        node, alive = np.zeros(len(word), dtype=np.int64), np.ones(len(word), dtype=bool)
        path = np.zeros(len(word), dtype=np.int64)
        for c, nodes, followers, (code, back) in zip(contexts, self.nodes, self.followers, self.codes[1:]):
            new = runs(path, c)
            path = np.cumsum(new) - 1
            head = np.flatnonzero(new)  # each context is looked up once
            at, met = at_root[c[head]], here[c[head]] & alive[head]
            up = np.flatnonzero(met)
            down, found, _ = nodes.find(node[head[up]], at[up])
            met[up] = found
            at[up] = down
            node, alive = np.where(met, at, 0)[path], met[path]
            codes[alive] += back[node[alive]]
            ask = np.flatnonzero(alive & known)
            place, found, first = followers.find(node[ask], rank[ask])
            hit = ask[found]
            codes[hit] = code[place[found]]
            rank[hit] = (place - first)[found]
            known[ask[~found]] = False
        return codes
