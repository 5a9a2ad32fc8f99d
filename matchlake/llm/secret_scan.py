"""Secret scans by grammar inference.

Fixed patterns find labelled credentials. From all of their distinct values that are not held out a prefix tree is counted over
character classes, and statistically compatible states are merged (ALERGIA: a state is compatible if the Hoeffding bound tells
neither its end nor any of its transitions apart, all the way down), which leaves a probabilistic automaton of each kind's
format. The counts are taken in the tasks; the driver has the branches that most values take, STATES a kind at the utmost, and
all the others' counts as one state that they lead to and stay in. All candidates of the corpus, labelled ones included (tokens of LEAST_ASSIGN characters or more), are then scored by
their likelihood under the automata against a background of ordinary tokens. One that touches no labelled span is added if
it scores above the cutoff. The cutoff lies between what held-out ordinary tokens of like length reach and what held-out
labelled values do, over all of both: at the score that RECALL of these reach, but never at one that more than 1 - ABOVE of the former do.

Cases: a null or empty text has no spans; without labelled credentials nothing is scored or added; repeated rows each get a
row; offsets are code points, end exclusive; texts are scanned whole. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import cut

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: The shortest match, by the length that the kinds ask for.
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{14,}"), re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN = 12
#: What may be a credential.
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST_ASSIGN},}}")
#: Candidates below and from this length on have cutoffs of their own, as ratios of short tokens spread more.
LONG = 16
#: States of a kind's prefix tree; scores that are put in order by the driver.
STATES, AT_ONCE = 20_000, 10_000
#: Significance of the merge test; share of held-out ordinary tokens that the cutoff lies above, and of held-out labelled values that should reach it.
ALPHA, ABOVE, RECALL = 0.05, 0.999, 0.95


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, credential) by start, then kind."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, spans: list[tuple]) -> list[tuple[int, int, str]]:
    """Tokens that touch no span."""
    out, k = [], 0
    by_start = sorted((s, e) for _, s, e, _ in spans)
    for m in CANDIDATE.finditer(text):
        while k < len(by_start) and by_start[k][1] <= m.start():
            k += 1
        x = k
        while x < len(by_start) and by_start[x][1] <= m.start():
            x += 1
        if x == len(by_start) or by_start[x][0] >= m.end():
            out.append((m.start(), m.end(), m[0]))
    return out


def char_class(c: str) -> str:
    if c.isdigit():
        return "0"
    if c.islower():
        return "a" if c <= "f" else "z"
    if c.isupper():
        return "A" if c <= "F" else "Z"
    return c


#: How many characters share a class: the emission of each is one over this.
_SIZE = {"0": 10, "a": 6, "z": 20, "A": 6, "Z": 20}


def shape(value: str) -> str:
    return "".join(map(char_class, value))


def shapes(value: Column) -> Column:
    """shape of a column of candidates."""
    return F.translate(value, "123456789bcdefghijklmnopqrstuvwxyBCDEFGHIJKLMNOPQRSTUVWXY", "0" * 9 + "a" * 5 + "z" * 19 + "A" * 5 + "Z" * 19)


class Automaton:
    """A deterministic probabilistic automaton: states have counts of arrivals, ends and transitions."""

    def __init__(self, values: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.seen: list[Counter] = [Counter()]
        self.ends, self.total = [0], [0]
        #: What the branches hold that have no state of their own: transitions by class, arrivals, ends.
        self.rare: tuple[Counter, int, int] = (Counter(), 0, 0)
        for v in values:
            at = 0
            self.total[0] += 1
            for c in v:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.seen.append(Counter())
                    self.ends.append(0)
                    self.total.append(0)
                self.seen[at][c] += 1
                at = self.next[at][c]
                self.total[at] += 1
            self.ends[at] += 1

    @classmethod
    def counted(cls, nodes: list, edges: list, rare: tuple[Counter, int, int]) -> Automaton:
        """From a tree's nodes (node, parent, c, n, ends; the root has no parent), the edges (parent, c, n) from these to rare branches, and what those hold."""
        own, below = cls([]), defaultdict(list)
        own.rare = rare
        for x in nodes:
            below[x["parent"]].append(x)
        at = {None: None}
        pending = sorted(below[None], key=lambda x: x["node"])
        for x in pending:  # by level
            at[x["node"]] = s = len(at) - 1
            if s:
                own.next.append({})
                own.seen.append(Counter())
                own.ends.append(0)
                own.total.append(0)
                own.next[at[x["parent"]]][x["c"]] = s
                own.seen[at[x["parent"]]][x["c"]] = x["n"]
            own.total[s], own.ends[s] = x["n"], x["ends"]
            pending += sorted(below[x["node"]], key=lambda y: y["c"])
        for x in edges:
            own.seen[at[x["parent"]]][x["c"]] += x["n"]
        return own

    def differ(self, x: int, n: int, y: int, m: int) -> bool:
        if not n or not m:
            return False
        return abs(x / n - y / m) > math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def compatible(self, p: int, q: int) -> bool:
        pending = [(p, q)]
        while pending:
            p, q = pending.pop()
            if self.differ(self.ends[p], self.total[p], self.ends[q], self.total[q]):
                return False
            for c in self.seen[p].keys() | self.seen[q].keys():
                if self.differ(self.seen[p][c], self.total[p], self.seen[q][c], self.total[q]):
                    return False
                if c in self.next[p] and c in self.next[q]:
                    pending.append((self.next[p][c], self.next[q][c]))
        return True

    def fold(self, p: int, q: int) -> None:
        """Adds the tree under q to state p."""
        pending = [(p, q)]
        while pending:
            p, q = pending.pop()
            self.ends[p] += self.ends[q]
            self.total[p] += self.total[q]
            for c, n in self.seen[q].items():
                self.seen[p][c] += n
                if c not in self.next[q]:
                    continue
                if c in self.next[p]:
                    pending.append((self.next[p][c], self.next[q][c]))
                else:
                    self.next[p][c] = self.next[q][c]

    def merged(self) -> Automaton:
        red, blue = [0], [(0, c) for c in sorted(self.next[0])]
        while blue:
            blue.sort(key=lambda x: (-self.total[self.next[x[0]][x[1]]], x))
            p, c = blue.pop(0)
            q = self.next[p][c]
            if q in red:
                continue
            for r in red:
                if self.compatible(r, q):
                    self.next[p][c] = r
                    self.fold(r, q)
                    break
            else:
                red.append(q)
            known = set(red)
            blue = [(s, x) for s in red for x in self.next[s] if self.next[s][x] not in known]
        return self

    def table(self) -> tuple[list[dict[str, tuple[int, float]]], list[float]]:
        """For each state: class to (state, log probability of a character), and the log probability of an end; with a little for what was never seen."""
        keep, order = {0: 0}, [0]
        for s in order:
            for t in self.next[s].values():
                if t not in keep:
                    keep[t] = len(order)
                    order.append(t)
        steps, ends = [], []
        for s in order:
            whole = self.total[s] + 1.0
            steps.append({c: (keep[self.next[s][c]] if c in self.next[s] else len(order), math.log(n / whole / _SIZE.get(c, 1))) for c, n in self.seen[s].items()})
            ends.append(math.log(max(self.ends[s], 0.01) / whole))
        seen, total, ended = self.rare
        if total:
            steps.append({c: (len(order), math.log(n / (total + 1.0) / _SIZE.get(c, 1))) for c, n in seen.items()})
            ends.append(math.log(max(ended, 0.01) / (total + 1.0)))
        return steps, ends


#: Log probability of a character that an automaton has no transition for.
_MISS = math.log(1e-4)


def likelihood(model: tuple, value: str) -> float:
    steps, ends = model
    at, out = 0, 0.0
    for c in value:
        go = steps[at].get(char_class(c))
        if go is None:
            out += _MISS
        else:
            out += go[1]
            at = go[0]
    return out + ends[at]


def background(pairs: dict[str, Counter]) -> dict:
    """Character bigrams of ordinary tokens, as log probabilities; '' begins a token."""
    return {a: ({b: math.log((n + 0.1) / (sum(c.values()) + 8.0)) for b, n in c.items()}, math.log(0.1 / (sum(c.values()) + 8.0))) for a, c in pairs.items()}


def ordinary(model: dict, value: str) -> float:
    floor, out, before = math.log(0.1 / 8.0), 0.0, ""
    for c in value:
        known, miss = model.get(before, ({}, floor))
        out += known.get(c, miss)
        before = c
    return out


def ratio(models: list, base: dict, value: str) -> float:
    """The best automaton's log likelihood ratio against the background, a character."""
    return (max(likelihood(m, value) for m in models) - ordinary(base, value)) / len(value)


class Model(NamedTuple):
    automata: list
    background: dict
    #: Cutoffs of short and of long candidates, and the shares of held-out labelled values that reach them (null without such values).
    cutoffs: tuple[float, float]
    recall: tuple[float | None, float | None]


class Ordered:
    """Any number of scores (x), in their order: one is found by counting in ranges that narrow down to few scores, or to equal ones."""

    def __init__(self, rows: DataFrame):
        self.rows = cut(rows.select("x"))
        self.n, self.low, self.high = self.rows.agg(F.count("x"), F.min("x"), F.max("x")).first()

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, k: int) -> float:
        rows, n, low, high = self.rows, self.n, self.low, self.high
        while n > AT_ONCE and low < high:
            part = F.floor((F.col("x") - low) / ((high - low) / 1000))
            for r in rows.groupBy(part.alias("part")).agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("part").collect():
                if k < r["n"]:
                    break
                k -= r["n"]
            n, low, high = r["n"], r["low"], r["high"]
            rows = rows.where(F.col("x").between(low, high))
        return low if low == high else sorted(r["x"] for r in rows.collect())[k]

    def above(self, least: float) -> int:
        return self.rows.where(F.col("x") > least).count()


def cutoff(ordinary: list[float] | Ordered, labelled: list[float] | Ordered) -> tuple[float, float | None]:
    """(the cutoff, the share of labelled scores above it) from held-out scores of both."""
    ordinary, labelled = (sorted(x) if isinstance(x, list) else x for x in (ordinary, labelled))
    least = max(0.0, ordinary[min(len(ordinary) - 1, int(ABOVE * len(ordinary)))] if len(ordinary) else 0.0)
    # just below the score that so many reach, if ordinary tokens leave that much room
    at = labelled[int((1 - RECALL) * len(labelled))] if len(labelled) else least
    cut_at = max(least, math.nextafter(at, -math.inf))
    above = labelled.above(cut_at) if isinstance(labelled, Ordered) else sum(x > cut_at for x in labelled)
    return cut_at, above / len(labelled) if len(labelled) else None


def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, node, parent, c, n, ends): the prefixes of shapes (kind, shape, n), named by chained hashes."""
    for b in batches:
        out = []
        for kind, value, n in zip(*(x.to_pylist() for x in b.columns)):
            node, parent, c = xxhash.xxh64_intdigest(kind) >> 1, None, ""
            out.append((kind, node, parent, c, n, 0 if value else n))
            for k, c in enumerate(value, 1):
                parent, node = node, xxhash.xxh64_intdigest(f"{node}{c}") >> 1
                out.append((kind, node, parent, c, n, n if k == len(value) else 0))
        if out:
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*out), types)], names=["kind", "node", "parent", "c", "n", "ends"])


def automata(values: DataFrame) -> list[tuple]:
    """The merged automaton of each kind of values (kind, value)."""
    counts = values.groupBy("kind", shapes(F.col("value")).alias("shape")).agg(F.count("*").alias("n"))
    tree = counts.mapInArrow(grown, "kind string, node bigint, parent bigint, c string, n bigint, ends bigint")
    tree = cut(tree.groupBy("kind", "node", "parent", "c").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")))
    out = []
    arrivals = {r["kind"]: r["n"] for r in tree.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    for kind in (k for k in KINDS if k in arrivals):
        own, often = tree.where(F.col("kind") == kind), F.col("parent").isNull() | (F.col("n") > arrivals[kind] // STATES)
        nodes = own.where(often).collect()  # the arrivals at these are at most all: no more than STATES
        seen, total, ended, edges = Counter(), 0, 0, []
        for r in own.where(~often).groupBy("c").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")).collect():
            seen[r["c"]], total, ended = r["n"], total + r["n"], ended + r["ends"]
        if total:
            edges = own.where(~often).join(own.where(often).select(F.col("node").alias("parent")), "parent", "left_semi").select("parent", "c", "n").collect()
            for r in edges:
                seen[r["c"]] -= r["n"]
        out.append(Automaton.counted(nodes, edges, (+seen, total, ended)).merged().table())
    return out


def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pairs = Counter(p for t in b.column(0).to_pylist() for p in zip(["", *t], t))
        if pairs:
            yield pa.RecordBatch.from_pydict({"a": [a for a, _ in pairs], "b": [b for _, b in pairs], "n": pa.array(pairs.values(), pa.int64())})


def fitted(found: DataFrame) -> Model | None:
    """The automata, the background and the cutoffs, from all distinct values and tokens found; about every second one of each is held out."""
    held_out = F.pmod(F.xxhash64("value"), F.lit(2)) == 1
    values = cut(found.select(F.explode("base").alias("s")).select("s.kind", "s.value").distinct().withColumn("held", held_out))
    lone = [r["kind"] for r in values.groupBy("kind").agg(F.min("held").alias("held")).where("held").collect()]  # no value is left to learn from
    values = values.withColumn("held", F.col("held") & ~F.col("kind").isin(lone))
    models = automata(values.where("not held"))
    if not models:
        return None
    tokens = found.select(F.explode("candidates").alias("s")).select("s.value").where(~(F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")))  # words, and numbers such as addresses
    tokens = cut(tokens.distinct().withColumn("held", held_out))
    pairs: dict[str, Counter] = defaultdict(Counter)
    for r in tokens.where("not held").select("value").mapInArrow(bigrams, "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():  # pairs of characters
        pairs[r["a"]][r["b"]] = r["n"]
    base = background(pairs)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"long": pa.array([len(v) >= LONG for v in b.column(0).to_pylist()], pa.bool_()), "x": pa.array([ratio(models, base, v) for v in b.column(0).to_pylist()], pa.float64())})

    scored = [cut(d.where("held").select("value").mapInArrow(score, "long boolean, x double")) for d in (tokens, values)]
    made = [cutoff(*(Ordered(s.where(w)) for s in scored)) for w in ("not long", "long")]
    return Model(models, base, *zip(*made))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans (kind, start, end, value, score) of each row, by start and kind: the fixed patterns' and those that the automata add; and
    n_scored and top_score: how many candidates were scored, and the highest ratio."""
    kind = docs.schema[id_col].dataType.simpleString()
    base_t = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
    cand_t = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, rest = [], []
            for t in b.column(1):
                text = t.as_py() or ""
                spans = base_spans(text)
                base.append([dict(zip(("kind", "start", "end", "value"), s)) for s in spans])
                rest.append([dict(zip(("start", "end", "value"), s)) for s in candidates(text, spans)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, type=base_t), pa.array(rest, type=cand_t)], names=[id_col, "base", "candidates"])

    span = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"
    found = cut(docs.select(id_col, text_col).mapInArrow(scan, f"`{id_col}` {kind}, base {span}, candidates array<struct<start:bigint,end:bigint,value:string>>"))
    model = fitted(found)
    all_t = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("score", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda s: ratio(model.automata, model.background, s["value"]) if model else None
        for b in batches:
            out, n, top = [], [], []
            for base, rest in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                spans = [s | {"score": of(s)} for s in base]
                others = [s | {"kind": "format", "score": of(s)} for s in rest]
                scores = [s["score"] for s in (*spans, *others) if model]
                n.append(len(scores))
                top.append(max(scores, default=None))
                spans += [s for s in others if model and s["score"] > model.cutoffs[len(s["value"]) >= LONG]]
                out.append(sorted(spans, key=lambda s: (s["start"], KINDS.index(s["kind"]))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, type=all_t), pa.array(n, pa.int64()), pa.array(top, pa.float64())], names=[id_col, "spans", "n_scored", "top_score"])

    return found.mapInArrow(score, f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint,value:string,score:double>>, n_scored bigint, top_score double")
