"""Personal data by a semi-Markov conditional random field.

Fixed patterns with checks find e-mail addresses, ip addresses, card and phone numbers. Where a text has digits or an @,
it is cut into atoms (runs of letters or digits, single other characters), and a semi-Markov model scores whole segments
of atoms by features of the span: its shape, its lengths, its checks and what stands beside it. Forward and backward sums
over all segmentations train the weights on a bounded sample of regions labelled by the patterns; in scoring, a dynamic
program over segments of at most MOST_ATOMS atoms chooses boundaries and types jointly, with the patterns' spans given,
and adds a segment if its marginal probability is high.

Cases: a null or empty text has no spans; without labelled regions nothing is added; repeated rows each get a row; offsets
are code points, end exclusive; texts are scanned whole, in time linear in their length. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import cut

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match begins where its run of digits does, so earlier starts need no trial.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ATOM = re.compile(r"[A-Za-z]+|[0-9]+|.", re.DOTALL)
_HINT, _BLANK = re.compile(r"[0-9@]"), re.compile(r"\s")
#: Atoms of a segment; regions of each kind, and of none, that the model is trained on, those of smallest hash, and characters of each.
MOST_ATOMS, SAMPLE, SAMPLE_CHARS = 20, 150, 200
#: Atoms of a region whose segments are held at a time.
BLOCK = 2000
EPOCHS, RATE, PENALTY = 8, 0.3, 1e-3
#: Marginal probability from which a segment is added.
SURE = 0.95


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def small(part: str) -> bool:
    p = part.lstrip("0")
    return len(p) <= 3 and int(p or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at + 1):
            start = at
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append(("email", start, m.end()))
                last = m.end()
        at = text.find("@", max(at + 1, last))
    if not _HINT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches of tokens with a digit or an @, set apart by single blanks."""
    out: list[list[int]] = []
    end = 0
    while m := _HINT.search(text, end):
        at = m.start()
        start = at
        while start > end and not text[start - 1].isspace():
            start -= 1
        stop = s.start() if (s := _BLANK.search(text, at)) else len(text)
        if out and start == out[-1][1] + 1 and text[start - 1] == " ":
            out[-1][1] = stop
        else:
            out.append([start, stop])
        end = stop
    return [tuple(x) for x in out]


class Region:
    """The atoms of a stretch of text, and the segments of these that may be entities and touch no given span."""

    def __init__(self, text: str, start: int, end: int, given: list[tuple[str, int, int]] = ()):
        atoms = [m.span() for m in _ATOM.finditer(text, start, end)]
        self.text, self.end, self.borders = text, end, [a for a, _ in atoms] + [end]
        self.kinds = ["d" if "0" <= text[a] <= "9" else "w" if text[a].isascii() and text[a].isalpha() else text[a] for a, _ in atoms]
        self.given = sorted((s, e) for _, s, e in given)

    def segments(self, first: int = 0, behind: int | None = None) -> Iterator[tuple[int, int, list[str]]]:
        """(first atom, behind the last, features) of segments that begin in these atoms, in the order of their beginnings."""
        text, borders, kinds, given = self.text, self.borders, self.kinds, self.given
        x, within = 0, 0
        for i in range(first, min(len(kinds), behind if behind is not None else len(kinds))):
            k = kinds[i]
            while x < len(given) and given[x][0] <= borders[i]:
                within, x = max(within, given[x][1]), x + 1
            if k not in "dw+(" or borders[i] < within:
                continue
            limit = given[x][0] if x < len(given) else self.end
            digits = letters = ats = dots = 0
            shape = ""
            left = text[borders[i] - 1] if borders[i] else ""
            left = "^" if not left or left.isspace() else "x" if left.isalnum() else left
            for j in range(i, min(len(kinds), i + MOST_ATOMS)):
                if borders[j + 1] > limit:
                    break
                c, n = kinds[j], borders[j + 1] - borders[j]
                if c == "d":
                    digits += n
                    shape += f"d{min(n, 20)}"
                elif c == "w":
                    letters += n
                    shape += "w"
                elif c in "@.+-() _%:/":
                    ats += c == "@"
                    dots += c == "."
                    shape += c
                else:
                    break
                if c not in "dw" or not (digits or ats):
                    continue
                right = text[borders[j + 1]] if borders[j + 1] < len(text) else ""
                right = "$" if not right or right.isspace() else "x" if right.isalnum() else right
                span = text[borders[i] : borders[j + 1]]
                f = ["bias", f"left={left}", f"right={right}", f"digits={min(digits, 20)}", f"letters={bool(letters)}", f"atoms={min(j - i, 12)}", f"dots={min(dots, 4)}", f"at={ats}", f"first={k}"]
                f.append("shape=" + (re.sub(r"[dw0-9]+[dw0-9._%+-]*@.*", "@", shape) if ats else shape))
                if 13 <= digits <= 19 and not letters:
                    f.append(f"luhn={luhn(''.join(x for x in span if x.isdigit()))}")
                if dots == 3 and digits + 3 == len(span):
                    f.append(f"octets={all(map(small, span.split('.')))}")
                yield i, j + 1, f


def added(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    hi, lo = (a, b) if a > b else (b, a)
    return hi + math.log1p(math.exp(lo - hi)) if lo > -1e300 else hi


def scores(segs: Iterable, w: dict) -> list[tuple[int, int, int, float]]:
    """(first atom, behind the last, kind, score) of each segment and kind."""
    zero = (0.0,) * len(KINDS)
    out = []
    for i, j, f in segs:
        rows = [w.get(x, zero) for x in f]
        out += [(i, j, k, sum(r[k] for r in rows)) for k in range(len(KINDS))]
    return out


def marginals(n: int, scored: list) -> tuple[list[float], float]:
    """The probability of each scored segment over all segmentations of n atoms; atoms outside of segments score 0."""
    ends, starts = defaultdict(list), defaultdict(list)
    for i, j, _, s in scored:
        ends[j].append((i, s))
        starts[i].append((j, s))
    a, b = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        a[j] = a[j - 1]
        for i, s in ends[j]:
            a[j] = added(a[j], a[i] + s)
    for i in range(n - 1, -1, -1):
        b[i] = b[i + 1]
        for j, s in starts[i]:
            b[i] = added(b[i], b[j] + s)
    return [math.exp(min(0.0, a[i] + s + b[j] - a[n])) for i, j, _, s in scored], a[n]


def trained(examples: list[tuple[str, list[tuple[str, int, int]]]]) -> dict:
    """Weights from (text, spans) by stochastic ascent of the conditional likelihood."""
    w: dict[str, list[float]] = {}
    seen: dict[str, list[float]] = {}
    cases = []
    for text, spans in examples:
        region = Region(text, 0, len(text))
        borders, segs = region.borders, list(region.segments())
        gold = {(s, e, KINDS.index(k)) for k, s, e in spans}
        cases.append((len(borders) - 1, segs, [[(borders[i], borders[j], k) in gold for k in range(len(KINDS))] for i, j, _ in segs]))
    for _ in range(EPOCHS):
        for n, segs, gold in cases:
            p, _ = marginals(n, scores(segs, w))
            for x, (_, _, f) in enumerate(segs):
                for k in range(len(KINDS)):
                    step = gold[x][k] - p[x * len(KINDS) + k]
                    if abs(step) < 1e-4:
                        continue
                    for name in f:
                        row, past = w.setdefault(name, [0.0] * len(KINDS)), seen.setdefault(name, [1e-8] * len(KINDS))
                        g = step - PENALTY * row[k]
                        past[k] += g * g
                        row[k] += RATE * g / math.sqrt(past[k])
    return w


def best(text: str, start: int, end: int, w: dict, given: list[tuple[str, int, int]]) -> list[tuple[str, int, int, float]]:
    """The segments of the best segmentation of a region that touch no given span, with their probability. Segments are made BLOCK atoms at a time, so that a region of any length takes a few numbers an atom."""
    region = Region(text, start, end, given)
    borders, n = region.borders, len(region.kinds)
    before, top, how, at = [-math.inf] * (n + 1), [-1.0] * (n + 1), [None] * (n + 1), 0
    before[0] = top[0] = 0.0

    def settle(i: int) -> None:
        """All that ends up to atom i is known: leaving an atom out of any segment is one way more to get there."""
        nonlocal at
        while at < i:
            at += 1
            before[at] = added(before[at], before[at - 1])
            if top[at] <= top[at - 1]:
                top[at], how[at] = top[at - 1], None

    parts = [(a, a + BLOCK) for a in range(0, n, BLOCK)]
    made = None
    for part in parts:
        made = scores(region.segments(*part), w)
        for i, j, k, s in made:
            settle(i)
            before[j] = added(before[j], before[i] + s)
            if s > 0 and top[i] + s > top[j]:
                top[j], how[j] = top[i] + s, (i, k, s)
    settle(n)
    if top[n] <= 0:
        return []
    behind, i = [0.0] * (n + 1), n
    for part in reversed(parts):
        made = made if part == parts[-1] else scores(region.segments(*part), w)
        for first, j, _, s in reversed(made):
            while i > first:
                i -= 1
                behind[i] = behind[i + 1]
            behind[i] = added(behind[i], behind[j] + s)
    while i > 0:
        i -= 1
        behind[i] = behind[i + 1]
    out, j = [], n
    while j > 0:
        if how[j] is None:
            j -= 1
        else:
            i, k, s = how[j]
            p = math.exp(min(0.0, before[i] + s + behind[j] - before[n]))
            if p >= SURE:
                out.append((KINDS[k], borders[i], borders[j], p))
            j = i
    return out[::-1]


def personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans (kind, start, end, probability) of each row, by kind and start: the fixed patterns' (probability null) and those that the model adds."""
    kind = docs.schema[id_col].dataType.simpleString()
    span_t = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    region_t = pa.list_(pa.struct([("start", pa.int64()), ("text", pa.string()), ("spans", pa.list_(span_t))]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, near = [], []
            for t in b.column(1):
                text = t.as_py() or ""
                spans = base_spans(text)
                base.append([dict(zip(("kind", "start", "end"), s)) for s in spans])
                rows, k, by_start = [], 0, sorted(spans, key=lambda s: s[1])
                for start, end in regions(text):
                    # one character on each side tells what stands beside a span
                    lo, hi = max(0, start - 1), min(len(text), end + 1)
                    while k < len(by_start) and by_start[k][2] <= start:
                        k += 1
                    own = []
                    x = k
                    while x < len(by_start) and by_start[x][1] < end:
                        s, x = by_start[x], x + 1
                        own.append({"kind": s[0], "start": s[1] - lo, "end": s[2] - lo})
                    rows.append({"start": lo, "text": text[lo:hi], "spans": own})
                near.append(rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, type=pa.list_(span_t)), pa.array(near, type=region_t)], names=[id_col, "base", "regions"])

    span = "struct<kind:string,start:bigint,end:bigint>"
    found = cut(docs.select(id_col, text_col).mapInArrow(scan, f"`{id_col}` {kind}, base array<{span}>, regions array<struct<start:bigint,text:string,spans:array<{span}>>>"))
    labelled = found.select(F.explode("regions").alias("r")).select("r.text", "r.spans").where(F.length("text") <= SAMPLE_CHARS).distinct()
    label = F.coalesce(F.get(F.transform("spans", lambda s: s["kind"]), F.lit(0)), F.lit("none"))
    examples = []
    for k in (*KINDS, "none"):
        rows = labelled.where(label == k).orderBy(F.xxhash64("text"), "text").limit(SAMPLE).collect()
        examples.append([(r["text"], [(s["kind"], s["start"], s["end"]) for s in r["spans"]]) for r in rows])
    mixed = [x for at in range(SAMPLE) for rows in examples for x in rows[at : at + 1]]
    weights = trained(mixed) if any(map(len, examples[:-1])) else {}
    all_t = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for base, near in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                spans = [s | {"probability": None} for s in base]
                for r in near if weights else ():
                    given = [(s["kind"], s["start"], s["end"]) for s in r["spans"]]
                    spans += [{"kind": k, "start": s + r["start"], "end": e + r["start"], "probability": p} for k, s, e, p in best(r["text"], 0, len(r["text"]), weights, given)]
                out.append(sorted(spans, key=lambda s: (KINDS.index(s["kind"]), s["start"])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, type=all_t)], names=[id_col, "spans"])

    return found.mapInArrow(decode, f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint,probability:double>>")
