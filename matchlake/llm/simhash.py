"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints differ in at most 2r bits exactly if some 64-bit value lies within r bits of both. So each
distinct fingerprint stands for all values within r bits of it (its variants); fingerprints that share a variant are
verified and linked. The shuffle is on the variant: its top bits name the bucket, and a fingerprint is sent once to each
bucket that any of its variants falls into, where the variants of that bucket are enumerated. This sends the same
variants as one row each would, in a fiftieth of the bytes.

Cases: ids are integers, any of them; rows without an id are linked like others, but a component without any id is null; a null or empty text has no words
and fingerprint zero, which is linked like any other; fewer words than a shingle make one shingle; equal fingerprints collapse before the search, so copies cost one entry; repeated rows keep
their rows and share a component; an empty table gives an empty result. Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import cut, packed

#: A bucket is named by 12 bits of the variant, by more where it would hold more distinct fingerprints than this on average.
BUCKET_BITS, PER_BUCKET = 12, 400
#: Fingerprints of one bucket beyond which its variants are dealt out to several tasks.
SPLIT_AT = 1500
#: Buckets have so many bits at most: enough for 4e11 fingerprints. Up to 2^20 buckets the table of crowded ones is small enough to be broadcast.
MAX_BUCKET_BITS, BROADCAST_BITS = 30, 20
#: Links of a task on average, when components are looked for.
LINKS_PER_TASK = 50_000


def fingerprint_of(text: bytes | None, shingle: int, seed: int = 42) -> int:
    """The fingerprint of one UTF-8 text: a bit is set if it is in over half of the shingles' hashes."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    norm = b" ".join(w)
    digest = xxhash.xxh64_intdigest
    if len(w) <= shingle:
        return digest(norm, seed)
    ends = list(accumulate(map((1).__add__, map(len, w))))
    starts = [0, *ends[:-1]]
    h = np.array([digest(norm[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :])], dtype="<u8")
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): the 64-bit fingerprint of each row, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint_of(t, shingle) for t in b.column(1).to_pylist()), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.encode(F.col(text_col), "UTF-8").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, fp bigint")


def masks(bits: int, most: int) -> np.ndarray:
    """All values of so many bits with at most so many bits set."""
    return np.array([sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(bits), k)], dtype=np.uint64)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n nodes' components, for the edges of one bucket."""
    p = np.arange(n)
    while True:
        x, y = p[a], p[b]
        if (x == y).all():
            return p
        np.minimum.at(p, np.maximum(x, y), np.minimum(x, y))
        while (q := p[p]).tobytes() != p.tobytes():
            p = q


def bucket_links(fp: np.ndarray, distance: np.ndarray, radius: int, suffix_bits: int, part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions in fp that link all fingerprints which share one of this bucket's variants.

    fp: distinct fingerprints; distance: how many of the bucket's bits each differs in, so that radius - distance bits of
    the rest may still change. Only variants of this part of the bucket are looked at.
    """
    low = np.uint64((1 << suffix_bits) - 1)
    variants, owners = [], []
    for d in range(radius + 1):
        own = np.flatnonzero(distance == d)
        m = masks(suffix_bits, radius - d)
        for block in np.array_split(own, max(1, -(-len(own) * len(m) // 2_000_000))):
            v = ((fp[block] & low)[:, None] ^ m[None, :]).ravel()
            o = np.repeat(block.astype(np.int32), len(m))
            if parts > 1:
                mine = (v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(parts) == part
                v, o = v[mine], o[mine]
            variants.append(v)
            owners.append(o)
    v, o = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(v)
    v = v[order]
    same = np.flatnonzero(v[1:] == v[:-1])
    pairs = np.unique((o[order[same]].astype(np.int64) << 32) | o[order[same + 1]])
    a, b = pairs >> 32, pairs & 0xFFFFFFFF
    near = np.bitwise_count(fp[a] ^ fp[b]) <= 2 * radius  # a shared variant implies it; verified all the same
    return a[near], b[near]


def ball_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b), a > b: links between the nodes of fps (fp, node; each fp once) that join just those within 2 * radius bits, directly or through others of their bucket."""
    n = fps.count()
    bits = min(MAX_BUCKET_BITS, max(BUCKET_BITS, ceil(log2(max(n, 1) / PER_BUCKET))))
    prefix = F.shiftrightunsigned("fp", 64 - bits)
    crowded = fps.groupBy(prefix.alias("bucket")).count().where(F.col("count") > SPLIT_AT).select("bucket", F.least(F.ceil(F.col("count") / SPLIT_AT), F.lit(65535)).cast("int").alias("parts"))
    sent = fps.withColumn("mask", F.explode(F.array(*(F.lit(int(m)).cast("bigint") for m in masks(bits, radius))))).withColumn("bucket", prefix.bitwiseXOR(F.col("mask")))
    crowded = F.broadcast(crowded) if bits <= BROADCAST_BITS else crowded  # a row for each crowded bucket
    sent = sent.join(crowded, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sent = sent.select((F.shiftleft(F.col("bucket").cast("bigint"), 32) + F.shiftleft(F.col("parts").cast("bigint"), 16) + F.col("part")).alias("task"), "fp", "node")
    suffix_bits = 64 - bits

    def link(key: tuple, t: pa.Table) -> pa.Table:
        task = key[0].as_py()
        bucket, parts, part = task >> 32, task >> 16 & 0xFFFF, task & 0xFFFF
        fp, node = t.column("fp").to_numpy().view(np.uint64), t.column("node").to_numpy()
        distance = np.bitwise_count((fp >> np.uint64(suffix_bits)) ^ np.uint64(bucket))
        a, b = bucket_links(fp, distance, radius, suffix_bits, part, parts)
        root = roots(len(fp), a, b)
        far = np.flatnonzero(root != np.arange(len(fp)))
        x, y = node[far], node[root[far]]
        return pa.table({"a": np.maximum(x, y), "b": np.minimum(x, y)})

    return sent.groupBy("task").applyInArrow(link, "a bigint, b bigint").distinct()


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b; so many rows, where that is known) reaches; by alternating large and small stars."""
    edges = edges if rows is None else packed(edges, rows, LINKS_PER_TASK)
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    before = state(edges)
    while before[0]:
        edges = packed(edges, before[0], LINKS_PER_TASK)
        both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        both = small.union(least.select("a", F.col("m").alias("b")))
        edges = cut(packed(both, before[0], LINKS_PER_TASK).distinct())  # a star has no more links than what it replaces
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def named_components(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(node, component, component_id) of nodes (node, id), whatever numbers they have: the root that found (node, root) gives, else the node itself, and the smallest id there."""
    roots = found.select(F.col("root").alias("node"), "root").distinct()
    linked = cut(found.unionByName(roots).join(nodes, "node").select("node", "root", "id"))
    least = cut(linked.groupBy("root").agg(F.min("id").alias("component_id")))
    linked = linked.join(least, "root").select("node", F.col("root").alias("component"), "component_id")
    alone = nodes.join(linked, "node", "left_anti").select("node", F.col("node").alias("component"), F.col("id").alias("component_id"))
    return linked.unionByName(alone)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """(id, fp, component_id) for each row: component_id is the smallest id reachable over links of at most so many (an even number of) differing bits."""
    if distance % 2:
        raise ValueError("the distance must be even: two balls of half of it meet")
    prints = cut(fingerprints(docs, id_col, text_col, shingle))
    fps = cut(prints.groupBy("fp").agg(F.min(id_col).cast("bigint").alias("id")).withColumn("node", F.monotonically_increasing_id()))
    found = components(ball_links(fps.select("fp", "node"), distance // 2))
    label = fps.select("fp", "node").join(named_components(fps.select("node", "id"), found), "node").select("fp", "component_id")
    return prints.join(label, "fp", "left").select(id_col, "fp", F.col("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without near-duplicates: of each component the row whose id names it stays; of repeated rows with that id, one."""
    return keep_named(docs, near_duplicates(docs, id_col, text_col, **how), id_col, text_col)


def keep_named(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that name their component in found (id, component_id), one for an id, and those without an id."""
    chosen = found.where(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    alone = docs.where(F.col(id_col).isNull())  # rows without an id name no component
    kept = docs.join(chosen, id_col, "left_semi")
    names = docs.columns
    first = [F.min_by(F.struct(*names), F.struct(F.xxhash64(text_col), F.coalesce(text_col, F.lit("")))).alias("row")]
    return kept.groupBy(id_col).agg(*first).select("row.*").unionByName(alone)
