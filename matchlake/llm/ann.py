"""Largest inner products by an adaptive scan of dimensions within probed lists.

With one more component, sqrt(M^2 - |x|^2) for the table's largest norm M and zero for a query, the largest inner product is
the smallest distance. Lists are the cells of centroids (k-means on a bounded sample); a query probes the lists of its nearest
centroids, as many as the sample's own neighbours need for a recall of TARGET. Vectors are rotated at random, so the first d of
D components are a sample of the whole: in a list, distances are summed over blocks of columns, and after each block a
candidate is abandoned if its partial distance times D / d exceeds the query's bound by (1 + SURE / sqrt(d))^2: the hypothesis
that it lies within the bound is then rejected. What is left is scored exactly: the products of the original components in
double precision, summed from the first to the last.

Equal vectors are one entry, with the smallest ids that a result can need; so groups of copies cost one search. Lists are dealt
out over tasks in pieces of even size, however large a list is, and a query is sent once to each task that holds a part of a
list it probes.

Cases: a null, empty or zero vector, and one with null or non-finite components, take no part; nor do rows without an id and
vectors of another length than most have (of the longer, if equally many). Rows equal in id and vector are one; where an id has
several vectors each is a query, candidates of its own id are never its results, and its rows are ranked together. Equal scores
are ordered by id. Fewer candidates than asked for give all of them. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.llm.common import cut

#: Vectors that the centroids and the number of probed lists are fitted on, those of the smallest hash; lists, at most.
SAMPLE, LISTS = 20_000, 1_024
#: The share of the sample's own neighbours that the probed lists hold at least, on average.
TARGET = 0.97
#: Columns of a block; how sure an abandoning is (about 1e-4 a test).
BLOCK, SURE = 16, 2.1
#: Vectors, and queries, of one task.
PER_TASK, QUERIES = 8_192, 20_000
#: Pairs of a query and a candidate that are looked at together.
PAIRS = 1_000_000
#: One in so many pairs left, or more, are taken on as a product of matrices: as dear as a gather of a tenth of them, or so.
DENSE = 16


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, digest, vec): the rows that take part, each once; vec has the components as doubles, digest names the vector."""
    vectors = df.where(F.col(id_col).isNotNull() & (F.size(vector_col) > 0))
    lengths = vectors.groupBy(F.size(vector_col).alias("n")).count()
    most = lengths.orderBy(F.desc("count"), F.desc("n")).first()
    dim = most["n"] if most else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([np.nan if v is None else v for v in b.column(1).flatten().to_pylist()], dtype=np.float64).reshape(b.num_rows, dim) + 0.0  # no negative zero
            good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            vecs = [v.tobytes() for v in x[good]]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good)), pa.array([xxhash.xxh128_digest(v) for v in vecs], pa.binary()), pa.array(vecs, pa.binary())], names=["id", "digest", "vec"])

    rows = vectors.where(F.size(vector_col) == dim).select(F.col(id_col).cast("bigint"), F.col(vector_col).cast("array<double>"))
    return rows.mapInArrow(run, "id bigint, digest binary, vec binary").dropDuplicates(["id", "digest"])


def first_ids(own: DataFrame, is_query: Column, most: int) -> DataFrame:
    """(digest, ids, asks): each vector's smallest ids, so many at most, and whether a query has it. Large groups are first thinned by pieces."""
    stats = own.groupBy("digest").agg(F.count("*").alias("n"), F.max(is_query).alias("asks"))
    stats = cut(stats)
    largest = stats.agg(F.max("n")).first()[0] or 1
    parts = max(1, round((largest / most) ** 0.5))
    rows = own.select("digest", "id", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"))
    for by in (["digest", "part"], ["digest"]):
        rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("_k") <= most)
    ids = rows.groupBy("digest").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # most of them at the utmost
    return ids.join(stats.select("digest", "asks"), "digest")


def longer(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the component that gives all of them one norm."""
    return np.concatenate([x, np.sqrt(np.maximum(0, top - (x * x).sum(axis=1)))[:, None]], axis=1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T))


def centroids(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """k-means of the sample; a centroid that loses all its vectors stays."""
    r = np.random.default_rng(42)
    c = x[r.choice(len(x), n, replace=False)]
    for _ in range(rounds):
        own = distances(x, c).argmin(axis=1)
        size = np.bincount(own, minlength=n)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    return c


def probes_needed(x: np.ndarray, c: np.ndarray, k: int, tried: int = 256) -> int:
    """How many lists of the nearest centroids hold TARGET of the k nearest of the sample's vectors, on average over some of them."""
    own = distances(x, c).argmin(axis=1)
    q = x[np.random.default_rng(7).choice(len(x), min(tried, len(x)), replace=False)].copy()
    q[:, -1] = 0
    near = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, : k + 1]
    order = np.argsort(np.argsort(distances(q, c), axis=1, kind="stable"), axis=1)
    at = np.sort(order[np.arange(len(q))[:, None], own[near]].ravel())
    return int(at[min(len(at) - 1, int(np.ceil(TARGET * len(at))) - 1)]) + 1


def rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(1).standard_normal((dim, dim)))[0]


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, the components' products summed one after the other."""
    total = np.zeros(len(q))
    for k in range(q.shape[1]):
        total += q[:, k] * x[:, k]
    return total


class Best:
    """The best candidates of each of some queries: the largest scores, of equal ones the smaller ids."""

    def __init__(self, n: int, most: int):
        self.most, self.bound = most, np.full(n, -np.inf)
        self.query, self.score, self.first, self.at = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, first: np.ndarray, at: np.ndarray) -> None:
        query, score, first, at = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.first, first), (self.at, at)))
        by = np.lexsort((first, -score, query))
        query = query[by]
        start = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
        rank = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query))))
        keep = rank < self.most
        by = by[keep]
        self.query, self.score, self.first, self.at = query[keep], score[by], first[by], at[by]
        full = rank[keep] == self.most - 1
        self.bound[self.query[full]] = self.score[full]


def scan_list(q: np.ndarray, x: np.ndarray, rq: np.ndarray, rx: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(queries, candidates) of one list that no test abandons. rq, rx: rotated; within: the squared distance that a query's candidates must not exceed."""
    dim = rq.shape[1]
    if not len(rq) or not len(rx):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    near = 1e-12 * (1 + (rq * rq).sum(axis=1) + (rx * rx).sum(axis=1).max())  # what products of matrices round off
    part = distances(rq[:, :BLOCK], rx[:, :BLOCK])
    d = min(BLOCK, dim)
    reject = lambda d: (d / dim) * (1 + SURE / np.sqrt(d)) ** 2 if d < dim else 1 + 1e-9
    left = part <= (within * reject(d) + near)[:, None]
    # while many are left, a block of columns is a product of matrices; then those left are gathered one by one
    while d < dim and np.count_nonzero(left) * DENSE > left.size:
        step = slice(d, min(d + BLOCK, dim))
        part += distances(rq[:, step], rx[:, step])
        d = step.stop
        left &= part <= (within * reject(d) + near)[:, None]
    a, b = np.nonzero(left)
    part = part[a, b]
    while d < dim and len(a):
        step = slice(d, min(d + BLOCK, dim))
        diff = rq[a, step] - rx[b, step]
        part = part + np.einsum("ij,ij->i", diff, diff)
        d = step.stop
        ok = part <= within[a] * reject(d) + near[a]
        a, b, part = a[ok], b[ok], part[ok]
    return a, b


def nearest(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, <id_col>, score): for each row that is_query (a condition on a column `id`) holds for, its k nearest others found, nearest first."""
    own = cut(usable(df, id_col, vector_col))
    reps = first_ids(own, is_query, k + 1)
    reps = cut(reps.join(own.withColumnRenamed("id", "_id"), (F.col("ids")[0] == F.col("_id")) & (reps["digest"] == own["digest"])).select(reps["digest"], "ids", "asks", "vec"))
    stats = reps.mapInArrow(_norms, "n bigint, top double").agg(F.sum("n").alias("n"), F.max("top").alias("top")).first()
    n = stats["n"] or 0
    named = F.array_sort(F.flatten(F.transform("found", lambda x: F.transform(x["ids"], lambda i: F.struct((-x["score"]).alias("far"), i.alias("id"), x["score"].alias("score"))))))
    if n:
        found = cut(_searched(reps, n, stats["top"], k + 1).select("digest", F.slice(named, 1, k + 1).alias("found")))
    else:
        found = cut(reps.select("digest", F.array().cast("array<struct<far:double,id:bigint,score:double>>").alias("found")))
    asked = own.where(is_query).select(F.col("id").alias("query_id"), "digest")
    # copies of one vector share a row of found: the join on it is skewed, and adaptive execution splits it
    others = asked.join(found, "digest").select("query_id", F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k).alias("found"))
    return others.select("query_id", F.posexplode("found").alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias(id_col), F.col("x.score").alias("score"))


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 0))


def _norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x = _vectors(b.column(3))
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(x)], pa.int64()), "top": pa.array([(x * x).sum(axis=1).max()], pa.float64())})


def _searched(reps: DataFrame, n: int, top: float, most: int) -> DataFrame:
    """(digest, found): the best so many vectors of each query's vector, as an array of their ids and scores."""
    spark = reps.sparkSession
    sample = _vectors(pa.array([r["vec"] for r in reps.orderBy(F.xxhash64("digest"), "digest").limit(SAMPLE).select("vec").collect()], pa.binary()))
    sample = longer(sample, top)
    n_lists = int(min(LISTS, max(1, round(n**0.5)), len(sample)))
    centres = centroids(sample, n_lists)
    n_probes = probes_needed(sample, centres, most)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _vectors(b.column(3))
            own = np.concatenate([distances(p, centres).argmin(axis=1) for p in np.array_split(longer(x, top), 1 + len(x) // 2000)])
            asks = np.flatnonzero(b.column(2).to_numpy(zero_copy_only=False).astype(bool))
            probed: list = [None] * len(x)
            far = distances(np.concatenate([x[asks], np.zeros((len(asks), 1))], axis=1), centres)
            for i, row in zip(asks, np.argsort(far, axis=1, kind="stable")[:, :n_probes]):
                probed[i] = np.sort(row).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], b.column(3), pa.array(own.astype(np.int32)), pa.array(probed, pa.list_(pa.int32()))], names=["digest", "ids", "vec", "list", "probed"])

    dealt = cut(reps.mapInArrow(deal, "digest binary, ids array<bigint>, vec binary, list int, probed array<int>"))
    sizes = np.zeros(n_lists, dtype=np.int64)
    for r in dealt.groupBy("list").count().collect():  # a row a list
        sizes[r["list"]] = r["count"]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    # a list's vectors are spread evenly over its range of places, and tasks take equal ranges of them
    laid = spark.createDataFrame([(i, int(starts[i]), int(max(1, sizes[i]))) for i in range(n_lists)], "list int, start bigint, size bigint")
    place = F.col("start") + F.pmod(F.xxhash64("digest"), F.col("size"))
    candidates = dealt.join(F.broadcast(laid), "list").select(F.floor(place / PER_TASK).cast("int").alias("task"), "list", "ids", "vec")  # LISTS rows at most
    n_parts = max(1, -(-dealt.where("probed is not null").count() // QUERIES))
    if n_parts > 1:
        candidates = candidates.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))
    else:
        candidates = candidates.withColumn("part", F.lit(0))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, tasks = [], []
            for i, probed in enumerate(b.column(2).to_pylist()):
                own = {t for p in probed if sizes[p] for t in range(starts[p] // PER_TASK, (starts[p + 1] - 1) // PER_TASK + 1)}
                at += [i] * len(own)
                tasks += sorted(own)
            sent = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*sent.columns, pa.array(tasks, pa.int32())], names=["digest", "vec", "probed", "task"])

    queries = dealt.where("probed is not null").select("digest", "vec", "probed").mapInArrow(send, "digest binary, vec binary, probed array<int>, task int")
    queries = queries.withColumn("part", F.pmod(F.xxhash64("digest"), F.lit(n_parts)).cast("int"))

    def scan(held: pa.Table, asked: pa.Table) -> pa.Table:
        digests, at, scores = _scanned(held, asked, top, most)
        return pa.table({"digest": pa.array(digests, pa.binary()), "ids": held.column("ids").combine_chunks().take(pa.array(at, pa.int64())) if len(at) else pa.array([], pa.list_(pa.int64())), "score": pa.array(scores, pa.float64())})

    key = ["task", "part"]
    hits = candidates.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(scan, "digest binary, ids array<bigint>, score double")
    order = Window.partitionBy("digest").orderBy(F.desc("score"), F.col("ids")[0])
    best = hits.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most)
    return best.groupBy("digest").agg(F.collect_list(F.struct("score", "ids")).alias("found"))


def _scanned(held: pa.Table, asked: pa.Table, top: float, most: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(queries' digests, positions of candidates, scores): the best of one task's vectors for each of its queries."""
    if not held.num_rows or not asked.num_rows:
        return [], np.zeros(0, np.int64), np.zeros(0)
    x, q = _vectors(held.column("vec")), _vectors(asked.column("vec"))
    turn = rotation(x.shape[1] + 1)
    rx, rq = longer(x, top) @ turn, np.concatenate([q, np.zeros((len(q), 1))], axis=1) @ turn
    norms = (q * q).sum(axis=1) + top
    lists = held.column("list").to_numpy()
    first = np.array([i[0] for i in held.column("ids").to_pylist()], dtype=np.int64)
    probed = asked.column("probed").combine_chunks()
    of_list: dict[int, list[int]] = {}
    for i, row in enumerate(probed.to_pylist()):
        for p in row:
            of_list.setdefault(p, []).append(i)
    best = Best(len(q), most)
    by_list = np.argsort(lists, kind="stable")
    for own in np.split(by_list, np.flatnonzero(np.diff(lists[by_list])) + 1):
        who = np.array(of_list.get(int(lists[own[0]]), []), dtype=np.int64)
        for block in np.array_split(who, max(1, -(-len(who) * len(own) // PAIRS))) if len(who) else ():
            bound = best.bound[block]
            fresh = np.isinf(bound)
            if len(own) >= most and fresh.any():  # the first list of a query bounds it by all of its products at once, less what they round off
                least = np.partition(q[block[fresh]] @ x[own].T, len(own) - most, axis=1)[:, len(own) - most]
                bound[fresh] = least - 1e-12 * (1 + norms[block[fresh]])
            a, b = scan_list(q[block], x[own], rq[block], rx[own], np.maximum(0, norms[block] - 2 * bound))
            score = exact(q[block[a]], x[own[b]])
            ok = score >= bound[a]
            a, b = block[a], own[b]
            best.add(a[ok], score[ok], first[b[ok]], b[ok])
    names = asked.column("digest").to_pylist()
    return [names[i] for i in best.query], best.at, best.score
