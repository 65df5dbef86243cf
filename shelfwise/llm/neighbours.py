"""Approximate nearest neighbours by largest inner product, with learned partitions.

A bounded sample of the vectors is joined into a neighbour graph, which is cut into parts of equal
size by repeated bisection along its slowest mode. A small network learns to tell, from a
vector alone, in which parts its neighbours lie. All vectors are indexed under their most probable
part. A query looks through its most probable parts, as many as the sample needs to find
``target`` of its neighbours, and what it meets there is ranked by the exact inner product in doubles.

Vectors that are null, zero, of another length than most, or hold null or non-finite numbers take no part. Equal vectors are
indexed once with their smallest ids, as many as any query can need, so a vector
with very many copies costs no more than others. Ties go to the smaller id. Repeated ids are separate rows of
the same name. Fewer candidates than asked for: all of them. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.ordering import top_k
from shelfwise.llm.common import saved


@dataclass(frozen=True)
class Search:
    k: int = 20
    target: float = 0.93  # share of the sample's neighbours that the probed parts must hold
    part_rows: int = 1_600  # vectors for each part, within the bounds below
    least_parts: int = 8
    most_parts: int = 128
    sample_rows: int = 64  # sampled vectors for each part: at most 8,192 in all
    graph: int = 20  # neighbours in the graph
    hidden: int = 96
    rounds: int = 60
    block: int = 20_000  # candidates of one task
    queries: int = 4_000  # queries of one task


@dataclass
class Router:
    """Scores of the parts from a vector: one hidden layer."""

    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x * self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """For each row the k other rows with the largest inner product."""
    out = np.empty((len(x), k), dtype=np.int64)
    for at in range(0, len(x), 1_024):
        s = x[at : at + 1_024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 1_024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int) -> np.ndarray:
    """Part of each row; parts differ in size by one row at most for each bisection."""
    n, k = graph.shape
    part = np.zeros(n, dtype=np.int64)
    source, target = np.repeat(np.arange(n), k), graph.ravel()
    rng = np.random.default_rng(7)
    made = 1
    while made < parts:
        inside = part[source] == part[target]
        a, b = source[inside], target[inside]
        degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n) + 1.0
        v = rng.standard_normal(n)
        size = np.bincount(part, weights=degree, minlength=made)
        for _ in range(60):
            v = v - (np.bincount(part, weights=v * degree, minlength=made) / size)[part]
            v = (np.bincount(a, weights=v[b], minlength=n) + np.bincount(b, weights=v[a], minlength=n) + v) / degree + v
            v /= np.sqrt(np.bincount(part, weights=v * v, minlength=made))[part] + 1e-12
        order = np.lexsort((v, part))
        start = np.searchsorted(part[order], np.arange(made))
        counts = np.bincount(part, minlength=made)
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n) - np.repeat(start, counts)
        side = (place >= (counts[part] + 1) // 2).astype(np.int64)
        # a few rounds of swaps that bring rows to the side of their neighbours, as many each way
        for _ in range(4):
            other = (side[b] * 2 - 1).astype(float)
            back = (side[a] * 2 - 1).astype(float)
            pull = np.bincount(a, weights=other, minlength=n) + np.bincount(b, weights=back, minlength=n)
            gain = np.where(side == 0, pull, -pull)
            for p in range(made):
                rows = np.flatnonzero(part == p)
                left, right = rows[side[rows] == 0], rows[side[rows] == 1]
                left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
                m = min(len(left), len(right))
                swap = int(np.count_nonzero(gain[left[:m]] + gain[right[:m]] > 0) * 0.5)
                side[left[:swap]], side[right[:swap]] = 1, 0
        part = part * 2 + side
        made *= 2
    return part


def fit_router(x: np.ndarray, graph: np.ndarray, part: np.ndarray, parts: int, how: Search) -> Router:
    """Train on each row's neighbours: the share of them in each part."""
    n, d = x.shape
    want = np.zeros((n, parts))
    np.add.at(want, (np.repeat(np.arange(n), graph.shape[1]), part[graph].ravel()), 1.0)
    want[np.arange(n), part] += 2.0
    want /= want.sum(axis=1, keepdims=True)
    scale = np.sqrt(d) / max(1e-12, float(np.linalg.norm(x, axis=1).mean()))
    rng = np.random.default_rng(11)
    params = [rng.standard_normal((d, how.hidden)) / np.sqrt(d), np.zeros(how.hidden), rng.standard_normal((how.hidden, parts)) / np.sqrt(how.hidden), np.zeros(parts)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    xs = x * scale
    for t in range(1, how.rounds + 1):
        z = xs @ params[0] + params[1]
        h = np.maximum(z, 0)
        s = h @ params[2] + params[3]
        s -= s.max(axis=1, keepdims=True)
        p = np.exp(s)
        p /= p.sum(axis=1, keepdims=True)
        g = (p - want) / n
        dh = (g @ params[2].T) * (z > 0)
        grads = [xs.T @ dh + 1e-3 * params[0], dh.sum(axis=0), h.T @ g + 1e-3 * params[2], g.sum(axis=0)]
        for i, grad in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * grad, 0.999 * v[i] + 0.001 * grad * grad
            params[i] = params[i] - 0.02 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Router(scale, *params)


def probes_needed(router: Router, asked: np.ndarray, x: np.ndarray, k: int, target: float) -> int:
    """Most probable parts to look through so that ``target`` of the neighbours in ``x``, each indexed under
    its own most probable part, are met. The rows asked for were not trained on."""
    graph = np.argpartition(-(asked @ x.T), k - 1, axis=1)[:, :k]
    s, own = router.scores(asked), router.scores(x).argmax(axis=1)
    order = np.argsort(-s, axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(s.shape[1])[None, :], axis=1)
    at = place[np.repeat(np.arange(len(asked)), k), own[graph].ravel()]
    share = np.cumsum(np.bincount(at, minlength=s.shape[1])) / max(1, len(at))
    return int(np.searchsorted(share, target) + 1)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _best(q: np.ndarray, x: np.ndarray, ids: list[list[int]], k: int) -> Iterator[tuple[list[int], list[float]]]:
    """For each query the first k of (score descending, id ascending), with every id of a vector counted."""
    for at in range(0, len(q), 256):
        s = q[at : at + 256] @ x.T
        for row, own in zip(s, q[at : at + 256], strict=True):
            if len(row) > k:
                edge = np.partition(row, len(row) - k)[len(row) - k]
                near = np.flatnonzero(row >= edge - 1e-9 * max(1.0, abs(edge)))
            else:
                near = np.arange(len(row))
            exact = (x[near] * own).sum(axis=1)
            pairs = sorted((-v, i) for v, j in zip(exact.tolist(), near.tolist(), strict=True) for i in ids[j])[:k]
            yield [i for _, i in pairs], [-v for v, _ in pairs]


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """(id, v as doubles, key1, key2) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("id"), v.alias("v")).filter("id is not null and v is not null")
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    bad = F.exists("v", lambda a: a.isNull() | F.isnan(a) | (F.abs(a) == float("inf")))
    rows = rows.filter((F.size("v") == (common["d"] if common else 0)) & ~bad & F.exists("v", lambda a: a != 0))
    return rows.select("id", "v", F.xxhash64("v").alias("key1"), F.xxhash64(F.reverse("v")).alias("key2"))


def nearest(vectors: DataFrame, is_query: Column, how: Search = Search(), vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with ``is_query`` (of ``id``) its nearest other rows."""
    rows = usable(vectors, vector)
    keys, more = ["key1", "key2"], how.k + 1
    distinct = top_k(rows, keys, [F.col("id").asc()], more).groupBy(*keys).agg(
        F.first("v").alias("v"), F.array_sort(F.collect_list("id")).alias("ids")
    )
    distinct = saved(distinct)
    n = distinct.count()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not n:
        return vectors.sparkSession.createDataFrame([], schema)
    parts = how.least_parts
    while parts < how.most_parts and parts * how.part_rows < n:
        parts *= 2
    taken = distinct.select("key1", "key2", "v").orderBy("key1", "key2").limit(parts * how.sample_rows).toArrow()
    x = _matrix(taken.column("v"))
    asked, x = x[: len(x) // 5], x[len(x) // 5 :]
    k = min(how.graph, len(x) - 1)
    if k < 1 or len(x) < 2 * parts:
        router, probes = fit_router(x, np.zeros((len(x), 1), dtype=np.int64), np.zeros(len(x), dtype=np.int64), parts, how), parts
    else:
        graph = neighbour_graph(x, k)
        router = fit_router(x, graph, balanced_parts(graph, parts), parts, how)
        probes = probes_needed(router, asked, x, k, how.target)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = router.scores(_matrix(b.column(2))).argmax(axis=1) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best.astype(np.int32))], names=["key1", "key2", "v", "ids", "part"])

    # neighbouring parts of the bisection go together into bundles of about a task's candidates
    bundles = min(parts, max(1, -(-n // how.block)))
    bundle_of = np.arange(parts) * bundles // parts

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = router.scores(_matrix(b.column(2))) if b.num_rows else np.empty((0, parts))
            probed = np.sort(np.argsort(-s, axis=1, kind="stable")[:, :probes], axis=1)
            row, bundle, lists = [], [], []
            for i, own in enumerate(probed):
                for g in np.unique(bundle_of[own]).tolist():
                    row.append(i)
                    bundle.append(g)
                    lists.append(own[bundle_of[own] == g].tolist())
            taken = b.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(bundle, pa.int32()), pa.array(lists, pa.list_(pa.int32()))], names=["key1", "key2", "v", "bundle", "parts"]
            )

    indexed = saved(distinct.mapInArrow(index, "key1 bigint, key2 bigint, v array<double>, ids array<bigint>, part int"))
    asked = rows.filter(is_query)
    queries = asked.select("key1", "key2", "v").dropDuplicates(keys)
    routed = saved(queries.mapInArrow(route, "key1 bigint, key2 bigint, v array<double>, bundle int, parts array<int>"))
    indexed = indexed.withColumn("bundle", F.floor(F.col("part") * bundles / parts).cast("int"))
    # at most ``most_parts`` rows: how many blocks of candidates and of queries each bundle is dealt into
    size = {r["bundle"]: -(-r["count"] // how.block) for r in indexed.groupBy("bundle").count().collect()}
    load = {r["bundle"]: -(-r["count"] // how.queries) for r in routed.groupBy("bundle").count().collect()}
    deal = vectors.sparkSession.createDataFrame([(g, size[g], load.get(g, 1)) for g in size], "bundle int, blocks int, turns int")
    chunk = F.xxhash64("key1", "key2")
    left = indexed.join(F.broadcast(deal), "bundle").withColumn("block", F.pmod(chunk, F.col("blocks")).cast("int"))
    left = left.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).select("bundle", "block", "turn", "part", "v", "ids")
    right = routed.join(F.broadcast(deal), "bundle").withColumn("turn", F.pmod(chunk, F.col("turns")).cast("int"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("bundle", "block", "turn", "parts", "v", *keys)
    group = ["bundle", "block", "turn"]

    def rank(c: pa.Table, q: pa.Table) -> pa.Table:
        best: list[list[tuple[float, int]]] = [[] for _ in range(len(q))]
        if len(c) and len(q):
            x, own, ids = _matrix(c.column("v")), _matrix(q.column("v")), c.column("ids").to_pylist()
            part, lists = c.column("part").to_numpy(), q.column("parts").combine_chunks()
            asks, asked_part = np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
            for p in np.unique(part).tolist():
                there, who = np.flatnonzero(part == p), asks[asked_part == p]
                for i, (found, scores) in zip(who.tolist(), _best(own[who], x[there], [ids[j] for j in there.tolist()], more), strict=True):
                    best[i] += zip([-v for v in scores], found, strict=True)
        best = [sorted(pairs)[:more] for pairs in best]
        count = [len(pairs) for pairs in best]
        return pa.table({
            "key1": np.repeat(q.column("key1").to_numpy(), count), "key2": np.repeat(q.column("key2").to_numpy(), count),
            "vec_id": pa.array([i for pairs in best for _, i in pairs], pa.int64()), "score": pa.array([-v for pairs in best for v, _ in pairs], pa.float64()),
        })

    met = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(rank, "key1 bigint, key2 bigint, vec_id bigint, score double")
    best = top_k(met, keys, [F.col("score").desc(), F.col("vec_id").asc()], more, rank="at")
    lists = best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "vec_id", "score"))).alias("found"))
    mine = asked.select(F.col("id").alias("query_id"), *keys).join(lists, keys)
    # its own row goes, once; repeated ids are other rows
    own = F.array_position(F.transform("found", lambda f: f["vec_id"]), F.col("query_id"))
    others = F.slice(F.filter("found", lambda f, i: i + 1 != own), 1, how.k)
    out = mine.select("query_id", F.posexplode(others).alias("pos", "f"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))
