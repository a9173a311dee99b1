"""Exact top-k inner-product search by dual-tree cover-tree search.

Vectors are dealt to the nearest of at most ``PIVOTS`` pivots (a bounded
sample), and each pivot's vectors into blocks of about ``BLOCK`` by a hash of
their id, so vectors that are all alike are dealt out too.  A block's vectors
and the queries that may have hits in it meet in one task, which builds a
cover tree over either side and descends both together: a pair of nodes is
dropped if the largest inner product that the two centres and covering radii
allow is below the worst kth score of the node's queries.

Queries first search one block of their own pivot.  Their kth score there
rules out whole pivots (by the pivot's covering radius) before anything is
sent.  Queries come in chunks of about ``CHUNK``; a task holds one block and
one chunk, whatever the size of the table.

Components are integers.  Their inner products are computed in doubles where
these are exact, else in Python integers (kept within a long).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import first_by_hash, materialize

PIVOTS = 128
BLOCK = 2048
CHUNK = 2048
LEAF = 64
BASE = 1.3       # covering radii shrink by this factor from level to level
SCALE = 1024
_SLACK = 1e-9    # relative rounding room of the bounds


class Node:
    """A cover-tree node: members within ``radius`` of ``center``; children cover the members at a smaller radius."""

    def __init__(self, x: np.ndarray, idx: np.ndarray, center: np.ndarray, dist: np.ndarray, leaf: int) -> None:
        self.idx, self.center = idx, center
        self.radius = float(dist.max(initial=0.0))
        self.norm = float(np.sqrt(center @ center))
        self.children: list[Node] = []
        if len(idx) > leaf and self.radius > 0:
            groups, rest, at = [], idx, center
            while len(rest):
                if len(groups) * 8 > len(idx):
                    return  # the points do not cluster at this scale: one flat leaf
                d = np.sqrt(((x[rest] - at) ** 2).sum(axis=1))
                near = d <= self.radius / BASE
                if near.any():
                    groups.append((rest[near], at, d[near]))
                rest = rest[~near]
                if len(rest):
                    at = x[rest[0]]
            self.children = [Node(x, i, c, d, leaf) for i, c, d in groups]
            self.centers = np.array([c.center for c in self.children])
            self.radii = np.array([c.radius for c in self.children])
            self.norms = np.array([c.norm for c in self.children])


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> Node:
    center = x[0]
    return Node(x, np.arange(len(x)), center, np.sqrt(((x - center) ** 2).sum(axis=1)), leaf)


def _reach(dot, norm_a, radius_a, norm_b, radius_b):
    """The largest inner product of a vector within radius_a of a centre and one within radius_b of another."""
    top = dot + norm_a * radius_b + norm_b * radius_a + radius_a * radius_b
    return top + _SLACK * (np.abs(dot) + (norm_a + radius_a) * (norm_b + radius_b) + 1)


class Best:
    """The k best (score, smaller id) of each query so far; ``floor`` is a score that k vectors are known to reach."""

    def __init__(self, query_ids: np.ndarray, floor: np.ndarray, k: int) -> None:
        self.query_ids, self.k = query_ids, k
        self.score = np.full((len(query_ids), k), -np.inf)
        self.ids = np.zeros((len(query_ids), k), dtype=np.int64)
        self.floor = floor.copy()

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.where(self.query_ids[rows][:, None] == ids[None, :], -np.inf, scores)
        live = (scores >= self.floor[rows][:, None]).any(axis=1) & np.isfinite(scores).any(axis=1)
        if not live.any():
            return
        rows, scores = rows[live], scores[live]
        every = np.concatenate([self.score[rows], scores], axis=1)
        all_ids = np.concatenate([self.ids[rows], np.broadcast_to(ids, scores.shape)], axis=1)
        kth = np.partition(every, -self.k, axis=1)[:, -self.k]
        r, c = np.nonzero((every >= np.maximum(kth, self.floor[rows])[:, None]) & np.isfinite(every))
        s, i = every[r, c], all_ids[r, c]
        order = np.lexsort((i, -s, r))
        r, s, i = r[order], s[order], i[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        top = place < self.k
        self.score[rows], self.ids[rows] = -np.inf, 0
        self.score[rows[r[top]], place[top]] = s[top]
        self.ids[rows[r[top]], place[top]] = i[top]
        self.floor[rows] = np.maximum(self.floor[rows], self.score[rows, -1])


def dual_search(queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int,
                leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact k best rows of ``data`` for each query (integer arrays): query ids, ids, scores.

    Scores under a query's ``floor`` may be left out.
    """
    best = Best(query_ids, floor, k)
    width = max(1, queries.shape[1])
    largest = float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(data.astype(float)).max(initial=0)) * width
    if largest >= 2.0 ** 52:  # not exact in doubles: plain integers
        found = []
        for own, q in zip(query_ids.tolist(), queries.tolist()):
            scores = ((min((1 << 63) - 1, max(-(1 << 63), sum(map(mul, q, x)))), i) for i, x in zip(ids.tolist(), data.tolist()) if i != own)
            found += [(own, i, s) for s, i in heapq.nsmallest(k, scores, key=lambda p: (-p[0], p[1]))]
        return tuple(np.array(found, dtype=np.int64).reshape(-1, 3).T)
    if not len(queries) or not len(data):
        return (np.zeros(0, np.int64),) * 3
    q, x = queries.astype(np.float64), data.astype(np.float64)
    qt, xt = cover_tree(q, leaf), cover_tree(x, leaf)
    heap, n = [(0.0, 0, qt, xt)], 0
    while heap:
        bound, _, a, b = heapq.heappop(heap)
        worst = best.floor[a.idx].min()
        if n and -bound < worst:
            continue
        if a.children and (a.radius >= b.radius or not b.children):
            reach = _reach(a.centers @ b.center, a.norms, a.radii, b.norm, b.radius)
            pairs = [(child, b, r) for child, r in zip(a.children, reach)]
        elif b.children:
            reach = _reach(b.centers @ a.center, b.norms, b.radii, a.norm, a.radius)
            live = [(child, r) for child, r in zip(b.children, reach) if r >= worst]
            flat = [child.idx for child, r in live if not child.children]
            if flat and not a.children:  # leaves of one parent together
                at = np.concatenate(flat)
                best.add(a.idx, q[a.idx] @ x[at].T, ids[at])
                live = [(child, r) for child, r in live if child.children]
            pairs = [(a, child, r) for child, r in live]
        else:
            best.add(a.idx, q[a.idx] @ x[b.idx].T, ids[b.idx])
            pairs = []
        for a2, b2, r in pairs:
            n += 1
            heapq.heappush(heap, (-r, n, a2, b2))
        n += 1
    r, c = np.nonzero(np.isfinite(best.score))
    return query_ids[r], best.ids[r, c], best.score[r, c].astype(np.int64)


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v): one vector an id (of several the smallest), components floor(scale * x); null ids and null or non-finite vectors are left out."""
    fine = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    one = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & fine).groupBy(F.col(id_col).cast("bigint").alias("id")) \
        .agg(F.min(vec_col).alias("v"))
    return one.select("id", F.transform("v", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))


def _matrix(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i8").reshape(len(column), width)


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
           pivots: int = PIVOTS, block: int = BLOCK, chunk: int = CHUNK, leaf: int = LEAF) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products, ties to the smaller id.

    ``is_query`` picks queries by ``id_col``; every other id is a candidate.
    Vectors of different length never match; a vector without components
    scores 0 with its like.  A query without candidates has no rows, and an
    empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ints = materialize(integer_vectors(vectors, id_col, vec_col), "vectors")
    picked = first_by_hash(ints, pivots, 0, "id").collect()
    centers: dict[int, np.ndarray] = {}
    for r in picked:
        centers.setdefault(len(r.v), []).append(r.v)  # type: ignore[arg-type]
    names: dict[int, list[int]] = {}
    n = 0
    for width, rows in centers.items():
        names[width] = list(range(n, n + len(rows)))
        n += len(rows)
        centers[width] = np.array(rows, dtype=np.float64).reshape(len(rows), width)
    shared = spark.sparkContext.broadcast((centers, names))  # at most PIVOTS vectors

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, named = shared.value
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            raw, ends = lists.flatten().to_numpy().astype("<i8"), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            width = np.diff(ends)
            pid, dist = np.zeros(len(ids), np.int64), np.zeros(len(ids))
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                x = raw[ends[at][:, None] + np.arange(w)].astype(float)
                if int(w) in found:
                    c = found[int(w)]
                    near = np.argmin((c ** 2).sum(axis=1)[None, :] - 2 * x @ c.T, axis=1)
                    pid[at], dist[at] = np.array(named[int(w)])[near], np.sqrt(((x - c[near]) ** 2).sum(axis=1))
                else:  # no pivot of this length: a centre of zeros
                    pid[at], dist[at] = -1 - w, np.sqrt((x ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(width.astype(np.int32)), pa.array(pid), pa.array(dist),
                 pa.array([raw[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())],
                names=["id", "width", "pid", "dist", "v"])

    dealt = materialize(ints.mapInArrow(deal, "id bigint, width int, pid bigint, dist double, v binary"), "dealt-vectors")
    about = materialize(dealt.groupBy("pid").agg(F.max("dist").alias("radius"), F.ceil(F.count("*") / block).cast("int").alias("blocks")), "pivots")
    radius = {r.pid: r.radius for r in about.where("pid >= 0").select("pid", "radius").collect()}  # at most PIVOTS rows
    is_q = dealt.withColumnRenamed("id", id_col).where(is_query).withColumnRenamed(id_col, "id")
    chunks = max(1, -(-is_q.count() // chunk))
    data = materialize(dealt.join(about.select("pid", "blocks"), "pid")
                       .select("pid", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("part"), "width", "id", "v"), "blocks")
    queries = is_q.select("pid", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(chunks)).cast("int").alias("chunk"), "width", "id", "v")

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        width = key[3].as_py()
        data_ids, query_ids = left.column("id").to_numpy(), right.column("id").to_numpy()
        found = dual_search(_matrix(right.column("v"), width), query_ids, right.column("floor").to_numpy(),
                            _matrix(left.column("v"), width), data_ids, k, leaf)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found)))

    def run(data: DataFrame, queries: DataFrame) -> DataFrame:
        """Dual searches of queries (with part and floor) in the blocks they name."""
        by = ["pid", "part", "chunk", "width"]
        left = data.join(queries.select(*by).distinct().toDF(*by), ["pid", "part", "width"])  # a block goes only to chunks that aim at it
        return (left.groupBy(*by).cogroup(queries.groupBy(*by))
                .applyInArrow(meet, "query_id bigint, vec_id bigint, score bigint"))

    # first one block of the query's own pivot
    own = run(data.where("part = 0"), queries.withColumn("part", F.lit(0)).withColumn("floor", F.lit(float("-inf"))))
    floors = own.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("floor")).where(F.col("n") >= k)
    ready = materialize(queries.join(floors.select(F.col("query_id").alias("id"), "floor"), "id", "left")
                        .withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))), "queries")

    shared_radius = spark.sparkContext.broadcast(radius)

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and pivot whose radius allows a hit."""
        found, named = shared.value
        for batch in batches:
            rows, to = [], []
            for i, (width, v, floor) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("width", "v", "floor")))):
                if width in found:
                    q, c = np.frombuffer(v, dtype="<i8").astype(float), found[width]
                    r = np.array([shared_radius.value.get(p, -1.0) for p in named[width]])
                    top = _reach(c @ q, np.sqrt((c ** 2).sum(axis=1)), np.maximum(r, 0), np.sqrt(q @ q), 0.0)
                    go = [p for p, t, x in zip(named[width], top, r) if x >= 0 and t >= floor]
                else:
                    go = [-1 - width]
                rows += [i] * len(go)
                to += go
            out = batch.select(["chunk", "width", "id", "v", "floor"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), *out.columns], names=["pid", "chunk", "width", "id", "v", "floor"])

    aimed = ready.mapInArrow(aim, "pid bigint, chunk int, width int, id bigint, v binary, floor double")
    spread = aimed.join(about.select("pid", "blocks"), "pid").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    hits = run(data, spread.drop("blocks"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (hits.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
