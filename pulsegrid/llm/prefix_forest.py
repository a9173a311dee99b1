"""Approximate nearest neighbours by a forest of hash prefixes.

Every tree gives a vector a string of ``BITS`` hash bits (signs of seeded
random projections, of the vector with one more component that makes all
norms equal, so angles order as inner products do).  A tree is the sorted array
of its strings.  A query descends to its longest common prefix in every tree;
then all its trees ascend together, a bit at a time, until the prefixes of that
length hold ``need`` entries.  Everything under them is a candidate, and the
candidates' exact inner products decide.

* The first ``TOP`` levels are counted for every tree: at most
  ``TREES * 2 ** TOP`` numbers, which tell how far most queries ascend.  A query
  whose prefixes are still too full there goes into the sorted arrays below and
  counts on.
* ``need`` is found on the table itself: ``SAMPLE`` queries (of each vector
  length) are searched exactly in one pass, which also counts their prefixes;
  ``need`` is the least that gives them a recall of ``RECALL``.
* A tree's array is cut at prefixes into pieces of at most ``BLOCK`` entries; a
  fuller prefix at level ``TOP`` is dealt into parts by a hash of the id, each a
  sorted array of its own, and its queries go to all parts.  A task holds a
  piece and at most about ``CHUNK`` queries; pieces go only to chunks that ask.
* Rows with equal vectors are one entry with their k + 1 smallest ids.  No other
  copy can be among a query's k nearest (k smaller ids have the same score), so
  this leaves out nothing; equal query vectors are searched once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.topk import top_n
from .common import first_by_hash, materialize, small_batches

TREES = 16
BITS = 48
TOP = 12
BLOCK = 4096
CHUNK = 1024
SAMPLE = 64
RECALL = 0.96
SEED = 11


class Shape(NamedTuple):
    """What all tasks share about the vectors of one length: the largest component, and the largest norm in units of it."""
    unit: float
    norm: float


def planes(width: int, trees: int, seed: int = SEED) -> np.ndarray:
    """Projections of one vector length (a column a bit of a tree), in orthogonal groups."""
    rng = np.random.default_rng([seed, width])
    n, size = trees * BITS, width + 1
    groups = [np.linalg.qr(rng.standard_normal((size, size)))[0] for _ in range(-(-n // size))]
    return np.concatenate(groups, axis=1)[:, :n]


def strings(x: np.ndarray, shape: Shape, sides: np.ndarray, is_query: bool) -> np.ndarray:
    """Hash strings (rows x trees) as integers, first bit on top.  Queries count by direction only."""
    y = x / shape.unit
    norm = np.sqrt((y ** 2).sum(axis=1))
    if is_query:
        y, last = y / np.maximum(norm, 1e-300)[:, None], np.zeros(len(y))
    else:
        y, last = y / shape.norm, np.sqrt(np.maximum(0.0, 1.0 - (norm / shape.norm) ** 2))
    bits = (y @ sides[:-1] + last[:, None] * sides[-1]) > 0
    return bits.reshape(len(x), -1, BITS) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The length of the common prefix of two strings."""
    return BITS - np.frexp((a ^ b).astype(np.float64))[1]


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in doubles, summed in component order; NaN (infinities that cancel) counts as the lowest."""
    total = np.zeros(len(q))
    with np.errstate(over="ignore", invalid="ignore"):
        for j in range(q.shape[1]):
            total += q[:, j] * x[:, j]
    return np.where(np.isnan(total), -np.inf, total)


def near_best(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) pairs that hold every row's k best columns: a fast product with room for its rounding."""
    with np.errstate(over="ignore", invalid="ignore"):
        fast = q @ x.T
        room = 1e-14 * q.shape[1] * np.abs(q).max(axis=1, initial=0) * np.abs(x).max(initial=0)
    sure = np.isfinite(fast).all(axis=1) & np.isfinite(room)
    floor = np.partition(fast, -k, axis=1)[:, -k] if k < len(x) else np.full(len(q), -np.inf)
    with np.errstate(invalid="ignore"):
        return np.nonzero((fast >= (floor - room)[:, None]) | ~sure[:, None])


def best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k highest scores (ties to the smaller id), by query and rank; repeated ids count once."""
    order = np.lexsort((ids, -score, query))
    q, i = query[order], ids[order]
    fresh = np.concatenate([[True], (q[1:] != q[:-1]) | (i[1:] != i[:-1])]) if len(q) else np.zeros(0, bool)  # a copy has its twin's score
    order, q = order[fresh], q[fresh]
    return order[np.arange(len(q)) - np.searchsorted(q, q) < k]


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(column) == 0:
        return np.zeros((0, 0))
    ends = np.asarray(column.offsets)
    return column.values.to_numpy()[ends[0]:ends[-1]].astype(np.float64).reshape(len(column), -1)


def _by_width(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        width = batch.column("width").to_numpy()
        for w in np.unique(width).tolist():
            yield w, batch if (width == w).all() else batch.filter(pa.array(width == w))


def prepared(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, width, v): one vector an id (of several the smallest); null ids and null, zero, non-finite vectors are left out."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("v")).where("id IS NOT NULL AND v IS NOT NULL").where(fine)
    return rows.groupBy("id").agg(F.min("v").alias("v")).select("id", F.size("v").alias("width"), "v")


def _shapes(rows: DataFrame) -> dict[int, Shape]:
    """One row a vector length."""
    largest = F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))
    units = {r.width: r.unit for r in rows.groupBy("width").agg(F.max(largest).alias("unit")).collect()}
    unit = F.element_at(F.create_map(*[F.lit(c) for w, u in units.items() for c in (w, u)]), F.col("width")) if units else F.lit(1.0)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(x.cast("double") / unit, 2))
    return {r.width: Shape(units[r.width], float(np.sqrt(r.s)) * (1 + 1e-12))
            for r in rows.groupBy("width").agg(F.max(square).alias("s")).collect()}


def _hashed(rows: DataFrame, shapes, trees: int, is_query: bool) -> DataFrame:
    """``rows`` with their hash strings."""
    kind = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = {}
        for w, batch in _by_width(batches):
            if w not in sides:
                sides[w] = planes(w, trees)
            h = strings(_matrix(batch.column("v")), shapes.value[w], sides[w], is_query)
            yield batch.append_column("hs", pa.ListArray.from_arrays(np.arange(len(h) + 1, dtype=np.int32) * trees, pa.array(h.ravel())))

    return rows.mapInArrow(run, ", ".join(f"{c} {kind[c]}" for c in rows.columns) + ", hs array<bigint>")


def _fit(index: DataFrame, sample: list, k: int, trees: int, recall: float) -> dict[int, int]:
    """``need`` by vector length: the entries that the prefixes must hold for the sample's recall to reach ``recall``."""
    by = {}
    for r in sample:
        by.setdefault(r.width, []).append(r)
    packed = {w: (np.array([r.id for r in rs]), np.array([r.v for r in rs], dtype=np.float64), np.array([r.hs for r in rs], dtype=np.int64)) for w, rs in by.items()}
    shared = index.sparkSession.sparkContext.broadcast(packed)  # at most SAMPLE vectors a length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, tops = {}, {}
        for w, batch in _by_width(batches):
            if w not in shared.value:
                continue
            own, q, qh = shared.value[w]
            ids, x = batch.column("id").to_numpy(), _matrix(batch.column("v"))
            h = _matrix_of_longs(batch.column("hs"), trees)
            for j in range(len(own)):
                level = shared_bits(h, qh[j][None])
                counts[w, j] = counts.get((w, j), 0) + np.bincount(level.ravel().astype(np.int64), minlength=BITS + 1)
                deepest, scores = level.max(axis=1), np.where(ids == own[j], -np.inf, q[j] @ x.T)
                old = tops.get((w, j), (np.zeros(0), np.zeros(0, np.int64)))
                scores, deepest = np.concatenate([old[0], scores]), np.concatenate([old[1], deepest])
                top = np.argsort(-scores, kind="stable")[:k]
                top = top[np.isfinite(scores[top])]
                tops[w, j] = scores[top], deepest[top]
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
             pa.array([counts[k].tolist() for k in keys], pa.list_(pa.int64())), pa.array([tops[k][0].tolist() for k in keys], pa.list_(pa.float64())),
             pa.array([tops[k][1].tolist() for k in keys], pa.list_(pa.int32()))], names=["width", "q", "counts", "scores", "levels"])

    def together(table: pa.Table) -> pa.Table:
        """A sample query's figures over the tasks, a row each."""
        counts = np.sum(table.column("counts").to_pylist(), axis=0)
        scores, levels = (np.concatenate([np.zeros(0), *map(np.array, table.column(c).to_pylist())]) for c in ("scores", "levels"))
        top = np.argsort(-scores, kind="stable")[:k]
        return pa.table({"width": table.column("width").slice(0, 1), "counts": pa.array([counts.tolist()], pa.list_(pa.int64())),
                         "levels": pa.array([levels[top].astype(int).tolist()], pa.list_(pa.int32()))})

    seen = (index.mapInArrow(run, "width int, q int, counts array<bigint>, scores array<double>, levels array<int>")
            .groupBy("width", "q").applyInArrow(together, "width int, counts array<bigint>, levels array<int>").collect())
    out = {}
    for w in by:
        own = [(np.cumsum(r.counts[::-1])[::-1], np.array(r.levels)) for r in seen if r.width == w]  # entries under each prefix length
        own = [(c, levels) for c, levels in own if len(levels)]
        tries = np.unique(np.concatenate([c for c, _ in own])) if own else np.zeros(0, int)
        low, high = 0, len(tries) - 1
        while low < high:
            mid = (low + high) // 2
            found = np.mean([(levels >= _ascend(c, tries[mid])).mean() for c, levels in own])
            low, high = (low, mid) if found >= recall else (mid + 1, high)
        # (k + 1) entries a tree mean that some tree has k + 1 different ones
        out[w] = max(int(tries[low]) if len(tries) else 0, (k + 1) * trees)
    return out


def _ascend(counts: np.ndarray, need: int) -> int:
    """The longest prefix length whose entries reach ``need`` (0 if none does)."""
    enough = np.flatnonzero(counts >= need)
    return int(enough[-1]) if len(enough) else 0


def _matrix_of_longs(column, trees: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.asarray(column.offsets)
    return column.values.to_numpy()[ends[0]:ends[-1]].reshape(len(column), trees)


class Pieces(NamedTuple):
    """One tree: entries of each prefix at the levels 0 to TOP; for each prefix of length TOP its piece (first prefix), its depth, its parts."""
    levels: list[np.ndarray]
    piece: np.ndarray
    depth: np.ndarray
    parts: np.ndarray


def cut(counts: np.ndarray, block: int, top: int) -> Pieces:
    """Pieces: the shortest prefixes with at most ``block`` entries; at level ``top`` in parts if there are more."""
    levels = [counts]
    while len(levels[0]) > 1:
        levels.insert(0, levels[0].reshape(-1, 2).sum(axis=1))
    piece, depth, parts = (np.zeros(1 << top, np.int64) for _ in range(3))
    open_ = [(0, 0)]
    while open_:
        d, p = open_.pop()
        n = int(levels[d][p])
        if n <= block or d == top:
            at = slice(p << (top - d), (p + 1) << (top - d))
            piece[at], depth[at], parts[at] = at.start, d, max(1, -(-n // block))
        else:
            open_ += [(d + 1, 2 * p), (d + 1, 2 * p + 1)]
    return Pieces(levels, piece, depth, parts)


def _mix(ids: np.ndarray) -> np.ndarray:
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(31))


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = TREES, top: int = TOP,
           block: int = BLOCK, chunk: int = CHUNK, sample: int = SAMPLE, recall: float = RECALL, need: dict[int, int] | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query, by inner product in doubles, ties to the smaller id.

    ``is_query`` picks queries by ``id_col``; every other id is a candidate.
    Rows that repeat an id are one (the smallest vector); null ids, and vectors
    null, zero or with null or non-finite components, take no part.  Vectors of
    different length never match.  A query has fewer than k rows only if there
    are fewer candidates; an empty table gives an empty result.  ``need`` (by
    vector length) sets by hand how many entries the ascent must meet.
    """
    spark = vectors.sparkSession
    small_batches(vectors)
    rows = materialize(prepared(vectors, id_col, vec_col), "vectors")
    asking = rows.withColumnRenamed("id", id_col).where(is_query).withColumnRenamed(id_col, "id")
    asked = materialize(asking.groupBy("width", "v").agg(F.min("id").alias("id")), "query-vectors")
    members = materialize(asking.select("id", "v").alias("a").join(asked.select("v", F.col("id").alias("qid")).alias("b"), F.col("a.v") == F.col("b.v"))
                          .select("a.id", "qid"), "query-members")
    shapes = spark.sparkContext.broadcast(_shapes(rows))
    copies = top_n(rows, ["width", "v"], [F.col("id").asc()], k + 1)
    entries = copies.groupBy("width", "v").agg(F.min("id").alias("id"), F.array_sort(F.collect_list("id")).alias("ids"))  # k + 1 rows a group at most
    index = materialize(_hashed(entries, shapes, trees, False), "forest")
    queries = materialize(_hashed(asked, shapes, trees, True), "hashed-queries")

    # the counted top of the trees, and how far to ascend
    cells = index.select("width", F.posexplode("hs").alias("tree", "h")).groupBy("width", "tree", F.shiftright("h", BITS - top).alias("cell"))
    counted: dict[tuple[int, int], np.ndarray] = {}
    for r in cells.count().toLocalIterator():  # at most trees * 2 ** top rows a vector length
        counted.setdefault((r.width, r.tree), np.zeros(1 << top, np.int64))[r.cell] = r["count"]
    forest = spark.sparkContext.broadcast({key: cut(c, block, top) for key, c in counted.items()})
    if need is None:
        picked = [r for w in shapes.value for r in first_by_hash(queries.where(F.col("width") == w), sample, SEED, "id").collect()]
        need = _fit(index, picked, k, trees, recall)

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query's prefix length by the counted top (``top`` if it may have to be longer)."""
        for w, batch in _by_width(batches):
            h = _matrix_of_longs(batch.column("hs"), trees)
            held = [sum(forest.value[w, t].levels[d][h[:, t] >> (BITS - d)] for t in range(trees)) if (w, 0) in forest.value else np.zeros(len(h)) for d in range(top + 1)]
            enough = np.array(held) >= need.get(w, 0)
            at = np.where(enough.any(axis=0), top - np.argmax(enough[::-1], axis=0), 0)
            yield batch.append_column("level", pa.array(at.astype(np.int32)))

    kind = dict(queries.dtypes)
    shape = ", ".join(f"{c} {kind[c]}" for c in queries.columns)
    leveled = materialize(queries.mapInArrow(level, shape + ", level int"), "leveled-queries")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each piece that holds entries under the query's prefix in a tree."""
        for w, batch in _by_width(batches):
            h, deep = _matrix_of_longs(batch.column("hs"), trees), batch.column("level").to_numpy()
            out = [[], [], [], [], []]
            for t in range(trees):
                plan = forest.value.get((w, t))
                if plan is None:
                    continue
                for j in range(len(h)):
                    d = min(top, int(deep[j]))
                    first = int(h[j, t] >> (BITS - d)) << (top - d)
                    span = np.unique(plan.piece[first:first + (1 << (top - d))])
                    span = span[[plan.levels[plan.depth[p]][p >> (top - plan.depth[p])] > 0 for p in span]]
                    for p in span.tolist():
                        for part in range(int(plan.parts[p])):
                            for column, v in zip(out, (j, t, p, part, h[j, t])):
                                column.append(v)
            src = batch.take(pa.array(out[0], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [src.column("width"), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32()),
                 src.column("id"), pa.array(out[4], pa.int64()), src.column("level"), src.column("v")],
                names=["width", "tree", "piece", "part", "id", "h", "level", "v"])

    place = "width int, tree int, piece int, part int"

    def routed(some: DataFrame, name: str) -> DataFrame:
        return materialize(some.select("width", "id", "hs", "level", "v").mapInArrow(route, f"{place}, id bigint, h bigint, level int, v {kind['v']}"), name)

    def entries_for(to: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(entries of the pieces that ``to`` asks, dealt to its chunks; ``to`` with its chunk)."""
        asks = to.groupBy("width", "tree", "piece").agg(F.count("*").alias("n"))
        chunks = {(r.width, r.tree, r.piece): r.n for r in asks.toLocalIterator()}  # at most a row a piece
        for key in chunks:
            chunks[key] = -(-chunks[key] // (chunk * int(forest.value[key[:2]].parts[key[2]])))
        wanted = spark.sparkContext.broadcast(chunks)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for w, batch in _by_width(batches):
                h, spread = _matrix_of_longs(batch.column("hs"), trees), _mix(batch.column("id").to_numpy())
                for t in range(trees):
                    plan, cell = forest.value[w, t], h[:, t] >> (BITS - top)
                    piece = plan.piece[cell]
                    part = (spread % plan.parts[cell].astype(np.uint64)).astype(np.int32)
                    many = np.array([wanted.value.get((w, t, p), 0) for p in piece.tolist()], dtype=np.int64)
                    at = np.repeat(np.arange(len(h)), many)
                    src = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays(
                        [src.column("width"), pa.array(np.full(len(at), t, np.int32)), pa.array(piece[at].astype(np.int32)), pa.array(part[at]),
                         pa.array((np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)).astype(np.int32)),
                         pa.array(h[at, t]), src.column("ids"), src.column("v")],
                        names=["width", "tree", "piece", "part", "chunk", "h", "ids", "v"])

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = zip(*(batch.column(c).to_pylist() for c in ("width", "tree", "piece")))
                many = np.array([wanted.value[key] for key in keys], dtype=np.uint64)
                mine = (_mix(batch.column("id").to_numpy() + 1) % np.maximum(many, 1)).astype(np.int32)
                yield batch.append_column("chunk", pa.array(mine))

        data = index.select("width", "id", "ids", "v", "hs").mapInArrow(deal, f"{place}, chunk int, h bigint, ids array<bigint>, v {kind['v']}")
        return data, to.mapInArrow(number, f"{place}, id bigint, h bigint, level int, v {kind['v']}, chunk int")

    by = ["width", "tree", "piece", "part", "chunk"]

    def bounds(sorted_h: np.ndarray, h: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the strings with the same prefix begin and end."""
        shift = BITS - length
        first = (h >> shift) << shift
        return np.searchsorted(sorted_h, first), np.searchsorted(sorted_h, first + (np.int64(1) << shift))

    def count_on(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """Entries under longer prefixes than ``top``."""
        own, h, lengths = np.sort(left.column("h").to_numpy()), right.column("h").to_numpy(), np.arange(top + 1, BITS + 1)
        lo, hi = bounds(own, h[:, None], lengths[None, :])
        return pa.table({"id": right.column("id"), "counts": pa.array((hi - lo).tolist(), pa.list_(pa.int64()))})

    full = leveled.where(F.col("level") == top)
    if full.isEmpty():
        ready = leveled
    else:
        data, to = entries_for(routed(full, "deep-queries"))
        inner = data.groupBy(*by).cogroup(to.groupBy(*by)).applyInArrow(count_on, "id bigint, counts array<bigint>")
        sums = inner.select("id", F.posexplode("counts").alias("at", "n")).groupBy("id", "at").agg(F.sum("n").alias("n"))
        wanted_by = F.element_at(F.create_map(*[F.lit(c) for w, n in need.items() for c in (w, n)]), F.col("width"))
        deeper = (sums.join(full.select("id", "width"), "id").where(F.col("n") >= wanted_by).groupBy("id").agg((F.max("at") + top + 1).cast("int").alias("deep")))
        ready = leveled.join(deeper, "id", "left").withColumn("level", F.coalesce("deep", "level"))

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        h = left.column("h").to_numpy()
        order = np.argsort(h, kind="stable")
        own, x, ids = h[order], _matrix(left.column("v"))[order], left.column("ids").combine_chunks()
        id_ends, id_values = np.asarray(ids.offsets), ids.values.to_numpy()
        q, qid = _matrix(right.column("v")), right.column("id").to_numpy()
        lo, hi = bounds(own, right.column("h").to_numpy(), right.column("level").to_numpy().astype(np.int64))
        got = []
        for a, b in sorted(set(zip(lo.tolist(), hi.tolist()))):
            if a < b:  # queries that share a prefix search its range together
                mine = np.flatnonzero((lo == a) & (hi == b))
                r, c = near_best(q[mine], x[a:b], k + 1)
                got.append((mine[r], a + c))
        if not got:
            return pa.table({"qid": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "scores": pa.array([], pa.list_(pa.float64()))})
        r, c = (np.concatenate(z) for z in zip(*got))
        score, entry = exact_scores(q[r], x[c]), order[c]
        many = id_ends[entry + 1] - id_ends[entry]  # every id of an entry has its score
        at = np.repeat(id_ends[entry], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        r, score, vec = np.repeat(r, many), np.repeat(score, many), id_values[at]
        kept = best(r, vec, score, k + 1)
        rows, starts = np.unique(r[kept], return_index=True)
        ends = pa.array(np.append(starts, len(kept)).astype(np.int32))
        return pa.table({"qid": qid[rows], "ids": pa.ListArray.from_arrays(ends, pa.array(vec[kept])),
                         "scores": pa.ListArray.from_arrays(ends, pa.array(score[kept]))})

    def merge(table: pa.Table) -> pa.Table:
        """The k + 1 best of what a query's pieces gave."""
        vec, score = (np.concatenate([np.asarray(c.flatten()) for c in table.column(name).chunks]) for name in ("ids", "scores"))
        kept = best(np.zeros(len(vec), np.int64), vec, score, k + 1)
        return pa.table({"qid": table.column("qid").slice(0, 1), "hits": pa.array(
            [[{"vec_id": int(i), "score": float(s)} for i, s in zip(vec[kept], score[kept])]], pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())])))})

    data, to = entries_for(routed(ready, "routed-queries"))
    hits = data.groupBy(*by).cogroup(to.groupBy(*by)).applyInArrow(meet, "qid bigint, ids array<bigint>, scores array<double>")
    merged = materialize(hits.groupBy("qid").applyInArrow(merge, "qid bigint, hits array<struct<vec_id:bigint,score:double>>"), "merged-hits")
    found = members.join(merged, "qid").withColumn("hits", F.slice(F.filter("hits", lambda x: x["vec_id"] != F.col("id")), 1, k))
    return found.select(F.col("id").alias("query_id"), F.posexplode("hits").alias("pos", "hit")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), "hit.vec_id", "hit.score")
