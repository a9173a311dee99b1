"""Vector code compression: product codes found through memoised grid cells.

Vectors become integers and are cut into ``PARTS`` equal parts; each part has a
codebook of at most ``ENTRIES`` entries.  A part's nearest entry is looked for
among a few only: the part lies in a cell of a coarse grid (cells of ``cell``
wide), and an entry whose smallest distance to the cell's box is above another
entry's largest distance to it can be nearest to no part in that cell.  The
entries that are left are kept in a memo by the cell's hash, and only they are
evaluated exactly.  Cells whose hash is another cell's (checked by coordinates)
are evaluated on every entry, so results do not depend on hashes.

A round is one pass over the written vectors: a task adds up the parts of each
entry and gives one row an entry; the rows are added up by entry.  Codebooks
(``ENTRIES`` vectors a vector length) go to every task.

Components are kept as doubles that hold integers.  Where a distance could
pass 2^53 the task computes in Python integers instead, so results are exact
whatever the components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
CELL = 512          # grid step, in scaled units
MEMO = 1 << 16      # cells a part keeps; a fuller memo starts anew (a matter of speed only)
_EXACT = 2.0 ** 53


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column without nulls, and where each row's begin and end."""
    ends = np.asarray(column.offsets)
    return column.values.to_numpy(zero_copy_only=False), ends


def scaled(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int, parts: int) -> DataFrame:
    """(id, label, width, v): floor(scale * x) of vectors that are whole and finite, filled up with zeros to a multiple of ``parts``."""
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, lists = batch.columns
            raw, ends = _lists(lists)
            with np.errstate(over="ignore", invalid="ignore"):
                raw = np.floor(raw.astype(np.float64) * scale)  # nulls within are NaN here
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(raw))])
            keep = np.flatnonzero(np.asarray(lists.is_valid()) & (bad[ends[1:]] == bad[ends[:-1]]))
            width = ends[1:][keep] - ends[:-1][keep]
            full = -(-width // parts) * parts
            out_ends = np.concatenate([[0], np.cumsum(full)])
            out = np.zeros(out_ends[-1])
            at = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            out[np.repeat(out_ends[:-1], width) + at] = raw[np.repeat(ends[:-1][keep], width) + at]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(keep)), labels.take(pa.array(keep)), pa.array(full.astype(np.int32)),
                 pa.ListArray.from_arrays(pa.array(out_ends.astype(np.int32)), pa.array(out + 0.0))], names=["id", "label", "width", "v"])

    picked = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    kinds = dict(picked.dtypes)
    return picked.mapInArrow(convert, f"id {kinds['id']}, label {kinds['label']}, width int, v array<double>")


def first_entries(rows: DataFrame, entries: int) -> dict[int, list[list[int]]]:
    """By vector length: the vectors of the smallest ids (null last; of rows with one id the smallest vector)."""
    ids = rows.select("width", "id").distinct()
    rank = F.row_number().over(Window.partitionBy("width").orderBy(F.col("id").asc_nulls_last()))
    few = ids.withColumn("rank", rank).where(F.col("rank") <= entries).select(F.col("width").alias("_w"), F.col("id").alias("_id"), "rank")
    found = rows.join(F.broadcast(few), (F.col("width") == F.col("_w")) & F.col("id").eqNullSafe(F.col("_id")))
    books: dict[int, list] = {}
    for r in found.groupBy("width", "rank").agg(F.min("v").alias("v")).orderBy("width", "rank").collect():  # ``entries`` rows a length
        books.setdefault(r.width, []).append([int(x) for x in r.v])
    return books


class Books:
    """The codebooks of one vector length (entries x components, Python integers) and the memos of their parts."""

    def __init__(self, entries: list[list[list[int]]], cell: int) -> None:
        self.entries, self.cell, self.parts = entries, cell, len(entries)  # entries[part][entry][component]
        self.largest = max((abs(x) for part in entries for e in part for x in e), default=0)
        self.exact = [np.array(part, dtype=object) for part in entries]
        self.rounded = [np.array(part, dtype=np.float64) for part in entries]
        self.memo: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for book in self.rounded:  # hashes (sorted), cells, candidates
            self.memo.append((np.zeros(0, np.uint64), np.zeros((0, book.shape[1])), np.zeros((0, len(book)), bool)))

    def _undominated(self, part: int, cells: np.ndarray) -> np.ndarray:
        """For each cell which entries may be nearest to a part in its box."""
        low = cells[:, None, :] * self.cell
        high = low + self.cell - 1  # components are integers
        e = self.rounded[part][None]
        near = (np.maximum(np.maximum(low - e, e - high), 0) ** 2).sum(axis=2)
        far = (np.maximum(np.abs(e - low), np.abs(e - high)) ** 2).sum(axis=2)
        return near <= far.min(axis=1, keepdims=True)

    def candidates(self, part: int, x: np.ndarray) -> np.ndarray:
        """Which entries to evaluate for each row of ``x``."""
        cells = np.floor(x / self.cell)
        h = np.full(len(x), 0x9E3779B97F4A7C15, np.uint64)
        for column in cells.T.astype(np.int64).astype(np.uint64):
            h = (h ^ column) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
        hashes, places, masks = self.memo[part]
        fresh, first = np.unique(h, return_index=True)
        new = ~np.isin(fresh, hashes, assume_unique=True)
        if new.any():
            if len(hashes) + new.sum() > MEMO:
                hashes, places, masks, new = hashes[:0], places[:0], masks[:0], np.ones(len(fresh), bool)
            added = cells[first[new]]
            hashes = np.concatenate([hashes, fresh[new]])
            order = np.argsort(hashes)
            hashes, places = hashes[order], np.concatenate([places, added])[order]
            masks = np.concatenate([masks, self._undominated(part, added)])[order]
            self.memo[part] = (hashes, places, masks)
        at = np.searchsorted(hashes, h)
        same = (places[at] == cells).all(axis=1)
        return masks[at] | ~same[:, None]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, error): the nearest entry of each part (ties to the lower index) and the squared distances summed over parts."""
        n, size = len(x), x.shape[1] // self.parts if self.parts else 0
        codes, exact = np.zeros((n, self.parts), np.uint8), _fits(x, self.largest)
        error = np.zeros(n, np.float64 if exact else object)
        for p in range(self.parts):
            own = x[:, p * size:(p + 1) * size]
            if exact:
                rows, entry = np.nonzero(self.candidates(p, own))
                d = ((own[rows] - self.rounded[p][entry]) ** 2).sum(axis=1)
                starts = np.searchsorted(rows, np.arange(n))
                best = np.minimum.reduceat(d, starts) if n else d
                hit = np.flatnonzero(d == best[rows])  # entries ascend within a row: the first hit is the lowest index
                codes[:, p] = entry[hit[np.searchsorted(rows[hit], np.arange(n))]]
                error += best
            else:
                for i, row in enumerate(own):
                    v = np.array([int(c) for c in row], dtype=object)
                    d = ((self.exact[p] - v) ** 2).sum(axis=1)
                    codes[i, p] = min(range(len(d)), key=d.__getitem__)
                    error[i] += d[codes[i, p]]
        return codes, error


def _fits(x: np.ndarray, largest: int) -> bool:
    """Whether squared distances of such rows, and sums over them, are exact in doubles."""
    most = float(np.abs(x).max(initial=0)) + float(largest)
    return most * most * max(1, x.shape[1]) < _EXACT and most * max(1, len(x)) < _EXACT


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """(rows of one vector length, that length, their matrix)."""
    for batch in batches:
        width = batch.column("width").to_numpy()
        for w in np.unique(width):
            at = np.flatnonzero(width == w)
            part = batch if len(at) == len(width) else batch.take(pa.array(at))
            raw, ends = _lists(part.column("v"))
            yield part, int(w), raw[ends[0]:ends[-1]].reshape(len(at), int(w))


def improved(spark: SparkSession, rows: DataFrame, books: dict[int, list], cell: int) -> dict[int, list]:
    """The codebooks of the next round: each used entry becomes its parts' componentwise floor(sum / count)."""
    shared = spark.sparkContext.broadcast(books)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {w: Books(b, cell) for w, b in shared.value.items()}
        sums: dict[tuple[int, int, int], tuple[int, np.ndarray]] = {}
        for _, w, x in _batches(batches):
            book = own[w]
            codes, _ = book.assign(x)
            size, exact = w // book.parts, _fits(x, 0)
            for p in range(book.parts):
                for e in np.unique(codes[:, p]).tolist():
                    mine = x[codes[:, p] == e, p * size:(p + 1) * size]
                    total = np.array([int(c) for c in mine.sum(axis=0)] if exact else [sum(map(int, c)) for c in mine.T], dtype=object)
                    count, so_far = sums.get((w, p, e), (0, 0))
                    sums[w, p, e] = count + len(mine), so_far + total
        keys = list(sums)
        yield pa.RecordBatch.from_arrays(
            [*[pa.array([k[j] for k in keys], pa.int32()) for j in range(3)], pa.array([sums[k][0] for k in keys], pa.int64()),
             pa.array([[str(v) for v in sums[k][1]] for k in keys], pa.list_(pa.string()))], names=["width", "part", "entry", "n", "sums"])

    def together(table: pa.Table) -> pa.Table:
        """An entry's sums over the tasks, a row each."""
        n = sum(table.column("n").to_pylist())
        total = [sum(map(int, c)) for c in zip(*table.column("sums").to_pylist())]
        return table.slice(0, 1).select(["width", "part", "entry"]).append_column("v", pa.array([[str(t // n) for t in total]], pa.list_(pa.string())))

    tasks = rows.select("width", "v").mapInArrow(add_up, "width int, part int, entry int, n bigint, sums array<string>")
    out = {w: [list(part) for part in b] for w, b in books.items()}
    for r in tasks.groupBy("width", "part", "entry").applyInArrow(together, "width int, part int, entry int, v array<string>").collect():
        out[r.width][r.part][r.entry] = [int(v) for v in r.v]  # one row an entry
    return out


def digest(book: list) -> str:
    """SHA-256 of all components, by part, entry, place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for part in book for e in part for x in e).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = SCALE,
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, cell: int = CELL) -> tuple[DataFrame, dict[int, list]]:
    """(vec_id, code, error, label_error, codebooks_sha256 of each kept row; codebooks by vector length).

    Rows whose vector is null or holds null or non-finite components are left
    out.  Repeated ids and null ids keep their rows; the codebooks start from
    the smallest distinct ids (null last; of one id the smallest vector), fewer
    than ``entries`` if there are fewer.  Vectors of different length have
    codebooks of their own; a length that ``parts`` does not divide is filled up
    with zeros; vectors without components have error 0.  A sum of squares
    beyond the range of a long is null (codes are right whatever the size).
    An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    small_batches(vectors)
    rows = materialize(scaled(vectors, id_col, vec_col, label_col, scale, parts), "scaled-vectors")
    books = {w: [[v[p * w // parts:(p + 1) * w // parts] for v in starts] for p in range(parts)] for w, starts in first_entries(rows, entries).items()}
    for _ in range(rounds if books else 0):
        books = improved(spark, rows, books, cell)
    shared = spark.sparkContext.broadcast((books, {w: digest(b) for w, b in books.items()}))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        final, names = shared.value
        own = {w: Books(b, cell) for w, b in final.items()}
        for part, w, x in _batches(batches):
            codes, error = own[w].assign(x)
            whole = [int(e) for e in error]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()),
                 pa.array([e if e < 1 << 63 else None for e in whole], pa.int64()), pa.array([names[w]] * len(codes), pa.string())],
                names=["id", "label", "code", "error", "codebooks_sha256"])

    kinds = dict(rows.dtypes)
    coded = rows.mapInArrow(encode, f"id {kinds['id']}, label {kinds['label']}, code string, error bigint, codebooks_sha256 string")
    coded = materialize(coded, "coded-vectors")
    # one row a label, joined back (a label may hold a third of all rows: AQE splits its side)
    total = F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(38,0)")))
    totals = coded.groupBy("label").agg(total.alias("total")).select(
        F.col("label").alias("_label"), F.when(F.col("total") <= (1 << 63) - 1, F.col("total")).cast("bigint").alias("label_error"))
    out = coded.join(totals, F.col("label").eqNullSafe(F.col("_label")))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256"), books
