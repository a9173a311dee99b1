"""Texts dealt into chunks of ascending ids, and keys exchanged between chunks.

A chunk is about ``CHUNK_BYTES`` of whole texts with neighbouring ids, held as
compressed blobs and written once to the shared folder, bucketed by chunk, so
that later passes over the chunks shuffle no text.

Chunks ask each other about keys (hashes): a chunk sends its distinct sorted
keys, packed, to buckets; a bucket compares the keys of all chunks and answers
each chunk with one bit a key.  A key that a third of all rows share is one
entry a chunk.  Chunk numbers follow the ids, so "held by an earlier chunk" means
by a smaller id.  Rows that share an id, or have none, are dealt over chunks of
their own in the order of their text once they pass a chunk's size; these chunks
are one group (``group_of``) where rows of one id count as one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucketed, load_order, materialize, small_batches, text_or_empty

CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 256 << 20  # about so much text in a bucket of the written chunks
MAX_BUCKETS = 100_000     # Spark's own bound (spark.sql.sources.bucketing.maxBuckets)
_LAST = (1 << 63) - 1


class Chunked:
    """``frame``: chunk, ids, lens, blob; ``bits``: of a key's first bits, how many name its bucket."""

    def __init__(self, frame: DataFrame, chunks: int, shared_ids: np.ndarray) -> None:
        self.frame, self.chunks, self.shared_ids = frame, chunks, shared_ids
        self.bits = min(20, max(0, (chunks - 1).bit_length()))

    def emit(self, fn: Callable, schema: str, answers: DataFrame | None = None) -> DataFrame:
        """``fn(chunk, texts, answers by kind and bucket)`` for every chunk."""
        if answers is None:
            return self.frame.groupBy("chunk").applyInArrow(lambda key, t: fn(key[0].as_py(), Texts(t), {}), schema)
        return (self.frame.groupBy("chunk").cogroup(answers.groupBy("chunk"))
                .applyInArrow(lambda key, t, a: fn(key[0].as_py(), Texts(t), _by_bucket(a)), schema))


class Texts:
    """The documents of one chunk by ascending id: ``ids`` (the largest long: none), ``texts`` (bytes)."""

    def __init__(self, table: pa.Table) -> None:
        pairs = []
        unpack = zstandard.ZstdDecompressor().decompress
        for ids, lens, blob in zip(*(table.column(c).to_pylist() for c in ("ids", "lens", "blob"))):
            data, at = unpack(blob), 0
            for i, n in zip(np.frombuffer(ids, "<i8").tolist(), np.frombuffer(lens, "<i8").tolist()):
                pairs.append((i, data[at:at + n]))
                at += n
        pairs.sort()
        self.ids = np.array([p[0] for p in pairs], dtype=np.int64)
        self.texts = [p[1] for p in pairs]

    def id_column(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.ids == _LAST)


def _by_bucket(table: pa.Table) -> dict:
    return {(k, b): bits for k, b, bits in zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "bits")))}


def deal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> Chunked:
    """Deal all rows into chunks of neighbouring integer ids (null ids last), about ``chunk_bytes`` of text each."""
    spark = docs.sparkSession
    small_batches(docs)
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST)).alias("ord"), F.lit(0).cast("bigint").alias("at"), text_or_empty(text_col).alias("text"))
    sized = rows.select("ord", F.octet_length("text").cast("bigint").alias("n"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    bounds, ids, first, cuts, span = (np.zeros(0, dtype=np.int64),) * 5
    if total > chunk_bytes:
        per = materialize(sized.groupBy("ord").agg(F.sum("n").alias("n"), F.count("*").alias("rows")), "id-bytes")
        bounds = _bounds(per, "ord", chunk_bytes)
        crowded = per.where((F.col("rows") > 1) & (F.col("n") > chunk_bytes)).select("ord")
        if not crowded.isEmpty():
            rows, ids, first, cuts, span = _spread(rows, crowded, chunk_bytes)
            before = ids[ids > -(1 << 63)] - 1
            bounds = np.unique(np.concatenate([bounds, ids, before]))  # such an id stands alone
    sizes = np.ones(len(bounds) + 1, dtype=np.int64)
    sizes[np.searchsorted(bounds, ids)] = span
    starts = np.cumsum(sizes) - sizes
    shared = spark.sparkContext.broadcast((bounds, starts, ids, first, cuts))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        bounds, starts, crowded, first, cuts = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            of = starts[np.searchsorted(bounds, ids)]
            if len(crowded):
                k = np.minimum(np.searchsorted(crowded, ids), len(crowded) - 1)
                of = of + np.where(crowded[k] == ids, np.searchsorted(cuts, batch.column(1).to_numpy()) - first[k], 0)
            texts = batch.column(2)
            out = []
            for c in np.unique(of):
                own = np.flatnonzero(of == c)
                data = [texts[int(i)].as_py().encode() for i in own]
                out.append((int(c), ids[own].astype("<i8").tobytes(), np.array([len(x) for x in data], "<i8").tobytes(), squeeze(b"".join(data))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                                                 names=["chunk", "ids", "lens", "blob"])

    n = int(sizes.sum())
    parts = min(n, MAX_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES)))
    packed = rows.mapInArrow(pack, "chunk int, ids binary, lens binary, blob binary")
    begin = starts[np.searchsorted(bounds, ids)]
    return Chunked(bucketed(packed, "chunks", parts, "chunk"), n, np.stack([begin, begin + span]))


def _bounds(per: DataFrame, key: str, chunk_bytes: int) -> np.ndarray:
    """The last key of each chunk but the last: distinct keys (with bytes ``n``) run into chunks by their running sum.

    The sum runs in the tasks of a range sort and over their totals; the driver
    gets 8 bytes a chunk.
    """
    placed = materialize(load_order(per, [], [F.col(key)]).withColumn("_part", F.shiftright("_at", 33)), "ordered-keys")
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = placed.groupBy("_part").agg(F.sum("n").alias("n")).select("_part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_before"))  # a row a task
    within = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    run = placed.select("_part", key, F.coalesce(F.sum("n").over(within), F.lit(0)).alias("_sum")).join(tasks, "_part")
    last = run.groupBy(F.floor((F.col("_sum") + F.col("_before")) / chunk_bytes).alias("chunk")).agg(F.max(key).alias("b"))
    return np.sort(last.select("b").toArrow().column("b").to_numpy())[:-1]


def _spread(rows: DataFrame, crowded: DataFrame, chunk_bytes: int) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(``rows`` with ``at``, crowded ids, the first cut of each, last ``at`` of each of their chunks, chunks of each).

    ``at`` numbers the rows of crowded ids by id, then text.  An id is crowded
    only beyond a chunk's bytes, so the driver and the broadcast get some 8 bytes a chunk.
    """
    own = materialize(rows.join(F.broadcast(crowded), "ord", "left_semi").select("ord", "text"), "crowded-rows")
    placed = materialize(load_order(own, [F.col("ord")], [F.col("text")]).withColumnRenamed("_at", "at"), "ordered-rows")
    cuts = _bounds(placed.select("at", F.octet_length("text").cast("bigint").alias("n")), "at", chunk_bytes)
    ends = placed.groupBy("ord").agg(F.min("at").alias("low"), F.max("at").alias("high")).orderBy("ord").toArrow()
    ids, low, high = (ends.column(c).to_numpy() for c in ("ord", "low", "high"))
    cuts = np.unique(np.concatenate([cuts, high]))  # nor do two ids share a chunk
    first = np.searchsorted(cuts, low)
    every = rows.join(F.broadcast(crowded), "ord", "left_anti").unionByName(placed.select("ord", "at", "text"))
    return every.select("ord", "at", "text"), ids, first, cuts, np.searchsorted(cuts, high) - first + 1


def group_of(shared_ids: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """The number of each chunk, or of the first chunk of its id where rows of one id fill several."""
    begin, end = shared_ids
    if not len(begin):
        return chunks
    k = np.maximum(np.searchsorted(begin, chunks, side="right") - 1, 0)
    return np.where((begin[k] <= chunks) & (chunks < end[k]), begin[k], chunks)


# -- hashes -----------------------------------------------------------------
_A, _B = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def rolling(x: np.ndarray, width: int, base: int = _A) -> np.ndarray:
    """Polynomial hash of every ``width`` neighbours (of 64-bit values), by doubling."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, done, part, size = None, 0, x, 1
    while True:
        if width & size:
            if out is None:
                out, done = part, size
            else:  # what is there so far stands to the right of this larger part
                m = len(x) - (done + size) + 1
                out = part[:m] * np.uint64(pow(base, done, 1 << 64)) + out[size:size + m]
                done += size
        if done == width:
            return out
        m = len(x) - 2 * size + 1
        part = part[:m] * np.uint64(pow(base, size, 1 << 64)) + part[size:size + m]
        size *= 2


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


# -- short keys: 48 bits, packed in four bytes and a count by the bits above ---
SHORT = 48


def short(x: np.ndarray) -> np.ndarray:
    return x >> np.uint64(64 - SHORT)


def buckets_of(keys: np.ndarray, width: int, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted keys of ``width`` bits."""
    top = (keys >> np.uint64(width - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    found, at = np.unique(top, return_index=True)
    ends = np.append(at[1:], len(keys))
    return list(zip(found.tolist(), at.tolist(), ends.tolist()))


def pack_short(keys: np.ndarray, bits: int) -> tuple[bytes, bytes]:
    """Sorted short keys of one bucket."""
    low = (keys & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()
    above = 16 - bits
    if above <= 0:
        return b"", low
    head = (keys >> np.uint64(32)).astype(np.int64) & ((1 << above) - 1)
    return np.bincount(head, minlength=1 << above).astype("<u4").tobytes(), low


def unpack_short(bucket: int, head: bytes, low: bytes, bits: int) -> np.ndarray:
    keys = np.frombuffer(low, "<u4").astype(np.uint64)
    above = 16 - bits
    if above <= 0:
        return keys | np.uint64(bucket << (SHORT - bits))
    counts = np.frombuffer(head, "<u4")
    tops = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    return keys | (tops | np.uint64(bucket << above)) << np.uint64(32)


def pack_bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unpack_bits(data: bytes | None, n: int) -> np.ndarray:
    if data is None:
        return np.zeros(n, dtype=bool)
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


SHORT_ROWS = "bucket int, chunk int, head binary, low binary, anchor binary, again binary"
LONG_ROWS = "bucket int, chunk int, one binary, two binary"
ANSWERS = "chunk int, kind int, bucket int, bits binary"


def table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[f[0] for f in fields])


def send_short(chunk: int, keys: np.ndarray, anchor: np.ndarray, again: np.ndarray, bits: int) -> pa.Table:
    """Distinct sorted short keys; ``anchor``: it may be met; ``again``: the chunk itself meets it."""
    return table([(b, chunk, *pack_short(keys[i:j], bits), pack_bits(anchor[i:j]), pack_bits(again[i:j]))
                  for b, i, j in buckets_of(keys, SHORT, bits)], SHORT_ROWS)


def answer_short(sent: DataFrame, bits: int, kind: int) -> DataFrame:
    """One bit a key: some chunk has it as an anchor, and it occurs again, in another chunk or in that one."""
    def compare(key, rows):
        bucket = key[0].as_py()
        got = list(zip(*(rows.column(c).to_pylist() for c in ("chunk", "head", "low", "anchor", "again"))))
        keys = [unpack_short(bucket, head, low, bits) for _, head, low, _, _ in got]
        sizes = [len(k) for k in keys]
        every, back = np.unique(np.concatenate(keys), return_inverse=True)
        anchor = np.concatenate([unpack_bits(g[3], n) for g, n in zip(got, sizes)])
        again = np.concatenate([unpack_bits(g[4], n) for g, n in zip(got, sizes)])
        met = (np.bincount(back, minlength=len(every)) > 1) | (np.bincount(back, weights=again, minlength=len(every)) > 0)
        hit = (met & (np.bincount(back, weights=anchor, minlength=len(every)) > 0))[back]
        ends = np.cumsum(sizes)
        return table([(g[0], kind, bucket, pack_bits(hit[e - n:e])) for g, n, e in zip(got, sizes, ends) if hit[e - n:e].any()], ANSWERS)

    return sent.groupBy("bucket").applyInArrow(compare, ANSWERS)


def read_answers(answers: dict, kind: int, keys: np.ndarray, width: int, bits: int) -> np.ndarray:
    """The answered bit of each of the sorted keys."""
    out = np.zeros(len(keys), dtype=bool)
    for b, i, j in buckets_of(keys, width, bits):
        out[i:j] = unpack_bits(answers.get((kind, b)), j - i)
    return out


# -- long keys: 96 bits -------------------------------------------------------
def distinct_long(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the first of each distinct key in key order, index of each position's key)."""
    order = np.lexsort((two, one))  # stable: the first of a key comes first
    a, b = one[order], two[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back


def send_long(chunk: int, one: np.ndarray, two: np.ndarray, bits: int) -> pa.Table:
    """Distinct keys in key order (64 and 32 bits)."""
    return table([(b, chunk, one[i:j].astype("<u8").tobytes(), two[i:j].astype("<u4").tobytes())
                  for b, i, j in buckets_of(one, 64, bits)], LONG_ROWS)


def answer_long(sent: DataFrame, kind: int, shared_ids: np.ndarray | None = None) -> DataFrame:
    """One bit a key: an earlier chunk holds it (with ``shared_ids``: one of a smaller id)."""
    def compare(key, rows):
        got = sorted(zip(*(rows.column(c).to_pylist() for c in ("chunk", "one", "two"))))
        one = np.concatenate([np.frombuffer(g[1], "<u8") for g in got])
        two = np.concatenate([np.frombuffer(g[2], "<u4") for g in got])
        first, back = distinct_long(one, two)
        chunks = np.array([g[0] for g in got], dtype=np.int64)
        group = np.repeat(chunks if shared_ids is None else group_of(shared_ids, chunks), [len(g[1]) // 8 for g in got])
        held = group > group[first][back]
        out, at = [], 0
        for chunk, x, _ in got:
            n = len(x) // 8
            if held[at:at + n].any():
                out.append((chunk, kind, key[0].as_py(), pack_bits(held[at:at + n])))
            at += n
        return table(out, ANSWERS)

    return sent.groupBy("bucket").applyInArrow(compare, ANSWERS)
