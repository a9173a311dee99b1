"""Quality classifier: supervised subword embeddings, trained by numpy stochastic gradient descent.

A document is the average of learned vectors: one for each of its words, of
its pairs of neighbouring words and of its character n-grams within words (all
hashed into ``BUCKETS`` rows), followed by a softmax over the two labels.

The fit runs in one task over a bounded sample: the ``SAMPLE`` labelled training
rows that come first in the order of a seeded hash of their id.  What is left
of the model for scoring is one number a bucket (its vector times the
difference of the two output vectors), ``4 * BUCKETS`` bytes whatever the input, so
it is broadcast.  Every document of any size is scored in the task that reads
it, whole, in slices of ``WORDS_AT_ONCE`` words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import first_by_hash, small_batches, text_or_empty

BITS = 17
BUCKETS = 1 << BITS
DIM = 8
EPOCHS = 6
RATE = 4.0
SAMPLE = 4000
SEED = 29
THRESHOLD = 0.7
WORDS_AT_ONCE = 1 << 16
UNTRAINED = (bytes(4 * BUCKETS), 0.0)  # the model of no rows: every score is 0.5
_MUL = 0x9E3779B1
_BASE = np.uint64(0x100000001B3)
_BACK = np.uint64(pow(0x100000001B3, -1, 1 << 64))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(size, _BASE), np.full(size, _BACK)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _bucket32(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint32(salt)) * np.uint32(_MUL)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS)


def _bucket64(h: np.ndarray, salt: int) -> np.ndarray:
    return (((h + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.uint32)


def features(text: str) -> Iterator[np.ndarray]:
    """Buckets of the text's features, with repeats, slice by slice."""
    words = text.encode().split()
    before = None  # hash of the word before the slice
    for at in range(0, len(words), WORDS_AT_ONCE):
        part = words[at:at + WORDS_AT_ONCE]
        raw = np.frombuffer(b" " + b" ".join(part) + b" ", dtype=np.uint8)
        b, inner = raw.astype(np.uint32), raw != 32
        three = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
        four = three[:-1] | b[3:] << np.uint32(24)
        yield _bucket32(three[inner[1:-1]], 3)
        yield _bucket32(four[inner[1:-2] & inner[2:-1]], 4)
        up, down = _powers(1 << max(16, int(len(raw)).bit_length()))
        with np.errstate(over="ignore"):
            sums = np.cumsum(raw * up[:len(raw)], dtype=np.uint64)
            gaps = np.flatnonzero(~inner)
            hashes = (sums[gaps[1:] - 1] - sums[gaps[:-1]]) * down[gaps[:-1]]
            yield _bucket64(hashes, 1)
            line = hashes if before is None else np.concatenate([before, hashes])
            yield _bucket64(line[1:] - line[:-1], 2)  # a pair by its difference: a word twice in a row is one feature
        before = hashes[-1:]


def fit(ids: list[np.ndarray], counts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE,
        seed: int = SEED) -> tuple[np.ndarray, float]:
    """Train on documents given as distinct buckets and their counts; the score's number for each bucket, and the bias."""
    rng = np.random.default_rng(seed)
    vec = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((2, DIM), dtype=np.float32)
    bias = np.zeros(2, dtype=np.float32)
    share = [c / max(1.0, c.sum()) for c in counts]
    steps, done = max(1, epochs * len(ids)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(ids)):
            step = rate * (1 - done / steps)
            done += 1
            rows = vec[ids[i]]
            mean = share[i] @ rows if len(rows) else np.zeros(DIM, dtype=np.float32)
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            if len(rows):
                vec[ids[i]] = rows - step * np.outer(share[i] * len(rows) ** 0.5, p @ out)
            out -= 0.1 * step * np.outer(p, mean)
            bias -= 0.01 * step * p
    return (vec @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def score(text: str, table: np.ndarray, bias: float) -> float:
    total, n = 0.0, 0
    for part in features(text):
        total += float(table[part].sum(dtype=np.float64))
        n += len(part)
    z = bias + (total / n if n else 0.0)
    return float(1 / (1 + np.exp(-min(60.0, max(-60.0, z)))))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether labels of this id are kept from training."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
          sample: int = SAMPLE) -> tuple[bytes, float]:
    """Fit on at most ``sample`` labelled rows that aren't held out; (numbers of the buckets as bytes, bias).

    Of an id with several labels the smallest counts; an id that several rows of
    ``docs`` have gives as many examples, but no more than four times ``sample`` in all.
    ``UNTRAINED`` if there is no such row (no labels, all held out, or of other ids).
    """
    small_batches(docs)
    labelled = labels.where(~held_out(id_col) & F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label).cast("int").alias("y"))
    chosen = first_by_hash(labelled, sample, SEED, "doc_id")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, y in zip(*(c.to_pylist() for c in batch.columns)):
                parts = list(features(text))
                ids, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0), np.zeros(0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id], pa.int64()), pa.array([y], pa.int32()), pa.array([ids.astype("<i4").tobytes()], pa.binary()),
                     pa.array([n.astype("<f4").tobytes()], pa.binary())], names=["doc_id", "y", "ids", "n"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = sorted((x for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns))))
        ids = [np.frombuffer(x[2], dtype="<i4") for x in seen]
        counts = [np.frombuffer(x[3], dtype="<f4") for x in seen]
        table, bias = fit(ids, counts, np.array([x[1] for x in seen], dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([table.astype("<f4").tobytes()], pa.binary()), pa.array([bias], pa.float64())],
                                         names=["table", "bias"])

    examples = (rows.select("doc_id", "text", "y").mapInArrow(extract, "doc_id bigint, y int, ids binary, n binary")
                .orderBy(F.xxhash64("doc_id"), "doc_id").limit(4 * sample))
    model = examples.coalesce(1).mapInArrow(learn, "table binary, bias double").first()
    return (bytes(model["table"]), model["bias"]) if model else UNTRAINED


def classify(docs: DataFrame, model: tuple[bytes, float], id_col: str = "doc_id", text_col: str = "text",
             keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Score every row: the id, the columns in ``keep``, held_out, score (0 to 1) and predicted (1 from ``threshold`` on).

    A null or empty text scores what the bias alone gives.  Null ids are scored
    and count as not held out; repeated rows score alike.
    """
    keep = [c for c in keep or [] if c not in (id_col,)]
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(text):
        table, bias = np.frombuffer(shared.value[0], dtype="<f4"), shared.value[1]
        return text.map(lambda t: score(t, table, bias)).astype("float64")

    rows = docs.select(F.struct(F.col(id_col), *keep).alias("row"), held_out(id_col).alias("held_out"),
                       scored(text_or_empty(text_col)).alias("score"))
    return rows.select("row.*", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
