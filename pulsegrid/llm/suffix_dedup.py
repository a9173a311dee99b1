"""Suffix-array dedup of byte strings that repeat across documents.

A string of ``LENGTH`` bytes that also starts in a document with a smaller id
is removed.  Texts are dealt into chunks of ascending ids (see ``chunks``):

1. Windows are grouped into segments: neighbouring windows with the same
   minimal hash of ``GRAM`` bytes inside.  Equal windows have equal minima, so
   only segments whose minimum another document has can hold repeats.  Minima
   are compared across chunks as packed 48-bit keys.
2. Of those segments, whole ones are compared: a segment whose bytes a
   chunk of smaller ids holds is removed as a whole.
3. Where several different segments share a minimum, the windows of each
   (sent once, by the first chunk that has it) are compared one by one.
4. Within a chunk the windows that are left and whose minimum several of its
   documents have are put in suffix order by
   difference-cover blockwise construction (see ``suffixes``): windows that stand
   together and agree on ``LENGTH`` bytes are one class, and all but those of
   its smallest document go.

Segments and windows are compared across chunks by 96 bits of XXH3-128,
within a chunk byte by byte.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from . import chunks as C
from .common import materialize
from .suffixes import PERIOD, suffix_classes

LENGTH = 50
_SHARED, _HELD, _VARIED, _WINDOW = 1, 2, 3, 4
_AT_ONCE = 1 << 14
SEGMENT_ROWS = "bucket int, chunk int, head binary, low binary, one binary, two binary"


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x, size = np.minimum(x[:-size], x[size:]), size * 2
    return np.minimum(x[:len(x) - (width - size)], x[width - size:]) if size < width else x


def _digests(data: bytes, starts: list[int], ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
    digest = xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([digest(data[i:j]) for i, j in zip(starts, ends)]), dtype="<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1] >> np.uint64(32)


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All integers of the ranges low..high (both included)."""
    n = high - low + 1
    return np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)


class Segments:
    """The segments of a chunk: window starts ``low``..``high`` with one minimum, and what the exchanges say about them."""

    def __init__(self, texts: C.Texts, length: int) -> None:
        self.length = length
        self.data = b"".join(texts.texts)
        self.raw = np.frombuffer(self.data, dtype=np.uint8)
        self.sizes = np.array([len(t) for t in texts.texts], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        _, self.rank = np.unique(texts.ids, return_inverse=True)  # documents that share an id are one
        n = max(0, len(self.raw) - self.length + 1)
        inside = np.ones(n, dtype=bool)
        for e, size in zip(self.ends.tolist(), self.sizes.tolist()):
            inside[max(e - size, e - self.length + 1):e] = False
        least, gram = np.empty(n, dtype=np.uint64), self.length // 2 + 1
        values = np.random.default_rng(gram).integers(0, 1 << 64, 256, dtype=np.uint64)
        for i in range(0, n, _AT_ONCE):  # in pieces that stay in the processor's cache
            part = values[self.raw[i:i + _AT_ONCE + self.length - 1]]
            least[i:i + _AT_ONCE] = _sliding_min(C.mixed(C.rolling(part, gram)), self.length - gram + 1)
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | (least[1:] != least[:-1])
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | begins[1:]
        self.low, self.high = np.flatnonzero(begins), np.flatnonzero(ends)
        self.key = C.short(C.mixed(least[self.low]))
        self.doc = np.searchsorted(self.ends, self.low, side="right")

    def shared(self, answers: dict, bits: int) -> None:
        """Keep the segments whose minimum another document has, with digests of their bytes.

        ``first`` has each distinct segment in key order, ``back`` each segment's index there.
        """
        keys, back = self.minima()
        hit = C.read_answers(answers, _SHARED, keys, C.SHORT, bits)[back]
        self.low, self.high, self.key, self.doc = (x[hit] for x in (self.low, self.high, self.key, self.doc))
        self.one, self.two = _digests(self.data, self.low.tolist(), (self.high + self.length).tolist())
        order = np.lexsort((self.two, self.one, self.key))
        new = np.ones(len(order), dtype=bool)
        new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (self.key, self.one, self.two)], axis=0)
        self.first, self.back = order[new], np.empty(len(order), dtype=np.int64)
        self.back[order] = np.cumsum(new) - 1

    def minima(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct sorted keys, index of each segment's key)."""
        return np.unique(self.key, return_inverse=True)

    def again(self, keys: np.ndarray, back: np.ndarray) -> np.ndarray:
        """The keys that several documents of the chunk have."""
        rank, width = self.rank[self.doc], len(keys)
        low, high = np.full(width, len(self.rank)), np.zeros(width, dtype=np.int64)
        np.minimum.at(low, back, rank)
        np.maximum.at(high, back, rank)
        return low < high

    def compared(self, answers: dict, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(segments that an earlier chunk holds, segments whose minimum has several segments)."""
        keys = self.key[self.first]
        return (C.read_answers(answers, _HELD, keys, C.SHORT, bits)[self.back],
                C.read_answers(answers, _VARIED, keys, C.SHORT, bits)[self.back])

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window starts of the chosen segments, their keys)."""
        at = _ranges(self.low[chosen], self.high[chosen])
        return at, *_digests(self.data, at.tolist(), (at + self.length).tolist())


def _answer_segments(sent: DataFrame, bits: int, shared_ids: np.ndarray) -> DataFrame:
    """Two bits a segment: a chunk of a smaller id holds it; its minimum has several different segments."""
    def compare(key, rows):
        bucket = key[0].as_py()
        got = sorted(zip(*(rows.column(c).to_pylist() for c in ("chunk", "head", "low", "one", "two"))))
        keys = [C.unpack_short(bucket, g[1], g[2], bits) for g in got]
        sizes = [len(k) for k in keys]
        m, one = np.concatenate(keys), np.concatenate([np.frombuffer(g[3], "<u8") for g in got])
        two = np.concatenate([np.frombuffer(g[4], "<u4") for g in got])
        order = np.lexsort((two, one, m))  # stable: earlier chunks first
        new = np.ones(len(order), dtype=bool)
        new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (m, one, two)], axis=0)
        held, varied = np.empty(len(m), dtype=bool), np.empty(len(m), dtype=bool)
        chunks = np.repeat(C.group_of(shared_ids, np.array([g[0] for g in got], dtype=np.int64)), sizes)[order]
        held[order] = chunks > chunks[new][np.cumsum(new) - 1]
        group = np.cumsum(np.append(True, m[order][1:] != m[order][:-1])) - 1
        varied[order] = (np.bincount(group, weights=new) > 1)[group]
        out, at = [], 0
        for g, n in zip(got, sizes):
            for kind, flags in ((_HELD, held), (_VARIED, varied)):
                if flags[at:at + n].any():
                    out.append((g[0], kind, bucket, C.pack_bits(flags[at:at + n])))
            at += n
        return C.table(out, C.ANSWERS)

    return sent.groupBy("bucket").applyInArrow(compare, C.ANSWERS)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                 chunk_bytes: int = C.CHUNK_BYTES, with_bytes: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that stay).

    Texts are UTF-8 bytes (null text: empty).  A byte goes if a ``length``-byte
    string covers it that also starts in a document with a smaller integer id;
    strings do not cross documents.  Null ids come last; rows that share an id
    are one document and take nothing from each other.  Spans are maximal runs
    of removed bytes.
    """
    if length < PERIOD:
        raise ValueError(f"strings have {PERIOD} bytes or more")
    held = C.deal(docs, id_col, text_col, chunk_bytes)
    bits = held.bits

    def send_minima(chunk: int, texts: C.Texts, _: dict) -> pa.Table:
        s = Segments(texts, length)
        keys, back = s.minima()
        return C.send_short(chunk, keys, np.ones(len(keys), dtype=bool), s.again(keys, back), bits)

    answers = materialize(C.answer_short(held.emit(send_minima, C.SHORT_ROWS), bits, _SHARED), "shared-minima")

    def send_segments(chunk: int, texts: C.Texts, answers: dict) -> pa.Table:
        s = Segments(texts, length)
        s.shared(answers, bits)
        key, one, two = s.key[s.first], s.one[s.first].astype("<u8"), s.two[s.first].astype("<u4")
        return C.table([(b, chunk, *C.pack_short(key[i:j], bits), one[i:j].tobytes(), two[i:j].tobytes())
                        for b, i, j in C.buckets_of(key, C.SHORT, bits)], SEGMENT_ROWS)

    answers = answers.unionByName(materialize(_answer_segments(held.emit(send_segments, SEGMENT_ROWS, answers), bits, held.shared_ids), "compared-segments"))

    def send_windows(chunk: int, texts: C.Texts, answers: dict) -> pa.Table:
        s = Segments(texts, length)
        s.shared(answers, bits)
        earlier, varied = s.compared(answers, bits)
        _, one, two = s.windows(varied & ~earlier)
        first, _ = C.distinct_long(one, two)
        return C.send_long(chunk, one[first], two[first], bits)

    answers = answers.unionByName(materialize(C.answer_long(held.emit(send_windows, C.LONG_ROWS, answers), _WINDOW, held.shared_ids), "held-windows"))
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_bytes

    def remove(_: int, texts: C.Texts, answers: dict) -> pa.Table:
        s = Segments(texts, length)
        s.shared(answers, bits)
        earlier, varied = s.compared(answers, bits)
        at, one, two = s.windows(varied & ~earlier)
        first, back = C.distinct_long(one, two)
        gone = [_ranges(s.low[earlier], s.high[earlier]), at[C.read_answers(answers, _WINDOW, one[first], 64, bits)[back]]]
        keys, back = s.minima()
        here = ~earlier & s.again(keys, back)[back]  # a repeat within the chunk shares its minimum with another document of the chunk
        order, group = suffix_classes(s.raw, _ranges(s.low[here], s.high[here]), length)
        if len(order):
            rank = s.rank[np.searchsorted(s.ends, order, side="right")]
            starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            smallest = np.minimum.reduceat(rank, starts)[np.cumsum(np.append(False, group[1:] != group[:-1]))]
            gone.append(order[rank > smallest])
        starts = np.zeros(len(s.raw) + 1, dtype=np.int8)
        for x in gone:
            starts[x] = 1
        sums = np.cumsum(starts, dtype=np.int32)
        keep = sums[:-1] == 0
        keep[length:] = sums[length:-1] == sums[:-length - 1]  # no removed string starts in the last ``length`` places
        total = np.concatenate([[0], np.cumsum(~keep)])
        removed = total[s.ends] - total[s.ends - s.sizes]
        begins = ~keep
        begins[1:] &= keep[:-1]
        heads = (s.ends - s.sizes)[s.sizes > 0]
        begins[heads] = ~keep[heads]  # a run does not go on from one document to the next
        spans = np.concatenate([[0], np.cumsum(begins)])
        spans = spans[s.ends] - spans[s.ends - s.sizes]
        kept = [s.raw[e - n:e][keep[e - n:e]].tobytes() if r else s.data[e - n:e]
                for n, e, r in zip(s.sizes.tolist(), s.ends.tolist(), removed.tolist())]
        cols = [texts.id_column(), pa.array(s.sizes), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_bytes:
            cols.append(pa.array(kept, pa.binary()))
            names.append("kept")
        return pa.Table.from_arrays(cols, names=names)

    return held.emit(remove, schema, answers)
