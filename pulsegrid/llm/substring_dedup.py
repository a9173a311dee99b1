"""Substring dedup on words by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of ``ANCHOR``
words; any window of ``WINDOW`` words contains a whole block of its document,
wherever it starts.  All blocks are indexed, and every rolling window of
``ANCHOR`` words of every document probes the index.  A hit is a block that
occurs again; hits are extended over all ``WINDOW``-word windows around them,
and a window repeats if an earlier document, or an earlier place of its own
document, has the same words.  Runs of repeating windows are the maximal
repeats, and their words go.

Index and probes travel as packed 48-bit keys with a bit for the blocks, so a
probe costs about four bytes; a false hit only means one window more to
compare.  Windows are compared by 96-bit hashes of their words' 64-bit hashes.
See ``chunks`` for how texts and keys are dealt.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from . import chunks as C
from .common import materialize

WINDOW = 20
_HITS, _HELD = 1, 2


class Words:
    """The words of a chunk's documents with their rolling hashes."""

    def __init__(self, texts: C.Texts, window: int) -> None:
        digest = xxhash.xxh3_64_intdigest
        self.docs = [t.split() for t in texts.texts]
        self.counts = np.array([len(w) for w in self.docs], dtype=np.int64)
        self.ends = np.cumsum(self.counts)
        self.hash = np.array([digest(w) for words in self.docs for w in words], dtype=np.uint64)
        self.doc = np.repeat(np.arange(len(self.docs)), self.counts)
        self.place = np.arange(len(self.hash)) - np.repeat(self.ends - self.counts, self.counts)
        self.window, self.anchor = window, (window + 1) // 2

    def within(self, width: int) -> np.ndarray:
        """Where a window of so many words starts and stays in its document."""
        n = max(0, len(self.hash) - width + 1)
        return self.doc[:n] == self.doc[width - 1:width - 1 + n] if n else np.zeros(0, dtype=bool)

    def probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts, distinct sorted keys, index of each start's key, starts that are reference blocks)."""
        at = np.flatnonzero(self.within(self.anchor))
        keys, back = np.unique(C.short(C.mixed(C.rolling(self.hash, self.anchor)))[at], return_inverse=True)
        return at, keys, back, self.place[at] % self.anchor == 0

    def candidates(self, answers: dict, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts of the windows around hits, their keys)."""
        at, keys, back, _ = self.probes()
        hit = np.zeros(len(self.hash) + 1, dtype=np.int64)
        hit[at + 1] = C.read_answers(answers, _HITS, keys, C.SHORT, bits)[back]
        sums, inside = np.cumsum(hit), self.within(self.window)
        reach = self.window - self.anchor + 1
        near = sums[reach:reach + len(inside)] > sums[:len(inside)]
        starts = np.flatnonzero(inside & near)
        one = C.mixed(C.rolling(self.hash, self.window))[starts]
        two = C.mixed(C.rolling(C.mixed(self.hash), self.window, C._B))[starts] >> np.uint64(32)
        return starts, one, two


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    chunk_bytes: int = C.CHUNK_BYTES, with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 (and kept_text).

    Words are runs of bytes other than space, \\t, \\n, \\v, \\f and \\r (null text:
    none).  A word goes if a window of ``window`` words covers it whose words
    also start earlier: in a smaller integer id or earlier in the same
    document.  Null ids come last; rows that repeat an id come in the order of
    their text.  Kept words are joined by one space.
    """
    if window < 2:
        raise ValueError("a window has two words or more")
    held = C.deal(docs, id_col, text_col, chunk_bytes)
    bits = held.bits

    def probe(chunk: int, texts: C.Texts, _: dict) -> pa.Table:
        _, keys, back, block = Words(texts, window).probes()
        return C.send_short(chunk, keys, np.bincount(back, weights=block, minlength=len(keys)) > 0,
                            np.bincount(back, minlength=len(keys)) > 1, bits)

    hits = materialize(C.answer_short(held.emit(probe, C.SHORT_ROWS), bits, _HITS), "anchor-hits")

    def extend(chunk: int, texts: C.Texts, answers: dict) -> pa.Table:
        _, one, two = Words(texts, window).candidates(answers, bits)
        first, _ = C.distinct_long(one, two)
        return C.send_long(chunk, one[first], two[first], bits)

    earlier = C.answer_long(held.emit(extend, C.LONG_ROWS, hits), _HELD)
    answers = hits.unionByName(materialize(earlier, "held-windows"))
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text binary" * with_text

    def remove(_: int, texts: C.Texts, answers: dict) -> pa.Table:
        w = Words(texts, window)
        starts, one, two = w.candidates(answers, bits)
        first, back = C.distinct_long(one, two)
        repeats = C.read_answers(answers, _HELD, one[first], 64, bits)[back]
        own = np.ones(len(starts), dtype=bool)
        own[first] = False  # starts ascend, so all but the first of a key repeat it
        gone = starts[repeats | own]
        cover = np.zeros(len(w.hash) + 1, dtype=np.int64)
        cover[gone] += 1
        cover[gone + window] -= 1
        keep = np.cumsum(cover)[:-1] == 0
        total = np.concatenate([[0], np.cumsum(~keep)])
        removed = total[w.ends] - total[w.ends - w.counts]
        kept = [b" ".join(compress(words, keep[e - n:e].tolist()) if r else words)
                for words, n, e, r in zip(w.docs, w.counts.tolist(), w.ends.tolist(), removed.tolist())]
        cols = [texts.id_column(), pa.array(w.counts), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            cols.append(pa.array(kept, pa.binary()))
            names.append("kept_text")
        return pa.Table.from_arrays(cols, names=names)

    out = held.emit(remove, schema, answers)
    return out.withColumn("kept_text", out.kept_text.cast("string")) if with_text else out
