"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is halved recursively down to leaves of ``LEAF`` characters, each leaf
is encoded by itself, and neighbours are joined pairwise up the tree.  A join
re-encodes a window around the seam that grows on both sides until it ends at
places where a match of the split pattern must start whatever stands around
it; the tokens outside cannot change (no match spans such a place, and the
matcher keeps no memory across it), so only the window's tokens are replaced.
The places are also checked against the tokens' byte lengths; if they do not
fall between two tokens, the window grows on.

One match can be longer than any window (a run of letters or of spaces).  Its
bytes are halved and joined in the same way one level below: the tokens at
the seam are re-encoded in growing windows until the window's first and last
token are each compatible with their outer neighbour, that is, the two
encode to themselves; a sequence of pairwise compatible tokens is the BPE
encoding of its bytes.

Decoding concatenates the bytes of halves up the same kind of tree.

Every document is encoded in the task that reads it: no shuffle.  The rank
file is read on the driver and broadcast; it does not grow with the data and
its size is checked against ``MAX_RANK_BYTES``.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty

LEAF = 1024              # characters of a leaf
PIECE_LEAF = 256         # bytes of a leaf inside one long match
LONG = 4096              # characters from which a window's matches are taken one by one
MAX_RANK_BYTES = 64 << 20

# Fixed: Unicode White_Space, as the tokenizer's \s understands it.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


class Codec:
    """Encoder and decoder of one rank file (one per Python worker)."""

    def __init__(self, rank_file: bytes, pattern: str) -> None:
        import regex
        import tiktoken

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        own = pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")
        self.match = regex.compile(own)
        s, other = _SPACE, f"[^{_SPACE}\\p{{L}}\\p{{N}}']"
        # a match starts here whatever stands around: after a non-space before a space, and where letters,
        # digits and other signs change, but for an apostrophe before letters (a contraction may span it)
        self.start = regex.compile(f"(?<=[^{s}])(?=[{s}])|(?<=\\p{{L}})(?=[^\\p{{L}}])|(?<=\\p{{N}})(?=[^\\p{{N}}])"
                                   f"|(?<={other})(?=[\\p{{L}}\\p{{N}}])|(?<=')(?=\\p{{N}})")

    # -- texts --------------------------------------------------------------
    def encode(self, text: str, leaf: int = LEAF) -> list[int]:
        return self._tree(text, 0, len(text), max(1, leaf))

    def _tree(self, text: str, a: int, b: int, leaf: int) -> list[int]:
        if b - a <= leaf:
            return self._window(text[a:b])
        m = (a + b) // 2
        return self._join(text, a, m, b, self._tree(text, a, m, leaf), self._tree(text, m, b, leaf))

    def _join(self, text: str, a: int, m: int, b: int, left: list[int], right: list[int]) -> list[int]:
        p, keep = self._before(text, a, m, left)
        q, skip = self._after(text, m, b, right)
        return left[:keep] + self._window(text[p:q]) + right[skip:]

    def _before(self, text: str, a: int, m: int, left: list[int]) -> tuple[int, int]:
        """The last sure start before the seam that lies between two tokens (else ``a``), and how many tokens stand before it."""
        reach = 16
        while True:
            low = max(a, m - reach)
            for p in reversed([x.start() for x in self.start.finditer(text, max(a, low - 1), m)]):
                if max(low, a + 1) <= p < m and (n := self._fit(reversed(left), text[p:m])) is not None:
                    return p, len(left) - n
            if low == a:
                return a, 0
            reach *= 4

    def _after(self, text: str, m: int, b: int, right: list[int]) -> tuple[int, int]:
        """The first sure start after the seam that lies between two tokens (else ``b``), and how many tokens stand before it."""
        reach = 16
        while True:
            high = min(b, m + reach)
            for q in [x.start() for x in self.start.finditer(text, m, min(b, high + 1))]:
                if m < q <= min(high, b - 1) and (n := self._fit(right, text[m:q])) is not None:
                    return q, n
            if high == b:
                return b, len(right)
            reach *= 4

    def _fit(self, tokens, span: str) -> int | None:
        """How many of ``tokens`` cover exactly the bytes of ``span``; None if none do."""
        need, n = len(span.encode()), 0
        for t in tokens:
            if need <= 0:
                break
            need -= len(self.bytes_of[t])
            n += 1
        return n if need == 0 else None

    def _window(self, text: str) -> list[int]:
        if len(text) <= LONG:
            return self.enc.encode_ordinary(text)
        out: list[int] = []
        for x in self.match.finditer(text):
            out += self.enc.encode_ordinary(x[0]) if len(x[0]) <= PIECE_LEAF else self.piece(x[0].encode())
        return out

    # -- one match ----------------------------------------------------------
    def piece(self, data: bytes) -> list[int]:
        """BPE tokens of one match of any length."""
        if len(data) <= max(PIECE_LEAF, self.longest):
            return self.enc._encode_single_piece(data)
        m = len(data) // 2
        left, right = self.piece(data[:m]), self.piece(data[m:])
        k = 1
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            middle = b"".join(map(self.bytes_of.__getitem__, left[i:] + right[:j]))
            if len(middle) > self.longest or (i == 0 and j == len(right)):
                w = self._merge(middle)
                if (i == 0 or self._pair(left[i - 1], w[0])) and (j == len(right) or self._pair(w[-1], right[j])):
                    return left[:i] + w + right[j:]
            k *= 2

    def _merge(self, data: bytes) -> list[int]:
        return self.enc._encode_single_piece(data)

    def _pair(self, x: int, y: int) -> bool:
        return self._merge(self.bytes_of[x] + self.bytes_of[y]) == [x, y]

    # -- back ---------------------------------------------------------------
    def decode(self, ids: list[int], leaf: int = LEAF) -> bytes:
        if len(ids) <= leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        m = len(ids) // 2
        return self.decode(ids[:m], leaf) + self.decode(ids[m:], leaf)


@lru_cache(maxsize=2)
def _codec(rank_file: bytes, pattern: str) -> Codec:
    return Codec(rank_file, pattern)


def _shared_ranks(df: DataFrame, ranks_path: str):
    small_batches(df)
    with open(ranks_path, "rb") as f:
        data = f.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"{ranks_path} is over {MAX_RANK_BYTES} bytes")
    return df.sparkSession.sparkContext.broadcast(data)


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out_col: str = "ids",
           leaf: int = LEAF) -> DataFrame:
    """``docs`` with ``out_col``: the text's token ids as little-endian unsigned 32-bit integers (null text: no ids)."""
    shared = _shared_ranks(docs, ranks_path)

    @F.pandas_udf("binary")
    def ids(text):
        codec = _codec(shared.value, pattern)
        return text.map(lambda t: _packed(codec.encode(t or "", leaf)))

    return docs.withColumn(out_col, ids(text_or_empty(text_col)))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded",
           leaf: int = LEAF) -> DataFrame:
    """``df`` with ``out_col``: the bytes that the packed ids of ``ids_col`` stand for (null: no bytes)."""
    shared = _shared_ranks(df, ranks_path)

    @F.pandas_udf("binary")
    def back(ids):
        codec = _codec(shared.value, pattern)
        return ids.map(lambda x: codec.decode(np.frombuffer(x or b"", dtype="<u4").tolist(), leaf))

    return df.withColumn(out_col, back(F.col(ids_col)))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
               leaf: int = LEAF, with_ids: bool = False) -> DataFrame:
    """Encode each text, decode its ids, and report both in one pass over the rows.

    doc_id, n_tokens, ids_sha256 (of the packed ids), decoded_sha256, and with
    ``with_ids`` the packed ids.  One row per input row, repeated rows and null
    ids included; a null or empty text has no tokens.  Other columns of
    ``docs`` are not read.
    """
    shared = _shared_ranks(docs, ranks_path)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    schema = "doc_id {}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{}".format(
        rows.schema["doc_id"].dataType.simpleString(), ", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern)
        for batch in batches:
            n, ids_sha, back_sha, packed = [], [], [], []
            for text in batch.column(1):
                ids = codec.encode(text.as_py(), leaf)
                raw = _packed(ids)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(raw).hexdigest())
                back_sha.append(hashlib.sha256(codec.decode(ids, leaf)).hexdigest())
                if with_ids:
                    packed.append(raw)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array(packed, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(run, schema)
