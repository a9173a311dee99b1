"""Suffix order of chosen positions of a text, by difference-cover blockwise construction.

A difference cover D modulo v has, for any two residues, a shift below v that
takes both into D.  The suffixes at cover positions (the sample) are ranked
first.  Then the wanted suffixes are sorted one bucket (leading two bytes) at a
time: by their first v bytes, and where these tie, by the ranks of the two
sample suffixes that the pair's shift leads to.  Only one bucket's sort keys are
in memory at once, and no tie takes more than one rank comparison, however long
the match is.

Order and equality are needed up to ``depth`` bytes; suffixes that agree on
those are one class.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

PERIOD = 32
BUCKET = 1 << 17


@lru_cache
def difference_cover(v: int) -> tuple[int, ...]:
    """A small set of residues whose differences are all residues modulo v (greedy)."""
    cover, open_ = [0], set(range(1, v))
    while open_:
        new = lambda x: {(x - c) % v for c in cover} | {(c - x) % v for c in cover}
        best = max(range(v), key=lambda x: (len(new(x) & open_), -x))
        open_ -= new(best)
        cover.append(best)
    return tuple(sorted(cover))


@lru_cache
def shifts(v: int) -> np.ndarray:
    """shift[a, b]: the smallest d with (a + d) % v and (b + d) % v in the cover."""
    inside = np.isin(np.arange(v), difference_cover(v))
    out = np.full((v, v), -1, dtype=np.int64)
    residues = np.arange(v)
    for d in range(v - 1, -1, -1):
        both = inside[(residues + d) % v]
        out[both[:, None] & both[None, :]] = d
    return out


def eights(data: np.ndarray, room: int) -> np.ndarray:
    """The eight bytes from every position as one big-endian number; ``room`` more positions of zeros."""
    w = np.concatenate([data, np.zeros(room + 8, dtype=np.uint8)]).astype(np.uint64)
    for step in (1, 2, 4):
        w = (w[:-step] << np.uint64(8 * step)) | w[step:]
    return w


def _words(w: np.ndarray, pos: np.ndarray, depth: int) -> list[np.ndarray]:
    out = [w[pos + i] for i in range(0, depth - 7, 8)]
    if depth % 8:
        out.append(w[pos + depth - depth % 8] >> np.uint64(64 - 8 * (depth % 8)))
    return out


def _differs(columns: list[np.ndarray]) -> np.ndarray:
    """Whether each row differs from the row before."""
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def sample_ranks(w: np.ndarray, n: int, pos: np.ndarray, depth: int, v: int) -> np.ndarray:
    """Ranks of the cover suffixes that the positions' comparisons can lead to, by position (-1: none)."""
    reach = np.zeros(n + v + 1, dtype=np.int32)
    np.add.at(reach, pos, 1)
    np.add.at(reach, pos + v, -1)
    wanted = np.cumsum(reach)[:n] > 0
    sample = np.flatnonzero(wanted & np.isin(np.arange(n) % v, difference_cover(v)))
    rank = np.full(n + 1, -1, dtype=np.int32)
    columns = _words(w, sample, depth)
    order = np.lexsort(columns[::-1])
    rank[sample[order]] = np.cumsum(_differs([c[order] for c in columns]))
    return rank


def suffix_classes(data: np.ndarray, pos: np.ndarray, depth: int, v: int = PERIOD, bucket: int = BUCKET) -> tuple[np.ndarray, np.ndarray]:
    """(positions in suffix order, class of each): equal classes agree on ``depth`` bytes.

    ``pos`` holds distinct positions at least ``depth`` bytes before the end.
    """
    if not len(pos):
        return pos, np.zeros(0, dtype=np.int64)
    if v > depth:
        raise ValueError("the cover's period is at most the depth")
    n, w = len(data), eights(data, depth + v)
    rank, shift = sample_ranks(w, n, pos, depth, v), shifts(v)
    lead = (w[pos] >> np.uint64(48)).astype(np.uint16)
    pos = pos[np.argsort(lead, kind="stable")]
    starts = np.flatnonzero(np.append(True, np.sort(lead)[1:] != np.sort(lead)[:-1]))
    ends, parts, at = np.append(starts[1:], len(pos)), [], 0
    while at < len(pos):  # whole buckets, together up to the size
        last = np.searchsorted(ends, at + bucket, side="right") - 1
        end = int(ends[last]) if last >= 0 and ends[last] > at else int(ends[np.searchsorted(ends, at, side="right")])
        parts.append(_bucket(w, pos[at:end], rank, shift, v))
        at = end
    pos = np.concatenate(parts)
    return pos, np.cumsum(_differs(_words(w, pos, depth)))


def _bucket(w: np.ndarray, pos: np.ndarray, rank: np.ndarray, shift: np.ndarray, v: int) -> np.ndarray:
    """One bucket's suffixes in order: by v bytes, then ties by cover ranks (three-way partition around a pivot of each tie)."""
    columns = _words(w, pos, v)
    order = np.lexsort(columns[::-1])
    pos, new = pos[order], _differs([c[order] for c in columns])
    group = np.cumsum(new) - 1
    slots = np.arange(len(pos))
    while True:
        sizes = np.bincount(group)
        tied = sizes[group] > 1
        slots, group = slots[tied], group[tied]
        if not len(slots):
            return pos
        _, first, group, sizes = np.unique(group, return_index=True, return_inverse=True, return_counts=True)
        own = pos[slots]
        pivot = own[first + sizes // 2][group]
        d = shift[own % v, pivot % v]
        side = np.sign(rank[own + d] - rank[pivot + d])
        order = np.lexsort((side, group))
        pos[slots] = own[order]
        part = (group * 3 + side + 1)[order]
        keep = part % 3 != 1  # what equals the pivot is done
        slots, part = slots[keep], part[keep]
        if not len(slots):
            return pos
        group = np.cumsum(np.append(True, part[1:] != part[:-1])) - 1
