"""Burrows-Wheeler transforms of string collections and their merge by interleave refinement.

A shard is a list of byte strings.  Its suffixes are sorted once and give its transform: of each
suffix, in order, the symbol before it.  Shards are merged without sorting a suffix again.  The
*interleave* says, for each place of the merged order, from which shard its suffix comes.  It
starts as one shard after the other, which is the order by no symbol at all; one refinement reads
the symbols of all shards in the present order and deals them out by symbol, which gives the
order by one symbol more (a suffix is its first symbol and a suffix whose place is known).

A boundary between neighbours that first shows in round *k* means a longest common prefix of
*k - 1*; after ``depth`` rounds the places without a boundary between them are the intervals of
suffixes that share their first ``depth`` bytes.
"""

from __future__ import annotations

import numpy as np


class Shard:
    """Sorted suffixes and transform of some strings; symbol 0 ends a string, byte b is b + 1."""

    def __init__(self, strings: list[bytes]):
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        self.count = len(strings)
        n = int(lengths.sum()) + len(strings)
        ends = np.cumsum(lengths + 1) - 1
        symbols = np.zeros(n, np.uint16)
        inner = np.ones(n, bool)
        inner[ends] = False
        symbols[inner] = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16) + np.uint16(1)
        self.owner = np.repeat(np.arange(len(strings)), lengths + 1)
        starts = ends - lengths
        self.offset = np.arange(n) - starts[self.owner]
        left = ends[self.owner] - np.arange(n)  # symbols before the end mark
        self.order = _sorted_suffixes(symbols, left)
        before = symbols[np.maximum(self.order - 1, 0)]
        before[self.offset[self.order] == 0] = 0
        self.transform = before
        self.left = left


def _sorted_suffixes(symbols: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Order of all suffixes, equal ones by place: ranks by 7 symbols, then doubled."""
    n = len(symbols)
    key = np.zeros(n, np.int64)
    wide = np.concatenate((symbols, np.zeros(8, np.uint16))).astype(np.int64)
    for k in range(7):
        key = (key << 9) | np.where(left >= k, wide[k : k + n], 0)
    h, most = 7, int(left.max(initial=0)) + 1
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1]))) if n else 0
        if h >= most or n == 0 or rank[order[-1]] == n - 1:
            return order
        ahead = np.zeros(n, np.int64)
        ok = np.flatnonzero(left >= h)
        ahead[ok] = rank[ok + h] + 1
        key = rank * (n + 1) + ahead
        h *= 2


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The merged order by the first ``depth`` symbols.

    Of each place: its shard, its place in the shard's own order, the length that the suffix
    there shares with the one before (``depth`` stands for that or more), its interval's number.
    """
    sizes = [len(s.transform) for s in shards]
    n = sum(sizes)
    z = np.repeat(np.arange(len(shards), dtype=np.uint8 if len(shards) < 256 else np.uint16), sizes)
    symbols = np.concatenate([s.transform for s in shards]) if shards else np.empty(0, np.uint16)
    marks = np.repeat(np.arange(len(shards), dtype=z.dtype), [s.count for s in shards])  # the end marks, in order
    group = np.zeros(n, np.int32)
    shared = np.full(n, depth, np.int32)
    if n:
        shared[0] = 0
    for k in range(depth):
        at = np.argsort(z, kind="stable")
        now = np.empty(n, np.uint16)
        now[at] = symbols
        order = np.argsort(now, kind="stable")
        z = z[order]
        z[: len(marks)] = marks
        first = now[order]
        g = group[order]
        new = np.empty(n, bool)
        new[:1] = True
        new[1:] = (first[1:] != first[:-1]) | (g[1:] != g[:-1])
        new[: len(marks)] = True  # every end mark is another symbol
        fresh = new & (shared > k)
        shared[fresh] = k
        group = np.cumsum(new, dtype=np.int32)
    if n:
        shared[0] = 0
    at = np.argsort(z, kind="stable")
    place = np.empty(n, np.int64)
    place[at] = np.concatenate([np.arange(s) for s in sizes]) if sizes else 0
    return z, place, shared, group


def repeated(strings: list[bytes], docs: np.ndarray, depth: int, shards: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of every ``depth``-byte substring that a string of a smaller document also holds."""
    parts = [list(range(s, len(strings), shards)) for s in range(min(shards, max(1, len(strings))))]
    built = [Shard([strings[i] for i in p]) for p in parts]
    z, place, shared, group = merge(built, depth)
    base = np.cumsum([0] + [len(b.order) for b in built])[:-1]
    suffix = np.concatenate([b.order for b in built])[base[z] + place] if len(z) else np.empty(0, np.int64)
    pick = lambda values: np.concatenate(values)[base[z] + suffix] if len(z) else np.empty(0, np.int64)
    owner = pick([np.array(p, np.int64)[b.owner] for p, b in zip(parts, built)])
    offset, left = pick([b.offset for b in built]), pick([b.left for b in built])
    first = np.flatnonzero(np.concatenate(([True], shared[1:] < depth))) if len(z) else np.empty(0, np.int64)
    if not len(first):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    size = np.diff(np.append(first, len(z)))
    doc = docs[owner]
    least = np.repeat(np.minimum.reduceat(doc, first), size)
    late = (doc > least) & (left >= depth)
    return owner[late], offset[late]
