"""Suffix arrays by induced sorting and permuted longest common prefixes, on NumPy arrays.

Induced sorting is a scan in which each entry places its left neighbour further on. It runs here in
blocks of entries that do not fill each other: with few symbols the filled part of a symbol's bucket,
else all entries up to the first place that the block itself fills. Entries of a block are dealt to
their buckets by counting, so every pass is linear.
"""

from __future__ import annotations

import numpy as np

#: Alphabets of fewer symbols are scanned symbol by symbol.
FEW = 2048
#: From this share of distinct names on, the recursion ends by doubling.
SETTLED = 0.35


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of integers >= 0 whose last is the only 0 (the sentinel)."""
    n = len(text)
    if n <= 2:
        return np.arange(n - 1, -1, -1)
    kinds = int(text.max()) + 1
    text = text.astype(np.uint16 if kinds < FEW else np.int32)
    small = _smaller(text)
    marks = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    tails = np.cumsum(np.bincount(text, minlength=kinds))
    induce = _induce_few if kinds < FEW else _induce_many
    # Substrings that begin at leftmost-smaller places, sorted by the same induction from unsorted ones.
    rough = induce(text, small, tails, marks)
    leftmost = np.zeros(n, bool)
    leftmost[marks] = True
    ordered = rough[leftmost[rough]]
    name = _names(text, marks, ordered)
    distinct = int(name.max()) + 1
    if distinct < len(marks):
        ordered = marks[_settle(name) if distinct >= SETTLED * len(marks) else suffix_array(name)]
    return induce(text, small, tails, ordered)


def _smaller(text: np.ndarray) -> np.ndarray:
    """Whether the suffix of each place is smaller than the next one: ruled by the next differing symbol."""
    n = len(text)
    less = text[:-1] < text[1:]
    differs = np.flatnonzero(text[:-1] != text[1:])  # the sentinel differs from what is before it
    until = np.diff(np.concatenate(([-1], differs)))
    return np.append(np.repeat(less[differs], until), np.ones(n - 1 - int(differs[-1]), bool))


def _names(text: np.ndarray, marks: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Numbers of the leftmost-smaller substrings in text order; equal ones, which are neighbours in the given order, alike."""
    length = np.empty(len(text), np.int32)
    length[marks] = np.append(np.diff(marks) + 1, 1)
    size = length[ordered]
    live = np.flatnonzero(size[1:] == size[:-1]) + 1
    new = np.ones(len(ordered), bool)
    at, before, left = ordered[live], ordered[live - 1], size[live]
    k = 0
    while len(live):
        same = text[at + k] == text[before + k]
        k += 1
        done = same & (left == k)
        new[live[done]] = False
        go = same & ~done
        live, at, before, left = live[go], at[go], before[go], left[go]
    name = np.empty(len(text), np.int32)
    name[ordered] = np.cumsum(new, dtype=np.int32) - 1
    return name[marks]


def _put_marks(sa: np.ndarray, text: np.ndarray, tails: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Writes the marks, in their order, to the ends of their symbols' buckets; how many each symbol has."""
    symbol = text[marks]
    by = _by(symbol, len(tails))
    counts = np.bincount(symbol, minlength=len(tails))
    sa[(tails - np.cumsum(counts))[symbol[by]] + np.arange(len(by))] = marks[by]
    return counts


def _by(symbol: np.ndarray, kinds: int) -> np.ndarray:
    """Stable order by symbol, by counting on 16 bits at a time."""
    if kinds <= 1 << 16:
        return np.argsort(symbol.astype(np.uint16), kind="stable")
    low = np.argsort((symbol & 0xFFFF).astype(np.uint16), kind="stable")
    return low[np.argsort((symbol[low] >> 16).astype(np.uint16), kind="stable")]


def _induce_few(text: np.ndarray, small: np.ndarray, tails: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """All suffixes in order, from leftmost-smaller ones in the given order within their first symbol."""
    n, kinds = len(text), len(tails)
    sa = np.empty(n, np.int32)
    marked = _put_marks(sa, text, tails, marks)
    heads = np.concatenate(([0], tails[:-1]))
    # What is left of each place: twice its symbol and whether it is a smaller one; the first place has none.
    left_of = np.empty(n, np.uint16)
    left_of[1:] = (text[:-1] << 1) | small[:-1]
    left_of[0] = 2 * kinds

    def deal(entry: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Left neighbours of the wanted kind by symbol, their symbols, and how many each symbol has."""
        left = left_of[entry]
        at = np.flatnonzero(((left & 1) == wanted) & (left < 2 * kinds))
        left = left[at] >> 1
        by = np.argsort(left, kind="stable")
        return entry[at[by]] - 1, left[by], np.bincount(left, minlength=kinds)

    filled = heads.copy()
    for c in range(kinds):
        a = int(heads[c])
        while a < filled[c]:
            b = int(filled[c])
            entry, symbol, counts = deal(sa[a:b], 0)
            sa[(filled - np.cumsum(counts) + counts)[symbol] + np.arange(len(entry))] = entry
            filled += counts
            a = b
        if marked[c]:
            entry, symbol, counts = deal(sa[int(tails[c] - marked[c]) : int(tails[c])], 0)
            sa[(filled - np.cumsum(counts) + counts)[symbol] + np.arange(len(entry))] = entry
            filled += counts
    larger, filled = filled, tails.copy()
    if kinds:
        filled[0] = tails[0] - 1  # the sentinel stays
    for c in range(kinds - 1, -1, -1):
        b = int(tails[c])
        while b > filled[c]:
            a = int(filled[c])
            entry, symbol, counts = deal(sa[a:b][::-1], 1)
            sa[(filled - 1 + np.cumsum(counts) - counts)[symbol] - np.arange(len(entry))] = entry
            filled -= counts
            b = a
        if larger[c] > heads[c]:
            entry, symbol, counts = deal(sa[int(heads[c]) : int(larger[c])][::-1], 1)
            sa[(filled - 1 + np.cumsum(counts) - counts)[symbol] - np.arange(len(entry))] = entry
            filled -= counts
    return sa


def _induce_many(text: np.ndarray, small: np.ndarray, tails: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The same for an alphabet that is too large to go through symbol by symbol."""
    n, kinds = len(text), len(tails)
    sa = np.full(n, -1, np.int32)
    _put_marks(sa, text, tails, marks)
    head = np.concatenate(([0], tails[:-1]))
    large = ~small
    a, size = 0, 4096
    while a < n:
        b = min(n, a + size)
        at, left, symbol = _lefts(sa[a:b], large, text)
        if len(left):
            target = _places(symbol, kinds, head, 1)
            first = int(target.min())
            if first < b:
                b = first
                fit = at < b - a
                left, target, symbol = left[fit], target[fit], symbol[fit]
                size = max(512, 2 * (b - a))
            sa[target] = left
            np.add.at(head, symbol, 1)
        if b == a + size:
            size *= 2
        a = b
    sa[small[sa]] = -1  # an empty place reads the sentinel, which is small
    sa[0] = n - 1
    tail = tails.copy()
    b, size = n, 4096
    while b > 0:
        a = max(0, b - size)
        at, left, symbol = _lefts(sa[a:b][::-1], small, text)
        if len(left):
            target = _places(symbol, kinds, tail - 1, -1)
            last = int(target.max())
            if last >= a:
                fit = at < b - 1 - last
                a = last + 1
                left, target, symbol = left[fit], target[fit], symbol[fit]
                size = max(512, 2 * (b - a))
            sa[target] = left
            np.subtract.at(tail, symbol, 1)
        if a == b - size:
            size *= 2
        b = a
    return sa


def _lefts(entry: np.ndarray, kind: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.flatnonzero(entry > 0)
    left = entry[at] - 1
    keep = kind[left]
    left = left[keep]
    return at[keep], left, text[left]


def _places(symbol: np.ndarray, kinds: int, edge: np.ndarray, way: int) -> np.ndarray:
    """Where entries go: to their symbol's edge, each further by the number of earlier entries with that symbol."""
    by = _by(symbol, kinds)
    ordered = symbol[by]
    where = np.arange(len(by))
    start = np.zeros(len(by), np.int64)
    start[1:] = np.where(ordered[1:] != ordered[:-1], where[1:], 0)
    target = np.empty(len(by), np.int64)
    target[by] = edge[ordered] + way * (where - np.maximum.accumulate(start))
    return target


def _refine(rank: np.ndarray, tied: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Ranks equal entries anew by their keys, in place; those that still have an equal."""
    old = rank[tied]
    order = np.lexsort((key, old))
    group, key = old[order], key[order]
    new_group = np.ones(len(order), bool)
    new_group[1:] = group[1:] != group[:-1]
    new = new_group.copy()
    new[1:] |= key[1:] != key[:-1]
    where = np.arange(len(order))
    begin = np.maximum.accumulate(np.where(new_group, where, 0))
    first = np.maximum.accumulate(np.where(new, where, 0))
    rank[tied[order]] = group + first - begin
    return tied[order[~(new & np.append(new[1:], True))]]


def _settle(name: np.ndarray) -> np.ndarray:
    """Suffix array of names of which few are equal: these are told apart by the ranks 1, 2, 4, ... places on."""
    m = len(name)
    counts = np.bincount(name)
    rank = (np.cumsum(counts) - counts)[name]
    tied, step = np.flatnonzero(counts[name] > 1), 1
    while len(tied):
        tied = _refine(rank, tied, np.where(tied + step < m, rank[np.minimum(tied + step, m - 1)], -1))
        step *= 2
    order = np.empty(m, np.int64)
    order[rank] = np.arange(m)
    return order


def permuted_prefixes(text: np.ndarray, sa: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    """For each place in text order the common prefix with its predecessor in the suffix array, up to `most` symbols.

    Pieces (starts, ends) are scanned side by side: a place's prefix is at least the one before it
    less 1, so each piece moves right only. Prefixes do not pass a piece's end.
    """
    before = np.empty(len(sa), np.int32)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    out = np.zeros(len(text), np.int64)
    length = ends - starts
    by = np.argsort(-length, kind="stable")
    starts, length = starts[by], length[by]
    have = np.zeros(len(starts), np.int64)
    for k in range(int(length[0]) if len(length) else 0):
        n = int(np.searchsorted(-length, -k, "left"))  # pieces longer than k
        place = starts[:n] + k
        other = before[place]
        have = np.maximum(have[:n] - 1, 0)
        limit = np.minimum(length[:n] - k, most)
        live = np.flatnonzero((other >= 0) & (have < limit))
        while len(live):
            same = text[place[live] + have[live]] == text[other[live] + have[live]]
            live = live[same]
            have[live] += 1
            live = live[have[live] < limit[live]]
        out[place] = have
    return out
