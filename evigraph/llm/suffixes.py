"""Suffix arrays by induced sorting and permuted common prefixes, with numpy.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour. The leftmost S
suffixes (LMS) are sorted by their substrings, recursively where substrings repeat; all others
are induced from them in two linear sweeps. Where buckets of equal first letters are long, as in
text, a sweep takes a bucket at a time in array operations; where they are short, as in the strings
of names the recursion sorts, it takes an entry at a time. Both forms give the same order.
"""

from __future__ import annotations

import numpy as np

#: Mean bucket length from which a sweep takes a whole bucket at a time. It decides on speed only.
LONG_BUCKETS = 64
FEW = 12                # entries that are put in place one by one, as in runs of one letter


def _types(x: np.ndarray) -> np.ndarray:
    """True for S suffixes; the last suffix is a sentinel smaller than all and counts as S."""
    n = len(x)
    up = np.empty(n, dtype=bool)
    up[-1] = True
    up[:-1] = x[:-1] < x[1:]
    fixed = np.ones(n, dtype=bool)
    fixed[:-1] = x[:-1] != x[1:]
    at = np.where(fixed, np.arange(n), n)                   # equal neighbours take the next one's type
    return up[np.minimum.accumulate(at[::-1])[::-1]]


def _append(sa: np.ndarray, at: np.ndarray, who: np.ndarray, letters: np.ndarray, step: int) -> None:
    """Put ``who`` behind (step 1) or before (step -1) what their buckets hold, in order."""
    if len(who) < FEW:
        for c, suffix in zip(letters.tolist(), who.tolist()):
            sa[at[c]] = suffix
            at[c] += step
        return
    order = np.argsort(letters, kind="stable")
    letters, who = letters[order], who[order]
    counts = np.bincount(letters, minlength=len(at))
    rank = np.arange(len(who)) - (np.cumsum(counts) - counts)[letters]
    sa[at[letters] + step * rank] = who
    at += step * counts


def _sweep(x, sa, s_type, filled, first, size, step):
    """Induce L suffixes left to right (step 1) or S suffixes right to left (step -1).

    ``filled`` is how many entries at the far end of each bucket are there already.
    """
    letters = len(size)
    start = first.copy() if step > 0 else first + size - 1
    at = start.copy()
    induced_type = step < 0
    for c in range(letters) if step > 0 else range(letters - 1, -1, -1):
        if not size[c]:
            continue
        done = start[c]
        while done != at[c]:                                # entries of this bucket, as they come
            batch = sa[done:at[c]] if step > 0 else sa[at[c] + 1:done + 1][::-1]
            done = at[c]
            who = batch[batch > 0] - 1
            who = who[s_type[who] == induced_type]
            if len(who):
                _append(sa, at, who, x[who], step)
        if filled[c]:
            lo, hi = (first[c] + size[c] - filled[c], first[c] + size[c]) if step > 0 else (first[c], first[c] + filled[c])
            batch = sa[lo:hi] if step > 0 else sa[lo:hi][::-1]
            who = batch[batch > 0] - 1
            who = who[s_type[who] == induced_type]
            if len(who):
                _append(sa, at, who, x[who], step)


def _induce(x: np.ndarray, s_type: np.ndarray, lms: np.ndarray, letters: int) -> np.ndarray:
    """The order of all suffixes from LMS suffixes in the given order."""
    if len(x) < LONG_BUCKETS * letters:
        return _induce_by_entry(x, s_type, lms, letters)
    size = np.bincount(x, minlength=letters)
    first = np.cumsum(size) - size
    sa = np.zeros(len(x), dtype=np.int64)
    seeds = np.bincount(x[lms], minlength=letters)
    at = first + size - seeds
    _append(sa, at, lms, x[lms], 1)
    _sweep(x, sa, s_type, seeds, first, size, 1)
    larger = np.bincount(x[~s_type], minlength=letters)
    _sweep(x, sa, s_type, larger, first, size, -1)
    return sa


def _induce_by_entry(x: np.ndarray, s_type: np.ndarray, lms: np.ndarray, letters: int) -> np.ndarray:
    """As ``_induce``, an entry at a time; every sweep is one pass over the array."""
    size = np.bincount(x, minlength=letters)
    ends = np.cumsum(size)
    seeded = np.zeros(len(x), dtype=np.int64)
    _append(seeded, ends - np.bincount(x[lms], minlength=letters), lms, x[lms], 1)
    letter, smaller, sa = x.tolist(), s_type.tolist(), seeded.tolist()
    free = (ends - size).tolist()                           # next place of each bucket, from its front
    for suffix in sa:                                       # the loop meets what it has put ahead of itself
        if suffix and not smaller[suffix - 1]:
            bucket = letter[suffix - 1]
            sa[free[bucket]] = suffix - 1
            free[bucket] += 1
    free = (ends - 1).tolist()                              # and from its back
    for place in range(len(sa) - 1, -1, -1):
        suffix = sa[place]
        if suffix and smaller[suffix - 1]:
            bucket = letter[suffix - 1]
            sa[free[bucket]] = suffix - 1
            free[bucket] -= 1
    return np.array(sa, dtype=np.int64)


def _same_substrings(x: np.ndarray, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether the substrings of those lengths at ``a`` and ``b`` are equal, letter by letter."""
    same = n_a == n_b
    live, k = np.flatnonzero(same), 0
    while len(live):
        equal = x[a[live] + k] == x[b[live] + k]
        same[live[~equal]] = False
        live = live[equal]
        k += 1
        live = live[n_a[live] > k]
    return same


def suffix_array(x: np.ndarray, letters: int) -> np.ndarray:
    """Suffix array of ``x``, whose last value must be 0 and occur nowhere else."""
    if len(x) < 3:
        return np.argsort(x, kind="stable")
    x = x.astype(np.int64) if letters > 1 << 16 else x.astype(np.uint16)
    s_type = _types(x)
    is_lms = s_type.copy()
    is_lms[1:] &= ~s_type[:-1]
    is_lms[0] = False
    lms = np.flatnonzero(is_lms)
    sa = _induce(x, s_type, lms, letters)
    order = sa[is_lms[sa]]                                  # LMS suffixes by their substrings
    length = np.zeros(len(x), dtype=np.int64)
    length[lms] = np.append(np.diff(lms) + 1, 1)
    a, b = order[:-1], order[1:]
    name = np.zeros(len(x), dtype=np.int64)
    name[order] = np.append(0, np.cumsum(~_same_substrings(x, a, b, length[a], length[b])))
    names = name[lms]
    if names.max(initial=0) + 1 < len(lms):
        order = lms[suffix_array(names, int(names.max()) + 1)]
    return _induce(x, s_type, order, letters)


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, zeros behind the end."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    return np.ndarray((len(data),), dtype="<u8", buffer=padded.tobytes(), strides=(1,))


def permuted_lcp(x: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common prefix of each suffix with its predecessor in the array, in text order.

    Only where the letters before the two suffixes differ is the prefix compared, eight bytes at
    a time; at other positions it is one less than at the position before. Also the predecessors.
    """
    n = len(x)
    before = np.zeros(n, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    position = np.arange(n)
    left = np.where((position > 0) & (before > 0), x[position - 1] == x[before - 1], False)
    left[sa[0]] = False
    own = np.flatnonzero(~left)
    words = words_at(x.astype(np.uint8))
    found = np.zeros(len(own), dtype=np.int64)
    live, k = np.flatnonzero(own != sa[0]), 0
    while len(live):
        i, j = own[live] + k, before[own[live]] + k
        inside = (i < n) & (j < n)
        live, i, j = live[inside], i[inside], j[inside]
        differ = words[i] ^ words[j]
        low = differ & (~differ + np.uint64(1))
        bits = np.zeros(len(differ), dtype=np.int64)
        some = differ != 0
        bits[some] = np.bitwise_count(low[some] - np.uint64(1)).astype(np.int64) // 8
        bits[~some] = 8
        found[live] += bits
        live = live[~some]
        k += 8
    last = np.maximum.accumulate(np.where(left, -1, position))
    at = np.zeros(n, dtype=np.int64)
    at[own] = found
    return np.maximum(0, at[last] - (position - last)), before
