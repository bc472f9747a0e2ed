"""Anchors: runs of bytes that deal the windows of a byte string into groups.

The anchor of a window of ``window`` bytes is the leftmost of its ``gram``-byte runs with the
smallest hash. It depends on the window's bytes alone, so equal windows anywhere have equal
anchors at the same place in them. The windows with the same anchor lie side by side, and every
window has exactly one, so a text is cut into ranges of windows without overlap.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power_table(name: str, base: int, n: int) -> np.ndarray:
    table = _powers.get(name)
    if table is None or len(table) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        table = np.multiply.accumulate(steps)
        if len(table) <= 1 << 20:
            _powers[name] = table
    return table[:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each position on that has as many."""
    n = len(data)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table("up", _BASE, n), out=total[1:])
    h = (total[gram:] - total[:n - gram + 1]) * _power_table("down", _INVERSE, n)[:n - gram + 1]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """The smallest value of every window of ``width`` values, from minima of blocks."""
    n = len(h)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = h
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def ranges(data: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``first, last, anchor, hash``: windows ``first`` to ``last`` have their anchor there."""
    width = window - gram + 1
    if len(data) < window:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, np.zeros(0, dtype=np.uint64)
    h = gram_hashes(data, gram)
    least = _window_minima(h, width)
    n = len(least)
    # of equal hashes the leftmost in the window counts: the next place of a hash, if it is near,
    # takes over when the place before it has left the window
    starts = np.append(0, np.flatnonzero(np.diff(least)) + 1)
    firsts, anchors = [], []
    ends = np.append(starts[1:], n).tolist()
    starts = starts.tolist()
    for start, end in zip(starts, ends):
        value = least[start]
        at = start + int(np.argmax(h[start:start + width] == value))
        firsts.append(start)
        anchors.append(at)
        while at < end - 1:
            firsts.append(at + 1)
            at += 1 + int(np.argmax(h[at + 1:at + 1 + width] == value))
            anchors.append(at)
    first, anchor = np.array(firsts, dtype=np.int64), np.array(anchors, dtype=np.int64)
    return first, np.append(first[1:] - 1, n - 1), anchor, h[anchor]
