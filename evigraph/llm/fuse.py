"""Static binary-fuse filters over 64-bit keys, built and probed with numpy.

A filter holds one fingerprint byte per slot, about 1.13 slots per key. It answers "may be
present" for every key it was built from and for about one in 256 other keys; it never misses
a key. Filters are immutable: a snapshot gets its own, a later batch never changes it.
"""

from __future__ import annotations

import math

import numpy as np

_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys ^ np.uint64((int(seed) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def _shape(n: int) -> tuple[int, int]:
    """Segment length (a power of two) and number of segments a first slot may lie in."""
    if n < 2:
        return 4, 1
    length = 1 << min(18, max(2, int(math.log(n) / math.log(3.33) + 2.25)))
    slots = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
    return length, max(1, math.ceil(slots / length) - 2)


def _slots(h: np.ndarray, length: int, segments: int) -> np.ndarray:
    """The three slots of each key, in three consecutive segments."""
    mask = np.uint64(int(length) - 1)
    first = ((h >> np.uint64(32)) * np.uint64(int(length) * int(segments))) >> np.uint64(32)
    second = (first + np.uint64(int(length))) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * int(length))) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(24))) & np.uint64(0xFF)).astype(np.uint8)


def build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """``(seed, segment length, segments, slots)`` of the filter of ``keys``.

    Keys are peeled in rounds: all slots that hold one key give it up at once, which frees
    further slots. The rounds are then filled in reverse order.
    """
    keys = np.unique(np.asarray(keys, dtype=np.uint64))
    length, segments = _shape(len(keys))
    size = (segments + 2) * length
    for seed in range(1, 1000):
        h = _hash(keys, seed)
        slots = _slots(h, length, segments)
        load = np.bincount(slots.ravel(), minlength=size)
        held = np.zeros(size, dtype=np.int64)
        for row in slots:
            np.bitwise_xor.at(held, row, np.arange(len(keys)))
        rounds, ready, peeled = [], np.flatnonzero(load == 1), 0
        while len(ready):
            which, first = np.unique(held[ready], return_index=True)
            rounds.append((which, ready[first]))
            peeled += len(which)
            touched = slots[:, which]
            for row in touched:
                np.subtract.at(load, row, 1)
                np.bitwise_xor.at(held, row, which)
            ready = np.unique(touched)
            ready = ready[load[ready] == 1]
        if peeled == len(keys):
            break
        if seed % 20 == 0:      # small sets may not peel; a longer table always does in the end
            segments += 1
            size = (segments + 2) * length
    else:
        raise RuntimeError("no seed peels this key set")
    table, prints = np.zeros(size, dtype=np.uint8), _prints(h)
    for which, own in reversed(rounds):
        a, b, c = slots[:, which]
        table[own] = prints[which] ^ table[a] ^ table[b] ^ table[c]
    return seed, length, segments, table.tobytes()


def may_contain(keys: np.ndarray, seed: int, length: int, segments: int, table: bytes) -> np.ndarray:
    h = _hash(np.asarray(keys, dtype=np.uint64), seed)
    a, b, c = _slots(h, length, segments)
    slots = np.frombuffer(table, dtype=np.uint8)
    return slots[a] ^ slots[b] ^ slots[c] == _prints(h)
