"""Immutable fingerprint filters built by peeling (three-wise xor filters)."""

from __future__ import annotations

import numpy as np

#: Bits of a fingerprint: a filter wrongly says "seen" of one key in 2^BITS.
BITS = 16
_STRUCT = np.dtype([("seed", "<u8"), ("block", "<u8")])


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer over keys and a seed."""
    x = keys + np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(keys: np.ndarray, seed: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Three slots of each key, one in each third of the table, and its fingerprint."""
    h = _mix(keys, seed)
    third = lambda r: ((((h << np.uint64(r)) | (h >> np.uint64(64 - r))) & np.uint64(0xFFFFFFFF)) * np.uint64(block)) >> np.uint64(32)
    h0 = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(block)) >> np.uint64(32)
    slots = np.stack([h0, third(21) + np.uint64(block), third(42) + np.uint64(2 * block)]).astype(np.int64)
    return slots, (_mix(h, 0x9E3779B97F4A7C15) & np.uint64((1 << BITS) - 1)).astype(np.uint16)


def build(keys: np.ndarray) -> bytes:
    """The filter of distinct 64-bit hashes ``keys``, about 1.23 x BITS bits a key.

    Keys that alone occupy one of their slots are peeled off, round by round;
    in reverse order each then sets that slot so that the xor of its three
    slots is its fingerprint. A seed whose peeling gets stuck is replaced.
    """
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    block = max(1, int(1.23 * n + 32) // 3 + 1)
    for seed in range(1, 1000):
        with np.errstate(over="ignore"):
            slots, prints = _places(keys, seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1, block)
        order = _peel(slots, 3 * block, n)
        if order is None:
            continue
        table = np.zeros(3 * block, np.uint16)
        for who, where in reversed(order):
            s = slots[:, who]
            table[where] = 0
            table[where] = prints[who] ^ table[s[0]] ^ table[s[1]] ^ table[s[2]]
        head = np.array([(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1, block)], _STRUCT)
        return head.tobytes() + table.tobytes()
    raise RuntimeError("no seed of a thousand could be peeled")


def _peel(slots: np.ndarray, size: int, n: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, their lone slots), or None if some keys never come free."""
    flat = slots.ravel()
    who = np.tile(np.arange(n), 3)
    count = np.bincount(flat, minlength=size)
    total = np.bincount(flat, weights=who, minlength=size).astype(np.int64)  # exact below 2^53: n is a shard's batch
    order, left = [], n
    lone = np.flatnonzero(count == 1)
    while left:
        if not len(lone):
            return None
        keys, first = np.unique(total[lone], return_index=True)
        order.append((keys, lone[first]))
        left -= len(keys)
        gone = slots[:, keys].ravel()
        np.subtract.at(count, gone, 1)
        np.subtract.at(total, gone, np.tile(keys, 3))
        touched = np.unique(gone)
        lone = touched[count[touched] == 1]
    return order


class Filter:
    """A sealed filter; ``has`` never misses a key it was built of."""

    def __init__(self, data: bytes):
        head = np.frombuffer(data[: _STRUCT.itemsize], _STRUCT)[0]
        self.seed, self.block = int(head["seed"]), int(head["block"])
        self.table = np.frombuffer(data, np.uint16, offset=_STRUCT.itemsize)

    def has(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            s, prints = _places(keys.astype(np.uint64), self.seed, self.block)
        return (self.table[s[0]] ^ self.table[s[1]] ^ self.table[s[2]]) == prints
