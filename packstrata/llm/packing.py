"""Items of varying length into containers of fixed capacity."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packstrata.session import ship

CAPACITY = 2048
#: Items of a group, packed by one task on its own: the last container of a group is all that grouping can waste.
GROUP_ITEMS = 16_384


class Tournament:
    """Free room of containers under a tournament tree: each inner node has the most room below it."""

    def __init__(self, capacity: int, containers: int):
        self.capacity, self.used = capacity, 0
        self.leaves = 1 << max(0, (containers - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first container with room for ``size``, which it takes."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        room[at] -= size
        found = at - self.leaves
        self.used = max(self.used, found + 1)
        while at > 1:
            at //= 2
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """The container of each size, largest first, each to the first with room; and the number of containers.

    Equal sizes keep their order. No size may exceed ``capacity``.
    """
    tree = Tournament(capacity, max(1, len(sizes)))
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        out[i] = tree.place(sizes[i])
    return out, tree.used


_OUT = pa.schema([("key", pa.int64()), ("piece", pa.int64()), ("container", pa.int64()), ("first_token", pa.int64()), ("n_tokens", pa.int64())])


def _pack(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """Sorted (group, key, size) rows: a group at a time."""
    group, items = None, []

    def packed() -> pa.RecordBatch:
        rows, tails = [], []
        number = 0
        for key, size in items:
            whole = size // capacity
            for k in range(whole):
                rows.append((key, k, group << 32 | number, k * capacity, capacity))
                number += 1
            if size % capacity or not whole:
                tails.append((key, whole, size - whole * capacity))
        bins, _ = first_fit_decreasing([t[2] for t in tails], capacity)
        rows += [(key, k, group << 32 | (number + b), k * capacity, n) for (key, k, n), b in zip(tails, bins, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_OUT)

    for batch in batches:
        for g, key, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if g != group:
                if items:
                    yield packed()
                group, items = g, []
            items.append((key, size))
    if items:
        yield packed()


def pack(items: DataFrame, key: str, size: str, rows: int, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, seed: int = 17) -> DataFrame:
    """The container of every item: first-fit decreasing in randomised groups.

    A group is drawn by a seeded hash of the key, so that groups are alike in
    size and mix; each is packed on its own with a tournament tree over the
    room of its containers. ``rows``, the number of items, sets the number of
    groups. An item larger than ``capacity`` is split into full containers and
    a rest; no other is. Null sizes count as 0; items of size 0 take no room
    but have a container. Keys are longs; equal keys are packed as separate
    items; a null key is packed like any other.

    Returns key, piece (0 but for split items), container (a number unique
    over all groups), first_token and n_tokens, the item's part in it.
    """
    ship(items.sparkSession)
    groups = max(1, -(-rows // group_items))
    drawn = items.select(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(groups)).alias("_g"), F.col(key).cast("long").alias("key"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_size"))
    shuffled = drawn.repartition(groups, "_g") if groups > 1 else drawn.repartition(1)
    ordered = shuffled.sortWithinPartitions("_g", "key", "_size")
    out = ordered.mapInArrow(lambda b: _pack(b, capacity), "key long, piece long, container long, first_token long, n_tokens long")
    return out.withColumnRenamed("key", key)
