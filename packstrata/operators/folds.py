"""Rules that are sequential by nature: where a group begins decides where it ends."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packstrata.session import ship


def _numbered(batches: Iterator[pa.RecordBatch], width: int, begin: Callable, flags: bool = False) -> Iterator[pa.RecordBatch]:
    """Numbers the groups of each key in one pass; ``begin`` gets the state and a row's values and says if a group begins there. With ``flags``, that answer itself."""
    key, number, state = None, 0, None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        numbers = []
        for row in zip(*columns, strict=True):
            if row[:width] != key:
                key, number, state = row[:width], 0, None
            fresh, state = begin(state, *row[width:])
            number += bool(fresh)
            numbers.append(int(fresh) if flags else number)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], names=[*batch.schema.names, "part"])


def sequential_parts(df: DataFrame, keys: list[str], order: list[str], values: list[str], begin: Callable, flags: bool = False) -> DataFrame:
    """keys, values and part: 1, 2, ... as ``begin`` opens new parts along ``order`` within each key.

    ``begin(state, *values) -> (opens, state)`` with state None at the first
    row of a key; with ``flags``, part is 1 where it opens and else 0. Rows stream through sorted partitions; a task holds one
    state, not a group.
    """
    ship(df.sparkSession)
    kept = [*keys, *dict.fromkeys([*values])]
    ordered = df.repartition(*keys).sortWithinPartitions(*keys, *order).select(*kept)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields) + ", part long"
    return ordered.mapInArrow(lambda b: _numbered(b, len(keys), begin, flags), schema)


def next_fit(target: int, early: list[int] | None = None) -> Callable:
    """A container is closed by the first item that does not fit it; the last value is the size. The first containers hold ``early``."""
    early = early or []

    def begin(state, *row):  # noqa: ANN001, ANN202
        size = row[-1]
        if state is None:
            return True, (size, 0)
        used, closed = state
        if used > 0 and size > 0 and used + size > (early[closed] if closed < len(early) else target):
            return True, (size, closed + 1)
        return False, (used + size, closed)

    return begin


def spans(gap: int, most: int) -> Callable:
    """Reads (off, length) join the span before while the gap and the span's size allow."""

    def begin(state, off, length):  # noqa: ANN001, ANN202
        if state is not None:
            start, end = state
            if 0 <= off - end <= gap and off + length - start <= most:
                return False, (start, off + length)
        return True, (off, off + length)

    return begin


def skip_and_continue(room: int) -> Callable:
    """For ``flags``: an item is taken if it still fits; one that does not is passed over."""

    def begin(used, *row):  # noqa: ANN001, ANN202
        used = used or 0
        return (True, used + row[-1]) if used + row[-1] <= room else (False, used)

    return begin


def gap_islands(df: DataFrame, keys: list[str], off: str, length: str, gap: int) -> DataFrame:
    """Adjacent or near pieces joined, without a limit of size: a running maximum and a running count."""
    w = Window.partitionBy(*keys).orderBy(off, length)
    end = F.max(F.col(off) + F.col(length)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col(off) - end > gap, F.lit(True)).cast("long")
    runs = df.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_run").agg(F.min(off).alias("off"), F.max(F.col(off) + F.col(length)).alias("end"), F.count(F.lit(1)).alias("pieces")).drop("_run")
