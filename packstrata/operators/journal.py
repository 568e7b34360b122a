"""Write journals: standing operations, and the content map they leave."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packstrata.operators.skew import hot_bounds, listed_join, most_tiles, saturated_sum, skew_join, tile_of
from packstrata.session import Scratch, ship

PLACE, TRUNCATE, FORGET, ADOPT = 1, 2, 3, 4
HOLE = 5
END = (1 << 63) - 1
FIELDS = ("session_id", "seq", "op", "inode", "handle", "fileoff", "length", "recv_at")
KEYS = ["session_id", "inode"]


def whole() -> Column:
    """True of a journal row that carries everything its operation uses."""
    ok = lambda c: F.col(c).isNotNull() & (F.col(c) >= 0)
    return F.coalesce(
        F.col("inode").isNotNull() & F.col("session_id").isNotNull() & F.col("seq").isNotNull()
        & F.when(F.col("op") == PLACE, F.col("handle").isNotNull() & ok("fileoff") & ok("length"))
        .when(F.col("op") == TRUNCATE, ok("length"))
        .when(F.col("op") == FORGET, F.lit(True))
        .when(F.col("op") == ADOPT, F.col("handle").isNotNull() & ok("length")),
        F.lit(False),
    )


def standing(journal: DataFrame) -> DataFrame:
    """The one row that counts of each (session_id, seq): whole, and received last.

    Rows that are torn, of unknown op, or without session, seq or inode count
    for nothing. A null recv_at is earlier than any other; among rows received
    at the same instant the greatest (op, inode, handle, fileoff, length)
    stands, so the result never depends on the order of the file. Columns
    beyond the journal's own are ignored.
    """
    order = [F.col("recv_at").desc_nulls_last(), *(F.col(c).desc_nulls_last() for c in ("op", "inode", "handle", "fileoff", "length"))]
    # rank 1 of a window is also limited before the shuffle, so a key delivered very often is cheap
    newest = F.row_number().over(Window.partitionBy("session_id", "seq").orderBy(*order))
    return journal.select(*FIELDS).where(whole()).withColumn("_rank", newest).where("_rank = 1").drop("_rank", "recv_at")


def place_end() -> Column:
    return saturated_sum(F.col("fileoff"), F.col("length"))


def _resolve(rows: Iterable[tuple]) -> list[tuple[int, int, int]]:
    """Pieces (lo, hi, handle) that survive of operations given newest first.

    Operations are taken one by one and only until every byte is resolved.

    Every byte belongs to the first operation that names it: later ones of the
    list, which are older, only get what is still open. ``los``/``his`` hold
    the resolved ranges, disjoint and merged, so each operation is placed in
    logarithmic time plus what it absorbs.
    """
    los: list[int] = []
    his: list[int] = []
    out: list[tuple[int, int, int]] = []
    for lo, hi, handle in rows:
        if lo >= hi:
            continue
        i = bisect_right(los, lo) - 1
        if i < 0 or his[i] < lo:
            i += 1
        j, at, start, stop = i, lo, lo, hi
        while j < len(los) and los[j] <= hi:
            if los[j] < start:
                start = los[j]
            if handle is not None and at < los[j]:
                out.append((at, los[j], handle))
            if his[j] > at:
                at = his[j]
            j += 1
        if handle is not None and at < hi:
            out.append((at, hi, handle))
        if at > stop:
            stop = at
        los[i:j] = [start]
        his[i:j] = [stop]
        if start <= 0 and stop == END:
            break
    out.sort()
    joined: list[tuple[int, int, int]] = []
    for lo, hi, handle in out:
        if joined and joined[-1][1] == lo and joined[-1][2] == handle:
            joined[-1] = (joined[-1][0], hi, handle)
        else:
            joined.append((lo, hi, handle))
    return joined


class _Size:
    """Whether an inode is present, and its size, from its operations newest first, as they pass by."""

    def __init__(self) -> None:
        self.present: bool | None = None
        self.size, self.exact = 0, False

    def watch(self, ops: Iterable[tuple]) -> Iterator[tuple]:
        for op, off, length, handle in ops:
            if self.present is None:
                self.present = op != FORGET
            if not self.exact:
                if op == PLACE:
                    self.size = max(self.size, min(off + length, END))
                else:
                    self.size, self.exact = self.size if op == FORGET else max(self.size, length), True
            yield op, off, length, handle


def _ranges(ops: Iterable[tuple]) -> Iterator[tuple]:
    """Operations as ranges; a handle of None resolves bytes to nothing."""
    for op, off, length, handle in ops:
        if op == PLACE:
            yield off, min(off + length, END), handle
        elif op == TRUNCATE:
            yield length, END, None
        elif op == ADOPT:
            yield 0, length, handle
            yield 0, END, None
        elif op == FORGET:
            yield 0, END, None
        else:  # HOLE, an already clipped range
            yield off, min(off + length, END), None


def sizes_left(journal: DataFrame, keys: list[str], order: list[str], floor: int | None = None) -> DataFrame:
    """keys, present and length that the standing operations of each key leave, applied in ``order``.

    As ``_Size``, by aggregation: TRUNCATE and ADOPT set the length, FORGET
    resets it, and a PLACE after the last of these raises it to its end.
    """
    ops = standing(journal)
    at = F.struct(*order)
    last = ops.where(F.col("op") != PLACE).groupBy(*keys).agg(F.max(F.struct(at.alias("at"), "op", "length")).alias("_set"))
    told = skew_join(ops, last, keys, "left", floor)
    later = F.col("_set").isNull() | (at > F.col("_set.at"))
    exact = F.when(F.col("_set.op") != FORGET, F.col("_set.length"))
    found = told.groupBy(*keys).agg(F.max_by("op", at).alias("_op"), F.max(F.when((F.col("op") == PLACE) & later, place_end())).alias("_raised"), F.max(exact).alias("_exact"))
    return found.select(*keys, (F.col("_op") != FORGET).alias("present"), F.greatest(F.coalesce("_raised", F.lit(0)), F.coalesce("_exact", F.lit(0))).cast("long").alias("length"))


MAP_SCHEMA = "session_id long, inode long, file_size long, fileoff long, length long, handle long"
_ARROW = pa.schema([pa.field(c, pa.int64()) for c in ("session_id", "inode", "file_size", "fileoff", "length", "handle")])


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Groups of rows with equal first ``width`` columns of a sorted partition, each a stream; what is left of one is passed over."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for key, group in groupby(rows, key=itemgetter(*range(width))):
        yield key, (row[width:] for row in group)


def _emit(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    chunk: list[tuple] = []
    for row in rows:
        chunk.append(row)
        if len(chunk) == 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*chunk, strict=True)], schema=_ARROW)
            chunk = []
    if chunk:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*chunk, strict=True)], schema=_ARROW)


def _apply_inodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for (session, inode), ops in _groups(batches, 2):
            seen = _Size()
            pieces = _resolve(_ranges(seen.watch(ops)))
            if not seen.present:
                continue
            for lo, hi, handle in pieces:
                yield session, inode, seen.size, lo, hi - lo, handle
            if not pieces:
                yield session, inode, seen.size, 0, 0, 0

    return _emit(rows())


def _apply_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _apply_inodes for tiles of inodes; file_size carries the tile."""

    def rows() -> Iterator[tuple]:
        for (session, inode, tile), ops in _groups(batches, 3):
            for lo, hi, handle in _resolve(_ranges(ops)):
                yield session, inode, tile, lo, hi - lo, handle

    return _emit(rows())


def _in_order(df: DataFrame, keys: list[str], newest_first: list[str], columns: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *(F.desc(c) for c in newest_first)).select(*keys, *columns)


def content_map(journal: DataFrame, floor: int | None = None, tiles: int | None = None) -> DataFrame:
    """Extents and size of every inode its session's journal leaves behind.

    Newest-first resolution: the standing operations of an inode are taken
    backwards by seq; an operation gets only the bytes no newer one has
    resolved (the first image seen of a byte stands), and TRUNCATE, FORGET and
    ADOPT resolve bytes to nothing, as tombstones do. Work on an inode ends as
    soon as everything is resolved.

    Inodes of more operations than an average task takes are split into tiles
    of the byte range, as many as their operations fill tasks, at offsets and
    ends of operations. An operation goes to the tiles in which it begins or
    ends; of those that cover a tile wholly only the newest matters, which an
    aggregation with map-side combine finds. Pieces are joined again across
    tile borders. A task streams operations and holds only what an inode, or a
    tile of one, has resolved so far.

    Returns session_id, inode, file_size, fileoff, length, handle: a row for
    each contiguous piece of a handle; an inode present without extents has one
    row with zeros. Ends beyond the largest long are held there. Empty journals
    give no rows; see ``standing`` for what is ignored. Runs jobs while it is
    called.
    """
    ship(journal.sparkSession)
    scratch = Scratch(journal.sparkSession)
    ops, n = scratch.keep_counted(standing(journal).select(*KEYS, "seq", "op", F.coalesce("fileoff", F.lit(0)).alias("fileoff"), F.coalesce("length", F.lit(0)).alias("length"), "handle"), F.lit(1))
    begins = F.when(F.col("op") == PLACE, F.col("fileoff")).when(F.col("op") == TRUNCATE, F.col("length"))
    ends = F.when(F.col("op") == PLACE, place_end()).when(F.col("op") == ADOPT, F.col("length"))
    cuts = hot_bounds(ops, KEYS, {"_los": begins, "_his": ends}, floor, tiles, n)
    if cuts is None:
        return _in_order(ops, KEYS, ["seq"], ["op", "fileoff", "length", "handle"]).mapInArrow(_apply_inodes, MAP_SCHEMA)
    size = cuts.count()
    cuts = cuts.select(*KEYS, F.array_sort(F.array_union("_los", "_his")).alias("_cuts"))
    cold = listed_join(ops, cuts.select(*KEYS), size, KEYS, "left_anti")
    done = _in_order(cold, KEYS, ["seq"], ["op", "fileoff", "length", "handle"]).mapInArrow(_apply_inodes, MAP_SCHEMA)
    return done.unionByName(_hot_map(ops, cuts, size, scratch))


def _covers(first: Column, last: Column, leaves: int) -> Column:
    """The nodes of a binary tree over ``leaves`` tiles (a power of two; leaves are numbered from ``leaves``) that make up tiles first to last.

    At each level at most the leftmost and the rightmost node of what is left
    are taken; their parents span the rest.
    """
    found = []
    for k in range(leaves.bit_length()):
        lo, hi = F.shiftright(first + F.lit(leaves + (1 << k) - 1), k), F.shiftright(last + F.lit(leaves + 1), k)
        found += [F.when((lo < hi) & (lo % 2 == 1), lo), F.when((lo < hi) & (hi % 2 == 1), hi - 1)]
    return F.array_compact(F.array_distinct(F.array(*found)))


def _hot_map(ops: DataFrame, cuts: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    hot = listed_join(ops, cuts.select(*KEYS), size, KEYS, "left_semi")
    last = scratch.keep(hot.where(F.col("op") != PLACE).groupBy(*KEYS).agg(F.max(F.struct("seq", "op", "length")).alias("_set"), F.max(F.when(F.col("op").isin(FORGET, ADOPT), F.col("seq"))).alias("_reset")))
    # nothing from before the last FORGET or ADOPT is left
    hot = scratch.keep(listed_join(hot, last, size, KEYS, "left").where(F.col("_reset").isNull() | (F.col("seq") >= F.col("_reset"))).drop("_reset"))
    sizes = (
        hot.groupBy(*KEYS)
        .agg(
            F.max("seq").alias("_seq"), F.first("_set").alias("_set"),
            F.max(F.when((F.col("op") == PLACE) & (F.col("seq") > F.coalesce("_set.seq", F.lit(-END))), place_end())).alias("_raised"),
        )
        .where(F.col("_set").isNull() | (F.col("_set.op") != FORGET) | (F.col("_set.seq") < F.col("_seq")))
        .select(*KEYS, F.greatest(F.coalesce("_raised", F.lit(0)), F.when(F.col("_set.op") != FORGET, F.col("_set.length")).otherwise(0)).alias("file_size"))
    )

    # each operation as ranges: op, lo, hi; sub orders an ADOPT's extent above its hole
    span = lambda op, lo, hi, sub: F.struct(F.lit(op).alias("op"), lo.alias("lo"), hi.alias("hi"), F.lit(sub).alias("sub"))
    zero, end = F.lit(0).cast("long"), F.lit(END)
    ranges = (
        F.when(F.col("op") == PLACE, F.array(span(PLACE, F.col("fileoff"), place_end(), 1)))
        .when(F.col("op") == TRUNCATE, F.array(span(HOLE, F.col("length"), end, 0)))
        .when(F.col("op") == FORGET, F.array(span(HOLE, zero, end, 0)))
        .otherwise(F.array(span(PLACE, zero, F.col("length"), 1), span(HOLE, zero, end, 0)))
    )
    most = most_tiles(cuts, "_cuts")
    leaves = 1 << (most - 1).bit_length()
    # tile t is [cuts[t-1], cuts[t]) in positions from 0; the outer ones are open
    tile_lo = lambda t: F.when(t == 0, zero).otherwise(F.get("_cuts", t - 1))
    tile_hi = lambda t: F.coalesce(F.get("_cuts", t), end)
    first, final, from_first, to_final = F.col("_first"), F.col("_final"), F.col("_from_first"), F.col("_to_final")
    one = (first == final) & ~(from_first & to_final)
    spread = (
        listed_join(hot.select(*KEYS, "seq", "handle", F.inline(ranges)).where("lo < hi"), cuts, size, KEYS)
        .withColumns({"_first": tile_of(F.col("lo"), "_cuts", most), "_final": tile_of(F.col("hi") - 1, "_cuts", most)})
        .withColumns({"_from_first": F.col("lo") <= tile_lo(first), "_to_final": F.col("hi") >= tile_hi(final)})
    )
    ends = F.array_compact(F.array(F.when(~from_first | one, first), F.when(~to_final & (first != final), final)))
    partial = (
        spread.withColumn("tile", F.explode(ends))
        .withColumns({"lo": F.greatest("lo", tile_lo(F.col("tile"))), "hi": F.least("hi", tile_hi(F.col("tile")))})
        .select(*KEYS, "tile", "seq", "sub", "op", "lo", "hi", "handle")
    )
    # of what covers tiles wholly, the newest of each node of a tree over the tiles, and then of each tile
    newest = F.max(F.struct("seq", "sub", "op", "handle")).alias("_x")
    nodes = spread.select(*KEYS, "seq", "sub", "op", "handle", F.explode(_covers(F.when(from_first, first).otherwise(first + 1), F.when(to_final, final).otherwise(final - 1), leaves)).alias("_node")).groupBy(*KEYS, "_node").agg(newest)
    levels = F.array(*(F.shiftright(F.col("tile") + F.lit(leaves), k) for k in range(leaves.bit_length())))
    tiles = cuts.select(*KEYS, "_cuts", F.explode(F.sequence(F.lit(0), F.size("_cuts"))).alias("tile")).select(*KEYS, "tile", tile_lo(F.col("tile")).alias("lo"), tile_hi(F.col("tile")).alias("hi"), F.explode(levels).alias("_node"))
    fields = ["seq", "sub", "op", "lo", "hi", "handle"]
    whole_tiles = tiles.join(nodes, [*KEYS, "_node"]).groupBy(*KEYS, "tile", "lo", "hi").agg(F.max("_x").alias("_x")).select(*KEYS, "tile", "_x.seq", "_x.sub", "_x.op", "lo", "hi", "_x.handle")
    rows = partial.unionByName(whole_tiles)
    pieces = _in_order(rows.select(*KEYS, "tile", "seq", "sub", "op", "lo", (F.col("hi") - F.col("lo")).alias("len"), "handle"), [*KEYS, "tile"], ["seq", "sub"], ["op", "lo", "len", "handle"])
    pieces = scratch.keep(
        pieces.select(*KEYS, F.col("tile").cast("long").alias("tile"), "op", "lo", "len", "handle").mapInArrow(_apply_tiles, MAP_SCHEMA).withColumnRenamed("file_size", "tile")
    )

    # pieces that touch a border of their tile: at most two a tile
    at = listed_join(pieces, cuts, size, KEYS).withColumns({"_end": F.col("fileoff") + F.col("length"), "tile": F.col("tile").cast("int")})
    border = (F.col("fileoff") == tile_lo(F.col("tile"))) | (F.col("_end") == tile_hi(F.col("tile")))
    inner = at.where(~border).select(*KEYS, "fileoff", "length", "handle")
    w = Window.partitionBy(*KEYS).orderBy("fileoff")
    new = F.coalesce((F.lag("_end").over(w) != F.col("fileoff")) | (F.lag("handle").over(w) != F.col("handle")), F.lit(True))
    seams = (
        at.where(border).withColumn("_new", new.cast("long")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*KEYS, "_run").agg(F.min("fileoff").alias("fileoff"), F.sum("length").alias("length"), F.first("handle").alias("handle"))
        .select(*KEYS, "fileoff", "length", "handle")
    )
    found = listed_join(inner.unionByName(seams), sizes, size, KEYS)
    bare = sizes.join(pieces.select(*KEYS).distinct(), KEYS, "left_anti").withColumns({c: F.lit(0).cast("long") for c in ("fileoff", "length", "handle")})
    columns = [*KEYS, "file_size", "fileoff", "length", "handle"]
    return found.select(*columns).unionByName(bare.select(*columns))
