"""Intervals per entity: continuous periods and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packstrata.operators.skew import hot_bounds, listed_join, most_tiles, tile_of
from packstrata.session import Scratch


def periods_and_gaps(df: DataFrame, keys: list[str], lo: str, hi: str, floor: int | None = None, tiles: int | None = None) -> DataFrame:
    """Maximal continuous ranges (kind 'run') and the holes between them (kind 'gap').

    Starts and ends are ranked independently per entity. Where the start of
    rank k + 1 lies above the end of rank k, all k intervals begun so far have
    ended: a gap. Gap borders paired in rank order are the periods. Equal
    starts (or ends) are counted first and take a block of ranks, so repeated
    intervals cost one row each.

    The ranks of an entity with more intervals than an average task takes are
    built over tiles of its value range, as many as its intervals fill tasks: a
    running count within each tile plus the total of the tiles before it, so no
    entity needs to fit a task. ``df`` is written once; the size of entities
    and the cut points are taken from there.

    Intervals are half-open [lo, hi) over longs; touching ones are continuous.
    Rows with a null key, lo or hi, or lo >= hi cover nothing and are ignored.
    Returns keys, kind, from_off, to_off.
    """
    scratch = Scratch(df.sparkSession)
    rows, n = scratch.keep_counted(df.select(*keys, F.col(lo).cast("long").alias("_lo"), F.col(hi).cast("long").alias("_hi")).dropna().where("_lo < _hi"), F.lit(1))
    cuts = hot_bounds(rows, keys, {"_los": F.col("_lo"), "_his": F.col("_hi")}, floor, tiles, n)
    size = 0 if cuts is None else cuts.count()
    edges = (
        rows.select(*keys, F.inline(F.array(F.struct(F.lit(True).alias("_start"), F.col("_lo").alias("_at")), F.struct(F.lit(False).alias("_start"), F.col("_hi").alias("_at")))))
        .groupBy(*keys, "_start", "_at").agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = _ranks(edges, keys, cuts, size)

    # between ranks k and k + 1: the start that raises the count of starts above k, the end that raises the count of ends to k
    rank = F.when(F.col("_start"), F.col("_rank") - F.col("_n")).otherwise(F.col("_rank"))
    borders = (
        ranked.select(*keys, rank.alias("_k"), F.when(F.col("_start"), F.col("_at")).alias("_s"), F.when(~F.col("_start"), F.col("_at")).alias("_e"), (~F.col("_start") & F.col("_last")).alias("_last"))
        .groupBy(*keys, "_k").agg(F.max("_s").alias("_s"), F.max("_e").alias("_e"), F.max("_last").alias("_last"))
        .where((F.col("_s") > F.col("_e")) | (F.col("_e").isNull() & (F.col("_k") == 0)) | (F.col("_s").isNull() & F.col("_last")))
    )
    if cuts is not None:
        borders = scratch.keep(borders)  # read twice, and no larger than the result
    # the end of a period is that of the next border
    paired = _with_next_end(borders, keys, cuts, size)
    out = F.array(
        F.struct(F.lit("run").alias("kind"), F.col("_s").alias("from_off"), F.col("_next").alias("to_off")),
        F.struct(F.lit("gap").alias("kind"), F.col("_e").alias("from_off"), F.col("_s").alias("to_off")),
    )
    return paired.select(*keys, F.inline(F.filter(out, lambda x: x["from_off"].isNotNull() & x["to_off"].isNotNull())))


def _ranks(edges: DataFrame, keys: list[str], cuts: DataFrame | None, size: int) -> DataFrame:
    """Adds _rank, the count of starts (or ends) of the entity up to _at, and _last, true at the greatest _at."""
    group = [*keys, "_start"]
    if cuts is None:
        w = Window.partitionBy(*group).orderBy("_at")
        return edges.withColumns({"_rank": F.sum("_n").over(w), "_last": F.lead("_at").over(w).isNull()})
    most = max(most_tiles(cuts, "_los"), most_tiles(cuts, "_his"))
    own = cuts.select(*keys, F.inline(F.array(F.struct(F.lit(True).alias("_start"), F.col("_los").alias("_cuts")), F.struct(F.lit(False).alias("_start"), F.col("_his").alias("_cuts")))))
    tiled = listed_join(edges, own, size, group, "left").withColumn("_tile", tile_of(F.col("_at"), "_cuts", most))
    # totals of tiles of hot entities: about as many as there are shuffle partitions
    before = Window.partitionBy(*group).orderBy("_tile")
    totals = tiled.where(F.col("_cuts").isNotNull()).groupBy(*group, "_tile").agg(F.sum("_n").alias("_t"))
    totals = totals.select(*group, "_tile", F.sum("_t").over(before.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.lead("_tile").over(before).isNull().alias("_final"))
    w = Window.partitionBy(*group, "_tile").orderBy("_at")
    return (
        tiled.drop("_cuts").withColumns({"_rank": F.sum("_n").over(w), "_last": F.lead("_at").over(w).isNull()})
        .join(F.broadcast(totals), [*group, "_tile"], "left")
        .withColumns({"_rank": F.col("_rank") + F.coalesce("_before", F.lit(0)), "_last": F.col("_last") & F.coalesce("_final", F.lit(True))})
        .drop("_before", "_final", "_tile")
    )


def _with_next_end(borders: DataFrame, keys: list[str], cuts: DataFrame | None, size: int) -> DataFrame:
    """Adds _next, the end that the following border of the entity begins with."""
    if cuts is None:
        return borders.withColumn("_next", F.lead("_e").over(Window.partitionBy(*keys).orderBy("_k")))
    tiled = listed_join(borders, cuts.drop("_his"), size, keys, "left").withColumn("_tile", tile_of(F.coalesce("_s", "_e"), "_los", most_tiles(cuts, "_los")))
    heads = tiled.where(F.col("_los").isNotNull()).groupBy(*keys, "_tile").agg(F.min("_e").alias("_head"))
    after = Window.partitionBy(*keys).orderBy("_tile")
    heads = heads.select(*keys, "_tile", F.lead("_head").over(after).alias("_head"))
    local = F.lead("_e").over(Window.partitionBy(*keys, "_tile").orderBy("_k"))
    return (
        tiled.drop("_los").withColumn("_next", local).join(F.broadcast(heads), [*keys, "_tile"], "left")
        .withColumn("_next", F.coalesce("_next", "_head")).drop("_head", "_tile")
    )
