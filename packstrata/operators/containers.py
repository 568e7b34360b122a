"""Next-fit packing of ordered items, also of groups that no task could hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packstrata.operators.asof import asof, running_totals
from packstrata.operators.folds import next_fit, sequential_parts
from packstrata.operators.hierarchy import Chains
from packstrata.operators.skew import hot_keys, listed_join
from packstrata.session import Scratch


def ramp(target: int, first: int | None) -> list[int]:
    """Capacities of the first containers, which double from ``first`` until they are ``target``."""
    out, now = [], first or target
    while now < target:
        out.append(now)
        now *= 2
    return out


def containers(items: DataFrame, keys: list[str], order: list[str], size: str, target: int, first: int | None = None, floor: int | None = None) -> DataFrame:
    """``items`` with part: 1, 2, ... along ``order`` within each group of ``keys``.

    A container is closed by the first item that does not fit it any more; an
    item larger than a container has one of its own. With ``first`` the first
    container holds that much and each next one twice as much, up to
    ``target``. Null sizes count as 0, items of size 0 never open a container.
    ``order`` tells the rows of a group apart. Group columns are not null.

    Small groups stream through one task each. In a large one, where a
    container begins decides where the next one does; that next place is looked
    up for every item in running totals, and the chain of places that begins at
    the first item is followed by pointer doubling.
    """
    rows = items.withColumn("_size", F.coalesce(F.col(size).cast("long"), F.lit(0)))
    rows = Scratch(items.sparkSession).keep(rows)
    hot = hot_keys(rows, keys, floor)
    streamed = rows if hot is None else listed_join(rows, hot, hot.count(), keys, "left_anti")
    values = [c for c in rows.columns if c not in keys and c != "_size"] + ["_size"]
    done = sequential_parts(streamed, keys, order, values, next_fit(target, ramp(target, first))).drop("_size").select(*items.columns, "part")
    if hot is None:
        return done
    return done.unionByName(_chained(listed_join(rows, hot, hot.count(), keys, "left_semi"), keys, order, target, ramp(target, first)).select(*items.columns, "part"))


def _chained(rows: DataFrame, keys: list[str], order: list[str], target: int, early: list[int]) -> DataFrame:
    scratch = Scratch(rows.sparkSession)
    # places of items that take room; others belong to what is open before them
    placed = scratch.keep(running_totals(rows.where("_size > 0").select(*keys, *order, "_size"), keys, [F.col(c) for c in order], "_size"))
    ends = placed.select(*keys, F.col("total").alias("_end"), "place")

    def after(starts: DataFrame, capacity: int) -> DataFrame:
        """keys, place, next: where the container after the one that begins at ``place`` begins; null if none does."""
        limit = F.greatest(F.col("total") - F.col("_size") + F.lit(capacity), F.col("total"))
        found = asof(starts.select(*keys, "place", limit.alias("_limit")), "_limit", ends.withColumnRenamed("place", "_last"), "_end", ["_last"], keys, ["place"])
        return found.select(*keys, "place", (F.col("_last") + 1).alias("next"))

    most = placed.groupBy(*keys).agg(F.max("place").alias("_most"))
    starts = placed.where("place = 1").select(*keys, "place")
    begun = starts
    for capacity in early:
        starts = scratch.keep(after(placed.join(starts, [*keys, "place"], "left_semi"), capacity).join(most, keys).where("next <= _most").select(*keys, F.col("next").alias("place")))
        begun = begun.unionByName(starts)
    node = lambda place: F.struct(*keys, F.col(place).alias("place"))
    links = after(placed, target).join(most, keys).select(node("place").alias("node"), F.when(F.col("next") <= F.col("_most"), node("next")).alias("up"), F.lit("").alias("seg"), F.lit(False).alias("shared"))
    chain = Chains(links, scratch, None).above(starts.select(node("place").alias("node")))
    begun = scratch.keep(begun.unionByName(chain.select("node.*")).distinct().withColumn("_one", F.lit(1)))
    numbered = running_totals(begun.withColumnRenamed("place", "begin"), keys, [F.col("begin")], "_one").select(*keys, F.col("begin").alias("place"), F.col("total").alias("part"))
    at = placed.join(numbered, [*keys, "place"]).select(*keys, F.struct(*order).alias("_from"), "part")
    told = asof(rows.select(*keys, *order, F.struct(*order).alias("_at")), "_at", at, "_from", ["part"], keys, order)
    return rows.join(told.drop("_at"), [*keys, *order]).withColumn("part", F.coalesce("part", F.lit(1).cast("long")))


def packed(items: DataFrame, keys: list[str], order: list[str], size: str, **options: int) -> DataFrame:
    """``containers`` with off, where each item begins in its container."""
    parts = containers(items, keys, order, size, **options)
    totals = running_totals(parts.withColumn("_size", F.coalesce(F.col(size).cast("long"), F.lit(0))), [*keys, "part"], [F.col(c) for c in order], "_size")
    off: Column = F.col("total") - F.col("_size")
    return totals.select(*items.columns, "part", off.alias("off"))
