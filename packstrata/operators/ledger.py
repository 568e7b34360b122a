"""Rules that walk a list newest first and stop: as windows, not loops.

A walk that stops at the first violation keeps exactly the rows at which no
row so far has violated, and until then its running total is the plain prefix
sum. So each rule is one ordered window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packstrata.operators.asof import running_totals

# Fixed values of the tiering rule: dust below which a run always merges, and the ceiling of a merge.
TIER_BASE = 256 << 10
TIER_TARGET = 64 << 20


def _running(group: list[str], order: list[Column]) -> Window:
    return Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def mergeable(refs: DataFrame, group: list[str], order: list[Column], size: str, base: int = TIER_BASE, target: int = TIER_TARGET) -> DataFrame:
    """Adds merges: the newest run of refs worth merging into one, if it has two or more.

    ``order`` is newest first. The newest ref always joins; an older one joins
    if it is no larger than all newer ones together, or the total is dust.
    """
    w = _running(group, order)
    before = F.sum(size).over(w) - F.col(size)
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    total = before + F.col(size)
    stop = (F.col(size) <= 0) | (total > target) | ((place > 1) & (F.col(size) > before) & (total > base))
    out = refs.withColumn("_stop", stop.cast("int")).withColumn("_stop", F.max("_stop").over(w))
    n = F.sum(F.when(F.col("_stop") == 0, 1).otherwise(0)).over(Window.partitionBy(*group))
    return out.withColumn("merges", (F.col("_stop") == 0) & (n >= 2)).drop("_stop")


def within_budget(rows: DataFrame, group: list[str], order: list[Column], cost: str, budget: int) -> DataFrame:
    """Adds fits: true along ``order`` up to the first row that exceeds the budget. Nothing after it fits. Costs are not negative."""
    return running_totals(rows, group, order, cost).withColumn("fits", F.col("total") <= budget).drop("place", "total")


def carried(prev: DataFrame, dropped: DataFrame, listed: DataFrame, now: int, grace: int) -> DataFrame:
    """The condemned rows (name, at) to carry: previous ones not listed again and younger than grace, then newly dropped names at ``now``."""
    old = prev.join(listed.select("name").distinct(), "name", "left_anti").where(F.lit(now) - F.col("at") < grace).groupBy("name").agg(F.max("at").alias("at"))
    new = dropped.where("name <> ''").select("name").distinct().join(listed.select("name").distinct(), "name", "left_anti").join(old, "name", "left_anti")
    return old.unionByName(new.withColumn("at", F.lit(now).cast("long")))


def last_generations(rows: DataFrame, branch: str, generation: str, keep: int) -> DataFrame:
    """The rows of the newest ``keep`` generations of each branch."""
    rank = F.dense_rank().over(Window.partitionBy(branch).orderBy(F.desc(generation)))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= keep).drop("_rank")


def evictable(entries: DataFrame, group: list[str], age: list[Column], size: str, excess: int, pinned: Column) -> DataFrame:
    """Adds evicted: oldest first, until at least ``excess`` bytes are freed; pinned entries are skipped."""
    sized = entries.withColumn("_free", F.when(pinned, 0).otherwise(F.col(size)).cast("long"))
    freed = running_totals(sized, group, [pinned.cast("int"), *age], "_free")
    return freed.withColumn("evicted", ~pinned & (F.col("total") - F.col("_free") < excess)).drop("place", "total", "_free")
