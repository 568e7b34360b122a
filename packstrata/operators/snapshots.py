"""Consecutive full snapshots: what was added, removed or changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot_changes(df: DataFrame, key: list[str], snapshot: str, compare: list[str]) -> DataFrame:
    """Change events between each two consecutive snapshots.

    Gaps and islands over key and row image: rows of a key with the same image
    in consecutive snapshots form one validity interval. An interval's start is
    'changed' where the key's previous interval ends in the snapshot before,
    else 'added'; its end is 'removed' in the next snapshot where no interval
    of the key is adjacent. The first snapshot only opens intervals.

    Snapshots are the distinct non-null values of ``snapshot``, which need not
    be consecutive numbers. Images are compared by hash and value, null equal
    to null. Rows with a null key or snapshot are ignored; repeated rows count
    once; of rows that differ for one key and snapshot the greatest image
    counts. Returns snapshot, key, change.
    """
    rows = df.select(*key, F.col(snapshot).alias("_at"), *(F.col(c).alias(f"_v{i}") for i, c in enumerate(compare))).dropna(subset=[*key, "_at"])
    image = [f"_v{i}" for i in range(len(compare))]
    # a row for each snapshot: its number, and the snapshot after it
    order = Window.orderBy("_at")
    at = rows.select("_at").distinct()
    calendar = at.select("_at", F.lag("_at").over(order).alias("_before"), F.lead("_at").over(order).alias("_after"))
    rows = rows.distinct().withColumn("_hash", F.xxhash64(*image))
    w = Window.partitionBy(*key).orderBy("_at", *(F.col(c).asc_nulls_first() for c in image))
    # the last of equal (key, snapshot) stands
    kept = rows.withColumn("_later", F.lead("_at").over(w)).where(F.col("_later").isNull() | (F.col("_later") != F.col("_at"))).drop("_later")
    kept = kept.join(calendar, "_at")
    w = Window.partitionBy(*key).orderBy("_at")
    same = F.lag("_hash").over(w) == F.col("_hash")
    for c in image:
        same = same & F.lag(c).over(w).eqNullSafe(F.col(c))
    adjacent = F.coalesce(F.lag("_at").over(w) == F.col("_before"), F.lit(False))
    start = F.when(F.col("_before").isNull() | adjacent & same, F.lit(None)).when(adjacent, "changed").otherwise("added")
    gone = F.col("_after").isNotNull() & ~F.coalesce(F.lead("_at").over(w) == F.col("_after"), F.lit(False))
    events = F.array(
        F.struct(F.col("_at").alias(snapshot), F.col("_start").alias("change")),
        F.struct(F.when(F.col("_gone"), F.col("_after")).alias(snapshot), F.lit("removed").alias("change")),
    )
    return (
        kept.select(*key, "_at", "_before", "_after", start.alias("_start"), gone.alias("_gone"))
        .select(*key, F.inline(F.filter(events, lambda e: e[snapshot].isNotNull() & e["change"].isNotNull())))
        .select(snapshot, *key, "change")
    )
