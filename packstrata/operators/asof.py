"""As-of matches and positions over keys of any order, without a task that sees all keys.

Rows are ranged by key over as many parts as the session shuffles into, and
written once with the number of their part, so that a lost task cannot cut
anew. Work in a part is an ordered window; what a part needs of those before
it is one row a part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packstrata.session import Scratch, parallelism


def _ranged(rows: DataFrame, keys: list, scratch: Scratch) -> DataFrame:
    """``rows`` in ranges of ``keys``, with their part; equal keys share a part."""
    return scratch.keep(rows.repartitionByRange(parallelism(rows.sparkSession), *keys).withColumn("_part", F.spark_partition_id()))


def asof(probes: DataFrame, key: str, starts: DataFrame, start: str, payload: list[str], by: list[str] = [], carry: list[str] = []) -> DataFrame:  # noqa: B006
    """Each distinct non-null ``key`` of ``probes`` with ``payload`` of the greatest ``start`` at or below it.

    With ``by``, columns of both tables, keys and starts of each group are
    matched on their own; ``carry`` columns of the probes come along (they are
    part of what is distinct). Payload columns are null where no start is at or
    below the key. Null starts are ignored; of equal starts the greatest
    payload counts. ``key`` and ``start`` have one type, of any kind that has
    an order. Runs a job.
    """
    scratch = Scratch(probes.sparkSession)
    entry = F.struct(*by, F.col(start).alias("_at"), *payload)
    shape = starts.select(entry.alias("_r")).schema["_r"].dataType
    both = starts.where(F.col(start).isNotNull()).select(*by, F.col(start).alias("_k"), F.lit(0).alias("_side"), entry.alias("_r")).unionByName(
        probes.select(*by, *carry, F.col(key).alias("_k")).where("_k is not null").distinct().select(*by, *carry, "_k", F.lit(1).alias("_side"), F.lit(None).cast(shape).alias("_r")),
        allowMissingColumns=True,
    )
    rows = _ranged(both, [*by, "_k"], scratch)
    w = Window.partitionBy("_part").orderBy(*by, "_k", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    got = rows.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    # a row a part: the last start of the parts before
    ends = rows.where("_side = 0").groupBy("_part").agg(F.max("_r").alias("_end"))
    parts = probes.sparkSession.range(parallelism(probes.sparkSession)).select(F.col("id").cast("int").alias("_part")).join(ends, "_part", "left")
    before = parts.select("_part", F.last("_end", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    got = got.join(F.broadcast(before), "_part", "left").withColumn("_r", F.coalesce("_r", "_before"))
    for b in by:
        got = got.withColumn("_r", F.when(F.col(f"_r.{b}").eqNullSafe(F.col(b)), F.col("_r")))
    return got.select(*by, *carry, F.col("_k").alias(key), *(F.col(f"_r.{p}").alias(p) for p in payload))


def order_bytes(number: Column) -> Column:
    """Eight bytes of a long whose byte order is the order of the numbers."""
    return F.unhex(F.lpad(F.hex(number.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))


def positions(keys: DataFrame, key: str) -> DataFrame:
    """Each distinct non-null ``key`` with ``place``, its number from 0 in the order of all. Runs a job."""
    rows = _ranged(keys.select(key).dropna().distinct(), [key], Scratch(keys.sparkSession))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    own: Column = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return rows.withColumn("_own", own).join(F.broadcast(before), "_part").select(key, (F.col("_own") - 1 + F.col("_before")).cast("long").alias("place"))


def running_totals(rows: DataFrame, by: list[str], order: list[Column], value: str, top: str | None = None) -> DataFrame:
    """``rows`` with place (from 1) and total (of ``value`` up to and with the row) along ``order`` within each group of ``by``.

    With ``top``, also the greatest value of that column before the row, as
    top. Groups of any size, or all rows as one: rows are ranged by group and
    order, summed within their part, and get the sums of the parts before. Rows
    of equal order must be told apart by it. Runs a job.
    """
    ranged = _ranged(rows, [*by, *order], Scratch(rows.sparkSession))
    w = Window.partitionBy("_part", *by).orderBy(*order)
    most = F.max(F.col(top)) if top else F.max(F.lit(None).cast("long"))
    sums = ranged.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_t"), most.alias("_m"))
    # a row a group and part
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = sums.select("_part", *by, F.coalesce(F.sum("_n").over(before), zero).alias("_n"), F.coalesce(F.sum("_t").over(before), zero).alias("_t"), F.max("_m").over(before).alias("_m"))
    local = ranged.withColumns({"_own": F.row_number().over(w), "_sum": F.sum(value).over(w), "_most": most.over(w.rowsBetween(Window.unboundedPreceding, -1))}).alias("l")
    same = F.expr(" and ".join(f"l.`{c}` <=> s.`{c}`" for c in ["_part", *by]))
    told = [(F.col("l._own") + F.col("s._n")).cast("long").alias("place"), (F.col("l._sum") + F.col("s._t")).cast("long").alias("total")]
    if top:
        told.append(F.greatest("l._most", "s._m").alias("top"))
    return local.join(sums.alias("s"), same).select(*(F.col(f"l.{c}") for c in rows.columns), *told)
