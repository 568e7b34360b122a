"""Keys that hold a large share of all rows.

A key is hot if it has more rows than the average task of a shuffle takes
(n rows by the session's number of shuffle partitions, at least HOT_FLOOR). So
there are never more hot keys than shuffle partitions, whatever the data, and
a key off the list fits a task as well as any other part does. The list and
the cut points of its keys are bounded by that setting, which is why they may
be held by the driver; they are broadcast up to BROADCAST_ROWS and joined with
salt beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packstrata.session import parallelism

#: A key with fewer rows than this never needs splitting, whatever its share.
HOT_FLOOR = 50_000
#: Tiles of a hot key if set (tests); else as many as its rows need.
TILES: int | None = None
#: Rows of a hot list that are broadcast; a longer one is joined with SALTS copies of its rows.
BROADCAST_ROWS = 100_000
SALTS = 32
#: Rows of a tile that are looked at to place the cut points.
SAMPLES = 64


def hot_floor(df: DataFrame, rows: int | None = None) -> int:
    """The rows an average task takes: a key of more is hot."""
    return max(HOT_FLOOR, (df.count() if rows is None else rows) // parallelism(df.sparkSession))


def _counted(df: DataFrame, keys: list[str], floor: int) -> list:
    """Hot keys with their rows; at most n / floor of them, no more than there are shuffle partitions."""
    return df.select(*keys).dropna().groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > floor).collect()


def hot_keys(df: DataFrame, keys: list[str], floor: int | None = None, rows: int | None = None, counted: DataFrame | None = None) -> DataFrame | None:
    """The keys of more than ``floor`` rows as a local DataFrame; None if there are none.

    Null keys are never hot: they match nothing and are not grouped by callers.
    ``rows``, if known, is the size of ``df``; ``counted``, if there is such a
    table, has its keys with their rows, _n.
    """
    if rows is not None and rows <= (HOT_FLOOR if floor is None else floor):
        return None
    floor = hot_floor(df, rows) if floor is None else floor
    found = _counted(df, keys, floor) if counted is None else counted.where(F.col("_n") > floor).select(*keys, "_n").collect()
    if not found:
        return None
    return df.sparkSession.createDataFrame([tuple(r)[:-1] for r in found], T.StructType([df.schema[k] for k in keys]))


def listed_join(df: DataFrame, few: DataFrame, size: int, keys: list[str], how: str = "inner") -> DataFrame:
    """Join of skewed ``df`` with a list of ``size`` rows: broadcast while it is small, else salted on both sides."""
    if size <= BROADCAST_ROWS:
        return df.join(F.broadcast(few), keys, how)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", floor: int | None = None, rows: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    """Join ``left`` with ``right``, whose ``keys`` are unique, whatever the skew of ``left``.

    Rows of the hot keys meet the few rows of ``right`` that have them; all
    others take the ordinary shuffled join. ``how`` is inner, left, left_semi
    or left_anti. ``rows`` and ``counted`` are as for ``hot_keys``, of ``left``.
    """
    hot = hot_keys(left, keys, floor, rows, counted)
    if hot is None:
        return left.join(right, keys, how)
    size = hot.count()
    few = right.join(F.broadcast(hot) if size <= BROADCAST_ROWS else hot, keys, "left_semi")
    cold = listed_join(left, hot, size, keys, "left_anti").join(right, keys, how)
    return listed_join(listed_join(left, hot, size, keys, "left_semi"), few, size, keys, how).unionByName(cold)


def hot_bounds(df: DataFrame, keys: list[str], values: dict[str, Column], floor: int | None = None, tiles: int | None = None, rows: int | None = None) -> DataFrame | None:
    """For each hot key, ascending cut points of every one of ``values``: an array column per name. None if no key is hot.

    A key gets as many tiles as its rows fill tasks. Cut points come from about
    SAMPLES rows a tile, taken by a hash of the row: they only say where work
    is cut, every row is worked on. They are collected, so that every later use
    of them is the same, also after a lost executor; together they are no more
    than twice the shuffle partitions for each of ``values``.
    """
    spark = df.sparkSession
    floor = hot_floor(df, rows) if floor is None else floor
    if rows is not None and rows <= floor:
        return None
    found = _counted(df, keys, floor)
    if not found:
        return None
    tiles = TILES if tiles is None else tiles
    fields = [df.schema[k] for k in keys]
    plan = spark.createDataFrame([(*tuple(r)[:-1], tiles or -(-r["_n"] // floor)) for r in found], T.StructType([*fields, T.StructField("_t", T.LongType())]))
    rate = max(1, floor // SAMPLES)
    sample = listed_join(df.where(F.pmod(F.xxhash64(*df.columns), F.lit(rate)) == 0), plan, len(found), keys).select(*keys, "_t", F.explode(F.array(*(F.struct(F.lit(n).alias("_v"), v.cast("long").alias("_x")) for n, v in values.items()))).alias("_s"))
    sample = sample.select(*keys, "_t", "_s.*").where("_x is not null")
    w = Window.partitionBy(*keys, "_v")
    placed = sample.withColumn("_b", F.floor((F.row_number().over(w.orderBy("_x")) - 1) * F.col("_t") / F.count(F.lit(1)).over(w)))
    cuts = placed.where("_b > 0").groupBy(*keys, "_v", "_b").agg(F.min("_x").alias("_x"))
    told = cuts.groupBy(*keys).agg(*(F.array_sort(F.collect_set(F.when(F.col("_v") == n, F.col("_x")))).alias(n) for n in values))
    empty = F.array().cast("array<long>")
    rows = plan.join(told, keys, "left").select(*keys, *(F.coalesce(n, empty).alias(n) for n in values)).collect()
    return spark.createDataFrame(rows, T.StructType([*fields, *(T.StructField(n, T.ArrayType(T.LongType())) for n in values)]))


def most_tiles(cuts: DataFrame, name: str) -> int:
    """The number of tiles of the key that has most."""
    return (cuts.agg(F.max(F.size(name))).first()[0] or 0) + 1


def tile_of(value: Column, cuts: str, tiles: int) -> Column:
    """The tile of ``value`` among the ascending cut points in array column ``cuts``; 0 where that is null.

    A binary search in jumps of halving width; ``tiles`` bounds the size of ``cuts``.
    """
    jumps = F.array(*(F.lit(1 << k) for k in reversed(range(max(1, tiles.bit_length())))))
    onward = lambda at, jump: F.when((at + jump <= F.size(cuts)) & (F.get(cuts, at + jump - 1) <= value), at + jump).otherwise(at)
    return F.coalesce(F.when(F.col(cuts).isNotNull(), F.aggregate(jumps, F.lit(0), onward)), F.lit(0))


def saturated_sum(a: Column, b: Column) -> Column:
    """a + b for non-negative longs, held at the largest long instead of overflowing."""
    return F.coalesce(F.try_add(a, b), F.when(a.isNotNull() & b.isNotNull(), F.lit((1 << 63) - 1)))
