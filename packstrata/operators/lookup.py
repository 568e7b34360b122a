"""Indexes over keys: newest wins, sampled windows, truncated keys, fallbacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packstrata.operators.asof import asof, positions

def newest_wins(tables: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Of the rows of each key, the values of the newest; ties take the greatest values. Combines before the shuffle."""
    best = F.max(F.struct(*order, *(F.col(v).alias(f"_{v}") for v in values))).alias("_b")
    return tables.groupBy(*keys).agg(best).select(*keys, *(F.col(f"_b._{v}").alias(v) for v in values))


def first_source(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of sources in order of preference: a key's rows come from the first source that has it, named in ``source``."""
    ranked = reduce(DataFrame.unionByName, [s.withColumn("source", F.lit(i)) for i, s in enumerate(sources)])
    best = ranked.groupBy(*keys).agg(F.min("source").alias("source"))
    return ranked.join(best, [*keys, "source"], "left_semi")


def sampled(table: DataFrame, key: str, every: int) -> DataFrame:
    """sample, place: every ``every``-th distinct key of the whole sorted table, the sparse index of it."""
    return positions(table, key).where(F.col("place") % every == 0).select(F.col(key).alias("sample"), "place")


def windows_of(probes: DataFrame, key: str, samples: DataFrame) -> DataFrame:
    """For each distinct probe the last sample not above it: where a search of the table begins. Null below the first."""
    return asof(probes, key, samples, "sample", ["sample", "place"])


def by_prefix(probes: DataFrame, key: str, index: DataFrame, entry: str, size: int = 12) -> DataFrame:
    """Join on the first ``size`` bytes, confirmed on the whole key: a hint of an index never decides."""
    left = probes.withColumn("_p", F.substring(key, 1, size))
    right = index.withColumn("_p", F.substring(entry, 1, size))
    return left.join(right, "_p").where(F.col(key) == F.col(entry)).drop("_p")


def located(keys: DataFrame, key: str, sources: list[tuple[str, DataFrame]], complete: bool) -> DataFrame:
    """Where each key is found: the first of the named sources that has it, else 'absent' (or 'unknown' if the sources are incomplete)."""
    out, where = keys, F.lit(None).cast("string")
    for name, source in reversed(sources):
        out = out.join(source.select(key).distinct().withColumn(f"_{name}", F.lit(True)), key, "left")
        where = F.when(F.col(f"_{name}"), name).otherwise(where)
    return out.select(key, F.coalesce(where, F.lit("absent" if complete else "unknown")).alias("found_in"))


def in_order(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Adds place, the rank of a row in its group; ties must be broken by ``order``."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long"))
