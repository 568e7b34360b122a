"""Objects of a folder, packs as files, operation plans as text, and reports of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def objects(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Every file below a folder: path, length, modified. Content is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "length", F.col("modificationTime").alias("modified"))


def write_packs(entries: DataFrame, folder: str, target_rows: int = 1_000_000) -> None:
    """Pack entries as files sorted by key, so that a lookup reads the row groups whose key range fits."""
    entries.repartitionByRange("key").sortWithinPartitions("key").write.option("maxRecordsPerFile", target_rows).parquet(folder)


def find_entries(spark: SparkSession, folder: str, key: bytes) -> DataFrame:
    """Entries of one key; the predicate reaches the scan's row-group statistics."""
    return spark.read.parquet(folder).where(F.col("key") == F.lit(key))


def parse_plan(lines: DataFrame, column: str = "value") -> DataFrame:
    """Operation plans 'op path key=value ...' as op, path and a map of arguments.

    Blank lines and lines that begin with '#' are left out; a line without a
    path has a null path. An argument without '=' has a null value.
    """
    line = F.trim(F.col(column))
    parts = F.split(line, r"\s+")
    rest = F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0)))
    pair: Column = F.map_from_entries(F.array_distinct(F.transform(rest, lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("k"), F.nullif(F.split_part(p, F.lit("="), F.lit(2)), F.lit("")).alias("v")))))
    kept = lines.where((F.length(line) > 0) & ~line.startswith("#"))
    return kept.select(F.get(parts, F.lit(0)).alias("op"), F.get(parts, F.lit(1)).alias("path"), pair.alias("args"))


def prefetched(df: DataFrame, size: str, budget: int) -> DataFrame:
    """Keep a table on the executors' disks; refused before a byte moves if its sizes exceed the budget."""
    from pyspark import StorageLevel

    total = df.agg(F.sum(size)).first()[0] or 0
    if total > budget:
        raise ValueError(f"{total} bytes exceed the budget of {budget}")
    return df.persist(StorageLevel.DISK_ONLY)


def report(df: DataFrame, name: str, **measures: Column):  # noqa: ANN201
    """df observed, and a function that gives the measures of its run as a dict once it has run."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, *(c.alias(k) for k, c in measures.items())), lambda: dict(seen.get)
