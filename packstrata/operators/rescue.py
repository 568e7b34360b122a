"""Recovery of a volume whose references are lost, from backups in its packs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def candidates(backups: DataFrame) -> DataFrame:
    """Per branch the newest generation with verified backups (branch, generation, name, verified).

    One backup is recoverable; several of that generation are ambiguous and no
    name is chosen. Unverified backups count for nothing.
    """
    per = backups.where("verified").groupBy("branch", "generation").agg(F.count(F.lit(1)).alias("candidates"), F.min("name").alias("name"))
    best = per.groupBy("branch").agg(F.max(F.struct("generation", "candidates", "name")).alias("b")).select("branch", "b.*")
    alone = F.col("candidates") == 1
    return best.select("branch", "generation", "candidates", F.when(alone, "recoverable").otherwise("ambiguous").alias("verdict"), F.when(alone, F.col("name")).alias("name"))


def locate(roots: DataFrame, entries: DataFrame, complete: bool) -> DataFrame:
    """key, pack, state of each root: 'located', 'absent', or 'unknown' if not all packs could be read."""
    where = entries.groupBy("key").agg(F.min("pack").alias("pack"))
    state = F.when(F.col("pack").isNotNull(), "located").otherwise("absent" if complete else "unknown")
    return roots.join(where, "key", "left").select("key", "pack", state.alias("state"))
