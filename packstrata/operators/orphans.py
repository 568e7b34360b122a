"""References to records that do not exist, were deleted, or came later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packstrata.operators.asof import asof
from packstrata.operators.skew import BROADCAST_ROWS, skew_join
from packstrata.session import Scratch

#: Runs are built per block of so many keys, so that no task orders more than a block.
BLOCK_BITS = 16


def key_runs(parents: DataFrame, key: str, facts: list[str]) -> DataFrame:
    """Contiguous runs of integer keys with equal facts: _from, _to, facts.

    ``parents`` has unique non-null keys. Keys in sequence minus their rank is
    constant inside a run; ranks are taken per block of 2^BLOCK_BITS keys, so a
    longer run comes in pieces.
    """
    rows = parents.select(F.shiftright(key, BLOCK_BITS).alias("_block"), F.col(key).alias("_key"), *facts)
    w = Window.partitionBy("_block").orderBy("_key")
    new = F.lag("_key").over(w) != F.col("_key") - 1
    for f in facts:
        new = new | ~F.lag(f).over(w).eqNullSafe(F.col(f))
    rows = rows.withColumn("_new", F.coalesce(new, F.lit(True)).cast("long")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("_block", "_run").agg(F.min("_key").alias("_from"), F.max("_key").alias("_to"), *(F.first(f).alias(f) for f in facts)).drop("_block", "_run")


def match_runs(references: DataFrame, key: str, runs: DataFrame, facts: list[str], by: list[str] = []) -> DataFrame:  # noqa: B006
    """Distinct non-null keys of ``references`` with the facts of the run that holds them, or with nulls and _held false.

    As-of match: each key takes the run (_from, _to, any width, keys of any
    ordered type) whose start precedes it, and lies beyond that run if it is
    above its end. Of runs that overlap the one that starts last decides.
    """
    got = asof(references, key, runs, "_from", ["_to", *facts], by)
    held = F.coalesce(F.col("_to") >= F.col(key), F.lit(False))
    return got.select(*by, key, held.alias("_held"), *(F.when(held, F.col(f)).alias(f) for f in facts))


def state_of(held: Column, alive: Column, born: Column, at: Column) -> Column:
    """'missing', 'deleted' or 'late' of a reference made at ``at``; null of one that is in order."""
    return (
        F.when(~held, "missing").when(~alive, "deleted")
        .when(F.coalesce(born > at, F.lit(False)), "late")
    )


FACTS = ["_alive", "_born"]


def integer_orphans(references: DataFrame, key: str, at: str, parents: DataFrame, floor: int | None = None) -> DataFrame:
    """``references`` whose integer ``key`` is an orphan, with its state.

    ``parents``: unique ``key``, _alive (boolean), _born (first generation).
    References with a null key refer to nothing and are no orphans; a null
    generation is never late.
    """
    return orphans(references, key, at, key_runs(parents, key, FACTS), [], floor)


def keyed_orphans(references: DataFrame, key: str, at: str, parents: DataFrame, floor: int | None = None) -> DataFrame:
    """As integer_orphans for keys of any ordered type (bytes, text), of which none is next to another."""
    return orphans(references, key, at, single_runs(parents, key), [], floor)


def single_runs(parents: DataFrame, key: str) -> DataFrame:
    """Every non-null key as a run of one: _from, _to, facts."""
    return parents.where(F.col(key).isNotNull()).select(F.col(key).alias("_from"), F.col(key).alias("_to"), *FACTS)


def orphans(references: DataFrame, key: str, at: str, runs: DataFrame, by: list[str], floor: int | None = None) -> DataFrame:
    """``references`` whose ``key`` no run of the same ``by`` holds in good order, with their state.

    Tables told apart by ``by`` are matched in one pass, each with its own
    runs. Only keys that some reference finds wanting are joined back to the
    references. Runs jobs.
    """
    scratch = Scratch(references.sparkSession)
    refs, n = scratch.keep_counted(references.where(F.col(key).isNotNull()), F.lit(1))
    matched = match_runs(refs, key, runs, FACTS, by)
    first = refs.groupBy(*by, key).agg(F.min(at).alias("_first"))
    state = state_of(F.col("_held"), F.col("_alive"), F.col("_born"), F.col("_first"))
    suspect, few = scratch.keep_counted(matched.join(first, [*by, key]).where(state.isNotNull()).drop("_first"), F.lit(1))
    rows = refs.join(F.broadcast(suspect), [*by, key]) if few <= BROADCAST_ROWS else skew_join(refs, suspect, [*by, key], "inner", floor, n)
    return rows.withColumn("state", state_of(F.col("_held"), F.col("_alive"), F.col("_born"), F.col(at))).where("state is not null").drop("_held", *FACTS)
