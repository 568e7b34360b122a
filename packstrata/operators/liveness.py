"""Which bytes of which packs are still referenced, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packstrata.functions.scalar import live_fraction, pack_time_ns
from packstrata.operators.hierarchy import Forest
from packstrata.session import Scratch


def reachable(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes (id) that can be reached from ``roots`` (id) over links (src, dst), the roots themselves among them.

    Links are followed by the jumps of pointer doubling, so in as many rounds
    as the depth has bits. Nodes that several links lead to are visited once
    and cycles end. Null links and roots lead nowhere. Runs jobs.
    """
    scratch = Scratch(links.sparkSession)
    rows = links.select(F.col("src").alias("_p"), F.col("dst").cast("string").cast("binary").alias("_name"), F.col("dst").alias("_c")).dropna().distinct()
    f = Forest(*scratch.keep_counted(rows, F.lit(1)), scratch)
    met = scratch.keep(f.descendants(roots.select(F.col("id").alias("node")).dropna()))
    ends = f.rows.join(met.select(F.col("node").alias("_p")), "_p", "left_semi").select(F.col("_c").alias("node"))
    return met.unionByName(ends).distinct().select(F.col("node").alias("id"))


class NothingLive(ValueError):
    """A sweep that would delete everything: with no live reference at all, something failed to be read."""


def refuse_empty(live: DataFrame) -> DataFrame:
    """``live`` itself, unless it has no row: then everything would count as garbage."""
    if live.limit(1).count() == 0:
        raise NothingLive("no live reference: the sweep is refused")
    return live


def pack_liveness(placements: DataFrame, live: DataFrame, always: Column | None = None) -> DataFrame:
    """Per pack: entries, bytes, live entries and bytes, and the live fraction.

    A referenced identity counts once however often it is referenced, and every
    placement of it is credited. ``always`` marks entries that are live
    whatever is referenced (backups). An empty ``live`` is refused.
    """
    ids = refuse_empty(live).select("key").dropna().distinct().withColumn("_live", F.lit(True))
    alive = F.coalesce("_live", F.lit(False)) | (F.coalesce(always, F.lit(False)) if always is not None else F.lit(False))
    found = placements.join(ids, "key", "left").withColumn("_alive", alive)
    out = found.groupBy("pack").agg(
        F.count(F.lit(1)).alias("entries"), F.sum("length").alias("bytes"),
        F.sum(F.col("_alive").cast("long")).alias("live_entries"), F.sum(F.when(F.col("_alive"), F.col("length")).otherwise(0)).alias("live_bytes"),
    )
    return out.withColumn("fraction", live_fraction(F.col("live_bytes"), F.col("bytes")))


def unresolved(placements: DataFrame, live: DataFrame) -> DataFrame:
    """Referenced identities that no pack holds."""
    return live.select("key").dropna().distinct().join(placements.select("key"), "key", "left_anti")


def fail_closed(packs: DataFrame, failures: int) -> DataFrame:
    """If anything could not be read, every pack counts as fully live."""
    if not failures:
        return packs
    return packs.withColumn("live_entries", F.col("entries")).withColumn("live_bytes", F.col("bytes")).withColumn("fraction", F.lit(1.0))


def repack_plan(packs: DataFrame, listed: DataFrame, now: int, grace: int, below: float = 0.5) -> DataFrame:
    """Packs worth rewriting: listed, live fraction strictly below the threshold, name time known and at least ``grace`` old.

    reclaim is what their removal frees, move what must be copied first.
    """
    ns = pack_time_ns(F.col("pack"))
    return (
        packs.join(listed.select(F.col("name").alias("pack"), "size").distinct(), "pack")
        .where((F.col("fraction") < below) & ns.isNotNull() & (ns <= F.lit((now - grace) * 1_000_000_000)))
        .select("pack", (F.col("size") - F.col("live_bytes")).alias("reclaim"), F.col("live_bytes").alias("move"))
    )


def plan_totals(plan: DataFrame, target: int) -> DataFrame:
    """One row: packs, move, reclaim and the number of new packs."""
    move = F.coalesce(F.sum("move"), F.lit(0))
    return plan.agg(F.count(F.lit(1)).alias("packs"), move.alias("move"), F.coalesce(F.sum("reclaim"), F.lit(0)).alias("reclaim"), F.ceil(move / target).cast("long").alias("into_packs"))


def ref_liveness(members: DataFrame, listed: DataFrame, condemned: DataFrame) -> DataFrame:
    """Per index or manifest (ref): its packs, those listed and not condemned, those gone, those condemned."""
    inside = members.join(listed.select("pack", F.lit(1).alias("_l")).distinct(), "pack", "left").join(condemned.select("pack", F.lit(1).alias("_c")).distinct(), "pack", "left")
    return inside.groupBy("ref").agg(
        F.count(F.lit(1)).alias("packs"), F.count_if(F.col("_l").isNotNull() & F.col("_c").isNull()).alias("live_packs"),
        F.count_if(F.col("_l").isNull() & F.col("_c").isNull()).alias("gone"), F.count_if(F.col("_c").isNotNull()).alias("condemned"),
    )


def collectable(objects: DataFrame, live: DataFrame, now: int, grace: int) -> DataFrame:
    """Objects (name, size, created in seconds or null) that no root needs, of known age, created at least ``grace`` ago. An empty ``live`` is refused."""
    return objects.join(refuse_empty(live).select("name").distinct(), "name", "left_anti").where(F.col("created").isNotNull() & (F.col("created") <= now - grace))


def space_report(objects: DataFrame, live: DataFrame, now: int, grace: int) -> DataFrame:
    """One row: scanned, retained, young, candidates and their bytes."""
    kept = objects.join(refuse_empty(live).select("name", F.lit(1).alias("_k")).distinct(), "name", "left")
    held, old = F.col("_k").isNotNull(), F.col("created").isNotNull() & (F.col("created") <= now - grace)
    return kept.agg(
        F.count(F.lit(1)).alias("scanned"), F.count_if(held).alias("retained"), F.count_if(~held & ~old).alias("young"),
        F.count_if(~held & old).alias("candidates"), F.coalesce(F.sum(F.when(~held & old, F.col("size"))), F.lit(0)).alias("bytes"),
    )


def retained_generations(published: DataFrame, branch: str, generation: str, keep: int, tags: DataFrame) -> DataFrame:
    """branch, generation, why of what must be kept: each branch's head, its last ``keep`` generations, and those tagged on any branch.

    ``published`` has a row for each generation of a branch, ``tags`` a
    generation each; head comes before last, last before tag, as the reason.
    """
    rows = published.select(branch, generation).dropna().distinct()
    rank = F.dense_rank().over(Window.partitionBy(branch).orderBy(F.desc(generation)))
    told = rows.withColumn("_r", rank).join(F.broadcast(tags.select(generation).dropna().distinct().withColumn("_tag", F.lit(True))), generation, "left")
    why = F.when(F.col("_r") == 1, "head").when(F.col("_r") <= keep, "last").when(F.col("_tag"), "tag")
    return told.select(branch, generation, why.alias("why")).where("why is not null")


def gc_plan(objects: DataFrame, live: DataFrame, ledger: DataFrame, relisted: DataFrame, now: int, grace: int) -> DataFrame:
    """name, size and verdict of every object: what a collection does with it.

    'live': a retained root needs it. 'ledger': condemned less than ``grace``
    seconds ago (``ledger``: name, at). 'unknown-age': its creation time cannot
    be told, so it is never deleted. 'young': created less than ``grace`` ago.
    'relisted': needed again by the list read just before deleting. Else
    'delete'. An empty ``live`` is refused.
    """
    flag = lambda df, c: df.select("name").dropna().distinct().withColumn(c, F.lit(True))
    told = objects.join(flag(refuse_empty(live), "_live"), "name", "left").join(flag(ledger.where(F.col("at") > now - grace), "_held"), "name", "left").join(flag(relisted, "_again"), "name", "left")
    verdict = (
        F.when(F.col("_live"), "live").when(F.col("_held"), "ledger").when(F.col("created").isNull(), "unknown-age")
        .when(F.col("created") > now - grace, "young").when(F.col("_again"), "relisted").otherwise("delete")
    )
    return told.select("name", "size", verdict.alias("verdict"))


def gc_report(plan: DataFrame, samples: int = 20) -> DataFrame:
    """verdict, objects, bytes and the first ``samples`` names in order (a capped sample, which is the feature) of a plan."""
    rank = F.row_number().over(Window.partitionBy("verdict").orderBy("name"))
    few = plan.withColumn("_r", rank).where(F.col("_r") <= samples).groupBy("verdict").agg(F.array_sort(F.collect_list("name")).alias("sample"))
    return plan.groupBy("verdict").agg(F.count(F.lit(1)).alias("objects"), F.sum("size").alias("bytes")).join(few, "verdict")
