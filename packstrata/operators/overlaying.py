"""Operations on a namespace and on content, folded newest first; what they leave to do; what a crash leaves of their log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packstrata.operators.asof import asof, running_totals
from packstrata.operators.intervals import periods_and_gaps
from packstrata.operators.merging import overlay

PUTS, HIDES = ("create", "mkdir", "symlink", "mknod", "link"), ("unlink", "rmdir")
SETS, CLEARS = ("setattr", "setxattr"), ("removexattr",)


def namespace_after(base: DataFrame, ops: DataFrame, order: list[str]) -> DataFrame:
    """parent, name, inode, type of a namespace after ``ops``, whose ``order`` columns tell them apart.

    Every operation is one or two facts on names: create, mkdir, symlink, mknod
    and link put an inode at (parent, name), unlink and rmdir hide what is
    there, rename hides one name and puts its inode at (to_parent, to_name).
    Of the facts on a name the newest stands; a hidden name is a tombstone over
    the base. Other operations, and those without a parent or name, say nothing
    on names. Repeated operations change nothing.
    """
    fact = lambda parent, name, sub, kept: F.struct(parent.alias("parent"), name.alias("name"), F.lit(sub).alias("sub"), F.when(kept, F.col("inode")).alias("inode"), F.when(kept, F.col("type")).alias("type"))
    here, there, op = (F.col("parent"), F.col("name")), (F.col("to_parent"), F.col("to_name")), F.col("op")
    facts = (
        F.when(op.isin(*PUTS), F.array(fact(*here, 0, F.lit(True)))).when(op.isin(*HIDES), F.array(fact(*here, 0, F.lit(False))))
        .when(op == "rename", F.array(fact(*here, 0, F.lit(False)), fact(*there, 1, F.lit(True))))
    )
    rows = ops.select(F.struct(*order).alias("_at"), F.inline(facts)).where("parent is not null and name is not null")
    newest = rows.groupBy("parent", "name").agg(F.max(F.struct("_at", "sub", "inode", "type")).alias("_x")).select("parent", "name", "_x.inode", "_x.type")
    return overlay(base.select("parent", "name", "inode", "type"), newest, ["parent", "name"], F.col("inode").isNull())


def attributes_after(ops: DataFrame, order: list[str]) -> DataFrame:
    """inode, attr, value that setattr, setxattr and removexattr leave, the newest of each; removed ones are left out."""
    rows = ops.where(F.col("op").isin(*SETS, *CLEARS) & F.col("inode").isNotNull() & F.col("attr").isNotNull())
    best = F.max(F.struct(F.struct(*order).alias("_at"), F.col("op").isin(*SETS).alias("_set"), "value")).alias("_x")
    return rows.groupBy("inode", "attr").agg(best).where("_x._set").select("inode", "attr", "_x.value")


def disturbed_spans(refs: DataFrame, dirty: DataFrame) -> DataFrame:
    """inode, from_off, to_off to be chunked again: chunks (inode, off, llen) that meet a written range (inode, lo, hi), with the ranges.

    Ranges are first made disjoint; a chunk then meets one exactly if the last
    that begins before its end reaches beyond its start. No pair is tried.
    """
    runs = periods_and_gaps(dirty, ["inode"], "lo", "hi").where("kind = 'run'").select("inode", F.col("from_off").alias("_lo"), F.col("to_off").alias("_hi"))
    last = (F.col("off") + F.col("llen") - 1).alias("_last")
    met = asof(refs.where("llen > 0").select("inode", "off", last), "_last", runs, "_lo", ["_hi"], ["inode"], ["off"]).where("_hi > off")
    spans = met.select("inode", F.col("off").alias("lo"), (F.col("_last") + 1).alias("hi")).unionByName(runs.select("inode", F.col("_lo").alias("lo"), F.col("_hi").alias("hi")))
    return periods_and_gaps(spans, ["inode"], "lo", "hi").where("kind = 'run'").select("inode", "from_off", "to_off")


def longest_runs(log: DataFrame, session: str, order: list[Column], seq: str, good: str) -> DataFrame:
    """session, records, last_seq and torn of the run that recovery accepts: from the first record on, until one is not ``good`` or does not ascend.

    ``torn`` says that a bad record ended it. Up to the record that ends the
    run, the greatest number before is the number of the last one accepted.
    """
    placed = running_totals(log.withColumn("_one", F.lit(1)), [session], order, "_one", top=seq)
    ends = ~F.col(good) | F.coalesce(F.col(seq) <= F.col("top"), F.lit(False))
    told = placed.groupBy(session).agg(F.count(F.lit(1)).alias("_n"), F.max(seq).alias("_most"), F.min(F.when(ends, F.struct("place", "top", (~F.col(good)).alias("bad")))).alias("_stop"))
    stopped = F.col("_stop").isNotNull()
    return told.select(
        session, F.when(stopped, F.col("_stop.place") - 1).otherwise(F.col("_n")).alias("records"),
        F.when(stopped, F.col("_stop.top")).otherwise(F.col("_most")).alias("last_seq"), F.coalesce("_stop.bad", F.lit(False)).alias("torn"),
    )
