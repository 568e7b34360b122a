"""Which directories become catalogs of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packstrata.functions.scalar import ENTRY_WEIGHT
from packstrata.operators.hierarchy import Chains, forest
from packstrata.operators.namespace import own_weights


def peel(children: DataFrame, own: DataFrame, smax: int) -> DataFrame:
    """One level: child, peeled. ``children`` (parent, child, weight), ``own`` (parent, own).

    Children are taken largest first, ties by lowest number. Child k goes if
    what is left after the ones before it is still above ``smax`` and it
    weighs more than the entry that replaces it. Once a child stays, all after
    it stay, so the rule is a running sum.
    """
    w = Window.partitionBy("parent").orderBy(F.desc("weight"), "child")
    before = F.coalesce(F.sum(F.col("weight") - ENTRY_WEIGHT).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("weight").over(Window.partitionBy("parent"))
    rows = children.join(own, "parent").withColumns({"_b": before, "_t": total})
    return rows.select("parent", "child", "weight", ((F.col("own") + F.col("_t") - F.col("_b") > smax) & (F.col("weight") > ENTRY_WEIGHT)).alias("peeled"))


def split(edge: DataFrame, nodes: DataFrame, smax: int) -> DataFrame:
    """inode, weight (what stays with the directory), catalog (true of roots of catalogs) for every directory.

    A directory of several parents belongs to its smallest (parent, name). Only
    directories whose whole subtree exceeds ``smax`` can lose a child, so only
    they are walked, level by level from the deepest: which children go depends
    on what theirs have left. All others keep their subtree's weight, which
    doubling has found. Damaged directories (on or below a cycle) stay whole,
    with their own weight.
    """
    f = forest(edge)
    scratch = f.scratch
    own = scratch.keep(own_weights(edge, nodes).withColumnRenamed("w", "own"))
    damaged = f.damaged()
    sound = f.nodes.join(damaged, "node", "left_anti").select("node", F.col("_p").alias("up"))
    chains = Chains(sound.select("node", "up", F.lit("").alias("seg"), F.lit(False).alias("shared")), scratch, None)
    links = chains.table
    weights = chains.below(own.join(links.select("node"), "node").select("node", F.col("own").alias("w")))
    tree = links.select("node", "up").join(own, "node").join(weights, "node").join(chains.done.select("node", "dist"), "node")
    tree = scratch.keep(tree.select(F.col("node").alias("inode"), F.col("up").alias("parent"), "own", F.col("w").alias("weight"), F.col("dist").alias("level")))
    # every ancestor of a heavy directory is heavy too
    heavy = tree.where(F.col("weight") > smax).select("inode", "parent", "own", "level")
    light = tree.where(F.col("weight") <= smax).select("inode", "parent", "weight")
    deepest = heavy.agg(F.max("level")).first()[0]
    known, told = None, []
    for level in range(-1 if deepest is None else deepest, -1, -1):
        at = heavy.where(F.col("level") == level)
        child = light if known is None else light.unionByName(known)
        children = child.join(at.select(F.col("inode").alias("parent")), "parent", "left_semi").select("parent", F.col("inode").alias("child"), "weight")
        mine = at.select(F.col("inode").alias("parent"), "own")
        peeled = scratch.keep(peel(children, mine, smax))
        told.append(peeled.where("peeled").select(F.col("child").alias("inode")))
        kept = peeled.groupBy("parent").agg(F.sum(F.when(F.col("peeled"), F.lit(ENTRY_WEIGHT)).otherwise(F.col("weight"))).alias("_w"))
        now = mine.join(kept, "parent", "left").select(F.col("parent").alias("inode"), (F.col("own") + F.coalesce("_w", F.lit(0))).alias("weight")).join(at.select("inode", "parent"), "inode")
        known = scratch.keep(now if known is None else known.unionByName(now))
    result = light.select("inode", "weight") if known is None else light.select("inode", "weight").unionByName(known.select("inode", "weight"))
    result = result.unionByName(own.join(damaged, "node", "left_semi").select(F.col("node").alias("inode"), F.col("own").alias("weight")))
    roots = tree.where("parent is null").select("inode")
    for t in told:
        roots = roots.unionByName(t)
    return result.join(roots.distinct().withColumn("catalog", F.lit(True)), "inode", "left").withColumn("catalog", F.coalesce("catalog", F.lit(False)))
