"""Trees against trees: three-way merge, differences, overlays, collisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packstrata.functions.scalar import conflict_name
from packstrata.operators.asof import positions
from packstrata.session import Scratch

#: A kind that holds others and is never decided as a unit.
DIRECTORY = 2


def _side(df: DataFrame, key: list[str], kind: str, content: list[str], name: str) -> DataFrame:
    return df.select(*key, F.struct(F.col(kind).alias("kind"), F.struct(*content).alias("body")).alias(name))


def decide(base: Column, ours: Column, theirs: Column, directory: int = DIRECTORY) -> tuple[Column, Column]:
    """Outcome and kind of conflict of one name in three trees; the first rule that holds decides.

    Sides are structs (kind, body), null where the name is absent.
    """
    b, o, t = base.isNotNull(), ours.isNotNull(), theirs.isNotNull()
    o_dir, t_dir = F.coalesce(ours["kind"] == directory, F.lit(False)), F.coalesce(theirs["kind"] == directory, F.lit(False))
    same, ours_base, theirs_base = ours.eqNullSafe(theirs), ours.eqNullSafe(base), theirs.eqNullSafe(base)
    both = (
        F.when(ours["kind"] != theirs["kind"], "conflict:type-change").when(o_dir, "descend").when(same, "same").when(~b, "conflict:add-add")
        .when(~ours_base & ~theirs_base, "conflict:both-modified").when(ours_base & ~theirs_base, "take-theirs").when(theirs_base & ~ours_base, "take-ours")
        .otherwise("conflict:both-modified")
    )
    one = lambda is_dir, side_base, take: F.when(is_dir, "descend").when(~b, take).when(~side_base, "conflict:modify-delete").otherwise("drop")
    verdict = F.when(o & t, both).when(o, one(o_dir, ours_base, "take-ours")).when(t, one(t_dir, theirs_base, "take-theirs")).otherwise("drop")
    return F.split_part(verdict, F.lit(":"), F.lit(1)), F.nullif(F.split_part(verdict, F.lit(":"), F.lit(2)), F.lit(""))


def three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: list[str], kind: str, content: list[str], directory: int = DIRECTORY) -> DataFrame:
    """key, outcome, conflict and taken (whose count it adds to: ours, theirs or none) of every name of three trees.

    Two full outer joins on the key. Only ``kind`` and ``content`` are compared.
    """
    all_ = _side(base, key, kind, content, "b").join(_side(ours, key, kind, content, "o"), key, "full").join(_side(theirs, key, kind, content, "t"), key, "full")
    outcome, conflict = decide(F.col("b"), F.col("o"), F.col("t"), directory)
    drop_side = F.when(F.col("o").isNotNull(), "theirs").otherwise("ours")
    taken = F.when(outcome == "take-ours", "ours").when(outcome == "take-theirs", "theirs").when(outcome == "drop", drop_side)
    return all_.select(*key, outcome.alias("outcome"), conflict.alias("conflict"), taken.alias("taken"))


def _folder(path: str) -> Column:
    """The path of the folder that holds ``path``, null if none does."""
    return F.when(F.contains(F.col(path), F.lit("/")), F.left(F.col(path), F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1))


def _folders_below(decided: DataFrame, path: str) -> DataFrame:
    """Folders (_dir) that are a change of type or below one.

    Only folders are spread over those above them, each as a pair of hashes:
    texts of all that lies above every path would be many times the tree. A
    pair of hashes that meets a change of type is then confirmed by the texts.
    Runs a job.
    """
    cut = decided.where("conflict = 'type-change'").select(F.xxhash64(path).alias("_k"), F.col(path).alias("_cut"))
    folders = Scratch(decided.sparkSession).keep(decided.select(_folder(path).alias("_dir")).dropna().distinct().withColumn("_h", F.xxhash64("_dir")))
    parts = F.split("_dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.xxhash64(F.concat_ws("/", F.slice(parts, 1, n))))
    # what is spread is estimated by the folders' file, so without the hint it would be broadcast
    met = folders.select("_h", F.explode(above).alias("_k")).hint("merge").join(cut, "_k").select("_h", "_cut")
    both = folders.join(met, "_h").where((F.col("_dir") == F.col("_cut")) | F.startswith("_dir", F.concat("_cut", F.lit("/"))))
    return both.select("_dir").distinct()


def below_conflicts(decided: DataFrame, path: str) -> DataFrame:
    """Paths below a change of type: a walk does not go there, so their decisions do not count."""
    return decided.select(path, _folder(path).alias("_dir")).join(_folders_below(decided, path), "_dir", "left_semi").select(path).distinct()


def walked(decided: DataFrame, path: str) -> DataFrame:
    """The decisions that a walk from the root comes to: none below a change of type."""
    return decided.withColumn("_dir", _folder(path)).join(_folders_below(decided, path), "_dir", "left_anti").select(*decided.columns)


def walked_counts(decided: DataFrame, path: str) -> DataFrame:
    """outcome, conflict and n: how many decisions a walk comes to. Summed by folder first, so that no path is moved."""
    per = decided.groupBy(_folder(path).alias("_dir"), "outcome", "conflict").agg(F.count(F.lit(1)).alias("_n"))
    return per.join(_folders_below(decided, path), "_dir", "left_anti").groupBy("outcome", "conflict").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"))


def merged(base: DataFrame, ours: DataFrame, theirs: DataFrame, path: str, kind: str, content: list[str], inode: str, directory: int = DIRECTORY, branch: str | None = None) -> DataFrame:
    """The rows of the merged tree: path, kind, content, inode, origin.

    Conflicts keep ours (nothing if ours is gone), and below a change of type
    ours stays as it is, so no file ever has entries below it. With ``branch``,
    the name of theirs, a conflict present on both sides, neither a directory,
    also keeps theirs under a name that says so, with a new inode above all of
    ours, numbered in order of path; origin is then 'theirs-kept'. A directory
    deleted on one side stays if the other side still has it.
    """
    scratch = Scratch(ours.sparkSession)
    plan = scratch.keep(three_way(base, ours, theirs, [path], kind, content, directory))
    plan = plan.join(below_conflicts(plan, path).withColumn("_below", F.lit(True)), path, "left")
    rows = lambda side, name: side.select(path, F.struct(kind, *content, inode).alias(name))
    all_ = plan.join(rows(ours, "_o"), path, "left").join(rows(theirs, "_t"), path, "left")
    outcome = F.when(F.col("_below"), "conflict").otherwise(F.col("outcome"))
    first = F.when(outcome == "take-theirs", F.col("_t")).when(outcome.isin("take-ours", "same", "conflict"), F.col("_o")).when(outcome == "descend", F.coalesce("_o", "_t"))
    origin = F.when(outcome == "take-theirs", "theirs").otherwise("ours")
    both = F.col("_below").isNull() & (F.col("outcome") == "conflict") & F.col("_o").isNotNull() & F.col("_t").isNotNull() & (F.col(f"_o.{kind}") != directory) & (F.col(f"_t.{kind}") != directory)
    out = all_.select(path, first.alias("row"), origin.alias("origin")).where("row is not null").select(path, "row.*", "origin")
    if branch is None:
        return out
    kept = scratch.keep(all_.where(both).select(path, "_t.*"))
    top = ours.agg(F.max(inode)).first()[0] or 0
    parts = F.split(F.col(path), "/")
    named = F.concat_ws("/", F.slice(parts, 1, F.size(parts) - 1), conflict_name(F.element_at(parts, -1), branch))
    fresh = kept.join(positions(kept, path), path).select(named.alias(path), kind, *content, (F.lit(top + 1) + F.col("place")).alias(inode), F.lit("theirs-kept").alias("origin"))
    return out.unionByName(fresh)


def fast_forward(heads: DataFrame) -> DataFrame:
    """``heads`` (name, base, ours, theirs: root hashes) with ``merge``: the side that is the merge without looking at any row, else null.

    Equal root hashes mean equal trees, so a side that has not moved on takes the other.
    """
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    return heads.withColumn("merge", F.when(same("ours", "theirs") | same("theirs", "base"), "ours").when(same("ours", "base"), "theirs"))


def difference(old: DataFrame, new: DataFrame, key: list[str], content: list[str], attributes: list[str]) -> DataFrame:
    """key, change (added, removed, changed), content (content differs), attr (attributes differ) between two trees; equal rows are left out."""
    pack = lambda df, n: df.select(*key, F.struct(F.struct(*content).alias("c"), F.struct(*attributes).alias("a")).alias(n))
    both = pack(old, "_x").join(pack(new, "_y"), key, "full")
    c, a = ~F.col("_x.c").eqNullSafe(F.col("_y.c")), ~F.col("_x.a").eqNullSafe(F.col("_y.a"))
    change = F.when(F.col("_x").isNull(), "added").when(F.col("_y").isNull(), "removed").when(c | a, "changed")
    return both.select(*key, change.alias("change"), c.alias("content"), a.alias("attr")).where("change is not null")


def overlay(base: DataFrame, delta: DataFrame, key: list[str], tombstone: Column) -> DataFrame:
    """Base rows that no delta row shadows, and delta rows that are no tombstones."""
    return base.join(delta.select(*key).distinct(), key, "left_anti").unionByName(delta.where(~tombstone), allowMissingColumns=True)


def collisions(ours: DataFrame, theirs: DataFrame, inode: str, cut: int) -> DataFrame:
    """Inodes at or above the fork's cut that both sides allocated."""
    return ours.select(inode).where(F.col(inode) >= cut).distinct().join(theirs.select(inode).distinct(), inode)


def merge_bases(forks: DataFrame, refs: DataFrame) -> DataFrame:
    """Per fork (name, base_hash) the ref (ref, kind, hash) that still names its base, tags before branches, then by name; null if none does.

    Refs without a hash could not be read and are passed over.
    """
    order = F.struct(F.when(F.col("kind") == "tag", 0).otherwise(1).alias("o"), F.col("ref"), F.col("kind"))
    best = refs.where(F.col("hash").isNotNull()).groupBy(F.col("hash").alias("base_hash")).agg(F.min(order).alias("_b"))
    return forks.join(best, "base_hash", "left").select("name", "base_hash", F.col("_b.ref").alias("ref"), F.col("_b.kind").alias("kind"))
