"""Referential and structural checks, one query a kind, united."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packstrata.functions.scalar import DIRECTORY, hex_of, is_hash_name, parse_hex
from packstrata.operators.hierarchy import hierarchy
from packstrata.session import Scratch


def _found(df: DataFrame, kind: str, subject: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), subject.cast("string").alias("subject"))


def overlaps(df: DataFrame, group: list[str], lo: str, length: str, tie: list[str]) -> DataFrame:
    """Rows that begin before an earlier one of their group has ended."""
    w = Window.partitionBy(*group).orderBy(lo, length, *tie).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_top", F.max(F.col(lo) + F.col(length)).over(w)).where(F.col("_top") > F.col(lo)).drop("_top")


def chain(df: DataFrame, number: str) -> DataFrame:
    """number, prev, adjacent (prev + 1), rises (above all before). One row for each number: a short list."""
    w = Window.orderBy(number)
    prev = F.lag(number).over(w)
    return df.select(
        number, prev.alias("prev"), F.coalesce(F.col(number) == prev + 1, F.lit(False)).alias("adjacent"),
        (F.max(number).over(w.rowsBetween(Window.unboundedPreceding, -1)) < F.col(number)).alias("rises"),
    )


def lost_ranges(df: DataFrame, group: str, seq: str) -> DataFrame:
    """Runs of sequence numbers that are missing between those present.

    Numbers are blocked so that no group is ordered in one task: gaps inside a
    block of 2^16, and gaps between the blocks' ends.
    """
    s = df.select(group, seq).dropna().distinct().withColumn("_b", F.shiftright(seq, 16))
    inner = s.select(group, F.lag(seq).over(Window.partitionBy(group, "_b").orderBy(seq)).alias("_p"), F.col(seq).alias("_n"))
    ends = s.groupBy(group, "_b").agg(F.min(seq).alias("_lo"), F.max(seq).alias("_hi"))
    outer = ends.select(group, F.lag("_hi").over(Window.partitionBy(group).orderBy("_b")).alias("_p"), F.col("_lo").alias("_n"))
    return inner.unionByName(outer).where(F.col("_n") > F.col("_p") + 1).select(group, (F.col("_p") + 1).alias("first_lost"), (F.col("_n") - 1).alias("last_lost"))


def out_of_order(df: DataFrame, group: list[str], place: str, key: str) -> DataFrame:
    """Rows whose key is not above that of the row before them in their group."""
    w = Window.partitionBy(*group).orderBy(place, key)
    return df.withColumn("_before", F.lag(key).over(w)).where(F.col("_before") >= F.col(key)).drop("_before")


def check(edge: DataFrame, nested: DataFrame, head: DataFrame, pack: DataFrame, pack_entry: DataFrame, ochunk: DataFrame) -> DataFrame:
    """kind and subject of everything that contradicts the relations, each once.

    Null references refer to nothing. Every kind is an anti-join or an
    aggregation on keys; there is no pairwise comparison.
    """
    keep = Scratch(edge.sparkSession).keep  # what several kinds read is made distinct once
    names = pack.select(F.col("name").alias("pack")).distinct()
    placed = keep(pack_entry.select("pack", "key", "off", "length", "type").distinct())
    keys = placed.select("key").distinct()
    chunks = keep(ochunk.select("identity", "pack", "off", "stored", "logical").distinct())
    entry = keep(edge.select("parent", "name", "inode", "type").distinct())
    nodes = head.select("inode", F.col("type").alias("_t")).distinct()
    catalogs = placed.where("type = 'catalog'").select(F.col("key").alias("catalog_identity")).distinct()
    where = nested.select("parent", "name", "catalog_identity").distinct()
    sizes = pack.groupBy(F.col("name").alias("pack")).agg(F.max("size").alias("size"))
    path = F.concat(F.col("parent").cast("string"), F.lit("/"), F.col("name").cast("string"))
    kinds = [
        _found(chunks.where("pack is not null").join(names, "pack", "left_anti"), "missing-pack", F.col("pack")),
        _found(placed.join(names, "pack", "left_anti"), "missing-pack", F.col("pack")),
        _found(pack.where("trailer_hash is null"), "pack-trailer", F.col("name")),
        _found(placed.groupBy("pack").agg(F.max(F.col("off") + F.col("length")).alias("used")).join(sizes, "pack").where("used > size"), "pack-size", F.col("pack")),
        _found(overlaps(placed.where("length > 0"), ["pack"], "off", "length", ["key"]), "pack-overlap", F.col("pack")),
        _found(where.where("catalog_identity is not null").join(catalogs, "catalog_identity", "left_anti"), "missing-catalog", hex_of(F.col("catalog_identity"))),
        _found(chunks.where(~(is_hash_name(F.col("identity")) & (F.length("identity") == 64))), "identity", F.col("identity")),
        _found(keys.where(F.length("key") != 32), "chunk-key", hex_of(F.col("key"))),
        _found(entry.where("inode is not null").join(nodes.select("inode"), "inode", "left_anti"), "dangling-entry", F.col("inode")),
        _found(entry.join(nodes, "inode").where("_t <> type"), "type-mismatch", F.col("inode")),
        _found(where.join(entry.select("parent", "name"), ["parent", "name"], "left_anti"), "transition", path),
        _found(entry.join(nodes.where(F.col("_t") != DIRECTORY).select(F.col("inode").alias("parent")), "parent", "left_semi"), "content", F.col("parent")),
        _found(chunks.where("pack is not null").withColumn("key", parse_hex(F.col("identity"), 32)).where("key is not null").join(keys, "key", "left_anti"), "missing-chunk", F.col("identity")),
        _found(chunks.where("logical < 0 or stored < 0 or off < 0"), "chunk", F.col("identity")),
    ]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out.distinct()


def structure(edge: DataFrame, head: DataFrame, pack: DataFrame, pack_entry: DataFrame, ochunk: DataFrame) -> DataFrame:
    """kind and subject of what contradicts the shape of the store, beside ``check``.

    cycle: a directory that a walk reaches more than once, being on a directed
    cycle or having several entries. missing-shard: a shard without a placement
    in a pack that is listed and not condemned. bad-shard, bad-catalog: a
    placement that cannot be read (key of other than 32 bytes, no length, or
    outside its pack). shard-routing: a file of several links without a record
    in the head. chunkrefs: a chunk whose stored length no placement in its
    pack has. Runs jobs while it is called.
    """
    entry = edge.select("parent", "name", "inode", "type").distinct()
    with_entries = edge.select(F.col("parent").alias("inode")).distinct()
    on_cycle = hierarchy(edge, order="generation").where("state = 'cycle'").select(F.col("parent").alias("inode"))
    several = entry.select("parent", "name", "inode").distinct().join(with_entries, "inode", "left_semi").groupBy("inode").count().where("count > 1").select("inode")
    placed = pack_entry.select("pack", "key", "off", "length", "type").distinct()
    sizes = pack.groupBy(F.col("name").alias("pack")).agg(F.max("size").alias("size"), F.max("condemned_at_unix").alias("dead"))
    known = placed.where("type in ('shard', 'catalog')").join(sizes, "pack", "left").withColumn("_listed", F.col("size").isNotNull() & F.col("dead").isNull())
    lost = known.where("type = 'shard'").groupBy("key").agg(F.max("_listed").alias("_held")).where("not _held")
    unreadable = known.where("octet_length(key) <> 32 or length <= 0 or off < 0 or off + length > size")
    linked = entry.where(F.col("type") != DIRECTORY).groupBy("inode").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 and inode is not null").select("inode")
    refs = ochunk.where("pack is not null").select("identity", "pack", "stored").distinct().withColumn("key", parse_hex(F.col("identity"), 32)).where("key is not null")
    held = refs.join(placed.select("pack", "key").distinct(), ["pack", "key"], "left_semi")
    kinds = [
        _found(on_cycle.unionByName(several), "cycle", F.col("inode")),
        _found(lost, "missing-shard", hex_of(F.col("key"))),
        unreadable.select(F.concat(F.lit("bad-"), "type").alias("kind"), hex_of(F.col("key")).alias("subject")),
        _found(linked.join(head.select("inode"), "inode", "left_anti"), "shard-routing", F.col("inode")),
        _found(held.join(placed.select("pack", "key", F.col("length").alias("stored")), ["pack", "key", "stored"], "left_anti"), "chunkrefs", F.col("identity")),
    ]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out.distinct()
