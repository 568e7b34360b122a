"""Views of the general tables as relations of the store, where no table of its own exists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packstrata.operators.hierarchy import tree_paths
from packstrata.plans.problems import R as PROBLEMS
from packstrata.session import Scratch
from packstrata.sources.tables import table

P2_SQL = PROBLEMS.sql["p2_found"]

#: Order of a lineitem within its order; the columns together are unique.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"]

CHUNKREF_SQL = """chunkref as (
  select l_orderkey inode, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) - 1 as bigint) idx,
    sha256(cast(l_partkey as varchar)) identity, cast(l_quantity as bigint) llen from lineitem)"""


def chunkrefs(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as the chunks of a file."""
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("inode"), (F.row_number().over(w) - 1).cast("long").alias("idx"),
        F.sha2(F.col("l_partkey").cast("string").cast("binary"), 256).alias("identity"), F.col("l_quantity").cast("long").alias("llen"),
    )


VERSIONS_SQL = """ver as (
  select user_id, event_id, ts, event_type, value, cast(date_diff('day', date '1970-01-01', cast(ts as date)) as bigint) gen,
    row_number() over (partition by user_id, cast(ts as date) order by ts desc, event_id desc) rn from events)"""


def day_versions(spark: SparkSession, d: str) -> DataFrame:
    """The newest event of each user and day: the rows that generation `day` of a table adds."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value", F.unix_date(F.col("ts").cast("date")).cast("long").alias("gen"))
    return newest(e, ["user_id", "gen"], ["ts", "event_id"])


def newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


ENTRY_SQL = f"""ent as (select p.path, e.parent, e.name, e.inode, e.type, e.generation from (select * from ({P2_SQL}) where state = 'tree') p join (select distinct * from edge) e on e.parent = p.parent and decode(e.name) = split_part(p.path, '/', -1))"""

# generations at quarters of those present: the fork, and the two heads
BRANCHES_SQL = f"""{ENTRY_SQL}, gens as (select generation g, row_number() over (order by generation) r, count(*) over () n from (select distinct generation from node)),
forks as (select max(g) filter (r <= (n + 1) // 2) base, max(g) filter (r <= (3 * n + 3) // 4) ours, max(g) theirs from gens),
at_gen as (select distinct generation, inode, length, mtime_ns from node),
base as (select path, parent, type kind, length len, mtime_ns body, e.inode from ent e, forks f join at_gen n on n.generation = f.base where n.inode = e.inode and e.generation <= f.base),
ours as (select path, parent, type kind, length len, mtime_ns body, e.inode from ent e, forks f join at_gen n on n.generation = f.ours where n.inode = e.inode and e.generation <= f.ours),
theirs as (select path, parent, case when type = 2 and starts_with(sha256(path), '0') then 3 else type end kind, length len, mtime_ns body, e.inode from ent e, forks f join at_gen n on n.generation = f.theirs where n.inode = e.inode and e.generation <= f.theirs)"""


def placed_entries(spark: SparkSession, d: str) -> DataFrame:
    """Sound entries with their path: path, parent, name, inode, type, generation. Runs jobs."""
    edge = table(spark, d, "edge")
    found = tree_paths(edge, order="generation").select("parent", F.element_at(F.split("path", "/"), -1).cast("binary").alias("name"), "path")
    return Scratch(spark).keep(edge.distinct().join(found, ["parent", "name"]).select("path", "parent", "name", "inode", "type", "generation"))


def branches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three states of one tree by path (path, parent, kind, len, body, inode): the fork, ours and theirs.

    A state has the entries published up to a generation whose inodes that
    generation's snapshot holds, with their length and mtime. The fork is half
    way through the generations, ours at three quarters, theirs the head.
    Theirs has made symlinks of one directory in sixteen (by a hash of the
    path), with all that lies below still there.
    """
    placed, node = placed_entries(spark, d), table(spark, d, "node").select("generation", "inode", "length", "mtime_ns")
    gens = sorted(r[0] for r in node.select("generation").distinct().collect())  # one number a generation
    n = len(gens)

    def state(generation: int, kind: Column) -> DataFrame:
        at = node.where(F.col("generation") == generation).drop("generation").distinct()
        return placed.where(F.col("generation") <= generation).join(at, "inode").select("path", "parent", kind.alias("kind"), F.col("length").alias("len"), F.col("mtime_ns").alias("body"), "inode")

    turned = F.when((F.col("type") == 2) & F.sha2(F.col("path").cast("binary"), 256).startswith("0"), 3).otherwise(F.col("type"))
    return state(gens[(n + 1) // 2 - 1], F.col("type")), state(gens[(3 * n + 3) // 4 - 1], F.col("type")), state(gens[-1], turned)
