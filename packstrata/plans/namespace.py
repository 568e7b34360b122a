"""Queries over the namespace relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packstrata.functions import scalar as S
from packstrata.functions.chunking import fixed_pieces
from packstrata.operators import namespace as N
from packstrata.operators.hierarchy import hierarchy
from packstrata.operators.journal import standing
from packstrata.operators.orphans import match_runs
from packstrata.plans.adapters import CHUNKREF_SQL, chunkrefs, newest
from packstrata.plans.problems import STANDING
from packstrata.plans.registry import Registry
from packstrata.sources.tables import table

R = Registry()
HEAD_SQL = "head as (select distinct * from node where generation = (select max(generation) from node))"
EDGE_SQL = "e as (select distinct parent, name, inode, type, generation from edge)"


def head(spark: SparkSession, d: str) -> DataFrame:
    node = table(spark, d, "node")
    return N.at_generation(node, N.head_of(node))


@R.query("lookup_name", f"""with {EDGE_SQL}, n as (select distinct parent, name, catalog_identity from nested)
select coalesce(e.parent, n.parent) as parent, coalesce(e.name, n.name) as name, e.inode, e.type, n.catalog_identity
from e full join n on e.parent = n.parent and e.name = n.name""")
def lookup_name(spark: SparkSession, d: str) -> DataFrame:
    return N.lookup(table(spark, d, "edge"), table(spark, d, "nested"))


@R.query("list_directory", f"""with {EDGE_SQL} select parent, name, inode, type, cast(row_number() over (partition by parent order by name) as bigint) as place from e""")
def list_directory(spark: SparkSession, d: str) -> DataFrame:
    return N.listing(table(spark, d, "edge"))


@R.query("nested_of_directory", "select parent, cast(count(*) as bigint) as n_nested, min(name) as first_name from (select distinct * from nested) group by parent")
def nested_of_directory(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nested").distinct().groupBy("parent").agg(F.count(F.lit(1)).alias("n_nested"), F.min("name").alias("first_name"))


@R.query("stat_inode", f"with {HEAD_SQL} select * from head")
def stat_inode(spark: SparkSession, d: str) -> DataFrame:
    return head(spark, d)


@R.query("time_travel", "select generation, cast(count(*) as bigint) as inodes, cast(sum(length) as hugeint)::bigint as bytes from (select distinct * from node) group by generation")
def time_travel(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "node").distinct().groupBy("generation").agg(F.count(F.lit(1)).alias("inodes"), F.sum("length").alias("bytes"))


@R.query("list_with_stat", f"""with {EDGE_SQL}, {HEAD_SQL} select e.parent, e.name, e.inode, h.type, h.mode, h.uid, h.gid, h.length, h.mtime_ns from e join head h on h.inode = e.inode""")
def list_with_stat(spark: SparkSession, d: str) -> DataFrame:
    return N.listing_with_stat(table(spark, d, "edge"), head(spark, d))


@R.query("directory_links", f"""with {EDGE_SQL} select parent, cast(2 + count(*) filter (type = 2) as bigint) as nlink, cast(count(*) as bigint) as entries from e group by parent""")
def directory_links(spark: SparkSession, d: str) -> DataFrame:
    return N.directory_links(table(spark, d, "edge"))


@R.query("is_empty_directory", f"""with {EDGE_SQL} select inode, not exists (select 1 from edge c where c.parent = e.inode) as is_empty from e where type = 2""")
def is_empty_directory(spark: SparkSession, d: str) -> DataFrame:
    e = N.entries(table(spark, d, "edge"))
    with_entries = e.select(F.col("parent").alias("inode")).distinct().withColumn("_has", F.lit(True))
    return e.where("type = 2").join(with_entries, "inode", "left").select("inode", F.col("_has").isNull().alias("is_empty"))


@R.query("resolve_path", """with recursive e as (select distinct parent, name, inode from edge),
loops(a, b) as (select parent, inode from e where inode in (select parent from e) union select l.a, e.inode from loops l join e on e.parent = l.b where e.inode in (select parent from e)),
bad as (select b from loops where a in (select a from loops where a = b) union select a from loops where a = b),
walk(root, inode, path) as (select parent, inode, '/' || decode(name) from e where parent not in (select inode from e)
  union all select w.root, e.inode, w.path || '/' || decode(e.name) from e join walk w on e.parent = w.inode where w.inode not in (select b from bad))
select w.root, w.path, w.inode from walk w where w.inode in (select parent from e)""")
def resolve_path(spark: SparkSession, d: str) -> DataFrame:
    """Root and path of every directory that has entries."""
    edge = table(spark, d, "edge")
    found = hierarchy(edge, order="generation").where("state = 'tree'").select("root", "path", "inode")
    return found.join(edge.select(F.col("parent").alias("inode")).distinct(), "inode", "left_semi").select("root", "path", "inode")


@R.query("paths_inside", """with p as (select distinct source path from documents where source is not null), r as (select distinct split_part(path, '/', 1) root from p)
select p.path, r.root from p join r on p.path = r.root or starts_with(p.path, r.root || '/')""")
def paths_inside(spark: SparkSession, d: str) -> DataFrame:
    """Which source lies below which subtree."""
    p = table(spark, d, "documents").where("source is not null").select(F.col("source").alias("path")).distinct()
    return N.inside(p, p.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("root")))


@R.query("owner_remap", f"with {HEAD_SQL} select inode, case uid when 0 then 65534 when 1001 then 2001 else uid end as uid, case gid when 5000 then 100 else gid end as gid from head")
def owner_remap(spark: SparkSession, d: str) -> DataFrame:
    return head(spark, d).select("inode", S.remapped(F.col("uid"), {0: 65534, 1001: 2001}).alias("uid"), S.remapped(F.col("gid"), {5000: 100}).alias("gid"))


@R.query("permitted", f"""with {HEAD_SQL}, b as (select inode, type, mode, case when uid = 1000 then mode >> 6 when gid in (1000, 5000) then mode >> 3 else mode end bits from head)
select inode, bits & 4 = 4 as may_read, bits & 2 = 2 as may_write, (mode & 73) <> 0 or type = 2 as root_may_execute from b""")
def permitted(spark: SparkSession, d: str) -> DataFrame:
    """What user 1000 of groups 1000 and 5000 may do, and what the superuser may execute."""
    rule = lambda who, want: S.permitted(F.col("uid"), F.col("gid"), F.col("mode"), who, (1000, 5000), want, F.col("type") == S.DIRECTORY)
    return head(spark, d).select("inode", rule(1000, 4).alias("may_read"), rule(1000, 2).alias("may_write"), rule(0, 1).alias("root_may_execute"))


@R.query("hash_names", """select name, regexp_matches(name, '^[0-9a-f]{32,}$') as is_hash from (select identity as name from ochunk union all select name from pack)""")
def hash_names(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "ochunk").select(F.col("identity").alias("name")).unionByName(table(spark, d, "pack").select("name"))
    return names.select("name", S.is_hash_name(F.col("name")).alias("is_hash"))


@R.query("node_types", f"""with {HEAD_SQL} select inode, case type when 1 then 'file' when 2 then 'directory' when 3 then 'symlink' when 4 then 'fifo' when 5 then 'block' when 6 then 'char' when 7 then 'socket' end as kind,
 mode | case type when 1 then 32768 when 2 then 16384 when 3 then 40960 when 4 then 4096 when 5 then 24576 when 6 then 8192 when 7 then 49152 end as full_mode from head""")
def node_types(spark: SparkSession, d: str) -> DataFrame:
    return head(spark, d).select("inode", S.type_name(F.col("type")).alias("kind"), F.col("mode").bitwiseOR(S.type_bits(F.col("type"))).alias("full_mode"))


@R.query("ref_names", "select distinct source as name, coalesce(regexp_matches(source, '^[A-Za-z0-9_][A-Za-z0-9._-]{0,127}$'), false) as valid from documents where source is not null")
def ref_names(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "documents").where("source is not null").select(F.col("source").alias("name")).distinct()
    return names.select("name", S.valid_ref_name(F.col("name")).alias("valid"))


@R.query("lineages", "select inode >> 40 as lineage, cast(count(distinct inode) as bigint) as inodes, max(inode) + 1 as next_inode from node where inode is not null group by 1")
def lineages(spark: SparkSession, d: str) -> DataFrame:
    """Inodes by lineage, and the next one to allocate in each."""
    n = table(spark, d, "node").where("inode is not null")
    return n.groupBy(S.lineage_of(F.col("inode")).alias("lineage")).agg(F.countDistinct("inode").alias("inodes"), (F.max("inode") + 1).alias("next_inode"))


@R.query("lease_live", """select holder, renewed_us, greatest(renewed_us, mtime_us) + 86400000000 > (select max(epoch_us(ts)) from events) as live
from (select user_id holder, max(case when event_type = 'click' then epoch_us(ts) end) renewed_us, max(epoch_us(ts)) mtime_us from events group by 1)""")
def lease_live(spark: SparkSession, d: str) -> DataFrame:
    """Leases (users) renewed (clicks) or touched within a day of the last event."""
    e = table(spark, d, "events").select(F.col("user_id").alias("holder"), "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    now = e.agg(F.max("at")).first()[0]
    leases = e.groupBy("holder").agg(F.max(F.when(F.col("event_type") == "click", F.col("at"))).alias("renewed_us"), F.max("at").alias("mtime_us"))
    return leases.select("holder", "renewed_us", (F.greatest("renewed_us", "mtime_us") + 86_400_000_000 > F.lit(now)).alias("live"))


@R.query("subtree_weights", f"""with recursive {EDGE_SQL}, {HEAD_SQL},
own as (select e.parent n, sum(200 + case when e.type = 1 and coalesce(h.length, 0) <= 2048 then coalesce(h.length, 0) else 0 end) w from e left join (select inode, length from head) h on h.inode = e.inode group by 1),
step as (select distinct parent a, inode b from e where inode in (select n from own)), reach(a, b) as (select a, b from step union select r.a, s.b from reach r join step s on r.b = s.a),
bad as (select a n from reach where a = b union select b from reach where a in (select a from reach where a = b)),
total as (select x.a n, sum(own.w) t from (select n a, n b from own union select a, b from reach) x join own on own.n = x.b group by 1)
select own.n as inode, cast(own.w as bigint) as own, cast(case when own.n in (select n from bad) then own.w else t end as bigint) as weight, own.n in (select n from bad) as damaged from own join total on total.n = own.n""")
def subtree_weights(spark: SparkSession, d: str) -> DataFrame:
    return N.subtree_weights(table(spark, d, "edge"), head(spark, d))


SCOPE_SQL = f"""{EDGE_SQL}, {STANDING}, dirty as (select distinct inode from st), up(inode) as (select inode from dirty union select e.parent from e join up on up.inode = e.inode where e.parent is not null)"""


@R.query("change_scope", f"with recursive {SCOPE_SQL} select inode from up")
def change_scope(spark: SparkSession, d: str) -> DataFrame:
    """Inodes that standing operations of any kind touch, with every directory above them."""
    return N.ancestors_of(table(spark, d, "edge"), _journalled(spark, d))


@R.query("unchanged_entries", f"with recursive {SCOPE_SQL} select parent, name, inode from e where parent not in (select inode from up)")
def unchanged_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries outside the scope of all standing operations: their catalogs are carried over.

    While ``unplaced_inodes`` has rows the scope has a hole, and a caller must
    walk everything instead.
    """
    edge = table(spark, d, "edge")
    return N.outside_scope(edge, N.ancestors_of(edge, _journalled(spark, d))).select("parent", "name", "inode")


def _journalled(spark: SparkSession, d: str) -> DataFrame:
    return standing(table(spark, d, "ojournal")).select("inode").distinct()


@R.query("unplaced_inodes", f"with {STANDING} select distinct inode from st where inode not in (select inode from edge where inode is not null) and inode not in (select parent from edge where parent is not null)")
def unplaced_inodes(spark: SparkSession, d: str) -> DataFrame:
    """Journalled inodes that no entry places: the scope of changes cannot say which directories they touch."""
    edge = table(spark, d, "edge")
    return N.unplaced(edge, _journalled(spark, d))


@R.query("chunk_offsets", f"with {CHUNKREF_SQL} select inode, idx, cast(sum(llen) over (partition by inode order by idx rows unbounded preceding) - llen as bigint) as off, llen from chunkref")
def chunk_offsets(spark: SparkSession, d: str) -> DataFrame:
    return N.chunk_offsets(chunkrefs(spark, d)).select("inode", "idx", "off", "llen")


@R.query("range_overlap", f"""with {CHUNKREF_SQL}, o as (select *, cast(sum(llen) over (partition by inode order by idx rows unbounded preceding) - llen as bigint) off from chunkref)
select inode, idx, off, greatest(off, 20) as lo, least(off + llen, 60) as hi from o where off + llen > 20 and off < 60""")
def range_overlap(spark: SparkSession, d: str) -> DataFrame:
    """The chunks that bytes [20, 60) of every file need, cut to the range."""
    found = N.overlapping(N.chunk_offsets(chunkrefs(spark, d)), F.lit(20), F.lit(60))
    return found.select("inode", "idx", "off", F.greatest("off", F.lit(20)).cast("long").alias("lo"), F.least(F.col("off") + F.col("llen"), F.lit(60)).cast("long").alias("hi"))


@R.query("read_range", "select doc_id as inode, unhex(substr(hex(encode(text)), 201, 9800)) as bytes from documents where octet_length(encode(text)) > 100")
def read_range(spark: SparkSession, d: str) -> DataFrame:
    """Bytes [100, 5000) of every text that reaches them, read from chunks of 1,024 bytes."""
    files = table(spark, d, "documents").select(F.col("doc_id").alias("inode"), F.col("text").cast("binary").alias("b"))
    pieces = fixed_pieces(files, "inode", "b", 1024)
    return N.read_range(pieces.select("inode", "off", F.length("data").cast("long").alias("llen"), "data"), 100, 5000)


@R.query("newest_attributes", "select inode, generation, mode, length from (select *, row_number() over (partition by inode order by generation desc) rn from (select distinct * from node)) where rn = 1")
def newest_attributes(spark: SparkSession, d: str) -> DataFrame:
    """The newest image of every inode over all generations."""
    return newest(table(spark, d, "node"), ["inode"], ["generation"]).select("inode", "generation", "mode", "length")


@R.query("shard_routing", """with lo as (select inode >> 40 l, case when (inode >> 40) % 2 = 1 then inode >> 20 else inode >> 12 end s, min(inode) first_inode, max(inode) last_inode from node where inode is not null group by 1, 2)
select distinct e.inode, s.first_inode, s.last_inode from edge e left join lo s on e.inode between s.first_inode and s.last_inode where e.inode is not null""")
def shard_routing(spark: SparkSession, d: str) -> DataFrame:
    """The shard, a range of inodes, that answers for each entry's inode.

    A range join without pairs: shards and inodes are sorted together, and each
    inode takes the shard start that precedes it. Shards of odd lineages are
    2^20 inodes wide, others 2^12.
    """
    n = table(spark, d, "node").where("inode is not null")
    width = F.when(S.lineage_of(F.col("inode")) % 2 == 1, F.shiftright("inode", 20)).otherwise(F.shiftright("inode", 12))
    shards = n.groupBy(S.lineage_of(F.col("inode")).alias("_l"), width.alias("_s")).agg(F.min("inode").alias("_from"), F.max("inode").alias("_to"))
    runs = shards.select("_from", "_to", F.col("_from").alias("first_inode"), F.col("_to").alias("last_inode"))
    return match_runs(table(spark, d, "edge"), "inode", runs, ["first_inode", "last_inode"]).drop("_held")
