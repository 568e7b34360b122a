"""The pN_ queries of the general problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packstrata.operators.asof import order_bytes
from packstrata.operators.hierarchy import hierarchy
from packstrata.operators.intervals import periods_and_gaps
from packstrata.operators.journal import PLACE, content_map, place_end, standing
from packstrata.operators.orphans import FACTS, key_runs, orphans, single_runs
from packstrata.operators.skew import skew_join
from packstrata.operators.snapshots import snapshot_changes
from packstrata.plans.registry import Registry
from packstrata.sources.tables import table

R = Registry()

STANDING = """st as (
  select session_id, seq, op, inode, handle, fileoff, length from (
    select *, row_number() over (partition by session_id, seq order by recv_at desc nulls last, op desc, inode desc, handle desc nulls last, fileoff desc nulls last, length desc nulls last) rn
    from ojournal where inode is not null and session_id is not null and seq is not null and case op
      when 1 then handle is not null and fileoff >= 0 and length >= 0
      when 2 then length >= 0
      when 3 then true
      when 4 then handle is not null and length >= 0
      else false end)
  where rn = 1)"""


@R.query("p1_found", f"""
with {STANDING},
pl as (select session_id, inode, fileoff lo, fileoff + length hi from st where op = 1 and length > 0),
a as (select *, max(hi) over (partition by session_id, inode order by lo, hi rows between unbounded preceding and 1 preceding) top from pl),
b as (select *, sum(case when top is null or lo > top then 1 else 0 end) over (partition by session_id, inode order by lo, hi rows unbounded preceding) run from a),
r as (select session_id, inode, run, min(lo) lo, max(hi) hi from b group by 1, 2, 3),
g as (select session_id, inode, lag(hi) over (partition by session_id, inode order by run) lo, lo hi from r)
select session_id, inode, 'run' as kind, lo as from_off, hi as to_off from r
union all select session_id, inode, 'gap', lo, hi from g where lo is not null""")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Covered ranges of PLACE operations and the holes between them, per session and inode."""
    places = standing(table(spark, d, "ojournal")).where((F.col("op") == PLACE) & (F.col("length") > 0))
    return periods_and_gaps(places.select("session_id", "inode", F.col("fileoff").alias("lo"), place_end().alias("hi")), ["session_id", "inode"], "lo", "hi")


@R.query("p2_found", """
with recursive e as (select distinct parent, name, inode from edge),
dirs as (select distinct parent n from e),
step as (select distinct parent a, inode b from e where inode in (select n from dirs)),
reach(a, b) as (select a, b from step union select r.a, s.b from reach r join step s on r.b = s.a),
loops as (select distinct a n from reach where a = b),
bad as (select n from loops union select b from reach where a in (select n from loops)),
kind as (select e.*, case when exists (select 1 from reach r where r.a = e.inode and r.b = e.parent) or e.inode = e.parent then 'cycle'
  when e.parent in (select n from bad) then 'below_cycle' else 'tree' end state from e),
outd as (select parent n, count(*) c from e group by 1),
below as (select a n, sum(c) c from (select n a, n b from dirs union select a, b from reach) join outd on outd.n = b group by 1),
up as (select inode n, min(struct_pack(p := parent, m := name)) x from e where inode in (select n from dirs) group by 1),
walk(n, root, depth, path) as (
  select n, n, 0, '' from dirs where n not in (select inode from e)
  union all select u.n, w.root, w.depth + 1, w.path || '/' || decode(u.x.m) from up u join walk w on u.x.p = w.n where u.n not in (select n from bad))
select k.parent, k.inode, case when state = 'tree' then w.root else 0 end as root, cast(case when state = 'tree' then w.depth + 1 else 0 end as bigint) as depth,
  case when state = 'tree' then w.path || '/' || decode(k.name) else '' end as path, state, cast(case when state = 'tree' then coalesce(b.c, 0) else 0 end as bigint) as n_below
from kind k left join walk w on w.n = k.parent left join below b on b.n = k.inode""")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Path, depth, root, state and number of entries below, of every directory entry."""
    return hierarchy(table(spark, d, "edge"), order="generation")


@R.query("p3_found", """
with n as (select inode, min(generation) born, max(generation) last from node group by 1), h as (select max(generation) head from node),
e as (select distinct parent, name, inode, type, generation from edge where inode is not null),
p as (select name, max(condemned_at_unix) dead, min(generation) generation from pack group by 1),
c as (select pe.key, count(p.name) filter (p.dead is null) > 0 alive, min(p.generation) filter (p.dead is null) born
      from pack_entry pe left join p on p.name = pe.pack where pe.type = 'catalog' group by 1),
s as (select distinct parent, name, catalog_identity, generation from nested where catalog_identity is not null),
o as (select distinct * from ochunk where pack is not null),
x as (
 select 'edge' table_name, concat(parent, '/', decode(name)) row_key, e.generation,
   case when n.inode is null then 'missing' when n.last < h.head then 'deleted' when n.born > e.generation then 'late' end state
 from e cross join h left join n on n.inode = e.inode
 union all
 select 'nested', concat(parent, '/', decode(name)), s.generation,
   case when c.key is null then 'missing' when not c.alive then 'deleted' when c.born > s.generation then 'late' end
 from s left join c on c.key = s.catalog_identity
 union all
 select 'ochunk', identity, o.generation,
   case when p.name is null then 'missing' when p.dead is not null then 'deleted' when p.generation > o.generation then 'late' end
 from o left join p on p.name = o.pack)
select * from x where state is not null""")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references of edge, nested and ochunk with their state, one row for each distinct referring row.

    Inodes are compressed to runs; catalog identities and pack names are runs
    of one. As bytes in the order of their values, the keys of all three tables
    are matched in one pass.
    """
    entry_key = F.concat(F.col("parent").cast("string"), F.lit("/"), F.col("name").cast("string"))
    node, pack = table(spark, d, "node"), table(spark, d, "pack")
    head = node.agg(F.max("generation")).first()[0]
    inodes = node.where("inode is not null").groupBy("inode").agg(F.min("generation").alias("_born"), (F.max("generation") == F.lit(head)).alias("_alive"))
    packs = pack.where("name is not null").groupBy(F.col("name").alias("pack")).agg(F.max("condemned_at_unix").isNull().alias("_alive"), F.min("generation").alias("_born"))
    listed = table(spark, d, "pack_entry").where("type = 'catalog'").select("pack", F.col("key").alias("catalog_identity"))
    live = F.coalesce("_alive", F.lit(False))
    catalogs = skew_join(listed, packs, ["pack"], "left").groupBy("catalog_identity").agg(F.max(live).alias("_alive"), F.min(F.when(live, F.col("_born"))).alias("_born"))

    edge = table(spark, d, "edge").select("parent", "name", "inode", "type", "generation").distinct()
    nested = table(spark, d, "nested").select("parent", "name", "catalog_identity", "generation").distinct()
    chunk = table(spark, d, "ochunk").select("identity", "pack", "off", "stored", "logical", "alg", "key_id", "generation").where("pack is not null").distinct()
    refers = lambda rows, name, row_key, key: rows.select(F.lit(name).alias("table_name"), row_key.alias("row_key"), key.cast("binary").alias("key"), "generation")
    references = (
        refers(edge, "edge", entry_key, order_bytes(F.col("inode")))
        .unionByName(refers(nested, "nested", entry_key, F.col("catalog_identity"))).unionByName(refers(chunk, "ochunk", F.col("identity"), F.col("pack")))
    )
    held = lambda runs, name, of=F.col: runs.select(F.lit(name).alias("table_name"), of("_from").cast("binary").alias("_from"), of("_to").cast("binary").alias("_to"), "_alive", "_born")
    runs = (
        held(key_runs(inodes, "inode", FACTS), "edge", lambda c: order_bytes(F.col(c)))
        .unionByName(held(single_runs(catalogs, "catalog_identity"), "nested")).unionByName(held(single_runs(packs, "pack"), "ochunk"))
    )
    return orphans(references, "key", "generation", runs, ["table_name"]).select("table_name", "row_key", "generation", "state")


@R.query("p4_found", """
with g as (select generation, lag(generation) over (order by generation) prev, row_number() over (order by generation) k from (select distinct generation from node where generation is not null)),
r as (select distinct generation, inode, mtime_ns, length from node where inode is not null),
cur as (select g.generation, g.prev, r.inode, r.mtime_ns, r.length from g join r on r.generation = g.generation where g.prev is not null),
old as (select g.generation, r.inode, r.mtime_ns, r.length from g join r on r.generation = g.prev)
select coalesce(c.generation, o.generation) as generation, coalesce(c.inode, o.inode) as inode,
  case when o.inode is null then 'added' when c.inode is null then 'removed' else 'changed' end as change
from cur c full join old o on c.generation = o.generation and c.inode = o.inode
where o.inode is null or c.inode is null or c.mtime_ns is distinct from o.mtime_ns or c.length is distinct from o.length""")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Inodes added, removed or changed between consecutive generations."""
    return snapshot_changes(table(spark, d, "node"), ["inode"], "generation", ["mtime_ns", "length"])


@R.query("p6_found", f"""
with {STANDING},
ops as (select * from st),
lastset as (select session_id, inode, max(seq) s from ops where op <> 1 group by 1, 2),
lastop as (select session_id, inode, max_by(op, seq) op from ops group by 1, 2),
alive as (select l.session_id, l.inode, s.s from lastop l left join lastset s using (session_id, inode) where l.op <> 3),
size as (
  select a.session_id, a.inode, greatest(coalesce(max(case when o.seq = a.s and o.op in (2, 4) then o.length end), 0),
    coalesce(max(case when o.op = 1 and o.seq > coalesce(a.s, -1) then o.fileoff + o.length end), 0)) file_size
  from alive a join ops o using (session_id, inode) group by 1, 2),
paint as (
  select session_id, inode, seq * 2 + 1 k, fileoff lo, fileoff + length hi, handle from ops where op = 1 and length > 0
  union all select session_id, inode, seq * 2 + 1, 0, length, handle from ops where op = 4 and length > 0
  union all select session_id, inode, seq * 2, case op when 2 then length else 0 end, 9223372036854775807, null from ops where op <> 1),
pts as (select session_id, inode, lo p from paint union select session_id, inode, hi from paint),
cells as (select session_id, inode, p lo, lead(p) over (partition by session_id, inode order by p) hi from pts),
own as (
  select c.session_id, c.inode, c.lo, c.hi, max_by(coalesce(p.handle, -1), p.k) handle
  from cells c join paint p on p.session_id = c.session_id and p.inode = c.inode and p.lo <= c.lo and p.hi >= c.hi
  where c.hi is not null group by 1, 2, 3, 4),
held as (select * from own where handle >= 0),
mark as (select *, case when lag(hi) over w = lo and lag(handle) over w = handle then 0 else 1 end fresh from held window w as (partition by session_id, inode order by lo)),
runs as (select *, sum(fresh) over (partition by session_id, inode order by lo rows unbounded preceding) run from mark),
ext as (select session_id, inode, min(lo) fileoff, max(hi) - min(lo) length, min(handle) handle from runs group by session_id, inode, run)
select s.session_id, s.inode, cast(s.file_size as bigint) as file_size, coalesce(e.fileoff, 0) as fileoff, coalesce(e.length, 0) as length, coalesce(e.handle, 0) as handle
from size s left join ext e using (session_id, inode)""")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Extents and size of every inode that its session's journal leaves in the content map."""
    return content_map(table(spark, d, "ojournal"))
