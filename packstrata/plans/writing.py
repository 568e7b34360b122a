"""Queries of the write path: packing, shards, re-chunking, repack, publish statistics, namespace operations, small relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packstrata.functions import scalar as S
from packstrata.operators import liveness as L
from packstrata.operators import namespace as N
from packstrata.operators import overlaying as W
from packstrata.operators.containers import containers, packed
from packstrata.plans.adapters import CHUNKREF_SQL, chunkrefs
from packstrata.plans.maintenance import LIVENESS_SQL, live_ids, placements
from packstrata.plans.namespace import EDGE_SQL, HEAD_SQL, head
from packstrata.plans.registry import Registry
from packstrata.session import Scratch, fresh_folder
from packstrata.sources.generations import Store
from packstrata.sources.tables import table

R = Registry()
PACK_TARGET, PACK_FIRST, SHARD_TARGET = 2 << 20, 1 << 20, 5 << 20


def next_fit_sql(groups: str, order: str, size: str, first: int, target: int) -> str:
    """Recursive SQL of next-fit over a relation ``c``: w(groups, k, part, used)."""
    room = f"case when part = 1 then {first} else {target} end"
    cut = f"used > 0 and r.{size} > 0 and used + r.{size} > {room}"
    return f"""r as (select *, row_number() over (partition by {groups} order by {order}) k from c),
w({groups}, k, part, used) as (select {groups}, k, 1, {size} from r where k = 1 union all
 select r.{groups}, r.k, case when {cut} then part + 1 else part end, case when {cut} then r.{size} else used + r.{size} end from w join r on r.{groups} = w.{groups} and r.k = w.k + 1)"""


@R.query("pack_cuts", f"""with recursive c as (select distinct generation, identity, stored from ochunk where stored is not null), {next_fit_sql('generation', 'identity, stored', 'stored', PACK_FIRST, PACK_TARGET)}
select r.generation, r.identity, r.stored, cast(w.part as bigint) as part from r join w on w.generation = r.generation and w.k = r.k""")
def pack_cuts(spark: SparkSession, d: str) -> DataFrame:
    """The packs of each generation's chunks in order of identity: the first of 1 MiB, to be sent early, the others of 2 MiB."""
    chunks = table(spark, d, "ochunk").where("stored is not null").select("generation", "identity", "stored").distinct()
    return containers(chunks, ["generation"], ["identity", "stored"], "stored", PACK_TARGET, PACK_FIRST)


@R.query("shard_cuts", f"""with recursive {EDGE_SQL}, {HEAD_SQL}, linked as (select inode from e where type <> 2 and inode is not null group by 1 having count(*) > 1),
c as (select 0 g, h.inode, 200 + case when h.length <= 2048 then h.length else 64 * (h.length // 1048576 + 1) end weight from linked l join (select inode, coalesce(max(length), 0) length from head group by 1) h on h.inode = l.inode), {next_fit_sql('g', 'inode', 'weight', SHARD_TARGET, SHARD_TARGET)}
select cast(w.part as bigint) as shard, min(r.inode) as first_inode, max(r.inode) as last_inode, cast(count(*) as bigint) as inodes, cast(sum(weight) as bigint) as weight from r join w on w.k = r.k group by 1""")
def shard_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Files of several links in shards of contiguous inodes, each up to 5 MiB of records: their own content if small, else a reference a MiB."""
    linked = N.entries(table(spark, d, "edge")).where((F.col("type") != S.DIRECTORY) & F.col("inode").isNotNull()).groupBy("inode").count().where("count > 1").select("inode")
    lengths = head(spark, d).groupBy("inode").agg(F.coalesce(F.max("length"), F.lit(0)).alias("length"))
    weight = F.lit(S.ENTRY_WEIGHT) + F.when(F.col("length") <= S.INLINE_MAX, F.col("length")).otherwise(64 * (F.expr("length div 1048576") + 1))
    rows = linked.join(lengths, "inode").select(F.lit(0).alias("g"), "inode", weight.alias("weight"))
    parts = containers(rows, ["g"], ["inode"], "weight", SHARD_TARGET)
    return parts.groupBy(F.col("part").alias("shard")).agg(F.min("inode").alias("first_inode"), F.max("inode").alias("last_inode"), F.count(F.lit(1)).alias("inodes"), F.sum("weight").alias("weight"))


@R.query("rechunk_spans", f"""with {CHUNKREF_SQL}, o as (select inode, sum(llen) over (partition by inode order by idx rows unbounded preceding) - llen off, llen from chunkref),
dirty as (select o_orderkey inode, o_custkey % 120 lo, o_custkey % 120 + 10 hi from orders where o_custkey % 120 < (select max(e) from (select inode, sum(llen) e from chunkref group by 1) x where x.inode = o_orderkey)),
hit as (select o.inode, o.off lo, o.off + o.llen hi from o where exists (select 1 from dirty where dirty.inode = o.inode and dirty.lo < o.off + o.llen and dirty.hi > o.off) union select * from dirty),
a as (select *, max(hi) over (partition by inode order by lo, hi rows between unbounded preceding and 1 preceding) top from hit), b as (select *, sum(case when top is null or lo > top then 1 else 0 end) over (partition by inode order by lo, hi rows unbounded preceding) run from a)
select inode, cast(min(lo) as bigint) as from_off, cast(max(hi) as bigint) as to_off from b group by inode, run""")
def rechunk_spans(spark: SparkSession, d: str) -> DataFrame:
    """What a seal must chunk again: the chunks that written ranges disturb, and the ranges.

    Lines of an order are the chunks of a file; an order writes 10 bytes at a
    place in its file, if it reaches that far.
    """
    refs = Scratch(spark).keep(N.chunk_offsets(chunkrefs(spark, d)).select("inode", "off", "llen"))
    size = refs.groupBy("inode").agg(F.sum("llen").alias("_size"))
    at = F.col("o_custkey") % 120
    dirty = table(spark, d, "orders").select(F.col("o_orderkey").alias("inode"), at.alias("lo"), (at + 10).alias("hi")).join(size, "inode").where("lo < _size").drop("_size")
    return W.disturbed_spans(refs, dirty)


@R.query("repack_execute", f"""with recursive {LIVENESS_SQL}, thin as (select pack from f where bytes > 0 and live_bytes::double / bytes::double < 0.5),
c as (select 0 g, key, max(length) length from pe where pack in (select pack from thin) and (key in (select key from live) or type = 'sb') and length > 0 group by key), {next_fit_sql('g', 'key', 'length', PACK_TARGET, PACK_TARGET)},
o as (select r.key, r.length, w.part, sum(r.length) over (partition by w.part order by r.key rows unbounded preceding) - r.length off from r join w on w.k = r.k)
select 'copy' as kind, cast(part as bigint) as pack_no, null::varchar as name, key, cast(off as bigint) as off, cast(length as bigint) as length from o
union all select 'condemn', null, pack, null, null, null from thin""")
def repack_execute(spark: SparkSession, d: str) -> DataFrame:
    """Thin packs rewritten, committed and read back: what is copied into which new pack, and the packs this condemns.

    Entries that something still refers to, and backups, are copied once each
    however many thin packs hold them. Both lists are one generation of a
    store: a reader sees the new packs and the condemned ones together.
    """
    live = Scratch(spark).keep(live_ids(spark, d))
    placed = placements(spark, d)
    thin = L.pack_liveness(placed, live).where("fraction < 0.5").select("pack")
    held = placed.join(thin, "pack", "left_semi").where("length > 0")
    wanted = held.join(live, "key", "left_semi").unionByName(held.where("type = 'sb'")).groupBy("key").agg(F.max("length").alias("length"))
    copies = packed(wanted.withColumn("g", F.lit(0)), ["g"], ["key"], "length", target=PACK_TARGET)
    null = lambda kind: F.lit(None).cast(kind)
    rows = copies.select(F.lit("copy").alias("kind"), F.col("part").alias("pack_no"), null("string").alias("name"), "key", "off", "length").unionByName(
        thin.select(F.lit("condemn").alias("kind"), null("long").alias("pack_no"), F.col("pack").alias("name"), null("binary").alias("key"), null("long").alias("off"), null("long").alias("length"))
    )
    store = Store(spark, fresh_folder(spark, "store"))
    return store.read(store.commit("main", {"repack": rows}, expected=-1), "repack")


@R.query("publish_stats", f"""with {EDGE_SQL}, {HEAD_SQL}, h as (select inode, max(type) t, max(length) l from head group by 1), g as (select max(generation) g from edge),
linked as (select inode from e where type <> 2 and inode is not null group by 1 having count(*) > 1)
select cast(count(*) filter (t = 2) as bigint) as dirs, cast(count(*) filter (t = 1) as bigint) as files, cast(count(*) filter (t = 3) as bigint) as symlinks, cast(count(*) filter (t > 3) as bigint) as specials,
 cast(count(*) filter (t = 1 and coalesce(l, 0) between 1 and 2048) as bigint) as inline_files, cast(count(*) filter (t = 1 and l > 2048) as bigint) as chunked_files, (select count(*) from linked l join h on h.inode = l.inode) as promoted_inodes,
 (select count(distinct identity) from ochunk where generation = (select max(generation) from ochunk)) as chunks_added,
 cast((select count(distinct identity) from dedup_chunk where generation = (select max(generation) from dedup_chunk) and identity in (select identity from dedup_known)) as bigint) as chunks_deduped,
 (select count(distinct catalog_identity) from nested where generation = (select g from g)) as catalogs, (select count(distinct catalog_identity) from nested where generation < (select g from g)) as catalogs_reused from h""")
def publish_stats(spark: SparkSession, d: str) -> DataFrame:
    """One row of what the newest generation publishes, by kind."""
    top = lambda t: t.where(F.col("generation") == F.lit(t.agg(F.max("generation")).first()[0]))
    edge, nested = table(spark, d, "edge"), table(spark, d, "nested")
    h = head(spark, d).groupBy("inode").agg(F.max("type").alias("t"), F.max("length").alias("l"))
    linked = N.entries(edge).where((F.col("type") != S.DIRECTORY) & F.col("inode").isNotNull()).groupBy("inode").count().where("count > 1")
    n = lambda c, name: F.count_if(c).alias(name)
    kinds = h.agg(
        n(F.col("t") == 2, "dirs"), n(F.col("t") == 1, "files"), n(F.col("t") == 3, "symlinks"), n(F.col("t") > 3, "specials"),
        n((F.col("t") == 1) & F.coalesce("l", F.lit(0)).between(1, S.INLINE_MAX), "inline_files"), n((F.col("t") == 1) & (F.col("l") > S.INLINE_MAX), "chunked_files"),
    )
    g = edge.agg(F.max("generation")).first()[0]
    parts = [
        linked.join(h, "inode").agg(F.count(F.lit(1)).alias("promoted_inodes")), top(table(spark, d, "ochunk")).agg(F.countDistinct("identity").alias("chunks_added")),
        top(table(spark, d, "dedup_chunk")).join(table(spark, d, "dedup_known").select("identity"), "identity", "left_semi").agg(F.countDistinct("identity").alias("chunks_deduped")),
        nested.where(F.col("generation") == g).agg(F.countDistinct("catalog_identity").alias("catalogs")), nested.where(F.col("generation") < g).agg(F.countDistinct("catalog_identity").alias("catalogs_reused")),
    ]
    # one row each: joined on a constant
    out = kinds.withColumn("_1", F.lit(1))
    for p in parts:
        out = out.join(p.withColumn("_1", F.lit(1)), "_1")
    return out.drop("_1")


XATTR_SQL = f"""{HEAD_SQL}, xattr as (select distinct inode, unnest(['user.keyid', 'user.flags', 'user.rdev']) name, unnest([keyid, flags, rdev]) v from head), xa as (select inode, name, cast(v as varchar) as value from xattr where v is not null and v <> 0)"""


def xattrs(spark: SparkSession, d: str) -> DataFrame:
    """Attributes of the head as a relation (inode, name, value): those of its columns that are set."""
    pairs = F.inline(F.array(*(F.struct(F.lit(f"user.{c}").alias("name"), F.col(c).alias("v")) for c in ("keyid", "flags", "rdev"))))
    return head(spark, d).select("inode", pairs).where("v is not null and v <> 0").select("inode", "name", F.col("v").cast("string").alias("value")).distinct()


@R.query("list_xattrs", f"with {XATTR_SQL} select inode, list(name order by name) as names from xa group by 1")
def list_xattrs(spark: SparkSession, d: str) -> DataFrame:
    return N.xattr_names(xattrs(spark, d))


@R.query("get_xattr", f"with {XATTR_SQL} select e.inode, x.value, x.value is not null as present from (select distinct inode from edge where inode is not null) e left join xa x on x.inode = e.inode and x.name = 'user.keyid'")
def get_xattr(spark: SparkSession, d: str) -> DataFrame:
    """The attribute user.keyid of every entry's inode; absent is told from empty."""
    asked = table(spark, d, "edge").where("inode is not null").select("inode", F.lit("user.keyid").alias("name")).distinct()
    return N.xattr_values(asked, xattrs(spark, d)).select("inode", "value", "present")


@R.query("read_links", f"""with {HEAD_SQL}, {EDGE_SQL}, target as (select parent, min(name) m from e group by 1), links as (select e.parent, e.name, e.inode, concat('../', cast(e.parent as varchar), '/', decode(t.m)) target from e join target t on t.parent = e.parent where e.type = 3)
select l.parent, l.name, case when h.t = 3 then l.target end as target, case when h.t is null then 'missing' when h.t <> 3 then 'not-a-link' else 'ok' end as state from links l left join (select inode, max(type) t from head group by 1) h on h.inode = l.inode""")
def read_links(spark: SparkSession, d: str) -> DataFrame:
    """What every symlink entry points to: a relation made of its directory's first name."""
    e = N.entries(table(spark, d, "edge"))
    first = e.groupBy("parent").agg(F.min("name").alias("m"))
    links = e.where("type = 3").join(first, "parent").select("parent", "name", "inode", F.concat(F.lit("../"), F.col("parent").cast("string"), F.lit("/"), F.col("m").cast("string")).alias("target"))
    kinds = head(spark, d).groupBy("inode").agg(F.max("type").alias("type"))
    return N.link_targets(links, kinds).select("parent", "name", "target", "state")


# views are what a directory (user) had before; the other events are operations on it, by time
OPS_SQL = """ev as (select *, cast(json_extract(props, '$.k') as bigint) k from events), base as (select distinct user_id parent, 'f' || k as name, user_id * 1000 + k as inode, 1 as type from ev where event_type = 'view'),
ops as (select user_id parent, ts, event_id, event_type, k, row_number() over (order by ts, event_id) seq from ev where event_type <> 'view'),
rows as (select parent, 'd' || k as name, seq, 0 sub, event_id + 1125899906842624 as inode, 2 as type from ops where event_type = 'signup'
 union all select parent, 'f' || k, seq, 0, null, null from ops where event_type in ('error', 'purchase') union all select parent, 'g' || k, seq, 1, parent * 1000 + k, 1 from ops where event_type = 'purchase'),
last as (select *, row_number() over (partition by parent, name order by seq desc, sub desc) r from rows)"""


def name_operations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The entries that directories (users) had, and the log of operations on them, made of events.

    A signup makes a directory, an error unlinks a file, a purchase renames one,
    a click sets a mode.
    """
    e = table(spark, d, "events").select("event_id", "ts", "event_type", F.col("user_id").alias("parent"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    file = lambda prefix: F.concat(F.lit(prefix), F.col("k").cast("string"))
    inode = F.col("parent") * 1000 + F.col("k")
    base = e.where("event_type = 'view'").select("parent", file("f").alias("name"), inode.alias("inode"), F.lit(1).alias("type")).distinct()
    kind = F.create_map(*(F.lit(x) for kv in {"signup": "mkdir", "error": "unlink", "purchase": "rename", "click": "setattr"}.items() for x in kv))[F.col("event_type")]
    ops = e.where("event_type <> 'view'").select(
        "ts", "event_id", kind.alias("op"), "parent", F.when(kind == "mkdir", file("d")).otherwise(file("f")).alias("name"), F.col("parent").alias("to_parent"), file("g").alias("to_name"),
        F.when(kind == "mkdir", F.col("event_id") + (1 << 50)).otherwise(inode).alias("inode"), F.when(kind == "mkdir", 2).otherwise(1).alias("type"), F.lit("mode").alias("attr"), F.col("k").alias("value"),
    )
    return base, ops


@R.query("overlay_namespace", f"""with {OPS_SQL} select parent, name, inode, type from base where not exists (select 1 from last where r = 1 and last.parent = base.parent and last.name = base.name) union all select parent, name, inode, type from last where r = 1 and inode is not null""")
def overlay_namespace(spark: SparkSession, d: str) -> DataFrame:
    """The namespace after its operations: what is left of the base, and what operations put."""
    base, ops = name_operations(spark, d)
    return W.namespace_after(base, ops, ["ts", "event_id"])


@R.query("overlay_attributes", f"""with {OPS_SQL} select inode, 'mode' as attr, k as value from (select *, parent * 1000 + k as inode, row_number() over (partition by parent * 1000 + k order by ts desc, event_id desc) r from ops where event_type = 'click') where r = 1""")
def overlay_attributes(spark: SparkSession, d: str) -> DataFrame:
    """The attributes that operations leave set, the newest of each."""
    return W.attributes_after(name_operations(spark, d)[1], ["ts", "event_id"])


@R.query("empty_after", f"""with {OPS_SQL}, now as (select parent, name from base where not exists (select 1 from last where r = 1 and last.parent = base.parent and last.name = base.name) union all select parent, name from last where r = 1 and inode is not null)
select p.parent, not exists (select 1 from now where now.parent = p.parent) as is_empty from (select parent from base union select parent from ops) p""")
def empty_after(spark: SparkSession, d: str) -> DataFrame:
    """Whether a directory could be removed after the operations: nothing of the base is left unhidden and nothing new is in it."""
    base, ops = name_operations(spark, d)
    left = W.namespace_after(base, ops, ["ts", "event_id"]).select("parent").distinct().withColumn("_has", F.lit(True))
    known = base.select("parent").unionByName(ops.select("parent")).distinct()
    return known.join(left, "parent", "left").select("parent", F.col("_has").isNull().alias("is_empty"))


@R.query("carried_refs", """select seq, name from (select name, min(seq) seq from (select generation as seq, name from pack where condemned_at_unix is null and name is not null union all select (select max(generation) from pack) + 1, pack from ochunk where pack is not null) group by 1)""")
def carried_refs(spark: SparkSession, d: str) -> DataFrame:
    """A list of refs carried forward and appended to, each once, at the place where it first came."""
    top = table(spark, d, "pack").agg(F.max("generation")).first()[0]
    live = table(spark, d, "pack").where("condemned_at_unix is null and name is not null").select(F.col("generation").alias("seq"), "name")
    new = table(spark, d, "ochunk").where("pack is not null").select(F.lit(top + 1).cast("long").alias("seq"), F.col("pack").alias("name"))
    return live.unionByName(new).groupBy("name").agg(F.min("seq").alias("seq")).select("seq", "name")


@R.query("recovered_runs", """with j as (select session_id, seq, row_number() over (partition by session_id order by recv_at nulls first, seq, op nulls first, inode nulls first, handle nulls first, fileoff nulls first, length nulls first) k,
 coalesce(inode is not null and seq is not null and case op when 1 then handle is not null and fileoff >= 0 and length >= 0 when 2 then length >= 0 when 3 then true when 4 then handle is not null and length >= 0 else false end, false) good from (select distinct * from ojournal where session_id is not null)),
b as (select *, max(seq) over (partition by session_id order by k rows between unbounded preceding and 1 preceding) top from j),
s as (select session_id, min(k) filter (not good or seq <= top) stop, count(*) n from b group by 1)
select s.session_id, cast(coalesce(stop - 1, n) as bigint) as records, (select max(seq) from j where j.session_id = s.session_id and j.k < coalesce(stop, n + 1)) as last_seq, coalesce((select not good from j where j.session_id = s.session_id and j.k = stop), false) as torn from s""")
def recovered_runs(spark: SparkSession, d: str) -> DataFrame:
    """What a crash recovery accepts of each session, in order of receipt: the longest run of whole records whose numbers ascend."""
    from packstrata.operators.journal import FIELDS, whole

    j = table(spark, d, "ojournal").where("session_id is not null").select(*FIELDS).distinct().withColumn("_good", whole())
    order = [F.col("recv_at").asc_nulls_first(), F.col("seq").asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in ("op", "inode", "handle", "fileoff", "length"))]
    return W.longest_runs(j, "session_id", order, "seq", "_good")
