"""Queries on indexes, merges, differences, overlays and rescue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packstrata.functions import scalar as S
from packstrata.operators import lookup as I
from packstrata.operators import merging as M
from packstrata.operators import rescue
from packstrata.operators.journal import sizes_left, standing
from packstrata.plans.adapters import BRANCHES_SQL, VERSIONS_SQL, branches, day_versions
from packstrata.plans.problems import STANDING
from packstrata.plans.registry import Registry
from packstrata.session import Scratch
from packstrata.sources.tables import table

R = Registry()


@R.query("newest_wins", "select identity, arrival, clen from (select *, row_number() over (partition by identity order by generation desc, arrival desc) rn from dedup_chunk where identity is not null) where rn = 1")
def newest_wins(spark: SparkSession, d: str) -> DataFrame:
    """One entry a key over all segments (generations): that of the newest."""
    rows = table(spark, d, "dedup_chunk").where("identity is not null")
    return I.newest_wins(rows, ["identity"], ["generation"], ["arrival", "clen"])


@R.query("merged_records", "select pack, key, off, cast(row_number() over (partition by pack order by off, key) as bigint) as place from (select pack, key, off from pack_entry where type = 'catalog' union all select pack, key, off from pack_entry where type <> 'catalog')")
def merged_records(spark: SparkSession, d: str) -> DataFrame:
    """Two sorted runs of records merged into one order, repeated records kept."""
    e = table(spark, d, "pack_entry").select("pack", "key", "off", "type")
    both = e.where("type = 'catalog'").unionByName(e.where("type <> 'catalog'")).drop("type")
    return I.in_order(both, ["pack"], [F.col("off"), F.col("key")])


@R.query("index_windows", """with m as (select key, n from (select key, row_number() over (order by key) - 1 n from (select distinct key from pack_entry where key is not null)) where n % 8 = 0),
q as (select distinct identity from dedup_chunk where identity is not null)
select q.identity, m.key as sample, cast(m.n as bigint) as place from q asof left join m on q.identity >= m.key""")
def index_windows(spark: SparkSession, d: str) -> DataFrame:
    """Where the search for each incoming chunk key begins in the sorted table of entries, by every eighth key."""
    samples = I.sampled(table(spark, d, "pack_entry"), "key", 8)
    return I.windows_of(table(spark, d, "dedup_chunk"), "identity", samples)


@R.query("prefix_lookup", "select distinct unhex(o.identity) as id, e.pack, e.off from ochunk o join pack_entry e on e.key = unhex(o.identity) where regexp_matches(o.identity, '^[0-9a-fA-F]{64}$')")
def prefix_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Chunks found through 12 of 32 bytes of their key, then confirmed."""
    ids = table(spark, d, "ochunk").select(S.parse_hex(F.col("identity"), 32).alias("id")).dropna().distinct()
    return I.by_prefix(ids, "id", table(spark, d, "pack_entry").select("key", "pack", "off").distinct(), "key").select("id", "pack", "off")


@R.query("locate_chunks", """with n as (select distinct generation, name from pack), t as (select name from n order by generation desc, name desc limit 4), ids as (select distinct unhex(identity) id from ochunk where regexp_matches(identity, '^[0-9a-fA-F]{64}$')),
e as (select distinct key, pack, type from pack_entry)
select id, case when id in (select identity from dedup_known) then 'cache' when id in (select key from e where type = 'catalog') then 'index' when id in (select key from e where pack in (select name from t)) then 'newest' when id in (select key from e) then 'all' else 'absent' end as found_in from ids""")
def locate_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk through the sources in order: cache, index, the newest four packs, all packs."""
    ids = table(spark, d, "ochunk").select(S.parse_hex(F.col("identity"), 32).alias("id")).dropna().distinct()
    e = table(spark, d, "pack_entry").select(F.col("key").alias("id"), "pack", "type").distinct()
    four = table(spark, d, "pack").select("name", "generation").distinct().orderBy(F.desc("generation"), F.desc("name")).limit(4)
    newest = e.join(F.broadcast(four.select(F.col("name").alias("pack"))), "pack", "left_semi")
    known = table(spark, d, "dedup_known").select(F.col("identity").alias("id"))
    return I.located(ids, "id", [("cache", known), ("index", e.where("type = 'catalog'")), ("newest", newest), ("all", e)], True)


@R.query("segment_union", "select name, source from (select name, min(s) over (partition by name) m, s as source from (select distinct name, 0 s from pack where condemned_at_unix is null union select distinct pack, 1 from ochunk where pack is not null union select distinct pack, 2 from pack_entry)) where source = m")
def segment_union(spark: SparkSession, d: str) -> DataFrame:
    """All pack names: listed ones first, then those chunks name, then those entries name."""
    names = lambda t, c: table(spark, d, t).select(F.col(c).alias("name")).dropna().distinct()
    listed = table(spark, d, "pack").where("condemned_at_unix is null").select("name").distinct()
    return I.first_source([listed, names("ochunk", "pack"), names("pack_entry", "pack")], ["name"])


@R.query("distinct_packs_of_key", "select key, list_sort(list(distinct pack)) as packs from pack_entry group by 1")
def distinct_packs_of_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pack_entry").groupBy("key").agg(F.sort_array(F.collect_set("pack")).alias("packs"))


DECIDE_SQL = """case when o.path is not null and t.path is not null then case
   when o.kind <> t.kind then 'conflict:type-change' when o.kind = 2 then 'descend' when (o.len, o.body) is not distinct from (t.len, t.body) then 'same' when b.path is null then 'conflict:add-add'
   when (o.kind, o.len, o.body) is distinct from (b.kind, b.len, b.body) and (t.kind, t.len, t.body) is distinct from (b.kind, b.len, b.body) then 'conflict:both-modified'
   when (t.kind, t.len, t.body) is distinct from (b.kind, b.len, b.body) then 'take-theirs' when (o.kind, o.len, o.body) is distinct from (b.kind, b.len, b.body) then 'take-ours' else 'conflict:both-modified' end
 when o.path is not null then case when o.kind = 2 then 'descend' when b.path is null then 'take-ours' when (o.kind, o.len, o.body) is distinct from (b.kind, b.len, b.body) then 'conflict:modify-delete' else 'drop' end
 when t.path is not null then case when t.kind = 2 then 'descend' when b.path is null then 'take-theirs' when (t.kind, t.len, t.body) is distinct from (b.kind, b.len, b.body) then 'conflict:modify-delete' else 'drop' end
 else 'drop' end"""
ALL_SQL = f"""{BRANCHES_SQL}, x as (select coalesce(b.path, o.path, t.path) path, {DECIDE_SQL} v, o.path is not null has_ours, o.kind ok, o.len ol, o.body ob, o.inode oi, t.kind tk, t.len tl, t.body tb, t.inode ti
from base b full join ours o on o.path = b.path full join theirs t on t.path = coalesce(b.path, o.path)),
cut as (select path from x where v = 'conflict:type-change'), w as (select *, exists (select 1 from cut where starts_with(x.path, cut.path || '/')) below from x)"""


def _decided(spark: SparkSession, d: str) -> DataFrame:
    """What is decided of every path of three trees, written. Runs jobs."""
    return Scratch(spark).keep(M.three_way(*branches(spark, d), ["path"], "kind", ["len", "body"]))


@R.query("merge_plan", f"""with {ALL_SQL} select path, split_part(v, ':', 1) as outcome, nullif(split_part(v, ':', 2), '') as conflict,
case split_part(v, ':', 1) when 'take-ours' then 'ours' when 'take-theirs' then 'theirs' when 'drop' then case when has_ours then 'theirs' else 'ours' end end as taken from w where not below""")
def merge_plan(spark: SparkSession, d: str) -> DataFrame:
    """What is decided of every path of three trees; nothing is, below a change of type."""
    return M.walked(_decided(spark, d), "path")


@R.query("merge_counts", f"""with {ALL_SQL} select v as verdict, cast(count(*) as bigint) as n from w where not below group by 1""")
def merge_counts(spark: SparkSession, d: str) -> DataFrame:
    return M.walked_counts(_decided(spark, d), "path").select(F.concat_ws(":", "outcome", "conflict").alias("verdict"), "n")


STEM = "regexp_extract(split_part(path, '/', -1), '^(.+)(\\.[^.]*)$', {}, 's')"


@R.query("merge_apply", f"""with {ALL_SQL}, y as (select *, case when below then 'conflict' else split_part(v, ':', 1) end r from w),
kept as (select *, substr(path, 1, length(path) - length(split_part(path, '/', -1))) || case when {STEM.format(1)} <> '' then {STEM.format(1)} || ' (from theirs)' || {STEM.format(2)} else split_part(path, '/', -1) || ' (from theirs)' end np,
 (select max(inode) from ours) + row_number() over (order by path) ni from y where not below and r = 'conflict' and ok is not null and tk is not null and ok <> 2 and tk <> 2)
select path, case r when 'take-theirs' then tk when 'descend' then coalesce(ok, tk) else ok end as kind, case r when 'take-theirs' then tl when 'descend' then case when ok is null then tl else ol end else ol end as len,
 case r when 'take-theirs' then tb when 'descend' then case when ok is null then tb else ob end else ob end as body, case r when 'take-theirs' then ti when 'descend' then coalesce(oi, ti) else oi end as inode, case r when 'take-theirs' then 'theirs' else 'ours' end as origin
from y where r in ('take-theirs', 'descend') or r in ('take-ours', 'same', 'conflict') and ok is not null
union all select np, tk, tl, tb, ni, 'theirs-kept' from kept""")
def merge_apply(spark: SparkSession, d: str) -> DataFrame:
    """The merged tree, with theirs of a conflict kept under another name."""
    return M.merged(*branches(spark, d), "path", "kind", ["len", "body"], "inode", branch="theirs")


@R.query("merge_base", """with refs as (select 'tag' kind, name ref, lower(hex(trailer_hash)) hash from (select distinct name, trailer_hash from pack where condemned_at_unix is not null) union all select 'branch', name, lower(hex(trailer_hash)) from (select distinct name, trailer_hash from pack where condemned_at_unix is null)),
forks as (select distinct identity name, lower(hex(p.trailer_hash)) base_hash from ochunk o join pack p on p.name = o.pack)
select f.name, f.base_hash, b.ref, b.kind from forks f left join (select *, row_number() over (partition by hash order by kind desc, ref) r from refs where hash is not null) b on b.hash = f.base_hash and b.r = 1""")
def merge_base(spark: SparkSession, d: str) -> DataFrame:
    """Which ref still names the root that each fork began from.

    Packs stand for refs (condemned ones for tags) and their trailers' hashes
    for root hashes; a chunk is a fork of the root of its pack.
    """
    p = table(spark, d, "pack").select("name", "trailer_hash", F.col("condemned_at_unix").isNotNull().alias("tag")).distinct()
    refs = p.select(F.col("name").alias("ref"), F.when(F.col("tag"), "tag").otherwise("branch").alias("kind"), S.hex_of(F.col("trailer_hash")).alias("hash")).distinct()
    hashes = p.select(F.col("name").alias("pack"), S.hex_of(F.col("trailer_hash")).alias("base_hash")).distinct()
    forks = table(spark, d, "ochunk").select(F.col("identity").alias("name"), "pack").join(hashes, "pack").select("name", "base_hash").distinct()
    return M.merge_bases(forks, refs)


@R.query("fast_forwards", """with g as (select inode, list(struct_pack(l := length, m := mtime_ns) order by generation) s from (select inode, generation, max(length) length, max(mtime_ns) mtime_ns from node where inode is not null group by 1, 2) group by 1 having count(*) >= 3)
select inode as name, case when s[2] is not distinct from s[3] or s[3] is not distinct from s[1] then 'ours' when s[2] is not distinct from s[1] then 'theirs' end as merge from g""")
def fast_forwards(spark: SparkSession, d: str) -> DataFrame:
    """For each inode of three snapshots or more: the first as the base, the second ours and the third theirs, by a hash of its image."""
    n = table(spark, d, "node").where("inode is not null").groupBy("inode", "generation").agg(F.max("length").alias("length"), F.max("mtime_ns").alias("mtime_ns"))
    image = F.sha2(F.concat_ws("|", F.coalesce(F.col("length").cast("string"), F.lit("-")), F.coalesce(F.col("mtime_ns").cast("string"), F.lit("-"))), 256)
    w = Window.partitionBy("inode").orderBy("generation")
    first = n.select("inode", image.alias("h"), F.row_number().over(w).alias("k")).where("k <= 3")
    heads = first.groupBy(F.col("inode").alias("name")).agg(*(F.max(F.when(F.col("k") == i, F.col("h"))).alias(c) for i, c in ((1, "base"), (2, "ours"), (3, "theirs")))).where("theirs is not null")
    return M.fast_forward(heads).select("name", "merge")


@R.query("conflict_names", r"""select p_name as name, case when regexp_extract(p_name, '^(.+)(\.[^.]*)$', 1, 's') <> '' then regexp_extract(p_name, '^(.+)(\.[^.]*)$', 1, 's') || ' (from side)' || regexp_extract(p_name, '^(.+)(\.[^.]*)$', 2, 's') else p_name || ' (from side)' end as kept_as
from (select distinct decode(name) p_name from edge where name is not null)""")
def conflict_names(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "edge").select(F.col("name").cast("string").alias("name")).dropna().distinct()
    return names.select("name", S.conflict_name(F.col("name"), "side").alias("kept_as"))


@R.query("inode_collisions", "select distinct a.inode from edge a join ojournal b on a.inode = b.inode where a.inode >= 1099511627776")
def inode_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Inodes of later lineages that both the tree and the journals allocated."""
    return M.collisions(table(spark, d, "edge"), table(spark, d, "ojournal"), "inode", 1 << 40)


@R.query("generation_diff", """with g as (select max(generation) b, min(generation) a from node), x as (select distinct inode, length, mtime_ns, mode, uid, gid from node where generation = (select a from g)), y as (select distinct inode, length, mtime_ns, mode, uid, gid from node where generation = (select b from g))
select coalesce(x.inode, y.inode) as inode, case when x.inode is null then 'added' when y.inode is null then 'removed' else 'changed' end as change,
 x.inode is null or y.inode is null or (x.length, x.mtime_ns) is distinct from (y.length, y.mtime_ns) as content, x.inode is null or y.inode is null or (x.mode, x.uid, x.gid) is distinct from (y.mode, y.uid, y.gid) as attr
from x full join y on x.inode = y.inode where x.inode is null or y.inode is null or x.length is distinct from y.length or x.mtime_ns is distinct from y.mtime_ns or x.mode is distinct from y.mode or x.uid is distinct from y.uid or x.gid is distinct from y.gid""")
def generation_diff(spark: SparkSession, d: str) -> DataFrame:
    """First generation against the head: content is length or mtime, attributes are mode and owner."""
    node = table(spark, d, "node")
    lo, hi = node.agg(F.min("generation"), F.max("generation")).first()
    at = lambda g: node.where(F.col("generation") == F.lit(g)).select("inode", "length", "mtime_ns", "mode", "uid", "gid").distinct()
    return M.difference(at(lo), at(hi), ["inode"], ["length", "mtime_ns"], ["mode", "uid", "gid"])


# the rule: an exact set (TRUNCATE, ADOPT; FORGET is a set to nothing) decides, and PLACE ends after it raise it
OVERLAY_SQL = f"""{STANDING}, o as (select *, row_number() over (partition by inode order by session_id, seq) k from st),
l as (select inode, max(k) filter (op <> 1) k, max_by(op, k) op from o group by 1),
h as (select distinct inode, length from node where generation = (select max(generation) from node))"""


@R.query("overlay_view", f"""with {OVERLAY_SQL} select inode, length from h where inode not in (select inode from st) union all
select o.inode, cast(max(case when o.op = 1 and o.k > coalesce(l.k, 0) then o.fileoff + o.length when o.op in (2, 4) and o.k = l.k then o.length else 0 end) as bigint) from o join l on l.inode = o.inode where l.op <> 3 group by 1""")
def overlay_view(spark: SparkSession, d: str) -> DataFrame:
    """The head under the journals' delta: forgotten inodes are tombstones, others have the length their operations leave."""
    node = table(spark, d, "node")
    head = node.where(F.col("generation") == F.lit(node.agg(F.max("generation")).first()[0])).select("inode", "length").distinct()
    return M.overlay(head, sizes_left(table(spark, d, "ojournal"), ["inode"], ["session_id", "seq"]), ["inode"], ~F.col("present")).select("inode", "length")


@R.query("dirty_inodes", f"""with {STANDING} select inode from st union select inode from edge where generation = (select max(generation) from edge) and inode is not null union select inode from node where nlink = 0""")
def dirty_inodes(spark: SparkSession, d: str) -> DataFrame:
    """Everything a seal must look at: journalled inodes, entries of the newest generation, unlinked nodes."""
    edge = table(spark, d, "edge")
    fresh = edge.where(F.col("generation") == F.lit(edge.agg(F.max("generation")).first()[0])).select("inode").dropna()
    return standing(table(spark, d, "ojournal")).select("inode").unionByName(fresh).unionByName(table(spark, d, "node").where("nlink = 0").select("inode")).distinct()


@R.query("dirty_counts", f"with {STANDING} select op, cast(count(*) as bigint) as ops, cast(count(distinct inode) as bigint) as inodes, cast(sum(coalesce(length, 0)) as bigint) as bytes from st group by 1")
def dirty_counts(spark: SparkSession, d: str) -> DataFrame:
    return standing(table(spark, d, "ojournal")).groupBy("op").agg(F.count(F.lit(1)).alias("ops"), F.countDistinct("inode").alias("inodes"), F.sum(F.coalesce("length", F.lit(0))).alias("bytes"))


@R.query("rebased_journal", f"with {STANDING}, s as (select session_id, max(seq) // 2 sealed from st group by 1) select st.session_id, st.seq, st.op, st.inode from st join s using (session_id) where seq > sealed")
def rebased_journal(spark: SparkSession, d: str) -> DataFrame:
    """What is left of a session's operations after the first half of its sequence was sealed."""
    ops = standing(table(spark, d, "ojournal"))
    sealed = ops.groupBy("session_id").agg(F.expr("max(seq) div 2").alias("_s"))
    return ops.join(sealed, "session_id").where("seq > _s").select("session_id", "seq", "op", "inode")


@R.query("state_at_day", f"""with {VERSIONS_SQL}, k as (select * from ver where rn = 1), m as (select (min(gen) + max(gen)) // 2 g from k)
select user_id, gen, event_type, value from (select *, row_number() over (partition by user_id order by gen desc) r from k where gen <= (select g from m)) where r = 1""")
def state_at_day(spark: SparkSession, d: str) -> DataFrame:
    """The newest row of each user up to the middle day: a mount of an older generation."""
    v = day_versions(spark, d)
    lo, hi = v.agg(F.min("gen"), F.max("gen")).first()
    return I.newest_wins(v.where(F.col("gen") <= (lo + hi) // 2), ["user_id"], ["gen"], ["gen", "event_type", "value"])


@R.query("rescue_candidates", """with p as (select distinct name, generation, trailer_hash from pack), v as (select *, substr(name, length(name), 1) branch from p where trailer_hash is not null), r as (select *, rank() over (partition by branch order by generation desc) rk, count(*) over (partition by branch, generation) n from v)
select branch, generation, cast(n as bigint) as candidates, case when n > 1 then 'ambiguous' else 'recoverable' end as verdict, case when n = 1 then min(name) end as name from r where rk = 1 group by branch, generation, n""")
def rescue_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Per branch (the last letter of a pack's name) the newest verified backup; two of one generation are ambiguous."""
    backups = table(spark, d, "pack").select("name", "generation", "trailer_hash").distinct().select(F.substring("name", -1, 1).alias("branch"), "generation", "name", F.col("trailer_hash").isNotNull().alias("verified"))
    return rescue.candidates(backups)


@R.query("root_location", """with c as (select distinct catalog_identity key from nested where catalog_identity is not null), e as (select key, pack from pack_entry where type = 'catalog'), bad as (select count(*) n from pack where trailer_hash is null)
select c.key, min(e.pack) as pack, case when min(e.pack) is not null then 'located' when (select n from bad) > 0 then 'unknown' else 'absent' end as state from c left join e on e.key = c.key group by 1""")
def root_location(spark: SparkSession, d: str) -> DataFrame:
    """Where each catalog is; while some trailer is unreadable, not found is not the same as absent."""
    unread = table(spark, d, "pack").where("trailer_hash is null").limit(1).count() > 0
    roots = table(spark, d, "nested").select(F.col("catalog_identity").alias("key")).dropna().distinct()
    return rescue.locate(roots, table(spark, d, "pack_entry").where("type = 'catalog'"), complete=not unread)


@R.query("prefetch_refusal", "select cast(sum(size) as bigint) as bytes, sum(size) > 1000000000 as refused from (select name, max(size) size from pack where name in (select pack from ochunk) group by 1)")
def prefetch_refusal(spark: SparkSession, d: str) -> DataFrame:
    """The packs that chunks refer to, refused before a byte moves if they exceed 1 GB."""
    needed = table(spark, d, "pack").groupBy("name").agg(F.max("size").alias("size")).join(table(spark, d, "ochunk").select(F.col("pack").alias("name")), "name", "left_semi")
    return needed.agg(F.sum("size").alias("bytes")).select("bytes", (F.col("bytes") > 1_000_000_000).alias("refused"))


@R.query("op_counters", "select cast(ts as date)::varchar as phase, cast(count(*) filter (event_type = 'view') as bigint) as view, cast(count(*) filter (event_type = 'click') as bigint) as click, cast(count(*) filter (event_type = 'purchase') as bigint) as purchase, cast(count(*) filter (event_type = 'error') as bigint) as error, cast(count(*) filter (event_type = 'signup') as bigint) as signup from events group by 1")
def op_counters(spark: SparkSession, d: str) -> DataFrame:
    """Operations by phase (day) and kind, one column a kind."""
    kinds = ["view", "click", "purchase", "error", "signup"]
    e = table(spark, d, "events").groupBy(F.col("ts").cast("date").cast("string").alias("phase")).pivot("event_type", kinds).count()
    return e.select("phase", *(F.coalesce(k, F.lit(0)).alias(k) for k in kinds))


@R.query("usage_by_directory", "select lineage, map_from_entries(list((type, n) order by type)) as by_type from (select inode >> 40 lineage, type, cast(count(*) as bigint) n from (select distinct inode, type from edge where inode is not null) group by 1, 2) group by 1")
def usage_by_directory(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edge").where("inode is not null").select("inode", "type").distinct().groupBy(S.lineage_of(F.col("inode")).alias("lineage"), "type").agg(F.count(F.lit(1)).alias("n"))
    return e.groupBy("lineage").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("by_type"))


@R.query("size_contributors", "select 'name' as part, cast(sum(octet_length(name)) as bigint) as bytes from edge union all select 'catalog_identity', sum(octet_length(catalog_identity)) from nested union all select 'trailer_hash', sum(octet_length(trailer_hash)) from pack union all select 'pack', sum(octet_length(encode(name))) from pack")
def size_contributors(spark: SparkSession, d: str) -> DataFrame:
    """Bytes that each part adds to a root document."""
    part = lambda t, c, n: table(spark, d, t).agg(F.sum(F.octet_length(c)).alias("bytes")).select(F.lit(n).alias("part"), "bytes")
    return part("edge", "name", "name").unionByName(part("nested", "catalog_identity", "catalog_identity")).unionByName(part("pack", "trailer_hash", "trailer_hash")).unionByName(part("pack", "name", "pack"))


@R.query("freeze_list", f"with {STANDING}, h as (select distinct inode, mode, length from node where generation = (select max(generation) from node)) select c.inode, h.mode, h.length from (select distinct inode from st where op in (1, 4)) c join h on h.inode = c.inode")
def freeze_list(spark: SparkSession, d: str) -> DataFrame:
    """Inodes with journalled content, with their attributes: what a snapshot freezes."""
    node = table(spark, d, "node")
    head = node.where(F.col("generation") == F.lit(node.agg(F.max("generation")).first()[0])).select("inode", "mode", "length").distinct()
    return standing(table(spark, d, "ojournal")).where("op in (1, 4)").select("inode").distinct().join(head, "inode")


@R.query("collection_due", "select event_id, event_type = 'purchase' or (event_type = 'view' and gap >= 600) as due from (select event_id, event_type, coalesce(epoch(ts)::bigint - lag(epoch(ts)::bigint) over (partition by user_id order by ts, event_id), 0) gap from events)")
def collection_due(spark: SparkSession, d: str) -> DataFrame:
    """Whether to collect at each event of a user: after a purchase, or at a view 600 s after the event before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    e = table(spark, d, "events").withColumn("_t", at).withColumn("_gap", F.coalesce(F.col("_t") - F.lag("_t").over(w), F.lit(0)))
    return e.select("event_id", S.collection_due(F.col("event_type") == "purchase", F.col("event_type") == "view", F.col("_gap"), 600).alias("due"))
