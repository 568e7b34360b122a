"""Queries of maintenance: liveness, repack, collection, ledgers, tiers, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packstrata.functions import scalar as S
from packstrata.operators import folds, integrity, ledger, splitting
from packstrata.operators import liveness as L
from packstrata.operators import namespace as N
from packstrata.operators.asof import positions
from packstrata.plans.registry import Registry
from packstrata.session import Scratch
from packstrata.sources.tables import table

R = Registry()
#: Seconds; the moment maintenance is planned for, and the grace of deletions.
NOW, GRACE = 1_741_000_000, 72 * 3600

PACK_SQL = "p as (select name, max(size) size, max(condemned_at_unix) dead, min(generation) generation from pack group by 1)"
PE_SQL = "pe as (select distinct pack, key, off, length, type from pack_entry)"
LIVE_SQL = "live as (select distinct unhex(identity) key from ochunk where identity is not null union select distinct catalog_identity from nested)"
NS_SQL = "case when regexp_matches(name, '^p-[0-7][0-9a-fA-F]{15}-') then cast(concat('0x', substr(name, 3, 16)) as bigint) end"
LIVENESS_SQL = f"""{PE_SQL}, {LIVE_SQL}, f as (
 select pe.pack, count(*) entries, sum(pe.length) bytes, count(l.key) live_entries, sum(case when l.key is not null then pe.length else 0 end) live_bytes
 from pe left join live l on l.key = pe.key group by 1)"""


def packs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pack").groupBy("name").agg(F.max("size").alias("size"), F.max("condemned_at_unix").alias("dead"), F.min("generation").alias("generation"))


def placements(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pack_entry").select("pack", "key", "off", "length", "type").distinct()


def live_ids(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "ochunk").select(S.parse_hex(F.col("identity"), 32).alias("key"))
    return chunks.unionByName(table(spark, d, "nested").select(F.col("catalog_identity").alias("key"))).dropna().distinct()


def liveness(spark: SparkSession, d: str) -> DataFrame:
    return L.pack_liveness(placements(spark, d), live_ids(spark, d))


@R.query("pack_liveness", f"""with {LIVENESS_SQL} select pack, cast(entries as bigint) as entries, cast(bytes as bigint) as bytes, cast(live_entries as bigint) as live_entries, cast(live_bytes as bigint) as live_bytes,
case when bytes <= 0 then 1.0::double else live_bytes::double / bytes::double end as fraction from f""")
def pack_liveness(spark: SparkSession, d: str) -> DataFrame:
    return liveness(spark, d)


@R.query("packs_below_threshold", f"with {LIVENESS_SQL} select pack from f where bytes > 0 and live_bytes::double / bytes::double < 0.5")
def packs_below_threshold(spark: SparkSession, d: str) -> DataFrame:
    return liveness(spark, d).where("fraction < 0.5").select("pack")


@R.query("volume_liveness", f"with {LIVENESS_SQL} select cast(sum(entries) as bigint) as entries, cast(sum(bytes) as bigint) as bytes, cast(sum(live_bytes) as bigint) as live_bytes, sum(live_bytes)::double / sum(bytes)::double as fraction from f")
def volume_liveness(spark: SparkSession, d: str) -> DataFrame:
    total = liveness(spark, d).agg(F.sum("entries").alias("entries"), F.sum("bytes").alias("bytes"), F.sum("live_bytes").alias("live_bytes"))
    return total.withColumn("fraction", S.live_fraction(F.col("live_bytes"), F.col("bytes")))


@R.query("liveness_fail_closed", f"""with {LIVENESS_SQL}, broken as (select count(*) n from pack where trailer_hash is null)
select pack, cast(case when n > 0 then bytes else live_bytes end as bigint) as live_bytes, case when n > 0 or bytes <= 0 then 1.0::double else live_bytes::double / bytes::double end as fraction from f, broken""")
def liveness_fail_closed(spark: SparkSession, d: str) -> DataFrame:
    """A pack whose trailer cannot be verified makes the whole sweep incomplete: everything counts as live."""
    failures = table(spark, d, "pack").where("trailer_hash is null").count()
    return L.fail_closed(liveness(spark, d), failures).select("pack", "live_bytes", "fraction")


@R.query("unresolved_references", f"with {PE_SQL}, {LIVE_SQL} select key from live where key not in (select key from pe)")
def unresolved_references(spark: SparkSession, d: str) -> DataFrame:
    return L.unresolved(placements(spark, d), live_ids(spark, d))


@R.query("repack_plan", f"""with {LIVENESS_SQL}, {PACK_SQL}
select f.pack, cast(p.size - f.live_bytes as bigint) as reclaim, cast(f.live_bytes as bigint) as move from f join p on p.name = f.pack
where f.bytes > 0 and f.live_bytes::double / f.bytes::double < 0.5 and {NS_SQL} <= {(NOW - GRACE) * 1_000_000_000}""")
def repack_plan(spark: SparkSession, d: str) -> DataFrame:
    return L.repack_plan(liveness(spark, d), packs(spark, d), NOW, GRACE)


@R.query("repack_totals", f"""with {LIVENESS_SQL}, {PACK_SQL}, x as (select p.size - f.live_bytes reclaim, f.live_bytes move from f join p on p.name = f.pack
where f.bytes > 0 and f.live_bytes::double / f.bytes::double < 0.5 and {NS_SQL} <= {(NOW - GRACE) * 1_000_000_000})
select cast(count(*) as bigint) as packs, cast(coalesce(sum(move), 0) as bigint) as move, cast(coalesce(sum(reclaim), 0) as bigint) as reclaim, cast(ceil(coalesce(sum(move), 0) / 2097152.0) as bigint) as into_packs from x""")
def repack_totals(spark: SparkSession, d: str) -> DataFrame:
    return L.plan_totals(repack_plan(spark, d), 2 << 20)


@R.query("repack_within_ledger", f"""with {LIVENESS_SQL}, {PACK_SQL}, x as (select f.pack, p.size - f.live_bytes reclaim, length(f.pack) + 24 cost from f join p on p.name = f.pack
where f.bytes > 0 and f.live_bytes::double / f.bytes::double < 0.5), t as (select sum(cost) need from x),
r as (select *, sum(cost) over (order by reclaim desc, pack rows unbounded preceding) used from x)
select pack, cast(reclaim as bigint) as reclaim, used <= 4096 as fits from r""")
def repack_within_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Largest gain first, as far as 4 KiB of ledger carry; the first that does not fit ends the run."""
    plan = liveness(spark, d).join(packs(spark, d).withColumnRenamed("name", "pack"), "pack").where("fraction < 0.5")
    plan = plan.select("pack", (F.col("size") - F.col("live_bytes")).alias("reclaim"), (F.length("pack") + 24).alias("cost"))
    return ledger.within_budget(plan, [], [F.desc("reclaim"), F.col("pack")], "cost", 4096).drop("cost")


@R.query("repack_copies", f"""with {LIVENESS_SQL} select distinct pe.key from pe join f on f.pack = pe.pack where f.bytes > 0 and f.live_bytes::double / f.bytes::double < 0.5 and pe.key in (select key from live)""")
def repack_copies(spark: SparkSession, d: str) -> DataFrame:
    """Identities to copy out of condemned packs: still referenced, each once."""
    thin = liveness(spark, d).where("fraction < 0.5").select("pack")
    return placements(spark, d).join(thin, "pack", "left_semi").join(live_ids(spark, d), "key", "left_semi").select("key").distinct()


@R.query("repack_trigger", "select generation, n as packs, case when n < 40 then 'too few packs' when (row_number() over (order by generation)) * 3600 < 21600 then 'too soon' else 'worthwhile' end as verdict from (select generation, cast(count(distinct name) as bigint) n from pack group by 1)")
def repack_trigger(spark: SparkSession, d: str) -> DataFrame:
    """The verdict for each generation as head, an hour apart, with 40 packs as the least."""
    g = table(spark, d, "pack").groupBy("generation").agg(F.countDistinct("name").alias("packs"))
    age = F.row_number().over(Window.orderBy("generation")) * 3600
    return g.select("generation", "packs", S.worthwhile(F.col("packs"), age, 40).alias("verdict"))


@R.query("index_liveness", f"""with {PACK_SQL} select generation as ref, cast(count(*) as bigint) as packs,
cast(count(*) filter (p.name is not null and p.dead is null) as bigint) as live_packs, cast(count(*) filter (p.name is null) as bigint) as gone, cast(count(*) filter (p.dead is not null) as bigint) as condemned
from (select distinct generation, pack from ochunk where pack is not null) o left join (select name, dead from p) p on p.name = o.pack group by 1""")
def index_liveness(spark: SparkSession, d: str) -> DataFrame:
    """For each generation's index: of the packs its chunks name, how many are live, gone, or condemned."""
    p = packs(spark, d)
    members = table(spark, d, "ochunk").where("pack is not null").select(F.col("generation").alias("ref"), "pack").distinct()
    listed = p.where("dead is null").select(F.col("name").alias("pack"))
    return L.ref_liveness(members, listed, p.where("dead is not null").select(F.col("name").alias("pack")))


@R.query("collectable_packs", f"""with {PACK_SQL}, live as (select pack n from ochunk where pack is not null union select name from p where dead > {NOW - GRACE})
select name, size from p where name not in (select n from live) and {NS_SQL} // 1000000000 <= {NOW - GRACE}""")
def collectable_packs(spark: SparkSession, d: str) -> DataFrame:
    """Packs that no chunk needs and no young condemnation protects."""
    objects, live = _objects(spark, d), _retained(spark, d)
    return L.collectable(objects, live, NOW, GRACE).select("name", "size")


def _objects(spark: SparkSession, d: str) -> DataFrame:
    return packs(spark, d).select("name", "size", F.floor(S.pack_time_ns(F.col("name")) / 1_000_000_000).alias("created"))


def _retained(spark: SparkSession, d: str) -> DataFrame:
    """The union of what chunks name and what was condemned less than GRACE ago.

    Without any chunk that names a pack there are no refs to go by, and the sweep is refused.
    """
    try:
        named = L.refuse_empty(table(spark, d, "ochunk").where("pack is not null").select(F.col("pack").alias("name")))
    except L.NothingLive as e:
        raise L.NothingLive("no chunk names a pack: every pack would count as garbage") from e
    return named.unionByName(packs(spark, d).where(F.col("dead") > NOW - GRACE).select("name")).distinct()


@R.query("space_report", f"""with {PACK_SQL}, live as (select pack n from ochunk where pack is not null union select name from p where dead > {NOW - GRACE}),
x as (select size, name in (select n from live) held, coalesce({NS_SQL} // 1000000000 <= {NOW - GRACE}, false) old from p)
select cast(count(*) as bigint) as scanned, cast(count(*) filter (held) as bigint) as retained, cast(count(*) filter (not held and not old) as bigint) as young,
cast(count(*) filter (not held and old) as bigint) as candidates, cast(coalesce(sum(size) filter (not held and old), 0) as bigint) as bytes from x""")
def space_report(spark: SparkSession, d: str) -> DataFrame:
    return L.space_report(_objects(spark, d), _retained(spark, d), NOW, GRACE)


KEEP = 3
# branches are the compressions of chunks; the oldest generation is tagged; catalogs are live if the root reaches the directory that names them
ROOTS_SQL = f"""{PACK_SQL}, {PE_SQL}, gens as (select alg, generation, dense_rank() over (partition by alg order by generation desc) r from (select distinct alg, generation from ochunk)),
kept as (select alg, generation, case when r = 1 then 'head' when r <= {KEEP} then 'last' else 'tag' end why from gens where r <= {KEEP} or generation = (select min(generation) from ochunk)),
walk(id) as (select 1::bigint union select e.inode from edge e join walk w on e.parent = w.id where e.inode in (select parent from edge)),
roots as (select distinct unhex(o.identity) key from ochunk o join kept k on k.alg = o.alg and k.generation = o.generation where regexp_matches(o.identity, '^[0-9a-fA-F]{{64}}$') union select catalog_identity from nested where parent in (select id from walk) and catalog_identity is not null)"""


@R.query("retained_generations", f"with recursive {ROOTS_SQL} select alg, generation, why from kept")
def retained_generations(spark: SparkSession, d: str) -> DataFrame:
    """Heads, the last three generations of each branch, and tags."""
    return _kept_generations(spark, d)


def _kept_generations(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "ochunk")
    return L.retained_generations(c, "alg", "generation", KEEP, c.agg(F.min("generation").alias("generation")))


def _from_roots(spark: SparkSession, d: str) -> DataFrame:
    """Keys that retained generations need: their chunks, and the catalogs of directories that the root reaches."""
    kept = F.broadcast(_kept_generations(spark, d).select("alg", "generation"))  # generations by branches
    chunks = table(spark, d, "ochunk").join(kept, ["alg", "generation"], "left_semi").select(S.parse_hex(F.col("identity"), 32).alias("key"))
    nested = table(spark, d, "nested").join(reachable_directories(spark, d).select(F.col("id").alias("parent")), "parent", "left_semi").select(F.col("catalog_identity").alias("key"))
    return chunks.unionByName(nested).dropna().distinct()


@R.query("sweep", f"""with recursive {ROOTS_SQL} select pe.pack, cast(count(*) as bigint) as entries, cast(sum(pe.length) as bigint) as bytes, cast(count(*) filter (k.key is not null or pe.type in ('sb', 'shard')) as bigint) as live_entries,
cast(coalesce(sum(pe.length) filter (k.key is not null or pe.type in ('sb', 'shard')), 0) as bigint) as live_bytes from pe left join roots k on k.key = pe.key group by 1""")
def sweep(spark: SparkSession, d: str) -> DataFrame:
    """Live bytes of every pack from what retained roots reach; backups and shards are live whatever is referenced."""
    keys = Scratch(spark).keep(_from_roots(spark, d))
    return L.pack_liveness(placements(spark, d), keys, F.col("type").isin("sb", "shard")).drop("fraction")


@R.query("gc_plan", f"""with recursive {ROOTS_SQL}, named as (select distinct pack n from pe where key in (select key from roots) or type in ('sb', 'shard')), again as (select o.pack n from ochunk o where o.generation = (select max(generation) from ochunk) and o.pack is not null),
x as (select name, size, dead, {NS_SQL} // 1000000000 made from p)
select name, size, case when name in (select n from named) then 'live' when dead > {NOW - GRACE} then 'ledger' when made is null then 'unknown-age' when made > {NOW - GRACE} then 'young' when name in (select n from again) then 'relisted' else 'delete' end as verdict from x""")
def gc_plan(spark: SparkSession, d: str) -> DataFrame:
    """What a collection does with every pack, after the head's own list of packs was read again."""
    keys = Scratch(spark).keep(L.refuse_empty(_from_roots(spark, d)))
    placed = placements(spark, d)
    live = placed.join(keys, "key", "left_semi").select("pack").unionByName(placed.where("type in ('sb', 'shard')").select("pack")).select(F.col("pack").alias("name")).distinct()
    c = table(spark, d, "ochunk")
    again = c.where(F.col("generation") == F.lit(c.agg(F.max("generation")).first()[0])).select(F.col("pack").alias("name"))
    return L.gc_plan(_objects(spark, d), live, packs(spark, d).select("name", F.col("dead").alias("at")), again, NOW, GRACE)


@R.query("gc_report", f"""with plan as ({{GC}}), n as (select *, row_number() over (partition by verdict order by name) r from plan)
select verdict, cast(count(*) as bigint) as objects, cast(sum(size) as bigint) as bytes, list(name order by name) filter (r <= 20) as sample from n group by 1""".replace("{GC}", R.sql["gc_plan"]))
def gc_report(spark: SparkSession, d: str) -> DataFrame:
    """The plan in numbers, with at most 20 names for each verdict."""
    return L.gc_report(gc_plan(spark, d))


@R.query("pack_times", f"with {PACK_SQL} select name, {NS_SQL} as ns from p")
def pack_times(spark: SparkSession, d: str) -> DataFrame:
    return packs(spark, d).select("name", S.pack_time_ns(F.col("name")).alias("ns"))


@R.query("ledger_carry", f"""with {PACK_SQL}, listed as (select distinct pack n from ochunk where generation = (select max(generation) from ochunk)),
old as (select name, dead seen from p where dead is not null and name not in (select n from listed where n is not null) and {NOW} - dead < {GRACE}),
new as (select name, {NOW} seen from p where dead is null and generation = (select min(generation) from p) and name not in (select n from listed where n is not null) and name not in (select name from old))
select name, cast(seen as bigint) as "at" from (select * from old union all select * from new)""")
def ledger_carry(spark: SparkSession, d: str) -> DataFrame:
    """The ledger of the next generation, which drops the packs of the first one."""
    p = packs(spark, d)
    first = p.agg(F.min("generation")).first()[0]
    c = table(spark, d, "ochunk")
    listed = c.where(F.col("generation") == F.lit(c.agg(F.max("generation")).first()[0])).select(F.col("pack").alias("name")).dropna()
    return ledger.carried(p.where("dead is not null").select("name", F.col("dead").alias("at")), p.where((F.col("dead").isNull()) & (F.col("generation") == F.lit(first))), listed, NOW, GRACE)


@R.query("ledger_cap", f"""with {PACK_SQL}, c as (select name, dead seen, length(name) + 24 cost from p where dead is not null)
select name, seen as "at", sum(cost) over (order by seen desc, name rows unbounded preceding) <= 1024 as fits from c""")
def ledger_cap(spark: SparkSession, d: str) -> DataFrame:
    """The newest condemned packs that 1 KiB of ledger holds."""
    c = packs(spark, d).where("dead is not null").select("name", F.col("dead").alias("at"), (F.length("name") + 24).alias("cost"))
    return ledger.within_budget(c, [], [F.desc("at"), F.col("name")], "cost", 1024).drop("cost")


@R.query("tier_choice", """with p as (select distinct name, size, generation from pack), r as (select *, row_number() over w place, sum(size) over w - size before from p window w as (partition by generation order by name desc rows unbounded preceding)),
s as (select *, max(case when size <= 0 or before + size > 67108864 or (place > 1 and size > before and before + size > 262144) then 1 else 0 end) over (partition by generation order by name desc rows unbounded preceding) stop from r)
select generation, name, size, stop = 0 and sum(case when stop = 0 then 1 else 0 end) over (partition by generation) >= 2 as merges from s""")
def tier_choice(spark: SparkSession, d: str) -> DataFrame:
    """The newest run of each generation's refs that is worth merging."""
    refs = table(spark, d, "pack").select("name", "size", "generation").distinct()
    return ledger.mergeable(refs, ["generation"], [F.desc("name")], "size").select("generation", "name", "size", "merges")


@R.query("last_generations", "select distinct generation, pack from (select generation, pack, dense_rank() over (partition by alg order by generation desc) r, alg from ochunk) where r <= 3 and pack is not null")
def last_generations(spark: SparkSession, d: str) -> DataFrame:
    """Packs of the last three generations of each branch (the compression)."""
    rows = table(spark, d, "ochunk").select("alg", "generation", "pack").distinct()
    return ledger.last_generations(rows, "alg", "generation", 3).where("pack is not null").select("generation", "pack").distinct()


@R.query("max_grace", "select max(case when l_quantity > 10 then l_quantity * 3600 end) as grace from lineitem")
def max_grace(spark: SparkSession, d: str) -> DataFrame:
    """The longest grace over all roots that state one."""
    return table(spark, d, "lineitem").agg(F.max(F.when(F.col("l_quantity") > 10, F.col("l_quantity") * 3600)).alias("grace"))


@R.query("cache_eviction", """with p as (select name, max(size) size, min(generation) generation, max(trailer_hash) trailer_hash from pack group by 1), c as (select name, size, generation, trailer_hash is null pinned from p)
select name, not pinned and coalesce(sum(case when pinned then 0 else size end) over (order by pinned, generation, name rows between unbounded preceding and 1 preceding), 0) < 100000000 as evicted from c""")
def cache_eviction(spark: SparkSession, d: str) -> DataFrame:
    """Oldest packs to evict until 100 MB are free; those without a hash are pinned."""
    p = table(spark, d, "pack").groupBy("name").agg(F.max("size").alias("size"), F.min("generation").alias("generation"), F.max("trailer_hash").alias("h"))
    return ledger.evictable(p, [], [F.col("generation"), F.col("name")], "size", 100_000_000, F.col("h").isNull()).select("name", "evicted")


@R.query("newest_first_probe", "select name, place from (select name, cast(row_number() over (order by generation desc, name desc) as bigint) place from (select distinct name, generation from pack)) where place <= 4")
def newest_first_probe(spark: SparkSession, d: str) -> DataFrame:
    """The four newest packs: where a lookup without an index tries first (a top-4 report)."""
    top = table(spark, d, "pack").select("name", "generation").distinct().orderBy(F.desc("generation"), F.desc("name")).limit(4)
    return top.select("name", F.row_number().over(Window.orderBy(F.desc("generation"), F.desc("name"))).cast("long").alias("place"))


@R.query("integrity", f"""with {PACK_SQL}, {PE_SQL}, e as (select distinct parent, name, inode, type from edge), n as (select distinct parent, name, catalog_identity from nested),
h as (select distinct inode, type from node where generation = (select max(generation) from node)),
o as (select distinct identity, pack, off, stored, logical from ochunk),
x as (
 select 'missing-pack' kind, pack subject from o where pack is not null and pack not in (select name from p)
 union all select 'missing-pack', pack from pe where pack not in (select name from p)
 union all select 'pack-trailer', name from pack where trailer_hash is null
 union all select 'pack-size', pack from (select pe.pack, max(pe.off + pe.length) used, max(p.size) size from pe join p on p.name = pe.pack group by 1) where used > size
 union all select 'pack-overlap', pack from (select pack, off, max(off + length) over (partition by pack order by off, length, key rows between unbounded preceding and 1 preceding) top from pe where length > 0) where top > off
 union all select 'missing-catalog', lower(hex(catalog_identity)) from n where catalog_identity is not null and catalog_identity not in (select key from pe where type = 'catalog')
 union all select 'identity', identity from o where not regexp_matches(identity, '^[0-9a-f]{{64}}$')
 union all select 'chunk-key', lower(hex(key)) from pe where octet_length(key) <> 32
 union all select 'dangling-entry', cast(inode as varchar) from e where inode not in (select inode from h)
 union all select 'type-mismatch', cast(e.inode as varchar) from e join h on h.inode = e.inode where h.type <> e.type
 union all select 'transition', cast(n.parent as varchar) || '/' || decode(n.name) from n left join e on e.parent = n.parent and e.name = n.name where e.parent is null
 union all select 'content', cast(parent as varchar) from e where parent in (select inode from h where type <> 2)
 union all select 'missing-chunk', identity from o where pack is not null and unhex(identity) not in (select key from pe)
 union all select 'chunk', identity from o where logical < 0 or stored < 0 or off < 0)
select distinct kind, subject from x""")
def integrity_check(spark: SparkSession, d: str) -> DataFrame:
    t = lambda name: table(spark, d, name)
    node = t("node")
    head = node.where(F.col("generation") == F.lit(node.agg(F.max("generation")).first()[0]))
    return integrity.check(t("edge"), t("nested"), head, t("pack"), t("pack_entry"), t("ochunk"))


@R.query("integrity_structure", f"""with recursive {PACK_SQL}, {PE_SQL}, e as (select distinct parent, name, inode, type from edge), o as (select distinct identity, pack, stored from ochunk where pack is not null and regexp_matches(identity, '^[0-9a-fA-F]{{64}}$')),
links as (select distinct parent, inode from e where inode in (select parent from e)), loops(a, b) as (select parent, inode from links union select l.a, k.inode from loops l join links k on k.parent = l.b),
placed as (select pe.*, p.size, p.name is not null and p.dead is null as listed from pe left join p on p.name = pe.pack where pe.type in ('shard', 'catalog')),
x as (
 select 'cycle' kind, cast(a as varchar) subject from loops where a = b
 union all select 'cycle', cast(inode as varchar) from (select distinct parent, name, inode from e) where inode in (select parent from e) group by inode having count(*) > 1
 union all select 'missing-shard', lower(hex(key)) from placed where type = 'shard' group by key having not bool_or(listed)
 union all select 'bad-' || type, lower(hex(key)) from placed where octet_length(key) <> 32 or length <= 0 or off < 0 or off + length > size
 union all select 'shard-routing', cast(inode as varchar) from (select inode from e where type <> 2 and inode is not null group by 1 having count(*) > 1) where inode not in (select inode from node where inode is not null and generation = (select max(generation) from node))
 union all select 'chunkrefs', identity from o where exists (select 1 from pe where pe.pack = o.pack and pe.key = unhex(o.identity)) and not exists (select 1 from pe where pe.pack = o.pack and pe.key = unhex(o.identity) and pe.length = o.stored))
select distinct kind, subject from x""")
def integrity_structure(spark: SparkSession, d: str) -> DataFrame:
    """The kinds of damage that ``integrity`` does not name: cycles, shards, unreadable catalogs, routing, stored lengths."""
    t = lambda name: table(spark, d, name)
    node = t("node")
    head = node.where(F.col("generation") == F.lit(node.agg(F.max("generation")).first()[0]))
    return integrity.structure(t("edge"), head, t("pack"), t("pack_entry"), t("ochunk"))


@R.query("integrity_counts", """with h as (select distinct inode, type, length from node where generation = (select max(generation) from node))
select type, cast(count(distinct inode) as bigint) as inodes, cast(sum(coalesce(length, 0)) as bigint) as bytes from h group by 1""")
def integrity_counts(spark: SparkSession, d: str) -> DataFrame:
    node = table(spark, d, "node")
    head = node.where(F.col("generation") == F.lit(node.agg(F.max("generation")).first()[0])).select("inode", "type", "length").distinct()
    return head.groupBy("type").agg(F.countDistinct("inode").alias("inodes"), F.sum(F.coalesce("length", F.lit(0))).alias("bytes"))


@R.query("generation_chain", """with g as (select generation, sha256(cast(count(*) as varchar)) h from (select distinct * from node) group by 1), c as (select *, lag(generation) over (order by generation) prev, lag(h) over (order by generation) prev_h from g)
select generation, prev, coalesce(generation = prev + 1, false) as adjacent, max(generation) over (order by generation rows between unbounded preceding and 1 preceding) < generation as rises from c""")
def generation_chain(spark: SparkSession, d: str) -> DataFrame:
    """Each generation against the one before: is it the next number, and does it never fall back."""
    return integrity.chain(table(spark, d, "node").select("generation").distinct(), "generation")


@R.query("journal_lost_ranges", """with s as (select distinct session_id, seq from ojournal where seq is not null and session_id is not null), l as (select *, lag(seq) over (partition by session_id order by seq) prev from s)
select session_id, prev + 1 as first_lost, seq - 1 as last_lost from l where seq > prev + 1""")
def journal_lost_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Gaps in each session's sequence: operations never received."""
    return integrity.lost_ranges(table(spark, d, "ojournal"), "session_id", "seq")


@R.query("catalog_split")
def catalog_split(spark: SparkSession, d: str) -> DataFrame:
    """Directories that become catalogs of their own, at most 32 KiB each, and what every directory then weighs."""
    node = table(spark, d, "node")
    head = node.where(F.col("generation") == F.lit(node.agg(F.max("generation")).first()[0])).distinct()
    return splitting.split(table(spark, d, "edge"), head, 32 << 10)


@R.query("reachable", """with recursive l as (select distinct parent src, inode dst from edge where inode in (select parent from edge)), w(id) as (select 1::bigint union select l.dst from l join w on l.src = w.id) select id from w""")
def reachable_directories(spark: SparkSession, d: str) -> DataFrame:
    """Directories reachable from the root, cycles included."""
    e = table(spark, d, "edge")
    links = e.join(e.select(F.col("parent").alias("inode")).distinct(), "inode", "left_semi").select(F.col("parent").alias("src"), F.col("inode").alias("dst")).distinct()
    return L.reachable(links, spark.range(1, 2).toDF("id")).select("id")


@R.query("rename_into_self", """with recursive e as (select distinct parent, inode from edge), dirs as (select n, row_number() over (order by sha256(cast(n as varchar)), n) k from (select distinct parent n from e)),
asked as (select d.n src, t.n dst from dirs d join dirs t on t.k = (d.k + 1) % (select count(*) + 1 from dirs) or t.k = 1 and d.k = (select count(*) from dirs) union select inode, parent from e where inode in (select parent from e) union select parent, inode from e where inode in (select parent from e)),
up(n, a) as (select n, n from dirs union select up.n, e.parent from up join e on e.inode = up.a)
select src, dst, exists (select 1 from up where up.n = asked.dst and up.a = asked.src) as refused from asked""")
def rename_into_self(spark: SparkSession, d: str) -> DataFrame:
    """Whether moving directory src into directory dst would put it below itself: is src above dst, or dst itself.

    Asked of every directory against the next one in the order of a hash, and
    of both ends of every edge between directories, either way.
    """
    e = table(spark, d, "edge")
    return N.moves_refused(e, _moves(e))


def _moves(e: DataFrame) -> DataFrame:
    dirs = e.select(F.col("parent").alias("n")).dropna().distinct()
    hashed = positions(dirs.select(F.struct(F.sha2(F.col("n").cast("string"), 256).alias("h"), "n").alias("k")), "k").select(F.col("k.n").alias("n"), "place")
    count = dirs.count()
    after = hashed.select(F.col("n").alias("dst"), F.pmod(F.col("place") - 1 + count, F.lit(count)).alias("place"))
    ends = e.join(dirs.select(F.col("n").alias("inode")), "inode", "left_semi").select("parent", "inode").dropna()
    both = ends.select(F.col("inode").alias("src"), F.col("parent").alias("dst")).unionByName(ends.select(F.col("parent").alias("src"), F.col("inode").alias("dst")))
    return hashed.select(F.col("n").alias("src"), "place").join(after, "place").select("src", "dst").unionByName(both).distinct()


@R.query("records_out_of_order", "select pack, key from (select pack, off, key, lag(key) over (partition by pack order by off, key) b from (select distinct pack, off, key from pack_entry)) where b >= key")
def records_out_of_order(spark: SparkSession, d: str) -> DataFrame:
    """Entries whose key does not follow the one before them in their pack."""
    e = table(spark, d, "pack_entry").select("pack", "off", "key").distinct()
    return integrity.out_of_order(e, ["pack"], "off", "key").select("pack", "key")


@R.query("retired_indexes", f"""with recursive {PACK_SQL}, c as (select name, length(name) * 7 % 61 + 24 cost, row_number() over (order by dead, name) k from p where dead is not null),
w(k, name, used, retired) as (select k, name, case when cost <= 1024 then cost else 0 end, cost <= 1024 from c where k = 1 union all
 select c.k, c.name, case when used + cost <= 1024 then used + cost else used end, used + cost <= 1024 from w join c on c.k = w.k + 1)
select name, retired from w""")
def retired_indexes(spark: SparkSession, d: str) -> DataFrame:
    """Condemned refs in order of age that 1 KiB of ledger takes; one that does not fit is passed over, smaller ones behind it still go."""
    c = packs(spark, d).where("dead is not null").select(F.lit("index").alias("kind"), "dead", "name", (F.length("name") * 7 % 61 + 24).alias("cost"))
    return folds.sequential_parts(c, ["kind"], ["dead", "name"], ["name", "cost"], folds.skip_and_continue(1024), flags=True).select("name", (F.col("part") == 1).alias("retired"))


@R.query("kept_index_entries", f"""with {PACK_SQL} select distinct pe.key, pe.pack from pack_entry pe join p on p.name = pe.pack where p.dead is null""")
def kept_index_entries(spark: SparkSession, d: str) -> DataFrame:
    """Index entries to re-emit when an index is retired: those that name a listed pack."""
    listed = packs(spark, d).where("dead is null").select(F.col("name").alias("pack"))
    return table(spark, d, "pack_entry").select("key", "pack").join(listed, "pack", "left_semi").distinct().select("key", "pack")


@R.query("backup_scan", """select name, generation, place from (select name, generation, cast(row_number() over (order by generation desc, name desc) as bigint) place from (select distinct name, generation from pack where trailer_hash is not null)) where place <= 1024""")
def backup_scan(spark: SparkSession, d: str) -> DataFrame:
    """The newest 1,024 verified packs: the budget of trailers that a search for backups reads."""
    top = table(spark, d, "pack").where("trailer_hash is not null").select("name", "generation").distinct().orderBy(F.desc("generation"), F.desc("name")).limit(1024)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("generation"), F.desc("name"))).cast("long"))


@R.query("merge_back", "select a.n as child, b.n as parent, a.w < 20000 and a.w + b.w - 200 <= 50000 as merges from (select parent n, count(*) * 200 w from (select distinct parent, name from edge) group by 1) a join (select distinct parent, inode from edge) e on e.inode = a.n join (select parent n, count(*) * 200 w from (select distinct parent, name from edge) group by 1) b on b.n = e.parent")
def merge_back(spark: SparkSession, d: str) -> DataFrame:
    """Which directory's catalog would return to its parent's, by the weight of their own entries."""
    e = table(spark, d, "edge")
    w = e.select("parent", "name").distinct().groupBy("parent").agg((F.count(F.lit(1)) * S.ENTRY_WEIGHT).alias("w"))
    links = e.select("parent", F.col("inode").alias("child")).distinct()
    both = links.join(w.select(F.col("parent").alias("child"), F.col("w").alias("_c")), "child").join(w.withColumnRenamed("w", "_p"), "parent")
    return both.select("child", "parent", S.should_merge(F.col("_c"), F.col("_p"), 50_000, 20_000).alias("merges"))
