"""Queries on content: chunks, identities, deduplication, stored forms, reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packstrata.functions import chunking as C
from packstrata.functions import scalar as S
from packstrata.operators import folds
from packstrata.plans.registry import Registry
from packstrata.sources.tables import table

R = Registry()


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("inode"), F.col("text").cast("binary").alias("data"))


@R.query("content_identity", "select doc_id as inode, sha256(text) as identity from documents")
def content_identity(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("inode", F.sha2("data", 256).alias("identity"))


@R.query("hex_round_trip", "select identity, regexp_matches(identity, '^[0-9a-fA-F]{64}$') as well_formed from ochunk")
def hex_round_trip(spark: SparkSession, d: str) -> DataFrame:
    parsed = S.parse_hex(F.col("identity"), 32)
    return table(spark, d, "ochunk").select("identity", F.coalesce(S.hex_of(parsed) == F.lower("identity"), F.lit(False)).alias("well_formed"))


@R.query("content_defined_chunks")
def content_defined_chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.content_chunks(files(spark, d), "inode", "data")


@R.query("fixed_chunks", """with f as (select doc_id inode, text, octet_length(encode(text)) n from documents where length(text) > 0),
p as (select inode, text, n, unnest(range(0, n, 1024)) a from f)
select inode, cast(a // 1024 as bigint) as idx, cast(a as bigint) as off, cast(least(1024, n - a) as bigint) as llen from p""")
def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.fixed_chunks(files(spark, d), "inode", "data", 1024).drop("identity")


@R.query("dedup_ratio")
def dedup_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and bytes of all texts, and of distinct chunks only."""
    chunks = C.content_chunks(files(spark, d), "inode", "data")
    once = chunks.groupBy("identity").agg(F.count(F.lit(1)).alias("n"), F.first("llen").alias("llen"))
    return once.agg(
        F.sum("n").alias("chunks"), F.count(F.lit(1)).alias("unique_chunks"), F.sum(F.col("n") * F.col("llen")).alias("bytes"), F.sum("llen").alias("unique_bytes"),
        (1 - F.sum("llen") / F.sum(F.col("n") * F.col("llen"))).alias("saved"),
    )


@R.query("whole_file_dedup", """with f as (select sha256(text) id, octet_length(encode(text)) n from documents where text is not null), u as (select id, count(*) c, min(n) n from f group by 1)
select cast(sum(c) as bigint) as files, cast(count(*) as bigint) as unique_files, cast(sum(c * n) as bigint) as bytes, cast(sum(n) as bigint) as unique_bytes from u""")
def whole_file_dedup(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d).where("data is not null").groupBy(F.sha2("data", 256).alias("id")).agg(F.count(F.lit(1)).alias("c"), F.min(F.length("data")).alias("n"))
    return f.agg(F.sum("c").alias("files"), F.count(F.lit(1)).alias("unique_files"), F.sum(F.col("c") * F.col("n")).alias("bytes"), F.sum("n").cast("long").alias("unique_bytes"))


@R.query("size_classes", """with f as (select octet_length(encode(coalesce(text, ''))) n from documents)
select case when n = 0 then 'empty' when n <= 2048 then 'inline' when n <= 4096 then 'single' when n <= 65536 then 'multi' else 'large' end as class, cast(count(*) as bigint) as files, cast(sum(n) as bigint) as bytes from f group by 1""")
def size_classes(spark: SparkSession, d: str) -> DataFrame:
    n = F.coalesce(F.length("data"), F.lit(0))
    kind = F.when(n == 0, "empty").when(n <= S.INLINE_MAX, "inline").when(n <= 4096, "single").when(n <= 65536, "multi").otherwise("large")
    return files(spark, d).groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("files"), F.sum(n).alias("bytes"))


@R.query("inline_or_chunked", """select doc_id as inode, n = 0 as bare, n > 0 and n <= 2048 as is_inline, n > 2048 as is_chunked from (select doc_id, octet_length(encode(coalesce(text, ''))) n from documents)""")
def inline_or_chunked(spark: SparkSession, d: str) -> DataFrame:
    n = F.coalesce(F.length("data"), F.lit(0))
    return files(spark, d).select("inode", (n == 0).alias("bare"), ((n > 0) & (n <= S.INLINE_MAX)).alias("is_inline"), (n > S.INLINE_MAX).alias("is_chunked"))


@R.query("stored_if_smaller")
def stored_if_smaller(spark: SparkSession, d: str) -> DataFrame:
    return C.stored_form(files(spark, d), "inode", "data").select("inode", "alg", F.length("stored").cast("long").alias("clen"))


@R.query("stored_round_trip", "select doc_id as inode, encode(text) as data from documents")
def stored_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return C.plain_form(C.stored_form(files(spark, d), "inode", "data"), "inode")


@R.query("sealed_round_trip", "select doc_id as inode, encode(text) as data, cast(octet_length(encode(text)) + 28 as integer) as sealed_bytes from documents")
def sealed_round_trip(spark: SparkSession, d: str) -> DataFrame:
    key = F.lit(b"0123456789abcdef0123456789abcdef")
    box = files(spark, d).withColumn("box", C.sealed(F.col("data"), key))
    return box.select("inode", C.opened(F.col("box"), key).alias("data"), F.length("box").alias("sealed_bytes"))


@R.query("carried_content", """with g as (select generation, lag(generation) over (order by generation) prev from (select distinct generation from node)),
n as (select distinct generation, inode, mtime_ns, length from node)
select a.generation, cast(count(*) as bigint) as files, cast(count(b.inode) as bigint) as carried from n a join g on g.generation = a.generation
left join n b on b.generation = g.prev and b.inode = a.inode and b.length is not distinct from a.length and b.mtime_ns is not distinct from a.mtime_ns group by 1""")
def carried_content(spark: SparkSession, d: str) -> DataFrame:
    """Files of each generation whose content the one before already has: they are not chunked again."""
    n = table(spark, d, "node").select("generation", "inode", "mtime_ns", "length").distinct()
    order = n.select("generation").distinct()
    order = order.select("generation", F.lag("generation").over(Window.orderBy("generation")).alias("prev"))
    w = Window.partitionBy("inode").orderBy("generation")
    same = (F.lag("generation").over(w) == F.col("prev")) & F.lag("length").over(w).eqNullSafe(F.col("length")) & F.lag("mtime_ns").over(w).eqNullSafe(F.col("mtime_ns"))
    told = n.join(order, "generation").withColumn("_c", F.coalesce(same, F.lit(False)))
    return told.groupBy("generation").agg(F.count(F.lit(1)).alias("files"), F.count_if("_c").alias("carried"))


@R.query("dedup_sidecar", """with k as (select identity from dedup_known), f as (select identity, min(arrival) first_arrival, count(*) n from dedup_chunk where identity is not null group by 1)
select f.identity, f.first_arrival, cast(f.n as bigint) as deliveries from f where f.identity not in (select identity from k)""")
def dedup_sidecar(spark: SparkSession, d: str) -> DataFrame:
    """What a generation adds to the table of known chunks: new identities with their first arrival."""
    f = table(spark, d, "dedup_chunk").where("identity is not null").groupBy("identity").agg(F.min("arrival").alias("first_arrival"), F.count(F.lit(1)).alias("deliveries"))
    return f.join(table(spark, d, "dedup_known").select("identity"), "identity", "left_anti")


@R.query("read_spans", """with recursive c as (select distinct pack, off, stored from ochunk where pack is not null and off is not null and stored is not null), r as (select *, row_number() over (partition by pack order by off, stored) k from c),
w(pack, k, part, lo, hi) as (select pack, k, 1, off, off + stored from r where k = 1 union all
 select r.pack, r.k, case when j then part else part + 1 end, case when j then lo else r.off end, r.off + r.stored from (select r.*, w.part, w.lo, r.off - w.hi between 0 and 1048576 and r.off + r.stored - w.lo <= 8388608 j from w join r on r.pack = w.pack and r.k = w.k + 1) r)
select w.pack, cast(w.part as bigint) as part, min(r.off) as off, max(r.off + r.stored) as "end", cast(count(*) as bigint) as chunks from w join r on r.pack = w.pack and r.k = w.k group by 1, 2""")
def read_spans(spark: SparkSession, d: str) -> DataFrame:
    """Ranged reads of every pack's chunks: gaps up to 1 MiB are read over, spans end at 8 MiB."""
    chunks = table(spark, d, "ochunk").where("pack is not null and off is not null and stored is not null").select("pack", "off", "stored").distinct()
    parts = folds.sequential_parts(chunks, ["pack"], ["off", "stored"], ["off", "stored"], folds.spans(1 << 20, 8 << 20))
    return parts.groupBy("pack", "part").agg(F.min("off").alias("off"), F.max(F.col("off") + F.col("stored")).alias("end"), F.count(F.lit(1)).alias("chunks"))


@R.query("gap_islands", """with c as (select distinct pack, off, stored from ochunk where pack is not null),
a as (select *, max(off + stored) over (partition by pack order by off, stored rows between unbounded preceding and 1 preceding) top from c),
b as (select *, sum(case when top is null or off - top > 1048576 then 1 else 0 end) over (partition by pack order by off, stored rows unbounded preceding) run from a)
select pack, min(off) as off, max(off + stored) as "end", cast(count(*) as bigint) as pieces from b group by pack, run""")
def gap_islands(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "ochunk").where("pack is not null").select("pack", "off", "stored").distinct()
    return folds.gap_islands(chunks, ["pack"], "off", "stored", 1 << 20)


@R.query("human_sizes", """select distinct stored, case when stored < 1024 then stored || ' B' when stored < 1048576 then printf('%.1f KiB', round(stored / 1024.0::double, 1)) when stored < 1073741824 then printf('%.1f MiB', round(stored / 1048576.0::double, 1))
when stored < 1099511627776 then printf('%.1f GiB', round(stored / 1073741824.0::double, 1)) else printf('%.1f TiB', round(stored / 1099511627776.0::double, 1)) end as text from ochunk where stored is not null""")
def human_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ochunk").where("stored is not null").select("stored").distinct().select("stored", S.human_bytes(F.col("stored")).alias("text"))
