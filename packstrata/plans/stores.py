"""Queries that go through a store, files or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packstrata.plans.problems import R as PROBLEMS
from packstrata.plans.registry import Registry
from packstrata.session import fresh_folder
from packstrata.sources import objects as O
from packstrata.sources.generations import Store
from packstrata.sources.tables import table
from packstrata.streaming.journal import JournalLog, journal_stream

R = Registry()
OP_NAMES = {1: "place", 2: "truncate", 3: "forget", 4: "adopt"}


def fresh(spark: SparkSession) -> str:
    return fresh_folder(spark, "store")


@R.query("publish_and_travel", "select name, size, generation, 0 as at_generation from (select distinct name, size, generation from pack) union all select name, size, generation, 1 from (select distinct name, size, generation from pack) where generation > (select min(generation) from pack)")
def publish_and_travel(spark: SparkSession, d: str) -> DataFrame:
    """Two generations of the pack list committed, and both read back."""
    store = Store(spark, fresh(spark))
    packs = table(spark, d, "pack").select("name", "size", "generation").distinct()
    first = store.commit("main", {"pack": packs}, expected=-1)
    low = packs.agg(F.min("generation")).first()[0]
    second = store.commit("main", {"pack": packs.where(F.col("generation") > F.lit(low))}, expected=first.generation)
    at = lambda r: store.read(r, "pack").withColumn("at_generation", F.lit(r.generation))
    return at(first).unionByName(at(second))


@R.query("pack_files", "select pack, key, off from pack_entry")
def pack_files(spark: SparkSession, d: str) -> DataFrame:
    """Entries written as key-sorted pack files and scanned again."""
    folder = fresh(spark)
    O.write_packs(table(spark, d, "pack_entry").select("pack", "key", "off"), folder)
    return spark.read.parquet(folder)


@R.query("plan_text", """select case op when 1 then 'place' when 2 then 'truncate' when 3 then 'forget' when 4 then 'adopt' else 'op' || coalesce(cast(op as varchar), '?') end as op, coalesce(cast(inode as varchar), '?') as path,
cast(handle as varchar) as handle, cast(fileoff as varchar) as off, cast(length as varchar) as len from ojournal""")
def plan_text(spark: SparkSession, d: str) -> DataFrame:
    """Every journal row, of any operation, as a line of a plan, parsed again; what a row lacks is no argument."""
    j = table(spark, d, "ojournal")
    word = F.coalesce(F.create_map(*(F.lit(x) for kv in OP_NAMES.items() for x in kv))[F.col("op")], F.concat(F.lit("op"), F.coalesce(F.col("op").cast("string"), F.lit("?"))))
    args = [F.concat(F.lit(f"{k}="), F.col(c).cast("string")) for k, c in (("handle", "handle"), ("off", "fileoff"), ("len", "length"))]
    lines = j.select(F.concat_ws(" ", word, F.coalesce(F.col("inode").cast("string"), F.lit("?")), *args).alias("value"))
    return O.parse_plan(lines).select("op", "path", *(F.col("args")[k].alias(k) for k in ("handle", "off", "len")))


@R.query("streamed_content_map", PROBLEMS.sql["p6_found"])
def streamed_content_map(spark: SparkSession, d: str) -> DataFrame:
    """The content map of a journal that arrived as a stream of files."""
    log = JournalLog(spark, fresh(spark))
    log.start(journal_stream(spark, f"{d}/ojournal.parquet")).awaitTermination()
    return log.map()


@R.query("object_list")
def object_list(spark: SparkSession, d: str) -> DataFrame:
    """Every object below the folder, with its size."""
    return O.objects(spark, d, "*.parquet").select("path", "length")
