"""Queries of the llm operators and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packstrata.llm.lookalike import consistent_forms, lookalike_classes, lookalike_pairs
from packstrata.llm.packing import CAPACITY, pack
from packstrata.llm.fingerprints import BITS
from packstrata.llm.seen import SHARD_KEYS, SealedKeys, seen_before, seen_errors
from packstrata.llm.tokens import token_bytes, token_ids, tokenizer_file
from packstrata.plans.registry import Registry
from packstrata.session import fresh_folder
from packstrata.sources.tables import table

R = Registry()


def ranks() -> str:
    """The rank file of byte_bpe_50k; PACKSTRATA_RANKS names another place."""
    return os.environ.get("PACKSTRATA_RANKS") or tokenizer_file("byte_bpe_50k.tiktoken")


@R.query("p5_found", """
select arrival from dedup_chunk d where identity is not null and (
  identity in (select identity from dedup_known where identity is not null)
  or arrival > (select min(arrival) from dedup_chunk e where e.identity = d.identity))""")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Arrivals whose key is known or came before."""
    return seen_before(table(spark, d, "dedup_chunk"), "identity", "arrival", table(spark, d, "dedup_known"))


@R.query("p5_error_rates")
def p5_error_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rate of wrong answers of the filters, per batch of arrivals."""
    return seen_errors(table(spark, d, "dedup_chunk"), "identity", "arrival", table(spark, d, "dedup_known"))


@R.query("p5_sealed_run", """with m as (select quantile_disc(arrival, 0.5) mid from dedup_chunk where identity is not null), old as (select identity from dedup_chunk, m where identity is not null and arrival < mid union select identity from dedup_known where identity is not null),
late as (select distinct identity from dedup_chunk, m where identity is not null and arrival >= mid)
select cast(count(*) as bigint) as probed, cast(count(*) filter (identity in (select identity from old)) as bigint) as seen, 0::bigint as missed, true as within_bound from late""")
def p5_sealed_run(spark: SparkSession, d: str) -> DataFrame:
    """The later half of the arrivals against stored filters of the known keys and of the earlier half.

    The run itself reads no old key; only this report on it does. The bound is
    five times what two filters may claim wrongly on average, and a few.
    """
    rows, known = table(spark, d, "dedup_chunk").where("identity is not null"), table(spark, d, "dedup_known")
    at, n = rows.agg(F.expr("percentile_disc(0.5) within group (order by arrival)"), F.count(F.lit(1))).first()
    early, late = rows.where(F.col("arrival") < F.lit(at)), rows.where(F.col("arrival") >= F.lit(at))
    store = SealedKeys(spark, fresh_folder(spark, "sealed"), max(1, -(-n // SHARD_KEYS)))
    store.seal(known, "identity", 0)
    store.seal(early, "identity", 1)
    old = known.select("identity").unionByName(early.select("identity")).dropna().distinct().withColumn("_old", F.lit(True))
    told = store.claims(late, "identity").join(old, "identity", "left").withColumn("_old", F.coalesce("_old", F.lit(False)))
    return told.agg(
        F.count(F.lit(1)).alias("probed"), F.count_if("_old").alias("seen"), F.count_if(F.col("_old") & ~F.col("claimed")).alias("missed"),
        (F.count_if(F.col("claimed") & ~F.col("_old")) <= 10 * 2.0**-BITS * F.count_if(~F.col("_old")) + 5).alias("within_bound"),
    )


@R.query("p7_ids")
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every text."""
    return token_ids(table(spark, d, "documents"), ranks())


@R.query("p7_round_trip", "select doc_id, encode(text) as bytes from documents")
def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The bytes that the ids of every text stand for: the text again."""
    return token_bytes(token_ids(table(spark, d, "documents"), ranks()), ranks())


@R.query("p8_containers")
def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of 2,048 tokens of every document, and its place among its tokens."""
    documents = table(spark, d, "documents")
    sizes = token_ids(documents, ranks(), keep=False)
    return pack(sizes, "doc_id", "n_tokens", documents.count())


@R.query("p8_fill")
def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full containers are, by eighths: containers and tokens."""
    full = p8_containers(spark, d).groupBy("container").agg(F.sum("n_tokens").alias("t"))
    return full.groupBy(F.ceil(F.col("t") * 8 / CAPACITY).cast("long").alias("eighths")).agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"))


@R.query("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents whose texts differ but look the same."""
    return lookalike_pairs(table(spark, d, "documents"))


@R.query("p9_forms")
def p9_forms(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every text."""
    return consistent_forms(table(spark, d, "documents"))


@R.query("p9_classes")
def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every document that looks like another text, its class, and the number of its partners."""
    return lookalike_classes(table(spark, d, "documents"))
