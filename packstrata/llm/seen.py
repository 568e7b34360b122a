"""Has this key been seen before, without keeping the earlier keys."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packstrata.llm.fingerprints import BITS, Filter, build
from packstrata.operators.skew import skew_join, tile_of
from packstrata.session import Scratch, parallelism, ship

#: Sealed batches of a run, each with its own filter; a key is held against at most this many. A power of two.
BATCHES = 64
#: A run of fewer rows than this for each of BATCHES has fewer batches.
BATCH_ROWS = 1 << 12
#: Distinct keys of a shard, whose filters a task holds: about 2.5 bytes each.
SHARD_KEYS = 1 << 17

_HITS = pa.schema([pa.field("_batch", pa.int64()), pa.field("_key", pa.binary()), pa.field("_probes", pa.int64())])


@dataclass
class Probed:
    """``rows`` (_key, _order, _batch), n of them; ``firsts``: _batch, _key, the least order, _first, and the rows, _rows, of
    each key of a batch, with the known keys as batch -1; ``hits``: those (_batch, _key) that a sealed filter claims to know."""

    rows: DataFrame
    n: int
    firsts: DataFrame
    hits: DataFrame


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards in turn, each batch by batch: probe the sealed filters, then seal the batch's new keys."""
    at, sealed, held = None, [], []

    def seal_and_find() -> pa.RecordBatch | None:
        hashes = np.concatenate([h for h, _ in held])
        hit = np.zeros(len(hashes), bool)
        for f in sealed:
            open_at = np.flatnonzero(~hit)
            if not len(open_at):
                break
            hit[open_at] = f.has(hashes[open_at])
        # a key wrongly taken for known need not be sealed: the same filter will claim it again
        if not hit.all():
            sealed.append(Filter(build(hashes[~hit])))
        if at[1] < 0 or not hit.any():
            return None
        index = pa.array(np.flatnonzero(hit))
        key = pa.concat_arrays([k for _, k in held]).take(index)
        n, probes = len(index), len(sealed) - int(not hit.all())
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, at[1])), key, pa.array(np.full(n, probes))], schema=_HITS)

    for batch in batches:
        shard, number = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        hashes = batch.column(2).to_numpy().view(np.uint64)
        cuts = [0, *(np.flatnonzero((shard[1:] != shard[:-1]) | (number[1:] != number[:-1])) + 1).tolist(), len(shard)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            now = (int(shard[a]), int(number[a]))
            if now != at:
                if held and (out := seal_and_find()) is not None:
                    yield out
                held = []
                if at is None or now[0] != at[0]:
                    sealed = []
                at = now
            held.append((hashes[a:b], batch.column(3).slice(a, b - a).cast(pa.binary())))
    if held and (out := seal_and_find()) is not None:
        yield out


def probe_batches(rows: DataFrame, key: str, order: str, known: DataFrame | None = None, batches: int | None = None, shard_keys: int = SHARD_KEYS) -> Probed:
    """Cut ``rows`` by ``order`` into batches and probe each against the filters of those before it.

    Batches have about equal numbers of rows, whatever the values of ``order``.
    Within a batch each key counts once, with its least order. The keys of a
    batch go to shards of the key's hash; a shard is one stream, in batch
    order, through a list of immutable xor filters, so memory holds
    fingerprints of earlier keys and the shard's keys of the batch at hand
    only. The number of shards follows the number of rows.

    Rows with a null key or order are ignored; rows of equal order are not
    before one another. ``known`` keys precede all rows. Keys are bytes of any
    length. Runs jobs; the first rows of keys are written once.
    """
    ship(rows.sparkSession)
    scratch = Scratch(rows.sparkSession)
    rows = rows.select(F.col(key).cast("binary").alias("_key"), F.col(order).cast("long").alias("_order")).dropna()
    most = batches or BATCHES
    n, grid = rows.agg(F.count(F.lit(1)), F.percentile_approx("_order", [i / most for i in range(1, most)] or [0.5], 10_000)).first()
    step = 1 if batches else max(1, most * BATCH_ROWS // max(1, n))
    # cut points are collected: every use cuts alike
    cuts = sorted(set((grid or [])[step - 1 :: step])) if most > 1 else []
    rows = rows.withColumn("_cuts", F.array(*(F.lit(c).cast("long") for c in cuts)).cast("array<long>")).withColumn("_batch", tile_of(F.col("_order"), "_cuts", len(cuts) + 1).cast("long")).drop("_cuts")
    firsts = rows.groupBy("_batch", "_key").agg(F.min("_order").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    if known is not None:
        before = known.select(F.lit(-1).cast("long").alias("_batch"), F.col(key).cast("binary").alias("_key"), F.lit(None).cast("long").alias("_first"), F.lit(1).cast("long").alias("_rows")).where("_key is not null").distinct()
        firsts = firsts.unionByName(before)
    firsts = scratch.keep(firsts)
    shards = max(1, -(-n // shard_keys))
    stream = firsts.withColumn("_hash", F.xxhash64("_key")).withColumn("_shard", F.pmod("_hash", F.lit(shards)).cast("long"))
    stream = stream.select("_shard", "_batch", "_hash", "_key").repartition(shards, "_shard").sortWithinPartitions("_shard", "_batch")
    hits = stream.mapInArrow(_probe, "_batch long, _key binary, _probes long")
    return Probed(rows, n, firsts, hits)


def _born(p: Probed) -> DataFrame:
    """The first batch of each key."""
    return p.firsts.groupBy("_key").agg(F.min("_batch").alias("_born"))


def seen_before(rows: DataFrame, key: str, order: str, known: DataFrame | None = None, floor: int | None = None, **options: int) -> DataFrame:
    """The ``order`` of each row whose key is known or came with a lower order: exact.

    A key of a batch that no sealed filter claims is new there. Claims are
    confirmed against the first batch of the claimed keys, so only their few
    wrong ones are undone; nothing is ever missed. Rows of a key that is
    confirmed or comes several times in its batch are then looked at: all of
    them are repeats, or those above the least order.
    """
    p = probe_batches(rows, key, order, known, **options)
    sure = p.hits.join(_born(p), "_key").where("_born < _batch").select("_batch", "_key", F.lit(True).alias("_seen"))
    verdict = p.firsts.where("_batch >= 0 and _rows > 1").select("_batch", "_key", "_first").join(sure, ["_batch", "_key"], "full")
    told = skew_join(p.rows, verdict, ["_batch", "_key"], "inner", floor, p.n, p.firsts.where("_batch >= 0").withColumnRenamed("_rows", "_n"))
    return told.where(F.coalesce("_seen", F.lit(False)) | (F.col("_order") > F.col("_first"))).select(F.col("_order").alias(order))


def seen_errors(rows: DataFrame, key: str, order: str, known: DataFrame | None = None, **options: int) -> DataFrame:
    """Rate of wrong answers of the filters alone, per batch, against the exact result.

    batch, probed (keys held against filters), hits, wrong (hits of keys never
    seen), missed (always 0: filters forget nothing), rate (wrong by probed
    keys that are new) and bound, the compounded 1 - (1 - 2^-bits)^filters.
    """
    p = probe_batches(rows, key, order, known, **options)
    told = p.firsts.where("_batch >= 0").join(_born(p), "_key").join(p.hits.select("_batch", "_key", F.lit(1).alias("_hit")), ["_batch", "_key"], "left")
    new = F.col("_born") == F.col("_batch")
    hit = F.col("_hit").isNotNull()
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    filters = F.col("batch") + F.lit(1 if known is not None else 0)
    return (
        told.groupBy(F.col("_batch").alias("batch"))
        .agg(F.count(F.lit(1)).alias("probed"), count(hit).alias("hits"), count(hit & new).alias("wrong"), count(~hit & ~new).alias("missed"), count(new).alias("_new"))
        .select("batch", "probed", "hits", "wrong", "missed", (F.col("wrong") / F.greatest("_new", F.lit(1))).alias("rate"), (1 - F.pow(F.lit(1 - 2.0**-BITS), filters)).alias("bound"))
    )


# --- filters kept between runs


def _sealed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (shard, hash) rows to one filter a shard."""
    rows = ((s, h) for b in batches for s, h in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for shard, group in groupby(rows, key=itemgetter(0)):
        hashes = np.fromiter((h for _, h in group), np.int64).view(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([build(hashes)], pa.binary())], names=["shard", "filter"])


def _claimed(keys: pa.Table, filters: pa.Table) -> pa.Table:
    """The rows of a shard, with whether one of its filters claims them."""
    hashes = keys.column("_hash").to_numpy().view(np.uint64)
    hit = np.zeros(len(hashes), bool)
    for f in filters.column("filter").to_pylist():
        hit |= Filter(f).has(hashes)
    return keys.select(["_key"]).append_column("claimed", pa.array(hit))


class SealedKeys:
    """Filters of sealed batches below a folder of any file system: a later run asks them without reading an old key.

    Each batch is a folder of (shard, filter), written once and never changed.
    The number of shards is chosen for the store, for the keys it is to hold.
    """

    def __init__(self, spark: SparkSession, folder: str, shards: int):
        self.spark, self.folder, self.shards = spark, folder.rstrip("/"), shards

    def _sharded(self, rows: DataFrame, key: str) -> DataFrame:
        keys = rows.select(F.col(key).cast("binary").alias("_key")).where("_key is not null").distinct()
        return keys.withColumn("_hash", F.xxhash64("_key")).withColumn("shard", F.pmod("_hash", F.lit(self.shards)).cast("long"))

    def seal(self, rows: DataFrame, key: str, batch: int) -> None:
        """Write the filters of a batch's keys."""
        ship(self.spark)
        keys = self._sharded(rows, key).select("shard", "_hash").repartition(min(self.shards, parallelism(self.spark)), "shard").sortWithinPartitions("shard")
        keys.mapInArrow(_sealed, "shard long, filter binary").write.mode("errorifexists").parquet(f"{self.folder}/batch={batch}")

    def claims(self, rows: DataFrame, key: str) -> DataFrame:
        """Each distinct non-null ``key`` with ``claimed``: false is certain, true is wrong at the filters' rate."""
        ship(self.spark)
        filters = self.spark.read.schema("shard long, filter binary, batch int").parquet(self.folder)
        told = self._sharded(rows, key).groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(_claimed, "_key binary, claimed boolean")
        return told.withColumnRenamed("_key", key)
