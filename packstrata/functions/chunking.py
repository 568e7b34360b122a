"""Content-defined chunking, identities and stored forms, over Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packstrata.functions.arrow import slices
from packstrata.session import ship

# Steps of the gear table, and how far the masks are from the average. Any seed will do.
GEAR_SEED = 1
GOLDEN = 0x9E3779B97F4A7C15
NORMALIZATION = 2
_ALL = (1 << 64) - 1


def gear_table(seed: int = GEAR_SEED) -> np.ndarray:
    """One pseudo-random 64-bit word for each byte (splitmix64)."""
    s = (np.uint64(seed) + np.uint64(GOLDEN) * np.arange(1, 257, dtype=np.uint64)).astype(np.uint64)
    s = (s ^ (s >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    s = (s ^ (s >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return s ^ (s >> np.uint64(31))


@dataclass(frozen=True)
class Sizes:
    """Chunk sizes: 0 < least < average < most, the average a power of two."""

    least: int = 256
    average: int = 1024
    most: int = 4096

    def __post_init__(self) -> None:
        if not 0 < self.least < self.average < self.most or self.average & (self.average - 1):
            raise ValueError("need 0 < least < average < most, average a power of two")
        if not NORMALIZATION < self.average.bit_length() - 1 <= 64 - NORMALIZATION:
            raise ValueError("average out of range")

    def masks(self) -> tuple[int, int]:
        """Before the average (strict) and after it (loose): the top bits that must be zero."""
        bits = self.average.bit_length() - 1
        return tuple(_ALL << (64 - k) & _ALL for k in (bits + NORMALIZATION, bits - NORMALIZATION))


with np.errstate(over="ignore"):
    _GEAR = gear_table()
_GEAR_INTS = _GEAR.tolist()


def cuts(data: bytes, sizes: Sizes = Sizes()) -> list[int]:
    """Ends of the chunks of ``data``.

    The rolling hash of a position depends on the last 64 bytes only, so it is
    computed for the whole text in six shifted additions. Only the first 63
    positions a chunk hashes start from less, and are stepped through.
    """
    n, (strict, loose) = len(data), sizes.masks()
    out, start = [], 0
    h = _GEAR[np.frombuffer(data, np.uint8)] if n > sizes.least else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(6):
            step = 1 << k
            if n > step and len(h):
                h = np.concatenate([h[:step], h[step:] + (h[:-step] << np.uint64(step))])
    tight, wide = np.flatnonzero(h & np.uint64(strict) == 0), np.flatnonzero(h & np.uint64(loose) == 0)
    while start < n:
        end = _cut(data, start, min(n, start + sizes.most), sizes, strict, loose, tight, wide)
        out.append(end)
        start = end
    return out


def _cut(data: bytes, start: int, stop: int, sizes: Sizes, strict: int, loose: int, tight: np.ndarray, wide: np.ndarray) -> int:
    first, normal = start + sizes.least, min(start + sizes.average, stop)
    if stop <= first:
        return stop
    h, warm = 0, min(first + 63, stop)
    for i in range(first, warm):
        h = ((h << 1) + _GEAR_INTS[data[i]]) & _ALL
        if h & (strict if i < normal else loose) == 0:
            return i + 1
    for places, a, b in ((tight, warm, normal), (wide, max(warm, normal), stop)):
        k = int(np.searchsorted(places, a))
        if k < len(places) and places[k] < b:
            return int(places[k]) + 1
    return stop


def _chunked(batches: Iterator[pa.RecordBatch], sizes: Sizes) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        rows = []
        for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            at = 0
            for idx, end in enumerate(cuts(data, sizes) if data else []):
                rows.append((key, idx, at, end - at, hashlib.sha256(data[at:end]).digest()))
                at = end
        kinds = (batch.schema.types[0], pa.int64(), pa.int64(), pa.int64(), pa.binary())
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "idx", "off", "llen", "identity"])


def content_chunks(files: DataFrame, key: str, data: str, sizes: Sizes = Sizes()) -> DataFrame:
    """Content-defined chunks of every file: key, idx, off, llen, identity (SHA-256 of the bytes).

    Empty and null contents have no chunks. No shuffle.
    """
    ship(files.sparkSession)
    kind = files.schema[key].dataType.simpleString()
    out = files.select(key, F.col(data).cast("binary")).mapInArrow(lambda b: _chunked(b, sizes), f"key {kind}, idx long, off long, llen long, identity binary")
    return out.withColumnRenamed("key", key)


def fixed_chunks(files: DataFrame, key: str, data: str, size: int) -> DataFrame:
    """Chunks of ``size`` bytes, the last one shorter; built-in expressions only."""
    return fixed_pieces(files, key, data, size).select(key, "idx", "off", F.length("data").cast("long").alias("llen"), F.sha2("data", 256).alias("identity"))


def fixed_pieces(files: DataFrame, key: str, data: str, size: int) -> DataFrame:
    """key, idx, off and data of every ``size`` bytes. Contents are cut before they are spread over rows, so each byte moves once."""
    content = F.col(data).cast("binary")
    pieces = F.transform(F.sequence(F.lit(0), F.length(content) - 1, F.lit(size)), lambda at: F.substring(content, at + 1, F.lit(size)))
    cut = files.where(F.length(content) > 0).select(key, F.posexplode(pieces).alias("idx", "data"))
    return cut.select(key, F.col("idx").cast("long").alias("idx"), (F.col("idx").cast("long") * size).alias("off"), "data")


def _stored(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    import zstandard

    press = zstandard.ZstdCompressor(level=level)
    for batch in slices(batches, 1):
        rows = []
        for raw in batch.column(1).to_pylist():
            small = None if raw is None else press.compress(raw)
            rows.append((None, None) if raw is None else (1, small) if len(small) < len(raw) else (0, raw))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=[batch.schema.names[0], "alg", "stored"])


def stored_form(chunks: DataFrame, key: str, data: str, level: int = 3) -> DataFrame:
    """key, alg (1 zstd, 0 raw), stored: compressed only where that is smaller. Null stays null."""
    ship(chunks.sparkSession)
    kind = chunks.schema[key].dataType.simpleString()
    return chunks.select(key, F.col(data).cast("binary")).mapInArrow(lambda b: _stored(b, level), f"{key} {kind}, alg int, stored binary")


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    press = zstandard.ZstdDecompressor()
    for batch in slices(batches, 2):
        raw = [None if s is None else press.decompress(s) if a == 1 else s for a, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=[batch.schema.names[0], "data"])


def plain_form(stored: DataFrame, key: str) -> DataFrame:
    """The inverse of ``stored_form``."""
    ship(stored.sparkSession)
    kind = stored.schema[key].dataType.simpleString()
    return stored.select(key, "alg", "stored").mapInArrow(_plain, f"{key} {kind}, data binary")


def sealed(data: Column, key: Column) -> Column:
    """AES-GCM: 12 bytes of nonce, the cipher text, 16 bytes of tag."""
    return F.aes_encrypt(data, key, F.lit("GCM"))


def opened(data: Column, key: Column) -> Column:
    return F.aes_decrypt(data, key, F.lit("GCM"))
