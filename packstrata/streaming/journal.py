"""Journals as streams: a log that any order of arrival may fill, and a strict fold of ordered ones."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from packstrata.operators.journal import ADOPT, END, FIELDS, FORGET, PLACE, TRUNCATE, content_map
from packstrata.session import ship

SCHEMA = "session_id long, seq long, op int, inode long, handle long, fileoff long, length long, recv_at timestamp"


def journal_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """Journal files of a folder, or one file, as a stream; the rate limit is the back-pressure."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())


class JournalLog:
    """A log of received operations, one folder a micro-batch, and the content map of all of it.

    A batch that is delivered again replaces itself, so the log holds each once.
    Operations may come in any order, late or repeated: which rows stand, and
    what they leave, is decided over the log.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def append(self, batch: DataFrame, number: int) -> None:
        batch.select(*FIELDS).write.mode("overwrite").parquet(f"{self.folder}/log/batch={number}")

    def start(self, stream: DataFrame, once: bool = True, every: str = "5 minutes"):  # noqa: ANN201
        """Fill the log from a stream: all that is there, or on and on."""
        writer = stream.writeStream.foreachBatch(self.append).option("checkpointLocation", f"{self.folder}/progress")
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()

    def received(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/log/*")

    def map(self) -> DataFrame:
        return content_map(self.received())


class Extents:
    """The content of one inode under operations in order: extents (lo, hi, handle), sorted and disjoint."""

    def __init__(self, los: list[int], his: list[int], handles: list[int], size: int, present: bool):
        self.los, self.his, self.handles, self.size, self.present = los, his, handles, size, present

    def punch(self, lo: int, hi: int) -> None:
        if lo >= hi:
            return
        i, j = bisect_right(self.his, lo), bisect_left(self.los, hi)
        keep = []
        if i < j:
            if self.los[i] < lo:
                keep.append((self.los[i], lo, self.handles[i]))
            if self.his[j - 1] > hi:
                keep.append((hi, self.his[j - 1], self.handles[j - 1]))
        self.los[i:j], self.his[i:j], self.handles[i:j] = ([k[n] for k in keep] for n in range(3))

    def apply(self, op: int, handle: int, off: int, length: int) -> None:
        self.present = op != FORGET
        if op == PLACE:
            end = min(off + length, END)
            if off < end:
                self.punch(off, end)
                at = bisect_left(self.los, off)
                self.los.insert(at, off)
                self.his.insert(at, end)
                self.handles.insert(at, handle)
            self.size = max(self.size, end)
        elif op == TRUNCATE:
            self.punch(length, END)
            self.size = length
        else:
            self.punch(0, END)
            self.size = 0
            if op == ADOPT:
                self.apply(PLACE, handle, 0, length)
                self.size = length


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    los, his, handles, size, present, last = state.get if state.exists else ([], [], [], 0, False, -1)
    e = Extents(list(los), list(his), list(handles), size, present)
    rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
    for seq, op, handle, off, length in rows[["seq", "op", "handle", "fileoff", "length"]].fillna(0).astype("int64").itertuples(index=False):
        if seq <= last:
            raise ValueError(f"session {key[0]}, inode {key[1]}: seq {seq} after {last}; this stream must be in order")
        last = seq
        e.apply(op, handle, off, length)
    state.update((e.los, e.his, e.handles, e.size, e.present, last))
    yield pd.DataFrame({"session_id": [key[0]], "inode": [key[1]], "seq": [last], "present": [e.present], "file_size": [e.size], "fileoff": [e.los], "end": [e.his], "handle": [e.handles]})


STATE = "los array<long>, his array<long>, handles array<long>, size long, present boolean, last long"
OUT = "session_id long, inode long, seq long, present boolean, file_size long, fileoff array<long>, end array<long>, handle array<long>"


def fold_ordered(stream: DataFrame) -> DataFrame:
    """The content of each inode a micro-batch touches, after it: keyed state, strictly ordered.

    ``stream`` has standing operations only. Within a batch rows are sorted by
    seq; a seq at or below one that an earlier batch applied is an error, not
    late data.
    """
    ship(stream.sparkSession)
    ops = stream.select("session_id", "inode", "seq", "op", "handle", "fileoff", "length")
    return ops.groupBy("session_id", "inode").applyInPandasWithState(_fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def latest_extents(updates: DataFrame) -> DataFrame:
    """The rows of ``content_map`` from the updates that a fold has emitted."""
    last = updates.groupBy("session_id", "inode").agg(F.max_by(F.struct("present", "file_size", "fileoff", "end", "handle"), "seq").alias("u")).select("session_id", "inode", "u.*").where("present")
    rows = last.select("session_id", "inode", "file_size", F.explode_outer(F.arrays_zip("fileoff", "end", "handle")).alias("x"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select("session_id", "inode", "file_size", zero(F.col("x.fileoff")).alias("fileoff"), zero(F.col("x.end") - F.col("x.fileoff")).alias("length"), zero(F.col("x.handle")).alias("handle"))
