"""Session construction and the shared folder for cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the engine expects everywhere."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("packstrata")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see; the session's setting decides.

    Only where the setting is absent and the master is local (tests, a laptop) a
    folder of our own is made and recorded in the session, so that it is found
    again. On a cluster a folder of this machine would be another one on every
    executor, so there the setting is required.
    """
    for read in (lambda: spark.conf.get(CHECKPOINT_KEY, None), lambda: spark.sparkContext.getConf().get(CHECKPOINT_KEY)):
        try:
            if found := read():
                return found.rstrip("/")
        except Exception:  # noqa: BLE001 - a key that a session refuses to show counts as absent
            continue
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="packstrata-")
    os.makedirs(own.removeprefix("file://"), exist_ok=True)
    spark.conf.set(CHECKPOINT_KEY, own)
    return own


_MADE: list[str] = []


def parallelism(spark: SparkSession) -> int:
    """Tasks of a shuffle: the cluster's setting, which grows with the cluster and the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below the shared one, which ``clear_scratch`` deletes."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


class Scratch:
    """Tables written to the shared folder, to cut lineage and survive lost executors.

    ``keep`` writes a DataFrame and returns it as a scan; ``drop`` deletes
    tables that no later plan reads. What is left is read by the plans that
    were returned; ``clear_scratch`` deletes it when they have run.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = fresh_folder(spark, "packstrata")
        self.made = 0

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.made}"
        self.made += 1
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def read(self, *tables: DataFrame, columns: list[str]) -> DataFrame:
        """The named columns of several kept tables as one scan."""
        schema = tables[0].select(*columns).schema
        return self.spark.read.schema(schema).parquet(*(t._scratch_path for t in tables))

    def keep_counted(self, df: DataFrame, *counts: Column) -> tuple:
        """As ``keep``, with the sum of each of ``counts`` over the rows, taken while they are written; 0 of no rows."""
        seen = Observation()
        sums = {f"n{i}": F.coalesce(F.sum(c), F.lit(0)).cast("long") for i, c in enumerate(counts)}
        kept = self.keep(df.observe(seen, *(c.alias(n) for n, c in sums.items())))
        return (kept, *(seen.get[n] for n in sums))

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> int:
    """Delete what this process has left in the shared folder; plans returned before can no longer run."""
    done = 0
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        done += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return done


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python workers import it. Once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_packstrata_shipped", False):
        return
    home = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="packstrata-ship-")) / "packstrata.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    sc.addPyFile(str(target))
    sc._packstrata_shipped = True
