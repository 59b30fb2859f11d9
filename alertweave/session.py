"""Session settings the jobs rely on, and where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Sessions are merged where they are read, so that a hot key sends one row per task and session.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}
#: Shuffle files of a finished job are deleted at once, not when the driver happens to collect its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings (time zone, adaptive execution)."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "alertweave", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


class Scratch:
    """The scratch folders this thread makes inside the `with` block, so that they can be deleted once nobody reads them."""

    def __init__(self):
        self.folders: list[str] = []

    def __enter__(self) -> Scratch:
        self._outer = getattr(_open, "scratch", None)
        _open.scratch = self
        return self

    def __exit__(self, *_) -> None:
        _open.scratch = self._outer

    def drop(self, spark: SparkSession) -> None:
        for folder in self.folders:
            delete_folder(spark, folder)
        self.folders.clear()

    def pass_on(self) -> None:
        """From now on the folders are those of the block around."""
        if outer := getattr(_open, "scratch", None):
            outer.folders += self.folders


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder: the cluster's own, or a scratch one in local mode."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="alertweave-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    context.setCheckpointDir(configured)
    return configured


_announced: set[str] = set()
_open = threading.local()


def _scratch_root(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/alertweave/{spark.sparkContext.applicationId}"


def scratch_folder(spark: SparkSession) -> str:
    """A name for a new folder in the shared checkpoint folder, which goes when the driver ends."""
    root = _scratch_root(spark)
    if root not in _announced:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
        _announced.add(root)
    folder = f"{root}/{uuid.uuid4().hex}"
    if scratch := getattr(_open, "scratch", None):
        scratch.folders.append(folder)
    return folder


def cut_lineage(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write to the shared checkpoint folder and read back.

    A lost executor then costs no recomputation, and as the table is columnar the plans that
    follow still prune columns, push filters down and know its size. The tables go when the
    driver ends, shuffle files of the steps before as soon as the table is written.
    """
    path = scratch_folder(df.sparkSession)
    if df.sparkSession.conf.get(TIDY, None) != "true":
        df.sparkSession.conf.set(TIDY, "true")
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_packed(df: DataFrame) -> DataFrame:
    """cut_lineage for rows made of ids: Zstandard halves their hexadecimal digits, which snappy leaves as they are."""
    return cut_lineage(df, "zstd")


def drop_scratch(spark: SparkSession) -> None:
    """Delete the tables this application cut its lineage with, once its results are stored."""
    delete_folder(spark, _scratch_root(spark))


def no_rows(spark: SparkSession, schema) -> DataFrame:
    """A table the optimiser knows to be empty."""
    return spark.createDataFrame([], schema).where(F.lit(False))
