"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _delete_on_exit(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The application's own folder within the cluster's ``spark.checkpoint.dir``; it goes when the driver's JVM ends.

    Only a session in one process may do without that setting and use a folder of this machine.
    """
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="folioworks-")
        context.setCheckpointDir(folder)
        held = context._jsc.sc().getCheckpointDir()
        _delete_on_exit(spark, held.get())
    return held.get()


@contextmanager
def _shuffles_end_with_the_job(spark: SparkSession) -> Iterator[None]:
    """What is executed here drops its shuffle files when it is done: its rows stand in the shared folder."""
    before = spark.conf.get(_CLEAN_SHUFFLES, "false")
    spark.conf.set(_CLEAN_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN_SHUFFLES, before)


@contextmanager
def rows_one_by_one(spark: SparkSession) -> Iterator[None]:
    """Rows of megabytes reach Python one at a time in what is executed here: a worker's memory doesn't grow with its partition."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    spark.conf.set(key, "1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Bytes of a batch of rows that Python gets.
BATCH_BYTES = 1 << 21


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows reach Python in batches of ``BATCH_BYTES``, or one row, in what is executed here: by default a task and its worker hold up to 64 MB each, and copies."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of any executor."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    with _shuffles_end_with_the_job(spark):
        return df.checkpoint(eager=True)


class Written:
    """A table of the shared folder, for rows too many for a checkpoint: compressed, and gone after the ``with`` block.

    Its values hardly ever repeat: no dictionaries are tried.
    """

    def __init__(self, df: DataFrame, codec: str = "snappy"):
        spark = df.sparkSession
        self.spark, self.path = spark, f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
        try:
            with _shuffles_end_with_the_job(spark):
                df.write.option("parquet.enable.dictionary", "false").option("compression", codec).parquet(self.path)
        except BaseException:
            self.drop()
            raise
        self.rows = spark.read.schema(df.schema).parquet(self.path)

    def __enter__(self) -> DataFrame:
        return self.rows

    def __exit__(self, *_) -> None:
        self.drop()

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: str = "doc_id"):
    """True for rows whose crc32 of the id as text leaves remainder 1 on division by 3; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conf_int(spark: SparkSession, key: str, default: int) -> int:
    try:
        return int(spark.conf.get(key, str(default)))
    except ValueError:
        return default
