"""Calls of an external model over a stream, paid for once and appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from ..functions.model_calls import BACKOFF, ModelFn, cache_key, call_model
from ..sources.sinks import append_run

_CACHE = "cache_key string, response string"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _mark(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True).close()


def _held(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The rows of a folder, none if it isn't there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


class CallLedger:
    """[J11][K3] A folder with what a stream of calls has done.

    * ``paid/batch=b/part=p``: the replies of a part of a batch's new prompts. A part that was written whole is never called again.
    * ``runs/run=b``: the rows of a batch with their replies. Writing a batch again replaces its own rows.
    * ``done/b``: batches whose rows stand in ``runs``. One that comes again, after a restart that forgot it, is passed over.

    So a batch that is stopped between its calls and its append pays only for the parts that weren't written, and its rows are
    appended once, whatever is repeated. Replies that are errors count as not given: a later batch asks again.
    """

    def __init__(self, folder: str, fn: ModelFn, model: str, params: str = "", waits: tuple[float, ...] = BACKOFF, in_flight: int = 8, parts: int = 4):
        self.folder, self.fn, self.model, self.params, self.waits, self.in_flight, self.parts = folder.rstrip("/"), fn, model, params, waits, in_flight, parts

    def paid(self, spark: SparkSession) -> DataFrame:
        """All replies that are paid for: ``(cache_key, response)``."""
        return _held(spark, f"{self.folder}/paid", _CACHE)

    def rows(self, spark: SparkSession) -> DataFrame:
        """All appended rows."""
        return spark.read.parquet(f"{self.folder}/runs").drop("run")

    def process(self, batch: DataFrame, number: int) -> None:
        """One batch of ``(prompt, ...)``, for ``foreachBatch``."""
        spark = batch.sparkSession
        if _exists(spark, f"{self.folder}/done/{number}"):
            return
        own = f"{self.folder}/paid/batch={number}"
        part = F.pmod(F.xxhash64(cache_key(F.col("prompt"), F.lit(self.model), F.lit(self.params))), F.lit(self.parts))
        for p in range(self.parts):
            if not _exists(spark, f"{own}/part={p}/_SUCCESS"):
                # what stands there already, of other batches or parts, isn't called; a part cut short is written anew
                _remove(spark, f"{own}/part={p}")
                _, fresh = call_model(batch.where(part == p).select("prompt").distinct(), self.paid(spark), self.fn, self.model, self.params, self.waits, self.in_flight)
                fresh.write.parquet(f"{own}/part={p}")
        self.append(batch, number)
        _mark(spark, f"{self.folder}/done/{number}")

    def append(self, batch: DataFrame, number: int) -> None:
        """The batch's rows with the replies that stand in ``paid``; they call nothing."""
        keyed = batch.withColumn("cache_key", cache_key(F.col("prompt"), F.lit(self.model), F.lit(self.params)))
        failed = F.startswith("response", F.lit("[ERROR"))
        best = self.paid(batch.sparkSession).groupBy("cache_key").agg(F.min_by("response", F.struct(failed, "response")).alias("response"))
        append_run(keyed.join(best, "cache_key", "left"), f"{self.folder}/runs", str(number))

    def start(self, prompts: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """The stream of ``prompts``; without a trigger it works off what is there and ends."""
        return prompts.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
