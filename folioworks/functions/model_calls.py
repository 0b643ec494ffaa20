"""Calls of an external model as a cached, idempotent step of a plan."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Takes (prompt, model) and gives the reply. Test with a deterministic stub.
ModelFn = Callable[[str, str], str]

# The waits in seconds between attempts.
BACKOFF = (30, 90, 180, 600, 1200)


def cache_key(prompt, model, params):
    """[J11] The key holds the prompt itself, so that a changed prompt never finds an old reply."""
    return F.sha2(F.concat_ws("\u0001", model, prompt, params), 256)


def with_retry(fn: ModelFn, prompt: str, model: str, waits: tuple[float, ...] = BACKOFF, sleep=time.sleep) -> str:
    """[Q9] The reply, or ``[ERROR: ...]`` once the attempts are used up; a task never fails because of a call."""
    for wait in (*waits, None):
        try:
            return fn(prompt, model)
        except Exception as e:  # any failure of the service
            if wait is None:
                return f"[ERROR: {e}]"
            sleep(wait)
    raise AssertionError


def settled(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept: in the folder of ``spark.checkpoint.dir``, or by a local session in memory and on disk."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not folder:
            kept = df.persist()
            kept.count()
            return kept
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def call_model(requests: DataFrame, cache: DataFrame, fn: ModelFn, model: str, params: str = "", waits: tuple[float, ...] = BACKOFF, in_flight: int = 8) -> tuple[DataFrame, DataFrame]:
    """[J11][Q11] ``requests(prompt, ...)`` with their ``response``, and the cache rows to be appended.

    Distinct prompts that ``cache(cache_key, response)`` lacks, or holds an error for, are called once each, at most
    ``in_flight`` of them at a time. The calls are made here, and their replies kept, so that reading either result, or
    both, calls nothing again.
    """
    keyed = requests.withColumn("cache_key", cache_key(F.col("prompt"), F.lit(model), F.lit(params)))
    good = cache.where(~F.startswith("response", F.lit("[ERROR"))).select("cache_key", "response").dropDuplicates(["cache_key"])
    missing = keyed.select("cache_key", "prompt").dropDuplicates(["cache_key"]).join(good, "cache_key", "left_anti")

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"cache_key": pdf["cache_key"], "response": [with_retry(fn, p, model, waits) for p in pdf["prompt"]]})

    fresh = settled(missing.repartition(in_flight, "cache_key").mapInPandas(call, "cache_key string, response string"))
    return keyed.join(good.unionByName(fresh), "cache_key", "left"), fresh
