"""The task fold over a stream, equal to the batch fold once all events have come."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_LOG = logging.getLogger(__name__)
STATE = "status string, worker_id string, applied int, refused int"
OUT = "task_id string, " + STATE


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, worker, applied, refused = state.get if state.exists else ("pending", None, 0, 0)
    events = pd.concat(list(batches)).sort_values(["ts", "seq"], kind="stable")
    for new, own in zip(events["status"], events["worker_id"].where(events["worker_id"].notna(), None), strict=True):
        ends = new in ("completed", "failed")
        if ends and not (status == "processing" and (own is None or own == worker)):
            refused += 1
            continue
        applied += 1
        status = new
        worker = own if new == "processing" else worker
    state.update((status, worker, applied, refused))
    yield pd.DataFrame([(key[0], status, worker, applied, refused)], columns=["task_id", "status", "worker_id", "applied", "refused"])


def fold_stream(events: DataFrame) -> DataFrame:
    """[Q3] The state of each task after every micro-batch that touched it (update mode).

    Events of a task must come in order between micro-batches; within one they are put in order.
    """
    return events.groupBy("task_id").applyInPandasWithState(_fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def resume_stream(spark: SparkSession, folder: str, schema: str, work, checkpoint: str, out: str):
    """[Q10] Each file of a folder is worked on once, whatever stops in between: the checkpoint knows what is done."""
    rows = work(spark.readStream.schema(schema).parquet(folder))
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()


def poll(claim: Callable[[], list], work: Callable[[object], None], idle: Callable[[int], float | None], sleep: Callable[[float], None] = time.sleep, failed: Callable[[object, Exception], None] | None = None) -> int:
    """[Q8] A worker's loop: claim tasks, work on each, and wait ``idle(empty rounds)`` seconds when there are none; ends, and
    returns the number of tasks done, once that is None. A task that fails is reported to ``failed``, or logged with its
    error, and left to its owner: the loop goes on."""
    done = empty = 0
    while True:
        tasks = claim()
        for task in tasks:
            try:
                work(task)
                done += 1
            except Exception as error:  # any failure of a task
                if failed is None:
                    _LOG.warning("task %r failed", task, exc_info=error)
                else:
                    failed(task, error)
        empty = 0 if tasks else empty + 1
        if not tasks:
            wait = idle(empty)
            if wait is None:
                return done
            sleep(wait)
