"""The memory of failures as keyed state of a stream: counts, quarantine, and what has been forgotten since.

Each path is a key whose value is its failure (size, time, count, whether it is in quarantine). A micro-batch brings the
attempts of a pass; the state follows them in order as ``incremental.record_failures`` does with a table, but touches the
keys of the batch alone, wherever they are. A path that succeeds is cleared. With ``forget_ms`` a timer clears a failure
that nothing has been heard of for so long, so that files that are gone do not stay in the state for ever.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from stowage.functions import constants as C
from stowage.session import shared_dir

VALUE = "size long, mtime_ns long, fail_count int, quarantined boolean, at long"
#: A row is the failure of a path as of its last attempt; fail_count 0: there is none any more.
OUT = f"source_path string, {VALUE}"
ATTEMPT = ["source_path", "size", "mtime_ns", "failed", "at"]
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class FailureMemory(StatefulProcessor):
    """Attempts (source_path, size, mtime_ns, failed, at: their order) in; failures as they are after the batch out."""

    def __init__(self, limit: int = C.POISON_LIMIT, forget_ms: int = 0):
        self.limit, self.forget_ms = limit, forget_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.failure = handle.getValueState("failure", VALUE)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        r = initialState
        self.failure.update((r["size"], r["mtime_ns"], r["fail_count"], r["quarantined"], None))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = self.failure.get() if self.failure.exists() else None
        size, mtime, count, poison, at = now or (None, None, 0, False, None)
        for r in sorted(rows, key=lambda r: r["at"]):
            if not r["failed"]:
                count, poison = 0, False
            elif count and (r["size"], r["mtime_ns"]) == (size, mtime):
                count += 1
                poison = poison or count >= self.limit
            else:
                count, poison = 1, self.limit <= 1
            size, mtime, at = r["size"], r["mtime_ns"], r["at"]
        yield self._left(key, (size, mtime, count, poison, at), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        size, mtime, _, _, at = self.failure.get()
        yield self._left(key, (size, mtime, 0, False, at), None)

    def _left(self, key, value: tuple, timers) -> Row:
        if self.forget_ms and timers:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if value[2]:
                self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.forget_ms)
        if value[2]:
            self.failure.update(value)
        else:
            self.failure.clear()
        return Row(source_path=key[0], size=value[0], mtime_ns=value[1], fail_count=value[2], quarantined=value[3], at=value[4])


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start in the block keep their state in RocksDB, which keyed processors need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def failures(attempts: DataFrame, limit: int = C.POISON_LIMIT, before: DataFrame | None = None, forget_ms: int = 0) -> DataFrame:
    """OUT as a stream. attempts: a stream of ATTEMPT; before: failures that are known at the start (source_path and VALUE without ``at``)."""
    start = None if before is None else before.groupBy("source_path")
    return attempts.groupBy("source_path").transformWithState(FailureMemory(limit, forget_ms), OUT, "Append", "ProcessingTime" if forget_ms else "None", start)


def replayed(spark: SparkSession, batches: list[DataFrame], limit: int = C.POISON_LIMIT, before: DataFrame | None = None) -> DataFrame:
    """OUT after batches of ATTEMPT, one micro-batch each, from a log in the shared folder.

    The stream ends after every batch and starts again from its checkpoint for the next, as over a restart.
    """
    root = f"{shared_dir(spark)}/failures-{uuid.uuid4().hex}"
    for folder in ("in", "out", "state"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{folder}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    for batch in batches:
        batch.select(*ATTEMPT).write.mode("append").parquet(f"{root}/in")
        log = spark.readStream.schema(batch.select(*ATTEMPT).schema).parquet(f"{root}/in")
        with state_store(spark):
            run = failures(log, limit, before).writeStream.format("parquet").option("checkpointLocation", f"{root}/state").option("path", f"{root}/out").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(OUT).parquet(f"{root}/out")


def latest(changes: DataFrame) -> DataFrame:
    """The failures that stand after all changes."""
    order = F.struct("at", F.col("fail_count") == 0)  # what a timer clears comes after the attempt
    last = changes.groupBy("source_path").agg(F.max_by(F.struct(*changes.columns), order).alias("row")).select("row.*")
    return last.where("fail_count > 0").drop("at")
