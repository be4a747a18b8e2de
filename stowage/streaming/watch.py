"""Incremental passes over a source, in a loop on the driver or as a stream of listings.

Spark's own file stream would take a rewritten file for an old one and would not try failures again, so a pass is an anti-join
of the listing with what was seen. Where a breaker guards the backend, a pass goes in chunks in order of path. The first
is no larger than the failures that would trip the breaker; while chunks end well the next is twice as large (``MOST``
at most), so a healthy pass takes few of them. In a larger chunk every task stops asking after as many failures in a row.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stowage.functions import constants as C
from stowage.functions import expressions as X
from stowage.operators import incremental as I
from stowage.plans.organize import Organizer
from stowage.session import stored, tallied, temporary_tables
from stowage.sources import files, sinks
from stowage.streaming.breaker import Breaker


@dataclass
class PassStats:
    passes: int = 0
    processed: int = 0
    skipped_unchanged: int = 0
    errors: int = 0
    quarantined: int = 0

    def __add__(self, other: PassStats) -> PassStats:
        return PassStats(*(getattr(self, f.name) + getattr(other, f.name) for f in fields(self)))


#: Files of a chunk; their paths and statuses come to the driver.
MOST = 50_000


def guarded(organizer: Organizer, todo: DataFrame, breaker: Breaker | None, left: int) -> Iterator[tuple[DataFrame, dict]]:
    """The results of chunks of files, with size and mtime_ns, and their tally, until all are done or the breaker opens.

    left: how many files there are.
    """
    columns = ["source_path", "digest", "status", "organized_path", "error"]
    if breaker is None or breaker.room is None:
        yield tallied(organizer.run(todo).select(*columns).join(todo.select("source_path", "size", "mtime_ns"), "source_path"), *_tally())
        return
    after, size = "", breaker.room
    while left > 0:
        chunk = stored(todo.where(F.col("source_path") > after).orderBy("source_path").limit(size))
        results, tally = tallied(organizer.run(chunk, breaker.threshold).select(*columns).join(chunk.select("source_path", "size", "mtime_ns"), "source_path"), *_tally())
        rows, stop = results.select("source_path", "status").orderBy("source_path").collect(), False
        for row in rows:
            if row["status"] in ("error", "untried"):
                stop = stop or row["status"] == "untried"
                breaker.failure()
            elif not breaker.is_open:
                breaker.success()
        yield results, tally
        if breaker.is_open or stop or not rows:
            return
        after, left = rows[-1]["source_path"], left - len(rows)
        size = breaker.room if breaker.failures or breaker.room == 1 else min(MOST, 2 * size)


def run_pass(organizer: Organizer, source: str, recursive: bool = True, breaker: Breaker | None = None, poison_limit: int = C.POISON_LIMIT, quarantine_dir: str | None = None) -> PassStats:
    """A pass over all that is listed now."""
    try:
        listed, sizes = tallied(files.scan(organizer.catalog.spark, source, recursive), *_sizes())
    except (OSError, PySparkException):
        return PassStats(passes=1, errors=1)  # the source is gone; the next pass tries again
    return look_through(organizer, listed, sizes, breaker, poison_limit, quarantine_dir)


def _sizes() -> list[Column]:
    """Of a listing; like all counts of a pass they are gathered by the job that writes the table."""
    return [F.count("*").alias("all"), F.count("size").alias("found")]


def _tally() -> list[Column]:
    return [F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("status").isin("copied", "duplicate")).alias("healthy")]


def look_through(organizer: Organizer, listed: DataFrame, sizes: dict, breaker: Breaker | None = None, poison_limit: int = C.POISON_LIMIT, quarantine_dir: str | None = None) -> PassStats:
    """A pass over a stored listing (source_path, size, mtime_ns); sizes: how many it has, and how many with a size."""
    catalog, stats = organizer.catalog, PassStats(passes=1)
    found = listed.where("size IS NOT NULL")
    todo = I.unseen(found, catalog.read("source_seen"))
    if breaker:
        todo = I.not_quarantined(todo, catalog.read("failed_files"))
    todo, left = tallied(todo, F.count("*").alias("n"))
    stats.skipped_unchanged, gone = sizes["found"] - left["n"], sizes["all"] - sizes["found"]
    failures, healthy = [], 0
    if not left["n"]:
        stats.errors += gone
        return stats
    for done, tally in guarded(organizer, todo, breaker, left["n"]):
        stats.errors += tally["errors"]
        healthy += tally["healthy"]
        good = done.where("status IN ('copied', 'duplicate')")
        changes = {"source_seen": good.select("source_path", "size", "mtime_ns", "digest", F.current_timestamp().alias("seen_at"))}
        if breaker:
            changes["failed_files"] = catalog.touched("failed_files", good).join(good.select("source_path"), "source_path", "left_semi").withColumn("_gone", F.lit(True))
        catalog.commit(**changes)
        failures.append(done.where("status = 'error'").select("source_path", "size", "mtime_ns", F.coalesce("error", F.lit("")).alias("error")))
    stats.processed = healthy
    if breaker and not breaker.is_open and stats.processed and stats.errors:
        _reconcile(organizer, failures, poison_limit, quarantine_dir, stats)
    stats.errors += gone  # files that went away or could not be looked at while they were listed
    return stats


def _reconcile(organizer: Organizer, failures, limit: int, quarantine_dir: str | None, stats: PassStats) -> None:
    """In a pass that proved the backend up, failures count; a file that reaches the limit goes into quarantine."""
    catalog, every = organizer.catalog, failures[0]
    for part in failures[1:]:
        every = every.unionByName(part)
    before = catalog.touched("failed_files", every).join(every.select("source_path"), "source_path", "left_semi")
    now = str(catalog.spark.sql("SELECT current_timestamp()").first()[0])
    after = stored(I.record_failures(before, every, now, limit))
    fresh = stored(after.where("quarantined").join(every.select("source_path"), "source_path", "left_semi").where(F.col("fail_count") >= limit))
    catalog.commit(failed_files=after)
    stats.quarantined += fresh.count()
    if quarantine_dir:
        sinks.copy_aside(fresh.withColumn("target", X.quarantine_path(quarantine_dir, F.col("source_path")))).count()


def watch(organizer: Organizer, source: str, interval: float = C.POLL_SECONDS, stop: threading.Event | None = None, sleep: Callable[[float], object] | None = None, breaker: Breaker | None = None, **options) -> PassStats:
    """Passes until ``stop`` is set. While the breaker is open its backoff is the wait, and the next pass is the probe."""
    stop = stop or threading.Event()
    sleep = sleep or stop.wait
    total = PassStats()
    while not stop.is_set():
        if breaker and breaker.is_open:
            if (wait := breaker.wait()) > 0:
                sleep(wait)
                continue
            breaker.probe()
        with temporary_tables(organizer.catalog.spark):
            total += run_pass(organizer, source, breaker=breaker, **options)
        organizer.catalog.vacuum()
        if not stop.is_set() and not (breaker and breaker.is_open):
            sleep(interval)
    return total


def watch_stream(organizer: Organizer, source: str, checkpoint: str, interval: float | None = C.POLL_SECONDS, recursive: bool = True, breaker: Breaker | None = None, report: Callable[[PassStats], object] | None = None, **options) -> StreamingQuery:
    """The watch loop as a stream: its source lists the tree once a trigger, and a micro-batch is a pass.

    With ``interval`` None one pass is made. A restart goes on from the checkpoint; a batch that was cut short is a pass
    again, which skips what the catalog has as seen. While the breaker is open, batches pass by until its backoff is
    over, and the next one is the probe (so waits are rounded up to whole intervals).
    """

    def one(batch: DataFrame, _: int) -> None:
        if breaker and breaker.is_open:
            if breaker.wait() > 0:
                return
            breaker.probe()
        with temporary_tables(organizer.catalog.spark):
            stats = look_through(organizer, *tallied(batch, *_sizes()), breaker, **options)
        organizer.catalog.vacuum()
        if report:
            report(stats)

    trigger = {"availableNow": True} if interval is None else {"processingTime": f"{interval} seconds"}
    return files.scan_stream(organizer.catalog.spark, source, recursive).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**trigger).start()
