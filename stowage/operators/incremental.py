"""What a pass has to look at, and the memory of failures: all joins on the path and its size and time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions import constants as C

KEYS = ["source_path", "size", "mtime_ns"]


def unseen(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Files that are new, or whose size or time has changed."""
    return files.join(seen.select(*KEYS), KEYS, "left_anti")


def unchanged(files: DataFrame, seen: DataFrame) -> DataFrame:
    return files.join(seen.select(*KEYS), KEYS, "left_semi")


def changed(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Known files with another size or time than before."""
    old = seen.select("source_path", F.col("size").alias("old_size"), F.col("mtime_ns").alias("old_mtime_ns"))
    return files.join(old, "source_path").where("size <> old_size OR mtime_ns <> old_mtime_ns")


def not_quarantined(files: DataFrame, failed: DataFrame) -> DataFrame:
    """Without files in quarantine that have not changed since."""
    return files.join(failed.where("quarantined").select(*KEYS), KEYS, "left_anti")


def record_seen(seen: DataFrame, done: DataFrame) -> DataFrame:
    """The table after a pass: the last write of a path wins. done: the columns of ``seen``, successes alone."""
    return seen.join(done.select("source_path"), "source_path", "left_anti").unionByName(done.select(*seen.columns))


def record_failures(failed: DataFrame, failures: DataFrame, at: str, limit: int = C.POISON_LIMIT) -> DataFrame:
    """One pass's failures (source_path, size, mtime_ns, error) merged in.

    New: one failure. Changed since: one again, out of quarantine, ``first_failed_at`` kept. Else one more. At
    ``limit`` a file goes into quarantine.
    """
    f = failures.select("source_path", *(F.col(c).alias(f"__{c}") for c in ("size", "mtime_ns", "error")))
    joined = failed.join(f, "source_path", "full")
    hit, old = F.col("__error").isNotNull(), F.col("fail_count").isNotNull()
    same = old & (F.col("size") == F.col("__size")) & (F.col("mtime_ns") == F.col("__mtime_ns"))
    count = F.when(hit, F.when(same, F.col("fail_count") + 1).otherwise(1)).otherwise(F.col("fail_count"))
    kept = F.when(hit & ~same, F.lit(False)).otherwise(F.coalesce("quarantined", F.lit(False)))
    now = F.lit(at).cast("timestamp")
    return joined.select(
        "source_path", F.coalesce("__size", "size").alias("size"), F.coalesce("__mtime_ns", "mtime_ns").alias("mtime_ns"), count.cast("int").alias("fail_count"), F.coalesce("__error", "last_error").alias("last_error"),
        F.coalesce("first_failed_at", now).alias("first_failed_at"), F.when(hit, now).otherwise(F.col("last_failed_at")).alias("last_failed_at"), (kept | (hit & (count >= limit))).alias("quarantined"),
    )


def clear_failures(failed: DataFrame, succeeded: DataFrame) -> DataFrame:
    return failed.join(succeeded.select("source_path"), "source_path", "left_anti")


def fail_counts(log: DataFrame, order: str, path: str, size: str) -> DataFrame:
    """The failure count of every path after a whole log of errors: how many came since its size last changed."""
    w = Window.partitionBy(path).orderBy(order)
    moved = F.when(F.lag(size).over(w) != F.col(size), 1).otherwise(0)
    version = log.withColumn("__v", moved)
    version = version.withColumn("__v", F.sum("__v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per = version.groupBy(path, "__v").agg(F.count("*").alias("n"))
    return per.groupBy(path).agg(F.max_by("n", "__v").alias("fail_count"))


def healthy_passes(attempts: DataFrame, by: str) -> DataFrame:
    """Per pass: totals, whether anything succeeded, so that its failures count."""
    good = F.col("status") != "error"
    return attempts.groupBy(by).agg(F.count_if(good).alias("processed"), F.count_if(~good).alias("errors"), F.bool_or(good).alias("any_success"))
