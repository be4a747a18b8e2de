"""Duplicates, known digests and run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mark_duplicates(files: DataFrame, catalog: DataFrame | None = None, digest: str = "digest", path: str = "source_path") -> DataFrame:
    """Adds ``status``: the first path of a digest is ``copied``, later ones and known digests are ``duplicate``.

    The first path is an aggregate joined back, not a rank: a digest that a third of all files share is combined
    before the shuffle, and the join's hot partition can be split.
    """
    known = catalog.select(F.col(digest).alias("__known")).distinct() if catalog is not None else None
    first = files.groupBy(F.col(digest).alias("__digest")).agg(F.min(path).alias("__first"))
    out = files.join(first, F.col(digest).eqNullSafe(F.col("__digest")))
    fresh = F.col(path) == F.col("__first")
    if known is not None:
        out = out.join(known, F.col(digest) == F.col("__known"), "left")
        fresh &= F.col("__known").isNull()
    return out.withColumn("status", F.when(fresh, "copied").otherwise("duplicate")).drop("__digest", "__first", "__known")


def survivors(attempts: DataFrame, digest: str = "digest", path: str = "source_path", ok: str = "ok") -> DataFrame:
    """Statuses where attempts may fail: the first path that succeeds is ``copied``, failures before it are ``error``.

    A file that fails is never catalogued, so the next path with the same bytes is tried.
    """
    first = attempts.groupBy(F.col(digest).alias("__digest")).agg(F.min(F.when(F.col(ok), F.col(path))).alias("__first"))
    joined = attempts.join(first, F.col(digest).eqNullSafe(F.col("__digest")))
    before = F.col("__first").isNull() | (F.col(path) < F.col("__first"))
    status = F.when(before, "error").when(F.col(path) == F.col("__first"), "copied").otherwise("duplicate")
    return joined.withColumn("status", status).drop("__digest", "__first")


def run_stats(results: DataFrame, *by: str) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s)
    return results.groupBy(*by).agg(F.count("*").alias("total"), count("copied").alias("copied"), count("duplicate").alias("duplicates"), count("skipped").alias("skipped"), count("error").alias("errors"))


def breaker_trips(attempts: DataFrame, threshold: int, order: list[str], by: list[str]) -> DataFrame:
    """Adds ``run`` (how many errors in a row end here) within each ``by`` group; a row trips where it reaches the threshold.

    A pass is one group: the order inside it is needed, across passes it is not.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    isle = F.sum(F.when(F.col("status") != "error", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    within = Window.partitionBy(*by, "__isle").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum(F.when(F.col("status") == "error", 1).otherwise(0)).over(within)
    out = attempts.withColumn("__isle", isle).withColumn("run", run).drop("__isle")
    return out.withColumn("trips", (F.col("status") == "error") & (F.col("run") >= threshold))


def untried_after_trip(tripped: DataFrame, order: str, by: list[str]) -> DataFrame:
    """Adds ``tried``: whether a pass got as far as the row before its breaker opened."""
    first = tripped.groupBy(*by).agg(F.min(F.when(F.col("trips"), F.col(order))).alias("__at"))
    return tripped.join(first, by).withColumn("tried", F.col("__at").isNull() | (F.col(order) <= F.col("__at"))).drop("__at")
