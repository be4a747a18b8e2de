"""Session helpers shared by the library."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Bytes of the Arrow batches that tasks exchange with Python; Spark's default of 64 MB is held several times over.
ARROW_BYTES = 2 << 20
_owned: ContextVar[list[str] | None] = ContextVar("owned", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    Where a session on a local master leaves it unset (tests, a notebook) a temporary folder is made and set; on a
    cluster, where executors would not see such a folder, it must be set.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="stowage-checkpoints-")
        sc.setCheckpointDir(folder)
        folder = sc.getCheckpointDir()
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by ``ARROW_BYTES``, unless the session bounds them more tightly."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(name)).rstrip("b")
    if now.lstrip("-").isdigit() and not 0 < int(now) <= ARROW_BYTES:  # a size in other units is the user's own
        spark.conf.set(name, ARROW_BYTES)


def _delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder as Parquet and read it back.

    Unlike a local checkpoint the table outlives a lost executor. It is deleted at the end of the ``temporary_tables``
    block it was made in, by ``forget``, or else by the JVM when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stowage-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    if (owned := _owned.get()) is not None:
        owned.append(path)
    schema = df.schema
    df.write.parquet(path)
    again = spark.read.schema(schema).parquet(path)
    again._stored_at = path
    return again


def tallied(df: DataFrame, *metrics: Column) -> tuple[DataFrame, dict]:
    """``stored``, and aggregates of its rows that the writing job itself has gathered."""
    seen = Observation()
    table = stored(df.observe(seen, *metrics))
    return table, seen.get


def forget(df: DataFrame) -> None:
    """Delete the table of a frame that ``stored`` returned; nothing may read it any more."""
    _delete(df.sparkSession, df._stored_at)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that the block stores when it ends; what it returns must have been written elsewhere by then."""
    paths: list[str] = []
    token = _owned.set(paths)
    try:
        yield
    finally:
        _owned.reset(token)
        for path in paths:
            _delete(spark, path)
