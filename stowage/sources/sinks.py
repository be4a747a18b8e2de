"""Writing files from tasks. What readers see is renamed into its place, so a task may run again or twice.

Copies are a data source's writer: its tasks stage and verify, and an abort cleans up. When all are staged the tasks of a
second job publish them. The root must be a folder that the driver and all executors mount alike.
"""

from __future__ import annotations

import json
import logging
import os
import shutil
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from stowage.session import forget, stored
from stowage.sources.files import file_digest

logger = logging.getLogger(__name__)


def copy_file(source: str, target: str) -> None:
    """Copies content and times; readers see the whole file or none."""
    os.makedirs(os.path.dirname(target), exist_ok=True)
    part = f"{target}.{uuid.uuid4().hex}.part"
    try:
        shutil.copy2(source, part)
        os.replace(part, target)
    finally:
        if os.path.exists(part):
            os.unlink(part)


def sidecar_name(target: str) -> str:
    """JSON beside the file, its extension replaced."""
    return os.path.splitext(target)[0] + ".json"


def _holds(name: str, raw: bytes) -> bool:
    try:
        with open(name, "rb") as f:
            return f.read(len(raw) + 1) == raw
    except FileNotFoundError:
        return False


STAGING = ".staging"
_RESULT = "source_path string, status string, error string"
_RESULTS = pa.schema([(n, pa.string()) for n in ("source_path", "target", "digest", "status", "error", "staged", "staged_sidecar")])


class _Done(WriterCommitMessage):
    def __init__(self, results: str):
        self.results = results


class _CopyWriter(DataSourceArrowWriter):
    """Tasks copy and verify into staging folders of their own below the root; the commit of the job tells whose results count.

    A task that fails or runs twice has staged in a folder that no message tells of; a job that is stopped leaves the
    staging folder alone, so nothing of it can be seen in the tree.
    """

    def __init__(self, options):
        self.folder = os.path.join(options["path"], STAGING, options["job"])

    def write(self, iterator):
        own = os.path.join(self.folder, uuid.uuid4().hex)
        os.makedirs(own)
        results = os.path.join(own, "results.parquet")
        with pq.ParquetWriter(results, _RESULTS) as out:
            count = 0
            for batch in iterator:
                column = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
                none = [None] * batch.num_rows
                rows = [self._stage(os.path.join(own, str(count + k)), *row) for k, row in enumerate(zip(column["source_path"], column["organized_path"], column["digest"], column.get("sidecar", none), strict=True))]
                count += len(rows)
                out.write_batch(pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(_RESULTS)], schema=_RESULTS))
        return _Done(results)

    def _stage(self, own: str, source: str, target: str, digest: str, sidecar: str | None) -> tuple:
        """A row of results: any failure is that file's alone. A target that verifies already is left alone, and so is a sidecar that says the same."""
        staged, beside = own, None
        try:
            if os.path.exists(target) and file_digest(target) == digest:
                staged = None
            else:
                shutil.copy2(source, staged)
                if file_digest(staged) != digest:
                    os.unlink(staged)
                    raise RuntimeError(f"integrity check failed: {source} -> {target}")
        except Exception as error:
            return source, target, digest, "error", str(error), None, None
        if sidecar is not None:
            try:
                raw = json.dumps(json.loads(sidecar), indent=2, ensure_ascii=False).encode()
                if not _holds(sidecar_name(target), raw):
                    beside = f"{own}.json"
                    with open(beside, "wb") as f:
                        f.write(raw)
            except Exception as error:  # the copy stands
                logger.warning("no sidecar for %s: %s", target, error)
                beside = None
        return source, target, digest, "copied", None, staged, beside

    def commit(self, messages):
        done = os.path.join(self.folder, "done")
        os.makedirs(done)
        for k, message in enumerate(messages):
            if message is not None:
                os.replace(message.results, os.path.join(done, f"{k}.parquet"))

    def abort(self, messages):
        shutil.rmtree(self.folder, ignore_errors=True)


def _moved(staged: str, name: str, there) -> None:
    """Rename, unless a task that ran before has done so; there: tells whether the name holds what was staged."""
    try:
        os.replace(staged, name)
    except FileNotFoundError:
        if os.path.lexists(staged) or not there():
            raise


def _published(batches):
    """Moves what tasks have staged into its place; a failure is that file's alone."""
    for batch in batches:
        rows, folders = [], set()
        for source, target, digest, status, error, staged, beside in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            folder = os.path.dirname(target)
            try:
                if (staged or beside) and folder not in folders:
                    os.makedirs(folder, exist_ok=True)
                    folders.add(folder)
                if staged:
                    _moved(staged, target, lambda: os.path.exists(target) and file_digest(target) == digest)
            except OSError as failure:
                status, error, beside = "error", str(failure), None
            if beside:
                try:
                    _moved(beside, sidecar_name(target), lambda: os.path.exists(sidecar_name(target)))
                except OSError as failure:  # the copy stands
                    logger.warning("no sidecar for %s: %s", target, failure)
            rows.append((source, status, error))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["source_path", "status", "error"])


class CopySink(DataSource):
    @classmethod
    def name(cls):
        return "stowage_copies"

    def schema(self):
        return "source_path string, organized_path string, digest string, sidecar string"

    def writer(self, schema, overwrite):
        return _CopyWriter(self.options)


def sweep(root: str) -> None:
    """Delete what jobs that were killed have staged; there is one writer, so no job is running."""
    shutil.rmtree(os.path.join(root, STAGING), ignore_errors=True)


def organize_files(rows: DataFrame, root: str, sidecars: bool = False) -> DataFrame:
    """Adds status and error. rows: source_path, organized_path below ``root``, digest; and ``sidecar`` (JSON) if sidecars are wanted.

    No copy becomes visible before all are staged and verified. A sidecar that can't be written does not undo its copy.
    """
    spark, job = rows.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(CopySink)
    rows = stored(rows)
    columns = ["source_path", "organized_path", "digest", F.col("sidecar") if sidecars else F.lit(None).cast("string").alias("sidecar")]
    rows.select(*columns).write.format("stowage_copies").option("job", job).mode("append").save(root)
    staged = spark.read.schema(", ".join(f"{n} string" for n in _RESULTS.names)).parquet(f"file:{os.path.abspath(root)}/{STAGING}/{job}/done")
    done = stored(rows.join(staged.mapInArrow(_published, _RESULT), "source_path").select(*rows.columns, "status", "error"))
    forget(rows)
    shutil.rmtree(os.path.join(root, STAGING, job), ignore_errors=True)
    return done


def copy_aside(rows: DataFrame, target: str = "target") -> DataFrame:
    """Copies source_path to a column's path (duplicates, quarantine); returns source_path, copied."""

    def run(batches):
        for batch in batches:
            paths = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("source_path", target)]
            done = []
            for source, to in zip(*paths, strict=True):
                try:
                    copy_file(source, to)
                    done.append(True)
                except OSError:
                    done.append(False)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("source_path")), pa.array(done)], names=["source_path", "copied"])

    return rows.mapInArrow(run, "source_path string, copied boolean")
