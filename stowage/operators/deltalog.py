"""Tables as logs of deltas: a batch appends what it changes, readers merge, and small segments grow together.

Parquet has no MERGE, and a table cannot be overwritten while it is read. A commit writes the changed rows alone, in
files of their own for every bucket of keys, and then replaces a pointer file that names the live segments; readers see
all of a commit or none. There is one writer.

- A keyed table keeps the last row of each key; a row that is marked as gone removes it. Reading takes the oldest segment
  of every bucket as it is, but for the keys that later ones have, so that a read shuffles what has changed lately.
- An event table keeps all rows.
- The segments of a bucket at least halve in size from one to the next. A segment that would break this is merged with
  those before it, in buckets that the commit has touched alone: a bucket of n rows has some log n segments, and each row
  is rewritten some log n times in all, so that what a batch writes follows its own size and not that of the table.

Rows are sorted by key in every file, so a look-up of one key reads one bucket, and of its files the pages of the key.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 16
_INNER = "_version long, _gone boolean"


@dataclass(frozen=True)
class Table:
    schema: str
    key: str
    #: Whether a key has one row, the last; else all rows stay, in this order below a key.
    keyed: bool = True
    order: tuple[str, ...] = ()
    #: A column whose largest value is kept beside the pointer.
    top: str | None = None

    @property
    def columns(self) -> list[str]:
        return StructType.fromDDL(self.schema).fieldNames()


def bucket(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def bucket_of(key) -> int:
    return zlib.crc32(("" if key is None else str(key)).encode()) & (BUCKETS - 1)


class DeltaLog:
    """Tables under one folder, on any file system Spark can write to."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table]):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def delete_on_exit(self) -> DeltaLog:
        """Let the folder go when the driver ends."""
        self._fs.deleteOnExit(self._path(self.root))
        return self

    # the pointer

    def _pointer(self) -> dict:
        """version; segments: table -> bucket -> [version, bytes], oldest first; top: table -> largest value."""
        at = self._path(f"{self.root}/CURRENT.json")
        if not self._fs.exists(at):
            return {"version": 0, "segments": {}, "top": {}}
        stream = self._fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _swap(self, pointer: dict) -> None:
        new, at = self._path(f"{self.root}/CURRENT.json.{pointer['version']}"), self._path(f"{self.root}/CURRENT.json")
        stream = self._fs.create(new, True)
        stream.write(bytearray(json.dumps(pointer).encode()))
        stream.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        swap = self.spark.sparkContext._gateway.new_array(options, 1)
        swap[0] = options.OVERWRITE
        context.rename(new, at, swap)

    def top(self, name: str) -> int:
        return self._pointer()["top"].get(name, 0)

    # segments

    def _segment(self, name: str, version: int, number: str) -> str:
        return f"{self.root}/{name}/v{version}/bucket={number}"

    def _load(self, name: str, paths: Iterable[str]) -> DataFrame:
        schema = f"{self.tables[name].schema}, {_INNER}"
        paths = list(paths)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, name: str, rows: DataFrame, version: int) -> dict[str, int]:
        """bucket -> bytes."""
        table, path = self.tables[name], f"{self.root}/{name}/v{version}"
        placed = rows.withColumn("bucket", bucket(F.col(table.key))).hint("rebalance", "bucket")
        placed.sortWithinPartitions("bucket", table.key, *table.order).write.mode("overwrite").partitionBy("bucket").parquet(path)
        found = {}
        for status in self._fs.listStatus(self._path(path)):
            if (said := status.getPath().getName()).startswith("bucket="):
                found[said.removeprefix("bucket=")] = self._fs.getContentSummary(status.getPath()).getLength()
        return found

    def _last(self, rows: DataFrame, key: str) -> DataFrame:
        """The last row of each key, those that are gone too."""
        return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), "_version").alias("row")).select("row.*")

    def read(self, name: str, keys: Iterable | None = None) -> DataFrame:
        """The table as of now; with ``keys``, the buckets that may hold these alone."""
        return self._merged(name, None if keys is None else {str(bucket_of(k)) for k in keys})

    def _merged(self, name: str, numbers: set[str] | None) -> DataFrame:
        table, live = self.tables[name], self._pointer()["segments"].get(name, {})
        live = {n: segments for n, segments in live.items() if numbers is None or n in numbers}
        columns = table.columns
        if not table.keyed:
            return self._load(name, (self._segment(name, v, n) for n, segments in live.items() for v, _ in segments)).select(*columns)
        oldest = self._load(name, (self._segment(name, segments[0][0], n) for n, segments in live.items()))
        later = [self._segment(name, v, n) for n, segments in live.items() for v, _ in segments[1:]]
        if later:
            last = self._last(self._load(name, later), table.key)
            oldest = oldest.join(last.select(table.key), table.key, "left_anti").select(*oldest.columns).unionByName(last)
        return oldest.where("NOT _gone").select(*columns)

    def touched(self, name: str, rows: DataFrame, key: str | None = None) -> DataFrame:
        """The table's buckets that hold the keys of ``rows``: all that a batch has to read to merge them."""
        numbers = {str(r[0]) for r in rows.select(bucket(F.col(key or self.tables[name].key))).distinct().collect()}  # BUCKETS at most
        return self._merged(name, numbers)

    # writing

    def commit(self, **deltas: DataFrame) -> None:
        """Append deltas: for keyed tables one row per key, with ``_gone`` where rows may be removals; then swap the pointer."""
        pointer = self._pointer()
        version = pointer["version"] + 1
        with ThreadPoolExecutor(len(deltas) or 1) as tables:  # small jobs, side by side
            list(tables.map(lambda named: self._append(pointer, version, *named), deltas.items()))
        self._swap(pointer | {"version": version + 1})

    def _append(self, pointer: dict, version: int, name: str, rows: DataFrame) -> None:
        table = self.tables[name]
        gone = F.coalesce("_gone", F.lit(False)) if "_gone" in rows.columns else F.lit(False)
        given = [F.lit(version).cast("long").alias(c) if c == "batch" else c for c in table.columns]
        written = self._write(name, rows.select(*given, F.lit(version).cast("long").alias("_version"), gone.alias("_gone")), version)
        segments = pointer["segments"].setdefault(name, {})
        for number, size in written.items():
            segments.setdefault(number, []).append([version, size])
        if table.top and written:
            most = self._load(name, (self._segment(name, version, n) for n in written)).agg(F.max(table.top)).first()[0]
            pointer["top"][name] = max(pointer["top"].get(name, 0), most or 0)
        self._grow_together(name, segments, set(written), version + 1)

    def _grow_together(self, name: str, segments: dict[str, list], numbers: set[str], version: int) -> None:
        """Merge the youngest segments of these buckets until sizes halve again from each to the next."""
        merged: dict[str, int] = {}  # bucket -> the first segment to merge
        for number in numbers:
            own = segments[number]
            first, size = len(own) - 1, own[-1][1]
            while first and 2 * size >= own[first - 1][1]:
                first -= 1
                size += own[first][1]
            if first < len(own) - 1:
                merged[number] = first
        if not merged:
            return
        table = self.tables[name]
        rows = self._load(name, (self._segment(name, v, n) for n, first in merged.items() for v, _ in segments[n][first:]))
        if table.keyed:
            rows = self._last(rows, table.key)
            if bottom := [int(n) for n, first in merged.items() if not first]:  # below them there is nothing to hide
                rows = rows.where(~F.col("_gone") | ~bucket(F.col(table.key)).isin(bottom))
        written = self._write(name, rows, version)
        for number, first in merged.items():
            segments[number][first:] = [[version, written[number]]] if number in written else []
            if not segments[number]:
                del segments[number]

    def vacuum(self) -> None:
        """Delete segments that are live no more, and what an unfinished commit has left."""
        live = {(name, f"v{v}", f"bucket={n}") for name, buckets in self._pointer()["segments"].items() for n, own in buckets.items() for v, _ in own}
        for name in self.tables:
            folder = self._path(f"{self.root}/{name}")
            if not self._fs.exists(folder):
                continue
            for version in self._fs.listStatus(folder):
                below = [s.getPath() for s in self._fs.listStatus(version.getPath())]
                kept = [p for p in below if (name, version.getPath().getName(), p.getName()) in live]
                for path in [version.getPath()] if not kept else [p for p in below if p not in kept]:
                    self._fs.delete(path, True)
