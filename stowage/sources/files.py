"""File metadata as a table: path, size and modification time in nanoseconds, without reading a byte of content.

Spark's own binary source leaves out hidden and empty files and rounds times to milliseconds, so this is a data source
of its own. The folder must be mounted alike on all executors.

A scan is dealt out before anything is looked at: folders are opened from the top until there are ``FOLDERS`` of them or
no more. Small ones are put together, and one with many entries is split into slices, so that a task has ``SLICE`` entries
at most, and fewer where that gives work to ``TASKS`` tasks. Every task of a split folder lists its names, which is one
read of the directory, and looks at those whose hash falls to it, which is what takes the time. A folder with more than
``FOLDERS`` folders is split with all that is below them, and folders that were not opened are dealt to ``WALKS`` tasks, so
neither the plan nor the number of tasks grows with the number of folders. The list of extensions is pushed into the source, so other files are not looked at; rows leave a task as Arrow batches.

As a stream every batch is a listing of the whole tree as of its time. Offsets hold that time alone: what has been seen,
with size and time, is the state of who reads it (``streaming.watch``), however many files there are.
"""

from __future__ import annotations

import hashlib
import logging
import os
import re
import time
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition

from stowage.functions import constants as C
from stowage.session import ARROW_BYTES

logger = logging.getLogger(__name__)
SCHEMA = "source_path string, size long, mtime_ns long"
_SOURCE = f"{SCHEMA}, extension string"
#: Folders that a plan opens at most, entries of a task at most and at least, tasks to aim at, tasks that walk what was not opened, rows of an Arrow batch.
FOLDERS = 1024
SLICE = 10_000
LEAST = 50
TASKS = 64
WALKS = 256
ROWS = 5_000


@dataclass(frozen=True)
class _Piece:
    """The entries of one folder whose name's hash modulo ``of`` is ``k``, if ``deep`` with all that is below them; a single file; or nothing."""

    path: str
    deep: bool
    k: int = 0
    of: int = 1


class _Part(InputPartition):
    def __init__(self, *pieces: _Piece):
        super().__init__(pieces[0].path)
        self.pieces = pieces


def extension_of(name: str) -> str:
    """As ``expressions.extension``, for a base name."""
    found = re.match(r"\.*[^.].*?(\.[^.]+)\Z", name, re.DOTALL)
    return found[1].lstrip(".").lower() if found else ""


def planned(root: str, recursive: bool, folders: int = FOLDERS, entries: int = SLICE) -> list[_Part]:
    if not os.path.exists(root):
        raise FileNotFoundError(f"no such source: {root}")
    if os.path.isfile(root):
        return [_Part(_Piece(root, False))]
    folders = max(folders, 2)
    opened, wide, queue = [], [], deque([root])
    while queue and len(opened) + len(queue) < folders:
        path, many, below = queue.popleft(), 0, []
        with os.scandir(path) as found:
            for entry in found:
                many += 1
                if recursive and len(below) <= folders and entry.is_dir(follow_symlinks=False):
                    below.append(entry.path)
        if len(below) > folders:
            wide.append((path, many))
        else:
            queue += sorted(below)
            opened.append((path, many))
    share = min(entries, max(LEAST, sum(many for _, many in [*opened, *wide]) // TASKS))
    left = [_Piece(path, True) for path in queue]
    parts, held, size = [_Part(*left[k::WALKS]) for k in range(min(WALKS, len(left)))], [], 0
    for path, many in wide:
        slices = min(WALKS, max(TASKS, -(-many // share)))
        parts += [_Part(_Piece(path, True, k, slices)) for k in range(slices)]
    for path, many in opened:
        slices = -(-max(many, 1) // share)
        if slices > 1:
            parts += [_Part(_Piece(path, False, k, slices)) for k in range(slices)]
            continue
        if held and size + many > share:
            parts.append(_Part(*held))
            held, size = [], 0
        held.append(_Piece(path, False))
        size += many
    return [*parts, _Part(*held)] if held else parts


def _names(part: _Part) -> Iterator[str]:
    for piece in part.pieces:
        if os.path.isfile(piece.path):
            yield piece.path
        elif piece.deep and piece.of == 1:
            yield from _walked(piece.path)
        elif os.path.isdir(piece.path):
            with os.scandir(piece.path) as found:
                for entry in found:
                    if piece.of == 1 or zlib.crc32(os.fsencode(entry.name)) % piece.of == piece.k:
                        if piece.deep and entry.is_dir(follow_symlinks=False):
                            yield from _walked(entry.path)
                        else:
                            yield entry.path


def _walked(path: str) -> Iterator[str]:
    return (os.path.join(d, n) for d, _, files in os.walk(path) for n in files)


def listed(part: _Part, extensions: frozenset[str] | None) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["source_path", "size", "mtime_ns", "extension"])

    for name in _names(part):
        kind = extension_of(os.path.basename(name))
        if (extensions is None or kind in extensions) and os.path.isfile(name):
            rows.append((name, *_size_and_time(name), kind))
            if len(rows) == ROWS:
                yield batch()
                rows = []
    yield batch()


def _size_and_time(name: str) -> tuple[int | None, int | None]:
    """Null for a file that went away since it was listed, which is an error of the pass."""
    try:
        st = os.stat(name)
    except OSError as error:
        logger.warning("could not stat %s: %s", name, error)
        return None, None
    return st.st_size, st.st_mtime_ns


class _Options:
    def __init__(self, options):
        self.root = options["path"]
        self.recursive = str(options.get("recursive", "true")).lower() == "true"
        self.folders, self.entries = int(options.get("folders", FOLDERS)), int(options.get("entries", SLICE))
        self.extensions: frozenset[str] | None = None

    def plan(self) -> list[_Part]:
        return planned(self.root, self.recursive, self.folders, self.entries)


class _Reader(_Options, DataSourceReader):
    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, In | EqualTo) and f.attribute == ("extension",):  # a list of one is an equality to Spark
                kinds = frozenset(f.value if isinstance(f, In) else (f.value,))
                self.extensions = kinds if self.extensions is None else self.extensions & kinds
            else:
                yield f

    def partitions(self):
        return self.plan()

    def read(self, partition):
        return listed(partition, self.extensions)


class _StreamReader(_Options, DataSourceStreamReader):
    """A listing a batch. A source that is gone gives an empty one, so that the next batch tries again."""

    def __init__(self, options):
        super().__init__(options)
        if str(options.get("supported", "true")).lower() == "true":
            self.extensions = frozenset(C.EXTENSIONS)

    def initialOffset(self):
        return {"at": 0}

    def latestOffset(self):
        return {"at": time.time_ns()}

    def partitions(self, start, end):
        try:
            return self.plan()
        except OSError as error:
            logger.warning("could not list %s: %s", self.root, error)
            return [_Part(_Piece(os.path.join(self.root, ""), False))]

    def read(self, partition):
        return listed(partition, self.extensions)


class FileSource(DataSource):
    @classmethod
    def name(cls):
        return "stowage_files"

    def schema(self):
        return _SOURCE

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)


def scan(spark: SparkSession, path: str, recursive: bool = True, supported_only: bool = True, extensions: tuple[str, ...] = (), **options) -> DataFrame:
    """Regular files below ``path`` (or that one file); by default pictures alone, or those of ``extensions``. A missing path fails.

    A file that can't be looked at has null size and time.
    """
    spark.dataSource.register(FileSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("stowage_files").option("recursive", str(recursive).lower()).options(**options).load(path)
    kinds = extensions or (C.EXTENSIONS if supported_only else ())
    return (df.where(F.col("extension").isin(*kinds)) if kinds else df).drop("extension")


def scan_stream(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """The pictures below ``path`` as a stream: every batch is a listing of all of them."""
    spark.dataSource.register(FileSource)
    return spark.readStream.format("stowage_files").option("recursive", str(recursive).lower()).load(path).drop("extension")


def file_digest(path: str) -> str:
    import base64

    with open(path, "rb") as f:
        raw = hashlib.file_digest(f, "sha256").digest()
    return base64.urlsafe_b64encode(raw).decode().rstrip("=")


def with_digests(files: DataFrame, wanted: str | None = None) -> DataFrame:
    """Adds digest and error, reading each file in chunks inside the task; a file that can't be read has the digest ``''``.

    wanted: a boolean column; where it does not hold the file is not read and both are null.
    """

    def run(batches):
        for batch in batches:
            digests, errors = [], []
            paths = batch.column(batch.schema.get_field_index("source_path")).to_pylist()
            asked = batch.column(batch.schema.get_field_index(wanted)).to_pylist() if wanted else [True] * len(paths)
            for path, ask in zip(paths, asked, strict=True):
                if not ask:
                    digests.append(None)
                    errors.append(None)
                    continue
                try:
                    digests.append(file_digest(path))
                    errors.append(None)
                except OSError as error:
                    digests.append("")
                    errors.append(str(error))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string()), pa.array(errors, pa.string())], names=[*batch.schema.names, "digest", "error"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(run, f"{columns}, digest string, error string")


def with_texts(files: DataFrame) -> DataFrame:
    """Adds text, each file's as UTF-8, read inside the task. Batches have ``ARROW_BYTES`` characters or one text more.

    Spark's own text source holds the list of all files on the driver, and gives some few small ones to a task.
    """

    def run(batches):
        for batch in batches:
            start, texts, held = 0, [], 0
            paths = batch.column(batch.schema.get_field_index("source_path")).to_pylist()
            for i, path in enumerate(paths, 1):
                with open(path, encoding="utf-8", errors="replace", newline="") as f:
                    texts.append(f.read())
                held += len(texts[-1])
                if held >= ARROW_BYTES or i == len(paths):
                    yield pa.RecordBatch.from_arrays([*batch.slice(start, i - start).columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])
                    start, texts, held = i, [], 0

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(run, f"{columns}, text string")
