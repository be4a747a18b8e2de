"""Vector code compression: product codes whose codebooks are trained by Lloyd's rounds over heaps of bounds.

A vector of integers is cut into ``PARTS`` equal parts, each with a codebook of ``ENTRIES`` entries. An assigned part has
a slack: the distance to its second nearest entry (lower bound of all others) minus that to its own (upper bound). When
entries move, a slack shrinks by no more than its entry's way plus the longest way of any other entry. Instead of
touching every part, each entry sums these up as its drift; a part is pushed with the key ``slack + drift`` and need not
be looked at while its key exceeds its entry's drift, for its own entry is the nearest by then. A round pops the parts
whose keys the drift has reached, compares them exactly with all entries, and pushes them again.

On Spark the heaps are sorted runs: every task writes what it pushes to its own file, by part, entry and key. Heaps are
popped in bulk and from the front alone, so runs are never rewritten: as drift only grows, what a round pops of a run
are the keys between the drift of the round before and that of now, a range at the front of the entry's stretch, and
Parquet's statistics let the scan leave out pages beyond the largest drift. Popped parts go to the runs of the next
round. Sums of entries follow by differences of the parts that have moved, added up in the task before the shuffle.

Exactness: components and sums are 64-bit integers, distances too (by way of 53-bit floats where these hold them, else
in integers); keys are rounded down and drifts up, and a tie has no slack, so that it is compared again in every round.
Components too large for exact distances or sums raise ``ValueError``.

Scale: one pass over the vectors, then what the rounds pop; the driver holds the codebooks (``ENTRIES`` times the
dimension) and takes one sum per entry and component. No row is shuffled until the parts of a vector meet for its code.

Defined results: rows whose vector is null or holds a null or non-finite component are dropped; shorter vectors count as
padded with zeros to the longest one, and that to a multiple of ``PARTS``; with fewer rows than ``ENTRIES`` there are
fewer entries; rows with equal ids (null ids last) are in order of their vectors and have codes of their own; equal
entries tie to the lower index; an empty table, or one of empty vectors, gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm.common import mapped, stored

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Parts that are compared with a codebook at once.
CHUNK = 4096
#: What a rounded key or drift may be off by, relative to the distances in it.
SLIP = 1e-12


def whole_vectors(rows: DataFrame, vector: str, scale: int, shift: int = 0) -> DataFrame:
    """Rows whose vector is whole and finite, with ``x``: floor(scale * component) + shift, as longs."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    good = rows.where(F.col(vector).isNotNull() & ~F.exists(F.col(vector).cast("array<double>"), bad))
    return good.withColumn("x", F.transform(F.col(vector).cast("array<double>"), lambda c: F.floor(c * scale).cast("long") + shift))


def padded(x: Column, size: int) -> Column:
    return F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size(x)))


def matrix(column: pa.Array) -> np.ndarray:
    """The lists of one length as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


# --- one codebook ------------------------------------------------------------------------------------------------


def exact_scores(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries, exact."""
    most = int(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * most * most * x.shape[1] < 1 << 53 else np.int64
    a, b = x.astype(kind), entries.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, ties to the lower index; slack, rounded down) of every row."""
    own, slack = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    for top in range(0, len(x), CHUNK):
        d = exact_scores(x[top : top + CHUNK], entries)
        rows, best = np.arange(len(d)), d.argmin(1)
        own[top : top + CHUNK] = best
        if len(entries) > 1:
            upper = np.sqrt(d[rows, best].astype(np.float64))
            d[rows, best] = np.iinfo(np.int64).max
            lower = np.sqrt(d.min(1).astype(np.float64))
            slack[top : top + CHUNK] = lower - upper - SLIP * (lower + upper)
    return own, slack


def next_entries(entries: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each component; an entry without parts stays."""
    return np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], entries)


def drifted(drift: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Each entry's drift after a move: its own way and the longest of the others', rounded up."""
    way = np.sqrt(((after - before).astype(np.float64) ** 2).sum(1)) * (1 + SLIP)
    if len(way) < 2:
        return drift
    order = np.argsort(way)
    others = np.full(len(way), way[order[-1]])
    others[order[-1]] = way[order[-2]]
    return (drift + way + others) * (1 + SLIP)


# --- heaps over a table ------------------------------------------------------------------------------------------

HEAP = "row long, part int, entry int, key double, x array<bigint>, was int"
#: What parts that change their entry add to an entry: how many, and their sum.
MOVE = "part int, entry int, count long, total array<bigint>"


@dataclass
class Heaps:
    """Runs of pushed parts, and the drift of each round that has popped them."""

    runs: list[DataFrame]
    drift: np.ndarray  # parts x entries, as of the last round

    @staticmethod
    def _reached(drift: np.ndarray) -> Column:
        """Whether a part's key is within its entry's drift. The largest drift bounds the pages that are read."""
        limits = F.split(F.lit(",".join(map(repr, drift.ravel().tolist()))), ",").cast("array<double>")
        return (F.col("key") <= float(drift.max(initial=0))) & (F.col("key") <= F.get(limits, F.col("part") * drift.shape[1] + F.col("entry")))

    def _left(self) -> DataFrame:
        """Parts that no round so far has popped. A run's own round and those before it did not."""
        return reduce(DataFrame.unionByName, [run.where(~self._reached(self.drift)) for run in self.runs])

    def pop(self, drift: np.ndarray) -> DataFrame:
        """Parts that the drift has reached since the last round."""
        popped = self._left().where(self._reached(drift))
        self.drift = drift
        return popped

    def push(self, parts: DataFrame) -> DataFrame:
        """The run that holds them from now on."""
        self.runs.append(stored(parts.sortWithinPartitions("part", "entry", "key")))
        return self.runs[-1]

    def all(self) -> DataFrame:
        return self._left()


def _compare(books: np.ndarray, drift: np.ndarray):
    """Parts (row, part, entry, x) with their entries and keys as of now, and the entry before."""

    def run(source: Iterator[pa.RecordBatch]):
        for batch in source:
            part, x = batch.column(1).to_numpy(), matrix(batch.column(3)) if batch.num_rows else None
            entry, key = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for p in np.unique(part):
                own = np.flatnonzero(part == p)
                best, slack = nearest(x[own], books[p])
                entry[own], key[own] = best, np.maximum(slack + drift[p][best], np.nextafter(drift[p][best], np.inf))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(entry), pa.array(key), batch.column(3), batch.column(2)], names=["row", "part", "entry", "key", "x", "was"])

    return run, HEAP


def _moved(entries: int):
    """MOVE of a task: what its parts add to and take from the sums."""

    def run(source: Iterator[pa.RecordBatch]):
        count = sums = None
        for batch in source:
            if not batch.num_rows:
                continue
            part, entry, was, x = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), matrix(batch.column(3)))
            if sums is None:
                count, sums = np.zeros(PARTS * entries, np.int64), np.zeros((PARTS * entries, x.shape[1]), np.int64)
            for to, sign in ((entry, 1), (was, -1)):
                there = to >= 0
                at = part[there] * entries + to[there]
                np.add.at(sums, at, sign * x[there])
                count += sign * np.bincount(at, minlength=len(count))
        if sums is not None:
            used = np.flatnonzero((count != 0) | (sums != 0).any(1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * sums.shape[1]), pa.array(sums[used].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array((used // entries).astype(np.int32)), pa.array((used % entries).astype(np.int32)), pa.array(count[used]), lists], names=["part", "entry", "count", "total"])

    return run, MOVE


class Lloyd:
    """Codebooks in training: entries, sums and counts on the driver, parts in heaps."""

    def __init__(self, parts: DataFrame, books: np.ndarray):
        self.books = books
        self.sums, self.counts = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        self.heaps = Heaps([], np.full(books.shape[:2], -1.0))
        self.drift = np.zeros(books.shape[:2])
        self._rescan(parts)

    def _rescan(self, popped: DataFrame) -> None:
        run = self.heaps.push(mapped(popped.select("row", "part", "entry", "x"), *_compare(self.books, self.drift)))
        moved = mapped(run.where("entry <> was").select("part", "entry", "was", "x"), *_moved(self.books.shape[1]))
        for r in moved.select("part", "entry", "count", F.posexplode("total").alias("at", "v")).groupBy("part", "entry", "at").agg(F.sum("count").alias("count"), F.sum("v").alias("v")).collect():
            self.sums[r["part"], r["entry"], r["at"]] += r["v"]
            if not r["at"]:
                self.counts[r["part"], r["entry"]] += r["count"]

    def round(self) -> None:
        """Move the entries to the means of their parts and assign all parts again, looking at those alone that may change."""
        before = self.books
        self.books = np.stack([next_entries(*args) for args in zip(before, self.sums, self.counts, strict=True)])
        self.drift = np.stack([drifted(*args) for args in zip(self.drift, before, self.books, strict=True)])
        self._rescan(self.heaps.pop(self.drift))


def _own_distance(books: np.ndarray):
    def run(source: Iterator[pa.RecordBatch]):
        for batch in source:
            part, entry = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            far = ((matrix(batch.column(3)) - books[part, entry]) ** 2).sum(1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(far)], names=["row", "part", "entry", "far"])

    return run, "row long, part int, entry int, far long"


def train(spark: SparkSession, base: DataFrame, size: int, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[np.ndarray, DataFrame]:
    """(codebooks, parts x entries x components; row, part, entry, far of every part). base: row, id, x of ``size`` components."""
    width = size // PARTS
    first = base.orderBy(F.col("id").isNull(), "id", "x").limit(entries).select("x").collect()
    seeds = np.array([r["x"] for r in first], np.int64).reshape(len(first), PARTS, width)
    pieces = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda p: F.slice("x", p * width + 1, width))
    parts = base.select("row", F.posexplode(pieces).alias("part", "x")).select("row", "part", F.lit(-1).alias("entry"), "x")
    lloyd = Lloyd(parts, np.ascontiguousarray(seeds.transpose(1, 0, 2)))
    for _ in range(rounds):
        lloyd.round()
    return lloyd.books, mapped(lloyd.heaps.all().select("row", "part", "entry", "x"), *_own_distance(lloyd.books))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def product_codes(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    spark = rows.sparkSession
    kinds = rows.schema[id_col].dataType.simpleString()
    kept = whole_vectors(rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")), "v", SCALE)
    base = stored(kept.select(F.monotonically_increasing_id().alias("row"), "id", "label", "x"))
    bounds = base.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("x")), F.lit(0)).alias("size"), F.max(F.greatest(F.array_max("x").cast("double"), -F.array_min("x").cast("double"))).alias("most")).first()
    if entries > 256:
        raise ValueError("a code has two hex digits a part, so at most 256 entries")
    if not bounds["size"]:
        return spark.createDataFrame([], f"vec_id {kinds}, code string, error long, label_error long, codebooks_sha256 string")
    size = -(-bounds["size"] // PARTS) * PARTS
    if max(bounds["n"] * bounds["most"], 4 * bounds["most"] ** 2 * size * bounds["n"]) >= 1 << 63:
        raise ValueError("components are too large for exact sums and distances in 64 bits")
    books, assigned = train(spark, base.withColumn("x", padded(F.col("x"), size)), size, entries, rounds)
    code = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "entry"))), lambda p: F.lower(F.lpad(F.hex(p["entry"]), 2, "0"))), "")
    coded = assigned.groupBy("row").agg(code.alias("code"), F.sum("far").alias("error"))  # a row has PARTS parts
    errors = stored(base.select("row", "id", "label").join(coded, "row"))
    labels = stored(errors.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "name"))
    joined = errors.join(labels, F.col("label").eqNullSafe(F.col("name")))
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
