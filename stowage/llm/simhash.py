"""SimHash near-duplicates.

A document's 64-bit fingerprint takes the majority of every bit over the XXH64 hashes of its word shingles. Two
fingerprints that differ in at most ``DISTANCE`` bits agree in all but that many of ``BLOCKS`` blocks, so they share
at least one choice of ``BLOCKS - DISTANCE`` whole blocks; documents meet in a join on these choices, the Hamming
distance is verified, and connected components follow.

Scale: all further work is on distinct fingerprints, so copies cost nothing. A block choice has about 32 bits. A
bucket that more than ``CHUNK`` fingerprints share is cut again: its other bits are split into ``DISTANCE + 1`` parts,
of which a linked pair shares one whole, so a fingerprint goes into that many smaller buckets. After ``LEVELS`` such
cuts some 18 bits are left, and a bucket that is still crowded goes in chunks, every pair of chunks being a group of its
own (at most 2**18 / ``CHUNK`` of them for a fingerprint). A group sends on links to its local roots, not all pairs.

Defined results: a null text is empty; a text without words has fingerprint 0 and is linked like any other; a text of
one or two words has one shingle; a text is hashed whole, however long, and a task holds one slice of texts at a time;
a bit that is set in exactly half of the hashes is 0; repeated rows and ids are rows of their own, alike in all columns;
of ids that are all null the component is null; an empty table gives an empty result; other columns are ignored, whatever
their names (and kept by ``drop_near_duplicates``).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm.common import batches, mapped, stored
from stowage.llm.components import components

SHINGLE = 3
DISTANCE = 3
BLOCKS = 6
CHUNK = 2048
LEVELS = 2


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = 42) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(s, seed) for s in map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))]
    total = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 4096):
        part = np.array(hashes[a : a + 4096], np.uint64)
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """A mask for every choice of blocks that a link may leave whole."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    whole = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(blocks)]
    return [sum(c) for c in combinations(whole, blocks - distance)]


def finer(mask: int, distance: int = DISTANCE) -> list[int]:
    """The mask with one of ``distance + 1`` parts of its other bits: a pair within the distance agrees on one of these."""
    free = [b for b in range(64) if not mask >> b & 1]
    edges = [len(free) * i // (distance + 1) for i in range(distance + 2)]
    return [mask | sum(1 << b for b in free[x:y]) for x, y in zip(edges, edges[1:], strict=False)]


def _linked(fps: np.ndarray, groups: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside groups of rows (equal, adjacent group numbers): each pair of small groups, roots of large ones."""
    edges = np.flatnonzero(np.diff(groups, prepend=-1, append=-1) != 0)
    size = np.diff(edges)
    out_a, out_b = [], []
    small = np.repeat(size <= 48, size)
    f, g = fps[small], groups[small]
    for d in range(1, min(48, int(size[size <= 48].max(initial=1)))):
        near = (g[d:] == g[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= distance)
        out_a.append(f[d:][near])
        out_b.append(f[:-d][near])
    for k in np.flatnonzero(size > 48):
        f = np.sort(fps[edges[k] : edges[k + 1]])
        root = np.arange(len(f))
        while True:
            low = root.copy()
            for a in range(0, len(f), 512):
                near = np.bitwise_count(f[a : a + 512, None] ^ f[None]) <= distance
                low[a : a + 512] = np.where(near, root[None], len(f)).min(axis=1)
            low = low[low]
            if (low == root).all():
                break
            root = low
        moved = root != np.arange(len(f))
        out_a.append(f[moved])
        out_b.append(f[root[moved]])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def _match(distance: int):
    def run(source):
        kept_f, kept_g, last, number = np.zeros(0, np.uint64), np.zeros(0, np.int64), None, 0
        for batch in source:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(5)])
            new = np.any(keys[:, 1:] != keys[:, :-1], axis=0)
            step = np.concatenate([[last is None or bool((keys[:, 0] != last).any())], new])
            groups = number + np.cumsum(step)
            number, last = int(groups[-1]), keys[:, -1]
            f = np.concatenate([kept_f, np.asarray(batch.column(5)).astype(np.int64).view(np.uint64)])
            g = np.concatenate([kept_g, groups])
            done = g < number
            kept_f, kept_g = f[~done], g[~done]
            yield _rows(*_linked(f[done], g[done], distance))
        yield _rows(*_linked(kept_f, kept_g, distance))

    def _rows(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return run


def links(prints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """a, b: links that join all distinct fingerprints (column fp) within ``distance`` bits of each other."""
    level, found = masks(blocks, distance), None
    bits = lambda m: F.col("fp").bitwiseAND(F.lit(_signed(m)))
    keyed = prints.select("fp", F.posexplode(F.array(*map(bits, level))).alias("c", "k"))
    for turn in range(LEVELS + 1):
        shared = stored(keyed.groupBy("c", "k").agg(F.count("*").alias("n")).where("n > 1"))
        met = keyed.join(shared, ["c", "k"])
        calm = met.where(F.col("n") <= chunk).select(F.lit(turn).alias("level"), "c", "k", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp")
        found = calm if found is None else found.unionByName(calm)
        crowded = met.where(F.col("n") > chunk)
        if shared.where(F.col("n") > chunk).isEmpty():
            break
        if turn < LEVELS:
            below = [finer(m, distance) for m in level]
            parts = [F.element_at(F.array(*(F.lit(_signed(b[j])) for b in below)), F.col("c") + 1) for j in range(distance + 1)]
            cut = F.posexplode(F.array(*(F.col("fp").bitwiseAND(m) for m in parts)))
            keyed = crowded.select("fp", "c", cut.alias("j", "k")).select("fp", (F.col("c") * (distance + 1) + F.col("j")).alias("c"), "k")
            level = [m for b in below for m in b]
        else:
            pairs = crowded.withColumn("chunks", F.expr(f"cast(ceil(n / {chunk}) as int)"))
            pairs = pairs.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
            pairs = pairs.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
            found = found.unionByName(pairs.select(F.lit(turn + 1).alias("level"), "c", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp"))
    keys = ["level", "c", "k", "i", "j"]
    grouped = found.repartition(*keys).sortWithinPartitions(*keys, "fp")
    return mapped(grouped, _match(distance), "a long, b long")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kept) -> DataFrame:
    """doc_id, fp (64 bits as a signed number); and columns given as name=expression."""
    names, n = list(kept), 1 + len(kept)
    rows = docs.select(F.col(id_col).alias("doc_id"), *(c.alias(k) for k, c in kept.items()), F.col(text_col).alias("text"))

    def run(source):
        for batch, _, _ in batches(source, "text"):
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column(n)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(fps.view(np.int64))], names=["doc_id", *names, "fp"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:n])
    return stored(mapped(rows, run, f"{schema}, fp long"))


def classes(prints: DataFrame, **options) -> DataFrame:
    """fp, root for every distinct fingerprint that is linked to another."""
    return components(links(prints.select("fp").distinct(), **options)).toDF("fp", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, fingerprint, component_id."""
    rows = fingerprints(docs, id_col, text_col)
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("m"))
    rooted = least.join(classes(rows, **options), "fp", "left").select("fp", "m", F.coalesce("root", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("m").alias("component_id"))
    named = rooted.join(first, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, all columns, of which each class keeps one: the smallest id (null first), then the smallest row hash.

    The survivors are chosen by id and 128-bit hash of the row alone. The texts are shuffled once, to meet them; of rows
    alike in all columns one is kept, in the same partitions.
    """
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    whole = [c for x in plain for c in (x, x.isNull())]
    one, two = F.xxhash64(*whole), F.xxhash64(F.lit("row"), *whole)
    rows = fingerprints(docs, id_col, text_col, one=one, two=two)
    rooted = rows.groupBy("fp").agg(F.min(F.struct("doc_id", "one", "two")).alias("m")).join(classes(rows, **options), "fp", "left")
    keep = rooted.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("m").alias("m")).select("m.one", "m.two")
    keyed = docs.select(F.struct("*").alias("row"), one.alias("one"), two.alias("two")).join(keep, ["one", "two"], "left_semi")
    alike = Window.partitionBy("one", "two").orderBy("one")
    return keyed.withColumn("n", F.row_number().over(alike)).where("n = 1").select("row.*")
