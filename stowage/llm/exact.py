"""Exact dedup: texts that are identical without their white space, by skew-safe combining.

1. Every row gets the SHA-256 digest of its normalised text. Rows whose digest no other row has are alone.
2. The others are combined with their full text: rows of one task that agree in digest, text and salt become one before
   the shuffle (the aggregate's partial step, which keeps the best row and a count), salted groups are merged after it,
   and the winners of the salts are combined globally. Digest and whole text are the key of every step, so no two texts
   are taken for equal by their digest alone.
3. Documents find their winner by the digest where the comparison found one text below it, and by digest and text where
   it found several.

Scale: no window, no list of members: a group of any size is a count and a best row, and salts spread what a hot group
leaves of itself in every task. Only texts whose digest repeats take part in step 2; they are told by a merge join at
every size alike, which shuffles the text once. The joins are plain equi-joins whose hot side Spark splits; of the others
it broadcasts what it knows to be small. Tables without text are stored between the steps.

Defined results: a null text counts as empty, and all texts without other characters than white space are one group;
texts of any length are compared whole; of equal texts the one with the most code points stays, then the smallest id (a
null id after all others), then, for rows alike in both, one of them; repeated rows are copies of each other; an empty
table gives an empty result; other columns are ignored, whatever their names (and kept by ``drop_copies``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import forget, letters, stored

#: White space is U+0020 and U+0009 to U+000D.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
SALTS = 16


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(letters(text), BLANKS, "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def combined(texts: DataFrame, salts: int = SALTS) -> DataFrame:
    """digest, norm, n, best (points negated, whether the id is null, id): one row per distinct text.

    texts: doc_id, digest, norm, points.
    """
    best = F.struct((-F.col("points")).alias("short"), F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"))
    salted = texts.select("digest", "norm", F.pmod(F.xxhash64("doc_id", "points"), F.lit(salts)).alias("salt"), best.alias("best"))
    merged = salted.groupBy("digest", "norm", "salt").agg(F.count("*").alias("n"), F.min("best").alias("best"))
    return merged.groupBy("digest", "norm").agg(F.sum("n").alias("n"), F.min("best").alias("best"))


def copies(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column], salts: int) -> DataFrame:
    """doc_id, points, digest, keep_id, group_size, kept: one row per row of ``docs``."""
    norm = normalised(F.col(text_col))
    named = docs.select(F.col(id_col).alias("doc_id"), F.length(letters(F.col(text_col))).alias("points"), norm.alias("norm")).withColumn("digest", digest(F.col("norm")))
    rows = stored(named.select(F.monotonically_increasing_id().alias("row"), "doc_id", "points", "digest", F.lit("").alias("norm")))
    again = stored(rows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"))
    of = lambda digests: named.join(digests.hint("merge"), "digest", "left_semi")
    found = stored(combined(of(again), salts).withColumn("norm", F.lit("")))
    shared = stored(found.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"))
    members, winners = rows, found
    if not shared.isEmpty():  # different texts below one digest: these rows are told apart by the text itself
        apart = of(shared).withColumn("row", -1 - F.monotonically_increasing_id()).select(*rows.columns)
        members = stored(rows.join(shared, "digest", "left_anti").unionByName(apart))
        winners = stored(found.join(shared, "digest", "left_anti").unionByName(combined(of(shared), salts)))
    key = ["digest", "norm"]
    best = F.col("doc_id").eqNullSafe(F.col("best.id")) & (-F.col("points") == F.col("best.short"))
    stays = members.join(winners, key).where(best).groupBy(*key).agg(F.min("row").alias("stays"))
    answer = stored(winners.join(stays, key))
    for table in (again, found, shared):
        forget(table)
    alone = F.col("n").isNull()
    return members.join(answer, key, "left").select(
        "doc_id", "points", "digest", F.when(alone, F.col("doc_id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (alone | (F.col("row") == F.col("stays"))).alias("kept"),
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text, lowercase hex)."""
    found = copies(docs, id_col, text_col, digest, salts)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The documents, all columns, that stay: one of each group of equal texts."""
    kept = copies(docs, id_col, text_col, sha256, salts).where("kept").select("doc_id", "points", "digest")
    norm = normalised(F.col(text_col))
    rows = docs.select(F.struct("*").alias("document"), F.col(id_col).alias("id"), F.length(letters(F.col(text_col))).alias("size"), sha256(norm).alias("sha"))
    met = rows.join(kept, (F.col("sha") == F.col("digest")) & F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("size") == F.col("points")), "left_semi")
    return met.dropDuplicates(["sha", "id", "size"]).select("document.*")
