"""The catalog: photos, their history, seen sources, the hierarchy, learned subjects and failures as logs of deltas.

A batch reads the buckets its keys fall into, works out what changes, and appends that (``deltalog``). The history of a
photo is rows of an event table, by digest, commit and path: a copy that is found again adds a row and touches no other,
and an array of events is made only for a digest that is asked about.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stowage.functions import expressions as X
from stowage.operators import taxonomy as T
from stowage.operators.deltalog import DeltaLog, Table
from stowage.session import stored

EVENT = "event string, source string, destination string, duplicate_path string, at timestamp"
SCHEMAS = {
    "photos": "id long, digest string, original_path string, organized_path string, pcs_version string, pcs_primary string, pcs_name string, secondary_tags array<string>, ai_caption string, objects array<string>, ocr_text string, exif string, model_version string, created_at timestamp, processed_at timestamp",
    "history": f"digest string, batch long, {EVENT}",
    "source_seen": "source_path string, size long, mtime_ns long, digest string, seen_at timestamp",
    "taxonomy": f"{T.SCHEMA}, created_at timestamp",
    "learned_concepts": "subject string, class_code string, hits long, created_at timestamp, updated_at timestamp",
    "failed_files": "source_path string, size long, mtime_ns long, fail_count int, last_error string, first_failed_at timestamp, last_failed_at timestamp, quarantined boolean",
}
TABLES = {
    "photos": Table(SCHEMAS["photos"], "digest", top="id"), "history": Table(SCHEMAS["history"], "digest", keyed=False, order=("batch", "duplicate_path")), "source_seen": Table(SCHEMAS["source_seen"], "source_path"),
    "taxonomy": Table(SCHEMAS["taxonomy"], "code"), "learned_concepts": Table(SCHEMAS["learned_concepts"], "subject"), "failed_files": Table(SCHEMAS["failed_files"], "source_path"),
}
KEEPS = ("id", "original_path", "created_at")


class Catalog(DeltaLog):
    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root, TABLES)

    def get(self, digest: str) -> DataFrame:
        """The photo of a digest with its history, one row or none."""
        mine = F.col("digest") == digest
        fields = [c.split()[0] for c in EVENT.split(", ")]
        order = F.struct("batch", F.coalesce("duplicate_path", F.lit("")).alias("path"))
        events = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.struct(*fields).alias("e"))))
        listed = self.read("history", [digest]).where(mine).groupBy("digest").agg(F.transform(events, lambda x: x["e"]).alias("processing_history"))
        return self.read("photos", [digest]).where(mine).join(listed, "digest", "left")

    def get_by_original_path(self, path: str) -> DataFrame:
        return self.read("photos").where(F.col("original_path") == path).orderBy("id").limit(1)

    def is_known(self, digests: DataFrame) -> DataFrame:
        return known(digests, self.touched("photos", digests))

    def all(self) -> DataFrame:
        return self.read("photos").orderBy("id")

    def upsert(self, new: DataFrame) -> DataFrame:
        """The delta of photos that a batch makes; see ``upserted``."""
        return upserted(self.touched("photos", new), new, self.top("photos"))


def stamped(after: DataFrame, before: DataFrame, key: str, touched: DataFrame | None = None) -> DataFrame:
    """``after`` with ``created_at`` from ``before``, or now where the key is new there.

    With ``touched`` (keys that were written) also ``updated_at``: now for these, else as before.
    """
    now = F.current_timestamp()
    old = before.select(F.col(key), F.col("created_at").alias("__created"), *([F.col("updated_at").alias("__updated")] if touched is not None else []))
    joined = after.join(old, key, "left").withColumn("created_at", F.coalesce("__created", now))
    if touched is not None:
        joined = joined.join(touched.select(key).distinct().withColumn("__touched", F.lit(True)), key, "left")
        joined = joined.withColumn("updated_at", F.when(F.col("__touched"), now).otherwise(F.coalesce("__updated", now)))
    return joined.drop("__created", "__updated", "__touched")


def altered(nodes: DataFrame, before: DataFrame) -> DataFrame:
    """Nodes that are new, or whose aliases or state differ from before."""
    fields = ("aliases", "alias_of", "active")
    old = before.select("code", F.lit(True).alias("__old"), *(F.col(c).alias(f"__{c}") for c in fields))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in fields]
    return nodes.join(old, "code", "left").where(F.col("__old").isNull() | ~(same[0] & same[1] & same[2])).select(*nodes.columns)


def known(digests: DataFrame, photos: DataFrame) -> DataFrame:
    """Rows whose digest the catalog has."""
    return digests.join(photos.select("digest"), "digest", "left_semi")


def upserted(photos: DataFrame, new: DataFrame, top: int) -> DataFrame:
    """What a batch changes. new: the columns of photos but ``id``, one row per digest.

    A digest that is there keeps id, original_path and created_at; all else is overwritten, with null too. New digests
    get the ids after ``top`` in order of original_path.
    """
    old = photos.select("digest", *(F.col(c).alias(f"__{c}") for c in KEEPS), F.lit(True).alias("__old"))
    joined = new.join(old, "digest", "left")
    kept = {c: F.when(F.col("__old"), F.col(f"__{c}")).otherwise(F.col(c) if c in new.columns else F.lit(None)) for c in KEEPS}
    return _numbered(joined.select(*(kept[c].alias(c) if c in KEEPS else F.col(c) for c in photos.columns)), top)


def _numbered(rows: DataFrame, top: int) -> DataFrame:
    """Gives rows without an id the next ones, in order of original_path: ranks within ranges, then offsets of ranges."""
    rows = stored(rows.withColumn("id", F.col("id").cast("long")))  # read three times
    fresh = rows.where("id IS NULL").repartitionByRange("original_path").sortWithinPartitions("original_path", "digest")
    placed = fresh.withColumn("__part", F.spark_partition_id()).withColumn("__n", F.monotonically_increasing_id() - F.shiftleft(F.col("__part").cast("long"), 33))
    placed = stored(placed)  # the parts must not change between the two uses
    sizes = stored(placed.groupBy("__part").agg(F.count("*").alias("n")))  # one row a task
    first = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = sizes.select("__part", (F.coalesce(first, F.lit(0)) + F.lit(top + 1)).alias("__first"))
    numbered = placed.join(shifts, "__part").withColumn("id", F.col("__first") + F.col("__n"))
    return rows.where("id IS NOT NULL").unionByName(numbered.select(*rows.columns))


def duplicate_events(photos: DataFrame, duplicates: DataFrame, at: str) -> DataFrame:
    """Rows of the history: an event per duplicate (digest, source_path) of a known photo; unknown digests make none."""
    none = F.lit(None).cast("string")
    seen = duplicates.join(photos.select("digest"), "digest", "left_semi")
    return seen.select("digest", F.lit("duplicate_detected").alias("event"), none.alias("source"), none.alias("destination"), F.col("source_path").alias("duplicate_path"), F.lit(at).cast("timestamp").alias("at"))


def listing(photos: DataFrame, limit: int) -> DataFrame:
    """The first rows by id, as lines."""
    top = photos.orderBy("id").limit(limit)
    return top.select("id", X.list_line(F.col("digest"), F.col("pcs_primary"), F.col("organized_path")).alias("line"))
