"""The organizing plan: digests, duplicates, description, class, code, name, copy, catalog."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from stowage.functions import expressions as X
from stowage.operators import catalog as K
from stowage.operators import concepts, dedup
from stowage.operators import taxonomy as T
from stowage.plans.adjudicate import resolve_with
from stowage.plans.classifiers import UNTRIED, Classifier, StubClassifier
from stowage.session import stored
from stowage.sources import exif, files, sinks

RESULT = ["source_path", "digest", "status", "organized_path", "error"]


def verdict(name: Column, actual: Column) -> Column:
    """OK, FAIL, or SKIP for names that are no pictures or not in the form."""
    digest = X.extract_digest(X.path_stem(name))
    return F.when(~X.is_supported(name) | digest.isNull(), "SKIP").when(digest == actual, "OK").otherwise("FAIL")


def verify_tree(spark, path: str) -> DataFrame:
    """source_path, verdict of every file; only names in the form are read."""
    p = F.col("source_path")
    every = files.scan(spark, path, supported_only=False).select(p, (X.is_supported(p) & X.extract_digest(X.path_stem(p)).isNotNull()).alias("named"))
    return files.with_digests(every, "named").select(p, verdict(p, F.col("digest")).alias("verdict"))


@dataclass
class Organizer:
    """Organizes batches of files into ``organized_dir``; the catalog is committed once a batch.

    A node minted and a subject learned are kept only if a file of the batch that led to them was copied.
    """

    catalog: K.Catalog
    organized_dir: str
    classifier: Classifier | None = None
    duplicates_dir: str | None = None
    sidecars: bool = False
    dry_run: bool = False

    def run(self, batch: DataFrame, give_up: int = 0) -> DataFrame:
        """source_path, digest, status, organized_path, error for a batch of source_path, size, mtime_ns.

        With ``give_up``, files that are left when the backend has failed so often in a row have the status ``untried``.
        """
        if not self.dry_run:
            sinks.sweep(self.organized_dir)
        hashed = stored(files.with_digests(batch))
        unread = hashed.where("error IS NOT NULL").select("source_path", "digest", F.lit("error").alias("status"), F.lit(None).cast("string").alias("organized_path"), "error")
        good = hashed.where("error IS NULL").drop("error")
        photos = self.catalog.touched("photos", good)
        if self.dry_run:
            marked = dedup.mark_duplicates(good, photos)
            return marked.select("source_path", "digest", "status", F.lit(None).cast("string").alias("organized_path"), F.lit(None).cast("string").alias("error")).unionByName(unread)
        known = good.join(photos.select("digest"), "digest", "left_semi")
        pending, done, repeats = good.join(photos.select("digest"), "digest", "left_anti"), unread, known.select("source_path", "digest")
        # a file that fails leaves its bytes to the next path: a round asks about one path of each digest, the next round
        # about two of those that are left, then four, so that many copies that all fail take few rounds
        paths = 1
        while True:
            if paths == 1:
                first = pending.groupBy("digest").agg(F.min("source_path").alias("source_path"))
                tried = pending.join(first, ["digest", "source_path"], "left_semi")
            else:
                rank = F.row_number().over(Window.partitionBy("digest").orderBy("source_path"))
                tried = pending.withColumn("__rank", rank).where(F.col("__rank") <= paths).drop("__rank")
            if tried.isEmpty():
                break
            result = self._attempt(tried, give_up)
            done = done.unionByName(result.select(*RESULT))
            copied = result.where("status = 'copied'").select("digest")
            rest = pending.join(result.select("source_path"), "source_path", "left_anti")
            repeats = repeats.unionByName(rest.join(copied, "digest", "left_semi").select("source_path", "digest"))
            pending, paths = stored(rest.join(copied, "digest", "left_anti")), 2 * paths
            if give_up and not result.where("status = 'untried'").isEmpty():
                done = done.unionByName(pending.select("source_path", "digest", F.lit("untried").alias("status"), F.lit(None).cast("string").alias("organized_path"), F.lit(UNTRIED).alias("error")))
                break
        repeats = stored(repeats)
        self._repeat(repeats)
        return done.unionByName(repeats.select("source_path", "digest", F.lit("duplicate").alias("status"), F.lit(None).cast("string").alias("organized_path"), F.lit(None).cast("string").alias("error")))

    def process_file(self, path: str) -> Row | None:
        """The result of one file, as ``run`` gives it; None for one that is no picture. A missing path fails."""
        return self.run(files.scan(self.catalog.spark, path)).first()

    def _repeat(self, repeats: DataFrame) -> None:
        if repeats.isEmpty():
            return
        now = str(repeats.sparkSession.sql("SELECT current_timestamp()").first()[0])
        self.catalog.commit(history=K.duplicate_events(self.catalog.touched("photos", repeats), repeats, now))
        if self.duplicates_dir:
            sinks.copy_aside(repeats.withColumn("target", X.duplicate_path(self.duplicates_dir, F.col("digest"), F.col("source_path")))).count()

    def _attempt(self, tried: DataFrame, give_up: int = 0) -> DataFrame:
        """The result of every path that failed, and of the first of each digest that could be described."""
        backend, nodes, learned = self.classifier or StubClassifier(), T.seed_taxonomy(tried.sparkSession, self.catalog.read("taxonomy").drop("created_at")), self.catalog.read("learned_concepts")
        described = stored(backend.describe_files(exif.with_exif(tried), give_up).withColumn("pos", F.col("source_path")))
        failed = described.where("failure IS NOT NULL")
        good = described.where("failure IS NULL")
        first = good.groupBy("digest").agg(F.min("source_path").alias("source_path"))
        classed = stored(concepts.class_for(good.join(first, ["digest", "source_path"], "left_semi"), learned))
        answers = stored(backend.answer(concepts.first_misses(classed)))
        decided = concepts.decide_class(classed, answers).withColumn("label", F.col("primary_subject"))
        if type(backend).adjudicate is Classifier.adjudicate:
            coded, minted = T.resolve_or_create(stored(decided), nodes)
            nodes_then = stored(T.insert(nodes, minted))
        else:
            coded, nodes_then = resolve_with(stored(decided), nodes, backend)
        placed = coded.join(T.folder_paths(nodes_then), "code").join(nodes_then.select("code", F.col("label").alias("node_label")), "code")
        name = X.generate_filename(F.col("code"), F.col("primary_subject"), F.col("digest"), X.extension(F.col("source_path")))
        placed = placed.withColumn("organized_path", F.concat(F.lit(f"{self.organized_dir}/"), "folder_path", F.lit("/"), name))
        side = F.to_json(F.struct("digest", F.col("source_path").alias("original_path"), "organized_path", F.col("code").alias("pcs_code"), X.normalize_descriptor(F.col("primary_subject")).alias("descriptor"), "caption", "scene", "objects", F.col("tags").alias("secondary_tags"), "ocr_text", "model_version", F.parse_json("exif").alias("exif")))
        result = sinks.organize_files(placed.withColumn("sidecar", side), self.organized_dir, self.sidecars)
        self._commit(result.where("status = 'copied'"), nodes_then, answers)
        return result.select(*RESULT).unionByName(failed.select("source_path", F.lit("").alias("digest"), F.when(F.col("failure") == UNTRIED, "untried").otherwise("error").alias("status"), F.lit(None).cast("string").alias("organized_path"), F.col("failure").alias("error")))

    def _commit(self, copied: DataFrame, nodes: DataFrame, answers: DataFrame) -> None:
        now, none = F.current_timestamp(), F.lit(None)
        events = copied.select("digest", F.lit("processed").alias("event"), F.col("source_path").alias("source"), F.col("organized_path").alias("destination"), none.cast("string").alias("duplicate_path"), none.cast("timestamp").alias("at"))
        new = copied.select(
            "digest", F.col("source_path").alias("original_path"), "organized_path", F.lit("1").alias("pcs_version"), F.col("code").alias("pcs_primary"), F.col("node_label").alias("pcs_name"), F.col("tags").alias("secondary_tags"), F.col("caption").alias("ai_caption"),
            "objects", "ocr_text", "exif", "model_version", now.alias("created_at"), now.alias("processed_at"),
        )
        used = copied.select("subject_norm").distinct()
        kept = answers.join(used, "subject_norm", "left_semi").select(F.col("subject_norm").alias("subject"), F.col("answer").alias("class_code"), "pos")
        learned = self.catalog.touched("learned_concepts", kept).join(kept.select("subject"), "subject", "left_semi")
        spine = T.seed_taxonomy(copied.sparkSession).select("code")
        known, subjects = self.catalog.read("taxonomy"), concepts.remember(learned.select("subject", "class_code", "hits"), kept)
        keep = known.select("code").union(spine).union(copied.select("code")).distinct()
        self.catalog.commit(
            photos=self.catalog.upsert(new),
            history=events,
            taxonomy=K.stamped(K.altered(nodes.join(keep, "code", "left_semi"), known), known, "code"),
            learned_concepts=K.stamped(subjects, learned, "subject", kept.where(X.is_class(F.col("class_code")))),
        )
