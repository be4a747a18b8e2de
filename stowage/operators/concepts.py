"""Deciding the class of described content: learned subjects, curated seeds, tokens, then one question per subject."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.functions import constants as C
from stowage.functions import expressions as X


def _normalized(name: str) -> str:
    """As ``normalize_label``, for the fixed list."""
    cut = lambda w: w[:-2] if len(w) > 4 and w.endswith("es") else w[:-1] if len(w) > 3 and w.endswith("s") else w
    return " ".join(map(cut, re.findall("[a-z0-9]+", name.lower())))


def seed_classes() -> dict[str, str]:
    """Normalized subject -> class: names of sub-categories, then curated synonyms that add to them."""
    names = [(label, str(parent)) for _, parent, label in C.seed_nodes() if parent]
    names += [(word, code) for code, words in C.SYNONYMS.items() for word in words]
    return {_normalized(name): code for name, code in reversed(names)}


def seed_concepts(spark: SparkSession) -> DataFrame:
    """subject (normalized), class: the fixed list as a table."""
    return spark.createDataFrame(sorted(seed_classes().items()), "subject string, class string")


def learned_get(learned: DataFrame, subject: str) -> DataFrame:
    """The learned class of a subject, in whatever spelling: one row or none."""
    return learned.where(F.col("subject") == X.normalize_label(F.lit(subject)))


def class_for(content: DataFrame, learned: DataFrame | None = None) -> DataFrame:
    """Adds ``class`` (null: a miss). content: primary_subject, objects, scene, and a unique column ``pos``.

    Order: a learned subject with a valid class; the seed by subject; the first object, then scene word, in the seed.
    """
    seed = F.broadcast(seed_concepts(content.sparkSession))
    base = content.withColumn("__subject", X.normalize_label(F.col("primary_subject")))
    if learned is not None:
        valid = learned.where(X.is_class(F.col("class_code"))).select(F.col("subject").alias("__s"), F.col("class_code").alias("__learned"))
        base = base.join(valid, F.col("__subject") == F.col("__s"), "left").drop("__s")
    else:
        base = base.withColumn("__learned", F.lit(None).cast("string"))
    base = base.join(seed.select(F.col("subject").alias("__s"), F.col("class").alias("__static")), F.col("__subject") == F.col("__s"), "left").drop("__s")
    # the seed is a fixed list, so tokens are looked up in a map of it; no token is exploded
    lookup = F.create_map(*(F.lit(x) for pair in sorted(seed_classes().items()) for x in pair))
    tokens = F.concat(F.coalesce("objects", F.array().cast("array<string>")), F.filter(F.split(F.coalesce("scene", F.lit("")), r"\s+"), lambda w: w != ""))
    hits = F.filter(F.transform(tokens, lambda t: F.try_element_at(lookup, X.normalize_label(t))), lambda c: c.isNotNull())
    return base.withColumn("class", F.coalesce("__learned", "__static", F.get(hits, F.lit(0)))).drop("__learned", "__static").withColumnRenamed("__subject", "subject_norm")


def first_misses(classified: DataFrame) -> DataFrame:
    """The rows to ask about: of every subject without a class, the first by ``pos``."""
    first = classified.where("class IS NULL").groupBy("subject_norm").agg(F.min("pos").alias("pos"))
    return classified.join(first, ["subject_norm", "pos"], "left_semi")


def decide_class(classified: DataFrame, answers: DataFrame) -> DataFrame:
    """Fills in classes. answers: subject_norm, answer, and ``pos`` of the row that asked.

    A valid answer is learned, and learned subjects win: from the row that asked on, all rows of the subject take it.
    An invalid answer is not learned; those rows, and rows without an answer, get the fallback class.
    """
    named = answers.select(F.col("subject_norm").alias("__s"), F.col("answer").alias("__a"), F.col("pos").alias("__p"))
    joined = classified.join(named, F.col("subject_norm") == F.col("__s"), "left")
    learned = X.is_class(F.col("__a")) & (F.col("pos") >= F.col("__p"))
    out = joined.withColumn("class", F.when(learned, F.col("__a")).otherwise(F.coalesce("class", F.lit(C.FALLBACK_CLASS))))
    return out.drop("__s", "__a", "__p")


def remember(learned: DataFrame, decided: DataFrame) -> DataFrame:
    """The learned table after new decisions (subject, class_code): invalid classes are refused, hits add up, the last class wins.

    decided has ``pos`` to order decisions on one subject.
    """
    new = decided.where(X.is_class(F.col("class_code"))).groupBy("subject").agg(F.max_by("class_code", "pos").alias("__c"), F.count("*").alias("__n"))
    merged = learned.join(new, "subject", "full")
    return merged.select("subject", F.coalesce("__c", "class_code").alias("class_code"), (F.coalesce("hits", F.lit(0)) + F.coalesce("__n", F.lit(0))).alias("hits"))
