"""The append-only hierarchy of codes: reads, closures, minting, merging.

No side is broadcast by hint, as the hierarchy grows with its labels; by size Spark does so itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stowage.functions import constants as C
from stowage.functions import expressions as X
from stowage.operators import chains

SCHEMA = "code string, parent_code string, label string, folder_name string, aliases array<string>, alias_of string, active boolean"


def seed_taxonomy(spark: SparkSession, existing: DataFrame | None = None) -> DataFrame:
    """The spine, unless the table has rows already."""
    if existing is not None and not existing.isEmpty():
        return existing
    rows = spark.createDataFrame([(c, p, label) for c, p, label in C.seed_nodes()], "code string, parent_code string, label string")
    return node_rows(rows)


def node_rows(rows: DataFrame) -> DataFrame:
    """Active nodes from code, parent_code and label."""
    return rows.select("code", "parent_code", "label", F.concat_ws("-", "code", X.slug(F.col("label"))).alias("folder_name"), F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("alias_of"), F.lit(True).alias("active"))


def children(taxonomy: DataFrame, parent: str | None) -> DataFrame:
    """All nodes below a parent (null: the top level), inactive ones too, by code."""
    return taxonomy.where(F.col("parent_code").eqNullSafe(F.lit(parent))).orderBy("code")


def get(taxonomy: DataFrame, code: str) -> DataFrame:
    """The node of a code: one row or none."""
    return taxonomy.where(F.col("code") == code)


def active(taxonomy: DataFrame) -> DataFrame:
    return taxonomy.where("active").orderBy("code")


def alias_closure(taxonomy: DataFrame) -> DataFrame:
    """code, target: where ``alias_of`` leads to, over any number of links; a cycle ends at the code that repeats."""
    return chains.ends(taxonomy.select("code", F.col("alias_of").alias("to"))).withColumnRenamed("end", "target")


def folder_paths(taxonomy: DataFrame) -> DataFrame:
    """code, folder_path from the top, however deep; a parent that is missing or repeats ends the path."""
    above = chains.trails(taxonomy.select("code", F.col("parent_code").alias("up"), "folder_name"), F.col("folder_name"))
    return above.select("code", F.array_join(F.reverse("values"), "/").alias("folder_path"))


def snapshot_lines(taxonomy: DataFrame) -> DataFrame:
    """sort_path, depth, line: the tree of active nodes, in order of sort_path. Below inactive nodes nothing shows."""
    nodes = taxonomy.where("active")
    above = chains.trails(nodes.select("code", F.col("parent_code").alias("up")), F.struct("code", "up"))
    whole = above.where(F.element_at("values", -1)["up"].isNull())  # neither a missing parent nor a cycle at its end
    depth = F.size("values") - 1
    shown = whole.select("code", F.array_join(F.transform(F.reverse("values"), lambda v: v["code"]), "/").alias("sort_path"), depth.alias("depth"))
    return shown.join(nodes.select("code", "label"), "code").select("sort_path", "depth", F.concat(F.repeat(F.lit("  "), F.col("depth")), "code", F.lit(" "), "label").alias("line"))


def snapshot_text(taxonomy: DataFrame) -> str:
    return "\n".join(r["line"] for r in snapshot_lines(taxonomy).orderBy("sort_path").collect())


def names(taxonomy: DataFrame) -> DataFrame:
    """code, parent_code, norm: the normalized label and aliases of every node."""
    every = F.explode(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>"))))
    return taxonomy.select("code", "parent_code", every.alias("name")).select("code", "parent_code", X.normalize_label(F.col("name")).alias("norm"))


def targets(items: DataFrame, taxonomy: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """Adds ``target`` (the class, or the fallback if it is no code, through aliases) and ``norm``."""
    closure = (closure or alias_closure(taxonomy)).toDF("__code", "target")
    valid = taxonomy.select(F.col("code").alias("__valid"))
    known = items.join(valid, F.col("class") == F.col("__valid"), "left").withColumn("__class", F.coalesce("__valid", F.lit(C.FALLBACK_CLASS))).drop("__valid")
    return known.join(closure, F.col("__class") == F.col("__code"), "left").withColumn("target", F.coalesce("target", "__class")).drop("__class", "__code").withColumn("norm", X.normalize_label(F.col("label")))


def free_slots(taxonomy: DataFrame, parents: DataFrame) -> DataFrame:
    """target, code, k: the k-th free integer code below every parent (column target)."""
    slots = parents.select("target", F.posexplode(X.child_slots(F.col("target"))).alias("i", "code"))
    taken = taxonomy.select("code")
    free = slots.join(taken, "code", "left_anti")
    return free.select("target", "code", F.row_number().over(Window.partitionBy("target").orderBy("i")).alias("k"))


def overflow_counts(taxonomy: DataFrame) -> DataFrame:
    """target, top: the highest N among its children named ``target~N``."""
    tail = F.substring(F.col("code"), F.length("parent_code") + 2, F.length("code"))
    numbered = taxonomy.where(F.col("code").startswith(F.concat("parent_code", F.lit("~"))) & tail.rlike(r"\A[0-9]+\z"))
    return numbered.groupBy(F.col("parent_code").alias("target")).agg(F.max(tail.cast("long")).alias("top"))


def resolve_or_create(items: DataFrame, taxonomy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items with ``code``, nodes to insert). items: pos, class, label.

    A label that says nothing, or names its class, stays at the class. One that a child (or a child's alias) bears
    resolves to it. Of the others the k-th new label of a class, in order of ``pos``, takes the k-th free code, and
    beyond the ninth ``class~N``. Everything is joins and windows over distinct labels; rows of one label never meet.
    """
    closure = alias_closure(taxonomy)
    aimed = targets(items, taxonomy, closure)
    known = names(taxonomy)
    own = known.select(F.col("code").alias("__t"), F.col("norm").alias("__n")).distinct()
    kids = known.where("parent_code IS NOT NULL").groupBy(F.col("parent_code").alias("__p"), F.col("norm").alias("__m")).agg(F.min("code").alias("__kid"))
    closure = closure.toDF("__from", "__to")
    placed = aimed.join(own, (F.col("target") == F.col("__t")) & (F.col("norm") == F.col("__n")), "left")
    placed = placed.withColumn("__stay", X.is_degenerate(F.col("label")) | F.col("__t").isNotNull()).drop("__t", "__n")
    placed = placed.join(kids, (F.col("target") == F.col("__p")) & (F.col("norm") == F.col("__m")), "left").drop("__p", "__m")
    placed = placed.join(closure, F.col("__kid") == F.col("__from"), "left").drop("__from")
    fresh = placed.where("NOT __stay AND __kid IS NULL").groupBy("target", "norm").agg(F.min(F.struct("pos", "label")).alias("__first"))
    ranked = fresh.withColumn("k", F.row_number().over(Window.partitionBy("target").orderBy("__first.pos")))
    parents = taxonomy.select(F.col("code").alias("target"))
    slots = free_slots(taxonomy, parents)
    count = slots.groupBy("target").agg(F.max("k").alias("nfree"))
    minted = ranked.join(slots, ["target", "k"], "left").join(count, "target", "left").join(overflow_counts(taxonomy), "target", "left")
    number = F.coalesce("top", F.lit(0)) + F.col("k") - F.coalesce("nfree", F.lit(0))
    minted = minted.select("target", "norm", F.col("__first.label").alias("label"), F.coalesce("code", F.concat("target", F.lit("~"), number.cast("string"))).alias("minted"))
    coded = placed.join(minted.select("target", "norm", "minted"), ["target", "norm"], "left")
    coded = coded.withColumn("code", F.when(F.col("__stay"), F.col("target")).otherwise(F.coalesce("__to", "minted"))).drop("__stay", "__kid", "__to", "minted")
    return coded, node_rows(minted.select(F.col("minted").alias("code"), F.col("target").alias("parent_code"), "label"))


def insert(taxonomy: DataFrame, nodes: DataFrame) -> DataFrame:
    """Conflicting codes change nothing."""
    return taxonomy.unionByName(nodes.join(taxonomy.select("code"), "code", "left_anti").dropDuplicates(["code"]).select(*taxonomy.columns))


def merge_codes(taxonomy: DataFrame, source: str, target: str) -> DataFrame:
    """Fold a node into another: its label becomes an alias there, and it points there, inactive. No-op if either is missing."""
    both = taxonomy.where(F.col("code").isin(source, target)).select("code", "label").collect()  # two rows at most
    labels = {r["code"]: r["label"] for r in both}
    if source not in labels or target not in labels:
        return taxonomy
    here, gone = F.col("code") == target, F.col("code") == source
    return taxonomy.withColumn("aliases", F.when(here, F.array_append("aliases", F.lit(labels[source]))).otherwise(F.col("aliases"))).withColumn("alias_of", F.when(gone, F.lit(target)).otherwise(F.col("alias_of"))).withColumn("active", ~gone & F.col("active"))


def set_alias(taxonomy: DataFrame, code: str, target: str | None) -> DataFrame:
    """Let a node point to another (null: to none)."""
    return taxonomy.withColumn("alias_of", F.when(F.col("code") == code, F.lit(target).cast("string")).otherwise(F.col("alias_of")))


def set_aliases(taxonomy: DataFrame, code: str, aliases: list[str]) -> DataFrame:
    new = F.array(*(F.lit(a) for a in aliases)).cast("array<string>")
    return taxonomy.withColumn("aliases", F.when(F.col("code") == code, new).otherwise(F.col("aliases")))
