"""Resolving labels with a judge, whose every answer may depend on the names minted before it.

Taken in order this is a fold over the new labels of a class. Here it is a guess that is put right: all labels are judged
at once, each against the names that are there and those that the last round would have minted before it. Up to the first
label of a class whose minting differs from the guess, the lists were right, so these answers stand; those behind it are
asked again. No answer can differ from the fold's, for any judge that answers a question the same way twice, and labels
seldom wait for more than a few rounds. A class goes to as many tasks as it has chunks of ``CHUNK`` labels, with the names
a judge is given, which is what its interface asks for; rows of items never go to a judge.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage.operators import taxonomy as T
from stowage.session import forget, stored

CHUNK = 200
_ANSWER = "target string, rank long, old_code string, of long"


def _asked(judge):
    def ask(labels: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
        names = names.sort_values(["rank", "code"], na_position="last")
        ranks, said, codes = names["rank"].to_numpy(), list(names["name"]), list(names["code"])
        out = []
        for row in labels.itertuples():
            listed = said[: int(ranks.searchsorted(row.rank))]
            try:
                answer = judge.adjudicate(row.first_label, listed) if listed else None
            except Exception:  # a judge that fails has not answered
                answer = None
            k = listed.index(answer) if answer and answer in listed else None
            old = k is not None and ranks[k] == 0
            out.append((row.target, row.rank, codes[k] if old else None, None if k is None or old else int(ranks[k])))
        return pd.DataFrame(out, columns=["target", "rank", "old_code", "of"]).astype({"of": "Int64"})

    return ask


def answered(labels: DataFrame, kids: DataFrame, judge, chunk: int = CHUNK) -> DataFrame:
    """target, rank, old_code, of: what each label is taken for: a child that is there, an earlier new label, or neither.

    labels: target, first_label, rank (1, 2, ... in order); kids: target, code, label.
    """
    old = kids.select("target", F.col("label").alias("name"), "code", F.lit(0).cast("long").alias("rank"))
    open_, settled = stored(labels.select("target", "first_label", F.col("rank").cast("long").alias("rank"))), None
    guess = stored(open_.select("target", "rank", F.lit(None).cast("string").alias("old_code"), F.lit(0).cast("long").alias("of")).where("false"))
    while True:
        minted = guess.where("old_code IS NULL AND of IS NULL").join(labels.select("target", "rank", "first_label"), ["target", "rank"])
        known = settled.where("old_code IS NULL AND of IS NULL").join(labels.select("target", "rank", "first_label"), ["target", "rank"]) if settled is not None else minted.where("false")
        names = old.unionByName(minted.unionByName(known).select("target", F.col("first_label").alias("name"), F.lit(None).cast("string").alias("code"), "rank"))
        part = open_.withColumn("chunk", F.expr(f"rank div {chunk}"))
        chunks = part.select(F.col("target").alias("to"), F.col("chunk").alias("part")).distinct()
        sent = names.join(chunks, F.col("target") == F.col("to")).select("to", "part", "name", "code", "rank")
        answers = stored(part.groupBy("target", "chunk").cogroup(sent.groupBy("to", "part")).applyInPandas(_asked(judge), _ANSWER))
        mints = lambda df, name: df.select("target", "rank", (F.col("old_code").isNull() & F.col("of").isNull()).alias(name))
        differ = mints(answers, "now").join(mints(guess, "then"), ["target", "rank"], "left").where("now <> coalesce(then, false)")
        first = stored(differ.groupBy("target").agg(F.min("rank").alias("first")))
        if first.isEmpty():
            return answers if settled is None else settled.unionByName(answers)
        placed = answers.join(first, "target", "left").withColumn("sure", F.col("first").isNull() | (F.col("rank") <= F.col("first")))
        good = placed.where("sure").drop("first", "sure")
        settled = stored(good if settled is None else settled.unionByName(good))
        guess = stored(placed.where("NOT sure").drop("first", "sure"))
        open_ = stored(open_.join(guess.select("target", "rank"), ["target", "rank"], "left_semi"))
        forget(answers)


def resolve_with(items: DataFrame, taxonomy: DataFrame, judge, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(items with ``code``, the taxonomy after). A judge that fails counts as no answer."""
    plain, minted = T.resolve_or_create(items, taxonomy)
    closure = T.alias_closure(taxonomy)
    wanted = T.targets(items, taxonomy, closure)
    first = wanted.groupBy("target", F.col("label").alias("first_label"), "norm").agg(F.min("pos").alias("pos"))
    fresh = minted.select(F.col("parent_code").alias("target"), F.col("label").alias("first_label"), F.col("code").alias("proposed")).join(first, ["target", "first_label"])
    labels = stored(fresh.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy("pos")).cast("long")))
    kids = taxonomy.where("parent_code IS NOT NULL").select(F.col("parent_code").alias("target"), "code", "label")
    answers = answered(labels, kids, judge, chunk)
    # the k-th label that is minted in the end takes the k-th code
    new = answers.where("old_code IS NULL AND of IS NULL").select("target", "rank", F.row_number().over(Window.partitionBy("target").orderBy("rank")).cast("long").alias("k"))
    coded_new = stored(new.join(labels.select("target", F.col("rank").alias("k"), "proposed"), ["target", "k"]).select("target", "rank", F.col("proposed").alias("new_code")))
    said = answers.withColumn("source", F.coalesce("of", "rank")).join(coded_new.withColumnRenamed("rank", "source"), ["target", "source"], "left")
    judged = stored(said.join(labels, ["target", "rank"]).select("target", "norm", "first_label", F.coalesce("old_code", "new_code").alias("code"), (F.col("old_code").isNull() & F.col("of").isNull()).alias("is_new")))
    named = judged.join(closure.withColumnRenamed("target", "canonical"), "code", "left").select("target", "norm", F.coalesce("canonical", "code").alias("judged"))
    aimed = wanted.select("pos", "target", "norm")
    coded = plain.drop("target", "norm").join(aimed, "pos").join(named, ["target", "norm"], "left").withColumn("code", F.coalesce("judged", "code")).drop("judged")
    nodes = T.insert(taxonomy, T.node_rows(judged.where("is_new").select("code", F.col("target").alias("parent_code"), F.col("first_label").alias("label"))))
    more = judged.where("NOT is_new").groupBy("code").agg(F.array_sort(F.collect_list("first_label")).alias("__more"))
    after = nodes.join(more, "code", "left").withColumn("aliases", F.concat("aliases", F.coalesce("__more", F.array().cast("array<string>")))).select(*taxonomy.columns)
    return coded, stored(after)
