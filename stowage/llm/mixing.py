"""Mixing sources to target weights with a low-discrepancy schedule.

Every source is one shuffled stream of words, cut into blocks of ``block`` words. Slot ``i`` of the mix takes the
point ``i * golden ratio mod 1``, maps it through the cumulative target weights to a source, and its rank among the
slots of that source names the block (and the pass over the source) that it takes. A source stops at its target, so
its last block may be taken in part; the few blocks by which the points fall short of a target follow as last slots.

Scale: positions in the streams, ranks of slots, ranks of sources and cumulative weights are all running sums over a
global order: the rows are dealt out by ranges of the order, summed inside each range, and each range is shifted by the
total of those before it (one number a range). No task holds a source, and sources are rows of a table, however many.
Points meet their source in an equi-join on a cell of the unit interval; blocks and slots in one on (source, block).

Defined results: a null text has size 0; a null source is a source of its own, the last; a document of size 0 takes 0;
a text of any length is counted whole and may lie in many blocks; documents whose shuffle keys tie follow by id, then
size, and equal ones in either order; repeated rows are separate documents; an empty table gives an empty result. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import WORD, mapped, stored

WEIGHTS = (5, 2, 1)
#: Golden-ratio points as integers: i * STEP mod 2**31, STEP being odd and the nearest to 2**31 / 1.618...
BITS = 31
STEP = 1327217885
#: Points meet sources in cells of this many bits.
CELL_BITS = 15
#: Targets are summed up as whole multiples of 1 / FINE words, so that the order of addition does not matter.
FINE = 1 << 16


def running(rows: DataFrame, order: list, value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` (a long) over all rows before this one in the order. The result is stored."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    at = len(rows.columns)

    def run(source):
        total = 0
        for batch in source:
            n = np.asarray(batch.column(batch.schema.get_field_index(value))).astype(np.int64)
            after = total + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(after - n), pa.array(after)], names=[*batch.schema.names, "__before", "__after"])
            total = int(after[-1]) if len(n) else total

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema)
    summed = stored(mapped(ranged, run, f"{columns}, __before long, __after long"))
    sums = sorted((r[0], r[1]) for r in summed.groupBy("__part").agg(F.max("__after")).collect())  # one row a range
    starts = np.concatenate([[0], np.cumsum([n for _, n in sums])])[:-1].tolist()
    shifts = rows.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(sums, starts, strict=True)], "__part int, __shift long")
    return summed.join(F.broadcast(shifts), "__part").select(*rows.columns[:at], (F.col("__before") + F.col("__shift")).alias(out))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """Adds ``target``. sources: n (size) and weight; ``share`` of all sizes is split by weight.

    What exceeds ``cap`` times a size is split again among the others, until none is above or all are at their cap.
    """
    rows = stored(sources.withColumn("full", F.lit(False)))
    rate = 0.0
    while True:
        r = rows.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("full"), F.col("n")).otherwise(0)).alias("held"), F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).alias("weight")).first()
        if not r["weight"]:
            break
        rate = (share * r["all"] - cap * r["held"]) / r["weight"]
        above = ~F.col("full") & (F.lit(rate) * F.col("weight") > F.lit(cap) * F.col("n"))
        if rows.where(above).isEmpty():
            break
        rows = stored(rows.withColumn("full", F.col("full") | above))
    return rows.withColumn("target", F.when(F.col("full"), F.lit(float(cap)) * F.col("n")).otherwise(F.lit(rate) * F.col("weight"))).drop("full")


def weighed(sized: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: sid (by code point, null last), source, n, base (words of the sources before it), weight, target."""
    sources = stored(sized.groupBy("source").agg(F.sum("size").alias("n"), F.lit(1).cast("long").alias("one")))
    order = [F.col("source").isNull(), F.col("source")]
    numbered = running(running(sources, order, "one", "sid"), order, "n", "base")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    return stored(water_fill(numbered.select("sid", "source", "n", "base", weight.alias("weight")), share, cap))


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """The slots: slot, sid, epoch, block, limit (how many words of the block the slot may take)."""
    spark = sources.sparkSession
    total, many = sources.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.count("*")).first()
    fine = running(sources.select("sid", F.floor(F.col("target") * FINE).alias("f")), ["sid"], "f", "before")
    end = fine.agg(F.coalesce(F.max(F.col("before") + F.col("f")), F.lit(0))).first()[0]
    scaled = lambda c: F.floor(c.cast("double") / F.lit(float(max(end, 1))) * F.lit(float(1 << BITS))).cast("long")
    edges = fine.select("sid", scaled(F.col("before")).alias("lo"), F.when(F.col("before") + F.col("f") >= end, F.lit(1 << BITS)).otherwise(scaled(F.col("before") + F.col("f"))).alias("hi")).where("hi > lo")
    shift = BITS - CELL_BITS
    cells = edges.select("*", F.explode(F.sequence(F.shiftright("lo", shift), F.shiftright(F.col("hi") - 1, shift))).alias("cell"))
    point = F.pmod(F.pmod(F.col("slot"), F.lit(1 << BITS)) * F.lit(STEP), F.lit(1 << BITS))
    slots = spark.range(ceil(total / block)).select(F.col("id").alias("slot"), point.alias("point")).withColumn("cell", F.shiftright("point", shift))
    aimed = slots.join(cells, "cell").where("point >= lo AND point < hi").select("slot", "sid", F.lit(1).cast("long").alias("one"))
    placed = running(aimed, ["sid", "slot"], "one", "place")
    words, size = F.round("target").cast("long"), F.col("n")
    full, rest = F.when(size > 0, F.expr("words div n")).otherwise(0), F.when(size > 0, F.col("words") % size).otherwise(0)
    blocks = lambda x: F.ceil(x / F.lit(block)).cast("long")
    plan = sources.withColumn("words", words).select("sid", blocks(size).alias("blocks"), full.alias("full"), rest.alias("rest")).withColumn("need", F.col("full") * F.col("blocks") + blocks(F.col("rest")))
    counts = placed.groupBy("sid").agg(F.min("place").alias("first"), F.count("*").alias("had"))
    plan = stored(plan.join(counts, "sid", "left").fillna(0, ["first", "had"]))
    ranked = placed.join(plan, "sid").withColumn("rank", F.col("place") - F.col("first")).where("rank < need")
    tail = plan.where("had < need").withColumn("rank", F.explode(F.expr("sequence(had, need - 1)"))).withColumn("slot", F.lit(ceil(total / block)) + F.col("rank") * many + F.col("sid"))
    columns = ["slot", "sid", "rank", "blocks", "full", "rest"]
    every = ranked.select(*columns).unionByName(tail.select(*columns))
    return every.select(
        "slot", "sid", F.expr("rank div blocks").alias("epoch"), (F.col("rank") % F.col("blocks")).alias("block"),
        F.expr(f"CASE WHEN rank div blocks < full THEN {block} ELSE least({block}, rest - (rank % blocks) * {block}) END").alias("limit"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, block: int = 128, seed: int = 42) -> DataFrame:
    """The mix as pieces: slot, epoch, source, doc_id, size, source_size, target, from_word, words; and ``at``, the document's number.

    A document that the mix does not take has one piece with null slot and 0 words.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    sized = stored(sized.withColumn("key", F.xxhash64(F.lit(seed), F.col("doc_id"))))
    sources = weighed(sized, weights, share, cap)
    order = [F.col("source").isNull(), "source", "key", "doc_id", "size"]
    begun = running(sized, order, "size", "begin").withColumn("at", F.monotonically_increasing_id())
    here = F.col("s.source").eqNullSafe(F.col("d.source"))
    placed = begun.alias("d").join(sources.alias("s"), here).select("at", "s.sid", "d.source", "doc_id", "size", F.col("n").alias("source_size"), "target", (F.col("begin") - F.col("base")).alias("start"))
    pieces = placed.withColumn("block", F.explode_outer(F.expr(f"CASE WHEN size > 0 THEN sequence(start div {block}, (start + size - 1) div {block}) END")))
    joined = pieces.join(schedule(sources, block), ["sid", "block"], "left")
    begin = F.greatest(F.col("start"), F.col("block") * block)
    end = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("limit"))
    words = F.when(F.col("slot").isNull(), 0).otherwise(F.greatest(F.lit(0), F.coalesce(end - begin, F.lit(0)))).cast("long")
    return joined.select("at", "slot", "epoch", "source", "doc_id", "size", "source_size", "target", (begin - F.col("start")).alias("from_word"), words.alias("words"))


def mix_manifest(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source, first_slot."""
    taken = F.when(F.col("words") > 0, F.col("slot"))
    whole = ["doc_id", "size", "source_size", "target"]
    per = mix(docs, **options).groupBy("at").agg(*(F.first(c).alias(c) for c in [*whole, "source"]), F.sum("words").alias("taken"), F.min(taken).alias("first_slot"))
    return per.select(*whole, "taken", "source", "first_slot")
