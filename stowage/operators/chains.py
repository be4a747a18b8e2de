"""Chains of pointers of any length, followed by doubling: who is reached, and what is passed on the way.

A table of pointers (code -> next) is squared: after k rounds of one equi-join each, a row knows where 2 ** k steps lead
and what these steps pass. A chain of n links takes log2(n) rounds, while a recursive query takes n and stops at its
limit. Rows that have come to an end take no further part. What never ends has fallen into a cycle: pointers that are
still moving after as many steps as there are rows stand on cycles, and the codes they stand on are those cycles.

Scale: each round is a shuffle join of the rows still moving with all pointers; rounds are stored tables, so lineage
does not grow and a lost executor repeats one round. No chain is walked in one task.

Defined results: a code whose pointer is null, or leads to a code without a pointer of its own, ends there; repeated
codes count once (the smallest pointer); null codes are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.session import forget, stored


def _edges(links: DataFrame) -> DataFrame:
    """code, to: one pointer per code that has one."""
    return stored(links.where("code IS NOT NULL AND to IS NOT NULL").groupBy("code").agg(F.min("to").alias("to")))


def _squared(moving: DataFrame, every: DataFrame) -> DataFrame:
    """code, to, done after twice the steps. Both: code, to, done."""
    ahead = every.select(F.col("code").alias("__at"), F.col("to").alias("__to"), F.col("done").alias("__done"))
    out = moving.join(ahead, moving["to"] == ahead["__at"], "left")
    return out.select("code", F.coalesce("__to", "to").alias("to"), F.coalesce("__done", F.lit(True)).alias("done"))


def _rounds(edges: DataFrame) -> tuple[DataFrame, DataFrame | None, list[DataFrame]]:
    """(code, to of what has an end; code, to of what has none, where ``to`` stands on a cycle; the tables of every round)."""
    n = edges.count()
    now, steps, levels = stored(edges.withColumn("done", F.lit(False))), 1, []
    while True:
        levels.append(now)
        moving = now.where("NOT done")
        if steps > n or moving.isEmpty():
            break
        now, steps = stored(now.where("done").unionByName(_squared(moving, now))), 2 * steps
    left = now.where("NOT done").select("code", "to")
    return now.where("done").select("code", "to"), None if steps <= n or left.isEmpty() else left, levels


def ends(links: DataFrame) -> DataFrame:
    """code, end: where the pointers of every code lead to in the end.

    links: code, to. A walk that would repeat ends at the code that repeats: on a cycle that is the code itself, and
    before it the first of its codes that is reached.
    """
    codes = links.where("code IS NOT NULL").select("code").distinct()
    edges = _edges(links)
    ended, lost, levels = _rounds(edges)
    found = ended.select("code", F.col("to").alias("end"))
    if lost is not None:
        cycle = stored(lost.select(F.col("to").alias("code")).distinct())
        before = stored(lost.select("code").join(cycle, "code", "left_anti").select("code", F.col("code").alias("at")))
        ring = cycle.select(F.col("code").alias("__ring"))
        for level in reversed(levels):  # the most steps that stay before the cycle, largest powers first
            jump = level.where("NOT done").select(F.col("code").alias("__at"), F.col("to").alias("__to")).join(ring, F.col("__to") == F.col("__ring"), "left_anti")
            then = stored(before.join(jump, before["at"] == jump["__at"], "left").select("code", F.coalesce("__to", "at").alias("at")))
            forget(before)
            before = then
        entry = before.join(edges.select(F.col("code").alias("at"), F.col("to").alias("end")), "at").select("code", "end")
        found = found.unionByName(cycle.select("code", F.col("code").alias("end"))).unionByName(entry)
    out = stored(codes.join(found, "code", "left").select("code", F.coalesce("end", "code").alias("end")))
    for level in levels:
        forget(level)
    forget(edges)
    return out


def _composed(rows: DataFrame) -> DataFrame:
    """code, values, up after all steps. rows: code, values (its own alone), up (null: the chain ends here; no cycles)."""
    now = stored(rows)
    while not now.where("up IS NOT NULL").isEmpty():
        ahead = now.select(F.col("code").alias("__at"), F.col("values").alias("__values"), F.col("up").alias("__up"), F.lit(True).alias("__there"))
        joined = now.where("up IS NOT NULL").join(ahead, F.col("up") == F.col("__at"), "left")
        longer = F.when(F.col("__there"), F.concat("values", "__values")).otherwise(F.col("values"))
        then = stored(now.where("up IS NULL").unionByName(joined.select("code", longer.alias("values"), F.col("__up").alias("up"))))
        forget(now)
        now = then
    return now.select("code", "values")


def trails(nodes: DataFrame, value: Column) -> DataFrame:
    """code, values: what ``value`` is at a code and all above it, its own first, as an array.

    nodes: code, up, and what ``value`` needs. A parent that is missing ends a trail, and so does one that is on it.
    """
    rows = stored(nodes.where("code IS NOT NULL").groupBy("code").agg(F.min(F.struct("up", F.struct(value.alias("v")).alias("own"))).alias("row")).select("code", "row.up", F.array("row.own.v").alias("values")))
    known = rows.select(F.col("code").alias("up"))
    rows = stored(rows.join(known, "up", "left_semi").select("code", "values", "up").unionByName(rows.join(known, "up", "left_anti").select("code", "values", F.lit(None).cast(rows.schema["up"].dataType).alias("up"))))
    _, lost, levels = _rounds(_edges(rows.select("code", F.col("up").alias("to"))))
    if lost is None:
        return _composed(rows)
    # cycles: each is cut below its least code, so that a trail on it is what is left of the round, and then its beginning
    ring = stored(lost.select(F.col("to").alias("code")).distinct())
    least = stored(rows.join(ring, "code", "left_semi").select("code", F.col("code").alias("least"), F.col("up").alias("to")))
    for _ in levels:
        ahead = least.select(F.col("code").alias("__at"), F.col("least").alias("__least"), F.col("to").alias("__to"))
        least = stored(least.join(ahead, least["to"] == ahead["__at"]).select("code", F.least("least", "__least").alias("least"), F.col("__to").alias("to")))
    on = rows.join(least.select("code", "least"), "code")
    cut = stored(_composed(on.select("code", "values", F.when(F.col("up") != F.col("least"), F.col("up")).alias("up"))).join(least.select("code", "least"), "code"))
    whole = cut.select(F.col("code").alias("least"), F.col("values").alias("all"))
    rounds = cut.join(whole.join(cut.select("least").distinct(), "least", "left_semi"), "least")
    full = stored(rounds.select("code", F.concat("values", F.expr("slice(all, 1, size(all) - size(values))")).alias("values")))
    off = rows.join(ring, "code", "left_anti")
    free = _composed(full.select("code", "values", F.lit(None).cast(rows.schema["up"].dataType).alias("up")).unionByName(off.select("code", "values", "up")))
    return free
