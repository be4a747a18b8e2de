"""Pointer doubling against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from stowage.operators import chains
from stowage.operators import taxonomy as T


def plain_end(links, code):
    seen, at = set(), code
    while at not in seen and links.get(at) is not None:
        seen.add(at)
        at = links[at]
    return at


def plain_trail(up, code):
    out = [code]
    while up.get(out[-1]) in up and up[out[-1]] not in out:
        out.append(up[out[-1]])
    return out


def ends(spark, links):
    return {r["code"]: r["end"] for r in chains.ends(spark.createDataFrame(list(links.items()), "code string, to string")).collect()}


def trails(spark, up):
    df = spark.createDataFrame(list(up.items()), "code string, up string")
    return {r["code"]: r["values"] for r in chains.trails(df, F.col("code")).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_random_pointers(spark, seed):
    """Trees, tails into cycles, cycles of one and more, missing codes, nulls."""
    rng = random.Random(seed)
    links = {f"n{i}": rng.choice([None, f"n{rng.randrange(60)}", f"n{max(0, i - rng.randint(1, 3))}", f"m{i}"]) for i in range(60)}
    links |= {"a": "b", "b": "c", "c": "a", "t1": "a", "t2": "t1", "t3": "t2", "s": "s", "u": "s"}
    assert ends(spark, links) == {c: plain_end(links, c) for c in links}
    assert trails(spark, links) == {c: plain_trail(links, c) for c in links}


def test_chains_of_ten_thousand_links(spark):
    links = {f"{i:05}": f"{i + 1:05}" for i in range(10000)}
    assert set(ends(spark, links).values()) == {"10000"}
    ring = links | {"09999": "00500"}
    got = ends(spark, ring)
    assert all(got[c] == (c if c >= "00500" else "00500") for c in ring)


def test_paths_a_thousand_deep(spark):
    rows = [(f"{i:04}", f"{i - 1:04}" if i else None, "x", f"f{i}", [], None, True) for i in range(1000)]
    taxonomy = spark.createDataFrame(rows, T.SCHEMA)
    got = {r["code"]: r["folder_path"] for r in T.folder_paths(taxonomy).collect()}
    assert len(got) == 1000 and got["0999"] == "/".join(f"f{i}" for i in range(1000)) and got["0000"] == "f0"
    lines = {r["sort_path"].split("/")[-1]: r["depth"] for r in T.snapshot_lines(taxonomy).collect()}
    assert lines == {f"{i:04}": i for i in range(1000)}


def test_nothing_and_repeated_rows(spark):
    assert ends(spark, {}) == {} and trails(spark, {}) == {}
    df = spark.createDataFrame([("a", "b"), ("a", "b"), (None, "a"), ("b", None)], "code string, to string")
    assert {r["code"]: r["end"] for r in chains.ends(df).collect()} == {"a": "b", "b": "b"}
