"""Rounds of guesses against the fold they stand for."""

import random
import zlib

import pytest

from stowage.operators import taxonomy as T
from stowage.plans import adjudicate


class Judge:
    """Answers by a hash of what it is asked, so that every name that is added may change any answer."""

    def __init__(self, kind, seed):
        self.kind, self.seed = kind, seed

    def adjudicate(self, label, names):
        n = zlib.crc32(f"{self.seed} {label} {names if self.kind == 'any' else ''}".encode())
        if self.kind == "fails" and n % 5 == 0:
            raise RuntimeError("no answer")
        if self.kind == "alike":
            return next((x for x in names if x[:2] == label[:2]), None)
        if self.kind == "never":
            return "no such name"
        return names[n % len(names)] if n % 3 == 0 else None


def fold(labels, kids, judge):
    names, out = sorted(((c, n) for c, n in kids), key=lambda x: x[0]), {}
    names = [(n, ("old", c)) for c, n in names]
    for rank, label in enumerate(labels, 1):
        try:
            said = judge.adjudicate(label, [n for n, _ in names]) if names else None
        except Exception:
            said = None
        out[rank] = next((w for n, w in names if n == said), None)
        if out[rank] is None:
            names.append((label, ("new", rank)))
    return out


@pytest.mark.parametrize("kind", ["any", "alike", "fails", "never"])
def test_rounds_equal_the_fold(spark, kind):
    rng, judge = random.Random(kind), Judge(kind, 3)
    classes = {c: ([f"{rng.choice('abc')}{rng.choice('xy')}{i}" for i in range(n)], [(f"{c}{i}", f"{rng.choice('abc')}x old {i}") for i in range(k)]) for c, n, k in (("100", 12, 3), ("200", 5, 0), ("300", 1, 1))}
    labels = spark.createDataFrame([(c, label, r) for c, (own, _) in classes.items() for r, label in enumerate(own, 1)], "target string, first_label string, rank long")
    kids = spark.createDataFrame([(c, code, name) for c, (_, own) in classes.items() for code, name in own], "target string, code string, label string")
    got = {(r["target"], r["rank"]): ("old", r["old_code"]) if r["old_code"] else ("new", r["of"]) if r["of"] else None for r in adjudicate.answered(labels, kids, judge, 4).collect()}
    assert got == {(c, r): w for c, (own, below) in classes.items() for r, w in fold(own, below, judge).items()}


def test_labels_become_aliases_and_nodes(spark):
    items = [(i, c, label) for i, (c, label) in enumerate([("500", "holiday party"), ("500", "holiday feast"), ("500", "spring fair"), ("900", "odd thing"), ("500", "spring market"), ("500", "holiday party"), ("900", "none")])]
    seed = T.seed_taxonomy(spark)
    coded, after = adjudicate.resolve_with(spark.createDataFrame(items, "pos long, class string, label string"), seed, Judge("alike", 0))
    codes = {r["pos"]: r["code"] for r in coded.collect()}
    nodes = {r["code"]: r for r in after.collect()}
    assert codes[0] == codes[1] == codes[5] and codes[2] == nodes[codes[2]]["code"] and codes[6] == "900"
    assert codes[2] == "510" and codes[4] == "510"  # a child that is there is alike
    assert nodes[codes[0]]["label"] == "holiday party" and nodes[codes[0]]["aliases"] == ["holiday feast"] and len(nodes) == 41 + len({c for c in codes.values() if c not in {r["code"] for r in seed.collect()}})
