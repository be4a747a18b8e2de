"""Exact dedup against a plain version, with digests that tell texts apart and with digests that don't."""

import hashlib

import pytest
from pyspark.sql import functions as F

from stowage.llm import exact


def plain(rows):
    """(id, keep, group size, kept, sha) of (id, text) rows; of rows alike one is kept."""
    norm = [(i, t or "", (t or "").translate(dict.fromkeys(map(ord, " \t\n\v\f\r")))) for i, t in rows]
    groups = {}
    for i, t, n in norm:
        groups.setdefault(n, []).append((-len(t), i is None, i or 0, i))
    out, used = [], set()
    for i, t, n in norm:
        best = min(groups[n])
        kept = (-len(t), i is None, i or 0, i) == best and n not in used
        used |= {n} if kept else set()
        out.append((i, best[3], len(groups[n]), kept, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


EXTRA = [(500, "a b  c"), (501, "ab c"), (502, "abc\t\t\t"), (503, "\x0b\x0c"), (504, "Abc"), (505, "abc "), (499, " a b c"), (600, "\U0001f600 x"), (601, "\U0001f600x ")]


def test_groups(spark, docs, rows):
    more = spark.createDataFrame([(i, t, *rows[0][2:]) for i, t in EXTRA], docs.schema)
    assert found(exact.exact_duplicates(docs.unionByName(more))) == plain([r[:2] for r in rows] + EXTRA)


@pytest.mark.parametrize("salts", [1, 7])
def test_texts_below_one_digest_are_told_apart(spark, docs, rows, salts):
    """With a digest of one bit, or none, all rests on the comparison of the texts."""
    want = [r[:4] for r in plain([r[:2] for r in rows])]
    for weak in (lambda c: F.sha2(c, 256).substr(1, 1) < "8", lambda c: F.lit(b"")):
        got = exact.exact_duplicates(docs, digest=lambda c, f=weak: f(c).cast("string").cast("binary"), salts=salts)
        assert [r[:4] for r in sorted((tuple(r) for r in got.collect()), key=repr)] == want


def test_a_hot_group_and_repeated_rows(spark):
    rows = [(i, "the same  text" if i % 2 else f"text {i}") for i in range(300)] + [(7, "the same  text")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = found(exact.exact_duplicates(df))
    assert got == plain(rows) and sum(r[3] for r in got) == 151


def test_string_ids(spark):
    rows = [("b", "x y"), ("a", "xy "), (None, "x y"), ("c", "z")]
    got = exact.exact_duplicates(spark.createDataFrame(rows, "name string, said string"), "name", "said").collect()
    assert sorted((r["doc_id"] or "", r["keep_id"], r["kept"]) for r in got) == [("", "a", False), ("a", "a", True), ("b", "a", False), ("c", "c", True)]


def test_drop_copies_keeps_the_documents(spark, docs, rows):
    kept = exact.drop_copies(docs)
    assert kept.schema == docs.schema
    want = sorted((i, t) for i, _, _, k, t in plain([r[:2] for r in rows]) if k and i is not None)
    norm = lambda t: hashlib.sha256((t or "").translate(dict.fromkeys(map(ord, " \t\n\v\f\r"))).encode()).hexdigest()
    assert sorted((r["doc_id"], norm(r["text"])) for r in kept.collect() if r["doc_id"] is not None) == want


def test_nothing(empty):
    assert exact.exact_duplicates(empty).collect() == [] and exact.drop_copies(empty).collect() == []


def test_no_python_in_the_plan(spark, docs):
    plan = exact.exact_duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "ExternalRDD"))
