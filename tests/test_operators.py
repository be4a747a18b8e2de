"""Set operators against row-at-a-time models written for these tests."""

import os
import random

import pytest
from pyspark.sql import functions as F

from stowage.functions import constants as C
from stowage.operators import catalog as K
from stowage.operators import concepts, dedup, incremental
from stowage.operators import taxonomy as T
from test_expressions import py_label


class Model:
    """A sequential taxonomy: a dict of code -> [parent, label, aliases]."""

    def __init__(self, extra=()):
        self.nodes = {c: [p, label, []] for c, p, label in C.seed_nodes()}
        self.nodes.update({c: [p, label, []] for c, p, label in extra})

    def place(self, cls, label, judge=None):
        target = cls if cls in self.nodes else "900"
        norm = py_label(label)
        if not norm or norm in {py_label(x) for x in C.DEGENERATE} or not any(ch.isalpha() for ch in label) or norm == py_label(self.nodes[target][1]):
            return target
        kids = sorted(c for c, n in self.nodes.items() if n[0] == target)
        for c in kids:
            if norm in [py_label(x) for x in (self.nodes[c][1], *self.nodes[c][2])]:
                return c
        if judge and kids:
            said = judge(label, [self.nodes[c][1] for c in kids])
            for c in kids:
                if said and self.nodes[c][1] == said:
                    self.nodes[c][2].append(label)
                    return c
        slots = [str(int(target) + 10 * k) for k in range(1, 10)]
        code = next((s for s in slots if s not in kids), None)
        if code is None:
            tops = [int(c.split("~")[1]) for c in kids if c.startswith(f"{target}~")]
            code = f"{target}~{max(tops, default=0) + 1}"
        self.nodes[code] = [target, label, []]
        return code


@pytest.mark.parametrize("seed", range(3))
def test_minting_equals_a_sequential_model(spark, seed):
    rng = random.Random(seed)
    labels = [f"thing {w}" for w in "abcdefghijklmnop"] + ["none!", "events", "Sports", "123", "misc", "Beaches"]
    rows = [(i, rng.choice(["500", "900", "zzz"]), rng.choice(labels)) for i in range(120)]
    extra = [("900~3", "900", "oddity"), ("540", "500", "holidays")]
    model = Model(extra)
    want = {i: model.place(c, label) for i, c, label in rows}
    nodes = T.insert(T.seed_taxonomy(spark), T.node_rows(spark.createDataFrame(extra, "code string, parent_code string, label string")))
    coded, minted = T.resolve_or_create(spark.createDataFrame(rows, "pos int, class string, label string"), nodes)
    assert {r["pos"]: r["code"] for r in coded.collect()} == want
    assert {r["code"] for r in minted.collect()} == model.nodes.keys() - {r["code"] for r in nodes.collect()}


def test_adjudicated_minting(spark):
    from stowage.plans.adjudicate import resolve_with

    class Judge:
        def adjudicate(self, label, candidates):
            if label == "boom":
                raise RuntimeError
            return next((c for c in candidates if label[:4] == c[:4] and label != c), None)

    def judge(label, candidates):
        return None if label == "boom" else Judge().adjudicate(label, candidates)

    rows = [(i, c, label) for i, (c, label) in enumerate([("500", "festivity"), ("500", "festoon"), ("500", "boom"), ("900", "festoon"), ("500", "sporty"), ("900", "festival day"), ("500", "festivity")])]
    model = Model()
    want = {i: model.place(c, label, judge) for i, c, label in rows}
    coded, after = resolve_with(spark.createDataFrame(rows, "pos int, class string, label string"), T.seed_taxonomy(spark), Judge())
    got = {r["pos"]: r["code"] for r in coded.collect()}
    assert {i: model.nodes[c][1] for i, c in want.items()} == {i: {r["code"]: r["label"] for r in after.collect()}[c] for i, c in got.items()}
    assert {c: sorted(n[2]) for c, n in model.nodes.items() if n[2]} == {r["code"]: sorted(r["aliases"]) for r in after.collect() if r["aliases"]}


def test_taxonomy_reads(spark):
    t = T.seed_taxonomy(spark)
    assert t.count() == 41 and T.seed_taxonomy(spark, t).count() == 41
    t = T.merge_codes(t, "510", "520")
    assert {r["code"]: r["target"] for r in T.alias_closure(t).collect()}["510"] == "520"
    text = T.snapshot_text(t)
    assert "500 events\n  520 concerts\n  530 ceremonies" in text and "510" not in text
    assert T.merge_codes(t, "nope", "500") is t
    cycle = t.unionByName(spark.createDataFrame([("1", None, "a", "1-a", [], "2", False), ("2", None, "b", "2-b", [], "1", False), ("3", "4", "c", "3-c", [], None, True), ("4", "3", "d", "4-d", [], None, True)], T.SCHEMA))
    assert {r["code"]: r["target"] for r in T.alias_closure(cycle).collect()}["1"] == "1"
    assert {r["code"]: r["folder_path"] for r in T.folder_paths(cycle).collect()}["3"] == "4-d/3-c"


def test_first_miss_is_asked_once(spark):
    rows = [(1, "zonkle", [], ""), (2, "Zonkle!", ["dog"], ""), (3, "beach", [], ""), (4, "zonkle", [], ""), (5, "quux", ["dogs"], ""), (6, "blip", [], "at the beach"), (7, "flub", [], "")]
    c = concepts.class_for(spark.createDataFrame(rows, "pos int, primary_subject string, objects array<string>, scene string"))
    assert {r["pos"]: r["class"] for r in c.collect()} == {1: None, 2: "200", 3: "300", 4: None, 5: "200", 6: "300", 7: None}
    asked = concepts.first_misses(c)
    assert sorted(r["pos"] for r in asked.collect()) == [1, 7]
    answers = spark.createDataFrame([("zonkle", 1, "400"), ("flub", 7, "nonsense")], "subject_norm string, pos int, answer string")
    assert {r["pos"]: r["class"] for r in concepts.decide_class(c, answers).collect()} == {1: "400", 2: "400", 3: "300", 4: "400", 5: "200", 6: "300", 7: "900"}


def test_survivor_is_the_first_success(spark):
    rows = [("a", "x", False), ("b", "x", True), ("c", "x", True), ("d", "y", False), ("e", None, True)]
    got = dedup.survivors(spark.createDataFrame(rows, "source_path string, digest string, ok boolean"))
    assert {r["source_path"]: r["status"] for r in got.collect()} == {"a": "error", "b": "copied", "c": "duplicate", "d": "error", "e": "copied"}


@pytest.mark.parametrize("seed", range(3))
def test_breaker_trips_where_a_loop_does(spark, seed):
    rng = random.Random(seed)
    log = [(g, i, rng.choice(["error", "error", "copied"])) for g in "ab" for i in range(60)]
    got = dedup.breaker_trips(spark.createDataFrame(log, "g string, i int, status string"), 3, ["i"], ["g"])
    want, run = set(), {}
    for g, i, s in log:
        run[g] = run.get(g, 0) + 1 if s == "error" else 0
        if run[g] >= 3:
            want.add((g, i))
    assert {(r["g"], r["i"]) for r in got.where("trips").collect()} == want


def test_failures_merge(spark):
    schema = K.SCHEMAS["failed_files"]
    first = incremental.record_failures(spark.createDataFrame([], schema), spark.createDataFrame([("a", 1, 1, "x"), ("b", 1, 1, "x")], "source_path string, size long, mtime_ns long, error string"), "2024-01-01", 2)
    second = incremental.record_failures(first, spark.createDataFrame([("a", 1, 1, "y"), ("b", 2, 1, "y"), ("c", 1, 1, "y")], "source_path string, size long, mtime_ns long, error string"), "2024-01-02", 2)
    got = {r["source_path"]: (r["fail_count"], r["last_error"], r["first_failed_at"].day, r["quarantined"]) for r in second.collect()}
    assert got == {"a": (2, "y", 1, True), "b": (1, "y", 1, False), "c": (1, "y", 2, False)}
    third = incremental.record_failures(second, spark.createDataFrame([("a", 9, 9, "z")], "source_path string, size long, mtime_ns long, error string"), "2024-01-03", 2)
    assert {r["source_path"]: (r["fail_count"], r["quarantined"]) for r in third.collect()}["a"] == (1, False)
    assert incremental.clear_failures(third, spark.createDataFrame([("b",)], "source_path string")).count() == 2


def seen_rows(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], K.SCHEMAS["source_seen"])


def test_catalog_snapshots(spark, tmp_path):
    cat = K.Catalog(spark, str(tmp_path / "cat"))
    assert cat.read("photos").count() == 0
    cat.commit(source_seen=seen_rows(spark, [("a", 1, 1, "d")]))
    cat.commit(source_seen=seen_rows(spark, [("a", 2, 2, "e"), ("b", 1, 1, "f")]))
    assert {(r["source_path"], r["size"]) for r in cat.read("source_seen").collect()} == {("a", 2), ("b", 1)}
    cat.vacuum()
    assert cat.read("source_seen").count() == 2 and cat.read("source_seen", ["b"]).where("source_path = 'b'").count() == 1


def written(root):
    """Bytes by file."""
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_a_batch_writes_in_proportion_to_itself(spark, tmp_path):
    cat = K.Catalog(spark, str(tmp_path / "cat"))
    stamp = "/some/long/folder/of/sources/with/a/name/that/does/not/compress"
    cat.commit(source_seen=spark.range(40000).selectExpr(f"concat('{stamp}', sha2(string(id), 256)) AS source_path", "id AS size", "id AS mtime_ns", "sha2(string(-id), 256) AS digest", "timestamp'2024-01-01' AS seen_at"))
    before = written(tmp_path)
    cat.commit(source_seen=seen_rows(spark, [(f"new {i}", i, i, "d") for i in range(10)]))
    after = written(tmp_path)
    assert sum(after[f] for f in after.keys() - before.keys()) < 0.02 * sum(before.values()) and before.items() <= after.items()
    assert cat.read("source_seen").count() == 40010


@pytest.mark.parametrize("seed", range(2))
def test_log_equals_a_dictionary(spark, tmp_path, seed):
    """Random upserts and removals; segments stay few, and a row is rewritten a few times in all."""
    rng, cat, want = random.Random(seed), K.Catalog(spark, str(tmp_path / "cat")), {}
    for k in range(14):
        keys = rng.sample(range(60), rng.choice([1, 5, 20]))
        rows = [(f"p{i}", k, i, None, None, rng.random() < 0.3) for i in keys]
        cat.commit(source_seen=spark.createDataFrame(rows, f"{K.SCHEMAS['source_seen']}, _gone boolean"))
        for path, size, mtime, _, _, gone in rows:
            want.pop(path, None)
            if not gone:
                want[path] = (size, mtime)
        if k % 5 == 4:
            cat.vacuum()
        assert {r["source_path"]: (r["size"], r["mtime_ns"]) for r in cat.read("source_seen").collect()} == want
    for own in cat._pointer()["segments"]["source_seen"].values():
        sizes = [s for _, s in own]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False))


def test_an_unfinished_commit_leaves_nothing_visible(spark, tmp_path, monkeypatch):
    cat = K.Catalog(spark, str(tmp_path / "cat"))
    cat.commit(source_seen=seen_rows(spark, [("a", 1, 1, "d")]))
    monkeypatch.setattr(cat, "_swap", lambda pointer: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError, match="killed"):
        cat.commit(source_seen=seen_rows(spark, [("a", 2, 2, "e"), ("b", 1, 1, "f")]))
    again = K.Catalog(spark, str(tmp_path / "cat"))
    assert [tuple(r)[:2] for r in again.read("source_seen").collect()] == [("a", 1)]
    again.commit(source_seen=seen_rows(spark, [("c", 3, 3, "g")]))
    again.vacuum()
    assert {r["source_path"] for r in again.read("source_seen").collect()} == {"a", "c"}


def test_history_is_rows(spark, tmp_path):
    """Of a digest with very many copies no row grows; the array is made for the digest that is asked about."""
    cat = K.Catalog(spark, str(tmp_path / "cat"))
    photo = {f.name: None for f in spark.createDataFrame([], K.SCHEMAS["photos"]).schema} | {"digest": "d", "original_path": "/a"}
    new = spark.createDataFrame([tuple(v for k, v in photo.items() if k != "id")], ", ".join(c for c in K.SCHEMAS["photos"].split(", ") if c != "id long"))
    cat.commit(photos=cat.upsert(new))
    copies = spark.range(100000).selectExpr("IF(id < 99990, 'd', 'other') AS digest", "concat('/copy/', lpad(id, 6, '0')) AS source_path")
    cat.commit(history=K.duplicate_events(cat.touched("photos", copies), copies, "2024-01-01"))
    history = cat.read("history")
    assert history.count() == 99990 and all(len(f.dataType.simpleString()) < 10 for f in history.schema)
    got = cat.get("d").first()
    assert got["id"] == 1 and [e["duplicate_path"] for e in got["processing_history"][:2]] == ["/copy/000000", "/copy/000001"]
    cat.commit(photos=cat.upsert(new.withColumn("original_path", F.lit("/b")).withColumn("pcs_name", F.lit("x"))))
    assert [(r["id"], r["original_path"], r["pcs_name"]) for r in cat.read("photos").collect()] == [(1, "/a", "x")]
