"""Listings dealt out, the watch as a stream, failures as keyed state."""

import os
import random
import time

import pytest

from stowage.operators import incremental
from stowage.operators.catalog import Catalog
from stowage.plans.organize import Organizer
from stowage.sources import files
from stowage.streaming import failures
from stowage.streaming.breaker import Breaker
from stowage.streaming.watch import watch_stream
from test_end_to_end import Picky, picture

# --- listing -----------------------------------------------------------------------


def test_a_flat_folder_is_dealt_out(spark, tmp_path):
    for i in range(2500):
        (tmp_path / f"p_{i:04}.{'jpg' if i % 2 else 'txt'}").write_bytes(b"")
    parts = files.planned(str(tmp_path), True)
    assert len(parts) == 50
    each = [sum(b.num_rows for b in files.listed(p, None)) for p in parts]
    assert sum(each) == 2500 and max(each) < 90  # every task has its share
    assert len(files.planned(str(tmp_path), True, entries=20)) == 125
    df = files.scan(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 50 and df.distinct().count() == 1250
    assert "extension" in df._jdf.queryExecution().executedPlan().toString()


def test_extensions_are_pushed_into_the_source(spark, tmp_path, monkeypatch):
    for name in ("a.jpg", "b.txt", "c.PNG", ".d.jpg", "e", "f.", "g.tar.gif"):
        (tmp_path / name).write_bytes(b"")
    reader = files._Reader({"path": str(tmp_path)})
    left = list(reader.pushFilters([files.In(("extension",), ("jpg", "png")), files.In(("source_path",), ("x",))]))
    assert [f.attribute for f in left] == [("source_path",)] and reader.extensions == {"jpg", "png"}
    got = {os.path.basename(r) for p in reader.partitions() for b in reader.read(p) for r in b.column(0).to_pylist()}
    assert got == {"a.jpg", "c.PNG", ".d.jpg"}
    assert {os.path.basename(r["source_path"]) for r in files.scan(spark, str(tmp_path)).collect()} == got | {"g.tar.gif"}


def test_texts_are_read_in_tasks(spark, tmp_path):
    """Of 600 files in 13 tasks, as the scan deals them out; the driver has no list of them."""
    want = {}
    for i in range(600):
        want[f"p {i}.json"] = f'{{"n": {i}, "é": "\r\n"}}' if i % 100 else "x" * (3 * files.ARROW_BYTES // 4 * (i // 100))
        (tmp_path / f"p {i}.json").write_bytes(want[f"p {i}.json"].encode())
    (tmp_path / "a.jpg").write_bytes(b"x")
    df = files.with_texts(files.scan(spark, str(tmp_path), extensions=("json",)))
    assert df.rdd.getNumPartitions() == 13 and not df.inputFiles()
    got = df.collect()
    assert len(got) == 600 and {os.path.basename(r["source_path"]): r["text"] for r in got} == want
    assert all(r["size"] == len(want[os.path.basename(r["source_path"])].encode()) for r in got)
    reader = files._Reader({"path": str(tmp_path)})
    assert not list(reader.pushFilters([files.EqualTo(("extension",), "json")])) and reader.extensions == {"json"}


def test_sidecars_query_asks_for_few_tasks(spark, data):
    from stowage.plans.registry import queries

    df = queries()["sidecars"](spark, data)
    assert df.rdd.getNumPartitions() <= 64 and not df.inputFiles() and df.count() > 0


def test_python_and_column_extensions_agree(spark):
    from pyspark.sql import functions as F

    from stowage.functions import expressions as X

    names = [".jpg", "..jpg", "a.jpg", ".a.JPG", "a.", "a..b", "a.b.c", "", ".", "x", "ä.PnG", "a b.gif", "a\n.tif"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", X.extension(F.col("n")).alias("e"))
    assert {r["n"]: r["e"] for r in df.collect()} == {n: files.extension_of(n) for n in names}


def test_small_folders_are_put_together(tmp_path):
    for i in range(300):
        (tmp_path / str(i)).mkdir()
        (tmp_path / str(i) / "a.jpg").write_bytes(b"")
    parts = files.planned(str(tmp_path), True)
    assert len(parts) == 6 + 6 and sum(len(p.pieces) for p in parts) == 6 + 300


@pytest.mark.parametrize("folders", [1, 4, 100])
def test_plans_cover_every_file_once(tmp_path, folders, monkeypatch):
    monkeypatch.setattr(files, "LEAST", 3)
    rng, want = random.Random(folders), set()
    for _ in range(120):
        path = tmp_path.joinpath(*(rng.choice("abc") for _ in range(rng.randint(0, 4))), f"{rng.random()}.jpg")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"")
        want.add(str(path))
    got = [n for p in files.planned(str(tmp_path), True, folders, 7) for b in files.listed(p, None) for n in b.column(0).to_pylist()]
    assert sorted(got) == sorted(want)


def test_a_wide_tree_is_dealt_to_few_tasks(tmp_path, monkeypatch):
    """As copy_and_verify has it: a folder for every file. The plan must not grow with them."""
    want = set()
    for i in range(1500):
        path = tmp_path / "wide" / f"{i:04}" / ("deep" if i % 7 == 0 else ".") / "a.jpg"
        path.parent.mkdir(parents=True)
        path.write_bytes(b"")
        want.add(str(path))
    (tmp_path / "wide" / "b.jpg").write_bytes(b"")
    (tmp_path / "wide" / "link").symlink_to(tmp_path / "wide" / "0001")  # is not followed
    (tmp_path / "c.jpg").write_bytes(b"")
    want |= {str(tmp_path / "wide" / "b.jpg"), str(tmp_path / "c.jpg")}
    parts = files.planned(str(tmp_path), True)
    each = [[n for b in files.listed(p, None) for n in b.column(0).to_pylist()] for p in parts]
    assert len(parts) == 65 and sum(len(p.pieces) for p in parts) == 65 and max(map(len, each)) < 60
    assert sorted(n for names in each for n in names) == sorted(want)
    few = files.planned(str(tmp_path), True, 2000)  # opened, and so put together
    assert sorted(n for p in few for b in files.listed(p, None) for n in b.column(0).to_pylist()) == sorted(want)
    monkeypatch.setattr(files, "WALKS", 8)
    for i in range(40):
        for k in range(30):
            (tmp_path / "two" / str(i) / str(k)).mkdir(parents=True)
    assert len(files.planned(str(tmp_path / "two"), True, 60)) <= 8 + 2  # folders that were not opened


# --- watching ----------------------------------------------------------------------


def test_watch_as_a_stream_over_restarts(spark, tmp_path):
    src = tmp_path / "s"
    for name in ("a_1.jpg", "bad_2.jpg"):
        picture(src / name, name.encode())
    job, seen = Organizer(Catalog(spark, str(tmp_path / "c")), str(tmp_path / "o"), Picky()), []

    def once():
        run = watch_stream(job, str(src), str(tmp_path / "cp"), None, breaker=Breaker(3), report=seen.append, poison_limit=2, quarantine_dir=str(tmp_path / "q"))
        run.awaitTermination()
        return seen[-1]

    first = once()
    assert (first.processed, first.errors, first.skipped_unchanged) == (1, 1, 0)
    picture(src / "a_1.jpg", b"changed since")  # a changed file comes again, a failed one is tried again
    picture(src / "b_3.jpg", b"b")
    second = once()
    assert (second.processed, second.errors, second.skipped_unchanged, second.quarantined) == (2, 1, 0, 1) and len(os.listdir(tmp_path / "q")) == 1
    third = once()
    assert (third.processed, third.errors, third.skipped_unchanged) == (0, 0, 3) and len(seen) == 3
    assert len(os.listdir(tmp_path / "cp" / "commits")) >= 3


def test_a_listing_stream_keeps_no_file_in_its_offsets(tmp_path):
    reader = files._StreamReader({"path": str(tmp_path / "gone")})
    a, b = reader.latestOffset(), reader.latestOffset()
    assert reader.initialOffset() == {"at": 0} and 0 < a["at"] < b["at"]
    assert sum(x.num_rows for p in reader.partitions(a, b) for x in reader.read(p)) == 0


# --- failures ----------------------------------------------------------------------


def test_state_follows_the_table(spark):
    """Random passes: the stream's state is what record_failures and clear_failures make of a table."""
    rng = random.Random(2)
    batches, table = [], spark.createDataFrame([("p0", 1, 1, 2, "x", None, None, False)], "source_path string, size long, mtime_ns long, fail_count int, last_error string, first_failed_at timestamp, last_failed_at timestamp, quarantined boolean")
    before = table.select("source_path", "size", "mtime_ns", "fail_count", "quarantined")
    for k in range(3):
        rows = [(f"p{i}", rng.choice([1, 1, 2]), 1, rng.random() < 0.8, k) for i in rng.sample(range(8), 6)]
        batches.append(spark.createDataFrame(rows, "source_path string, size long, mtime_ns long, failed boolean, at long"))
        bad = batches[-1].where("failed").selectExpr("source_path", "size", "mtime_ns", "'e' AS error")
        table = incremental.clear_failures(incremental.record_failures(table, bad, "2024-01-01", 3), batches[-1].where("NOT failed"))
    changes = failures.replayed(spark, batches, 3, before)
    got = failures.latest(changes).unionByName(before.join(changes.select("source_path"), "source_path", "left_anti"))
    key = lambda df: sorted((r["source_path"], r["size"], r["fail_count"], r["quarantined"]) for r in df.collect())
    assert key(got) == key(table)


def test_state_may_be_forgotten(spark, tmp_path):
    schema = "source_path string, size long, mtime_ns long, failed boolean, at long"
    spark.createDataFrame([("a", 1, 1, True, 1)], schema).write.parquet(str(tmp_path / "in"))
    log = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    with failures.state_store(spark):
        run = failures.failures(log, forget_ms=1).writeStream.format("memory").queryName("forgotten").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for _ in range(40):
            time.sleep(0.5)
            rows = spark.table("forgotten").collect()
            if len(rows) > 1:
                break
        assert sorted((r["at"], r["fail_count"]) for r in rows)[:2] == [(1, 0), (1, 1)]
        assert failures.latest(spark.table("forgotten")).count() == 0
    finally:
        run.stop()
