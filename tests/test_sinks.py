"""The copying writer: all or nothing, twice, broken, stopped."""

import json
import os

import pytest
from pyspark.sql import functions as F

from stowage.sources import files, sinks
from stowage.streaming.breaker import Breaker
from stowage.streaming.watch import run_pass
from test_end_to_end import Catalog, Organizer, Picky, picture


def visible(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names)


def planned(spark, src, root):
    named = files.with_digests(files.scan(spark, str(src))).drop("error")
    return named.withColumn("organized_path", F.concat(F.lit(f"{root}/sub/"), F.element_at(F.split("source_path", "/"), -1))).withColumn("sidecar", F.to_json(F.struct("digest")))


def test_copies_and_failures(spark, tmp_path):
    src, root = tmp_path / "s", str(tmp_path / "o")
    for i in range(6):
        picture(src / f"p{i}.jpg", bytes([i]))
    rows = planned(spark, src, root).withColumn("digest", F.when(F.col("source_path").endswith("p3.jpg"), "wrong").otherwise(F.col("digest")))
    rows = rows.withColumn("sidecar", F.when(F.col("source_path").endswith("p4.jpg"), "{no json").otherwise(F.col("sidecar")))
    got = {os.path.basename(r["source_path"]): (r["status"], r["error"]) for r in sinks.organize_files(rows, root, True).collect()}
    assert got.pop("p3.jpg")[0] == "error" and set(got.values()) == {("copied", None)}
    assert visible(root) == sorted([f"sub/p{i}.jpg" for i in (0, 1, 2, 4, 5)] + [f"sub/p{i}.json" for i in (0, 1, 2, 5)])
    assert json.loads((tmp_path / "o/sub/p0.json").read_text()).keys() == {"digest"}
    (tmp_path / "blocked").write_bytes(b"a file, where a folder is wanted")
    blocked = rows.where("sidecar NOT LIKE '{no%'").withColumn("organized_path", F.concat(F.lit(f"{tmp_path}/blocked/"), F.element_at(F.split("source_path", "/"), -1)))
    assert {r["status"] for r in sinks.organize_files(blocked, root).collect()} == {"error"}
    before = os.stat(f"{root}/sub/p0.jpg").st_ino
    (tmp_path / "o/sub/p1.jpg").write_bytes(b"damaged")
    again = sinks.organize_files(planned(spark, src, root), root)
    assert {r["status"] for r in again.collect()} == {"copied"} and os.stat(f"{root}/sub/p0.jpg").st_ino == before
    assert files.file_digest(f"{root}/sub/p1.jpg") == files.file_digest(str(src / "p1.jpg")) and not os.path.exists(f"{root}/{sinks.STAGING}/x")


def test_a_stopped_job_leaves_nothing_visible(spark, tmp_path, monkeypatch):
    src, root = tmp_path / "s", str(tmp_path / "o")
    for i in range(6):
        picture(src / f"p{i}.jpg", bytes([i]))
    rows = planned(spark, src, root)
    monkeypatch.setattr(sinks, "stored", lambda df: df)
    boom = rows.repartition(3).withColumn("digest", F.when(F.col("source_path").endswith("p5.jpg"), F.raise_error(F.lit("killed"))).otherwise(F.col("digest")))
    with pytest.raises(Exception, match="killed"):
        sinks.organize_files(boom, root)
    assert [f for f in visible(root) if not f.startswith(sinks.STAGING)] == []  # a task that still ran may stage after the abort
    os.makedirs(f"{root}/{sinks.STAGING}/old", exist_ok=True)  # what a killed driver leaves
    (tmp_path / "o" / sinks.STAGING / "old" / "part").write_bytes(b"x")
    sinks.sweep(root)
    assert visible(root) == []


def test_results_of_a_lost_task_do_not_count(spark, tmp_path):
    """A task that fails after it has told of some files, and then runs again, must not give their rows twice."""
    src, root = tmp_path / "s", str(tmp_path / "o")
    for i in range(3):
        picture(src / f"p{i}.jpg", bytes([i]))
    rows = planned(spark, src, root).select("source_path", "organized_path", "digest", "sidecar").collect()
    writer = sinks._CopyWriter({"path": root, "job": "j"})
    batches = [sinks.pa.RecordBatch.from_pylist([r.asDict()]) for r in rows]

    def lost():
        yield batches[0]
        raise OSError("executor lost")

    with pytest.raises(OSError, match="lost"):
        writer.write(lost())
    writer.commit([writer.write(iter(batches)), None])
    done = f"{root}/{sinks.STAGING}/j/done"
    told = [sinks.pq.read_table(f"{done}/{f}") for f in os.listdir(done)]
    assert sum(t.num_rows for t in told) == 3 and visible(f"{root}/sub") == []
    for _ in range(2):  # the publishing task too may run again
        got = [r for t in told for b in sinks._published(t.to_batches()) for r in b.to_pylist()]
        assert sorted(r["source_path"] for r in got) == sorted(r["source_path"] for r in rows) and {r["status"] for r in got} == {"copied"}
        assert visible(f"{root}/sub") == [f"p{i}.{e}" for i in range(3) for e in ("jpg", "json")]
    (tmp_path / "o/sub/p1.jpg").write_bytes(b"damaged")  # what was staged is gone, and this is not it
    assert [r["status"] for t in told for b in sinks._published(t.to_batches()) for r in b.to_pylist()].count("error") == 1


def test_sidecars_that_say_the_same_are_left_alone(spark, tmp_path):
    src, root = tmp_path / "s", str(tmp_path / "o")
    for i in range(3):
        picture(src / f"p{i}.jpg", bytes([i]))
    rows = planned(spark, src, root)
    sinks.organize_files(rows, root, True)
    before = [os.stat(f"{root}/sub/p{i}.json").st_ino for i in range(3)]
    said = (tmp_path / "o/sub/p0.json").read_text()
    (tmp_path / "o/sub/p1.json").write_text(said + " ")
    os.unlink(f"{root}/sub/p2.json")
    assert sinks.organize_files(rows, root, True).where("status = 'copied'").count() == 3
    assert os.stat(f"{root}/sub/p0.json").st_ino == before[0] and (tmp_path / "o/sub/p1.json").read_text() != said + " "
    assert {json.loads((tmp_path / f"o/sub/p{i}.json").read_text())["digest"] for i in range(3)} == {files.file_digest(str(src / f"p{i}.jpg")) for i in range(3)}
    assert sinks.organize_files(rows.limit(0), root, True).count() == 0


def test_a_pass_counts_in_its_own_jobs(spark, tmp_path):
    """The tallies of a pass come from the jobs that write: the pass itself asks for no count."""
    src, asked = tmp_path / "s", []
    for i in range(4):
        picture(src / f"p{i}.jpg", bytes([i]))
    job = Organizer(Catalog(spark, str(tmp_path / "c")), str(tmp_path / "o"), Picky())
    run = job.run
    job.run = lambda batch, give_up=0: asked.append(give_up) or run(batch, give_up)
    stats = run_pass(job, str(src), breaker=Breaker(3))
    assert (stats.processed, stats.errors, stats.skipped_unchanged) == (4, 0, 0)
    idle, tracker = len(asked), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("idle", "a pass with nothing to do")
    try:
        stats = run_pass(job, str(src), breaker=Breaker(3))
        jobs = len(tracker.getJobIdsForGroup("idle"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert stats.skipped_unchanged == 4 and len(asked) == idle and jobs <= 6
