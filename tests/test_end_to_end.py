"""Real files: organize, repeat, verify, corrupt, watch."""

import json
import os
import sys

import pytest

from stowage import cli
from stowage.operators.catalog import Catalog
from stowage.operators.dedup import run_stats
from stowage.plans.classifiers import Classifier
from stowage.plans.organize import Organizer, verify_tree
from stowage.session import stored
from stowage.sources import exif, files
from stowage.streaming.breaker import Breaker, State
from stowage.streaming.watch import run_pass, watch


def picture(path, body):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\xff\xd8\xff\xe0" + body + b"\xff\xd9")


@pytest.fixture
def tree(tmp_path):
    src = tmp_path / "src"
    for name, body in {"beach_photo.jpg": b"0" * 16, "sub/mountain_view.JPG": b"1" * 16, "sub/copy.jpg": b"0" * 16, ".hidden.png": b"h", "notes.txt": b"n"}.items():
        picture(src / name, body)
    (src / "empty.jpg").write_bytes(b"")
    (src / "album.jpg").mkdir()
    return src


class Picky(Classifier):
    """Fails on files whose name says so; the subject is the name's first letter run."""

    def describe(self, path, exif):
        name = os.path.basename(path)
        if name.startswith("bad"):
            raise RuntimeError("backend down")
        return {"primary_subject": name.split("_")[0].split(".")[0], "objects": "oops"}

    def pick_class(self, content):
        return "400"


def test_one_file(spark, tree, tmp_path):
    job = Organizer(Catalog(spark, str(tmp_path / "c")), str(tmp_path / "o"), Picky())
    done = job.process_file(str(tree / "beach_photo.jpg"))
    assert done["status"] == "copied" and os.path.exists(done["organized_path"])
    assert job.process_file(str(tree / "sub" / "copy.jpg"))["status"] == "duplicate" and job.process_file(str(tree / "notes.txt")) is None


def test_scan(spark, tree):
    rows = {os.path.relpath(r["source_path"], tree): r for r in files.scan(spark, str(tree)).collect()}
    assert rows.keys() == {"beach_photo.jpg", "sub/mountain_view.JPG", "sub/copy.jpg", ".hidden.png", "empty.jpg"}
    assert all(r["mtime_ns"] == os.stat(r["source_path"]).st_mtime_ns for r in rows.values())
    assert files.scan(spark, str(tree), recursive=False).count() == 3
    assert files.scan(spark, str(tree / "beach_photo.jpg")).count() == 1
    assert files.scan(spark, str(tree / "notes.txt")).count() == 0
    with pytest.raises(Exception, match="no such source"):
        files.scan(spark, str(tree / "nowhere")).count()


def test_organize_twice_then_verify_and_corrupt(spark, tree, tmp_path):
    out = tmp_path / "out"
    cat = Catalog(spark, str(tmp_path / "cat"))
    job = Organizer(cat, str(out), duplicates_dir=str(tmp_path / "dup"), sidecars=True)
    dry = run_stats(Organizer(cat, str(out), dry_run=True).run(files.scan(spark, str(tree)))).first()
    first = stored(job.run(files.scan(spark, str(tree))))
    s = run_stats(first).first()
    assert (s["total"], s["copied"], s["duplicates"], s["errors"]) == (5, 4, 1, 0) == (dry["total"], dry["copied"], dry["duplicates"], dry["errors"])
    again = run_stats(job.run(files.scan(spark, str(tree)))).first()
    assert (again["copied"], again["duplicates"]) == (0, 5)
    photos = {r["original_path"]: r for r in cat.read("photos").collect()}
    beach = photos[str(tree / "beach_photo.jpg")]
    assert beach["pcs_name"] == "beach" and "300-places/330-beach/330-beach_" in beach["organized_path"] and os.path.exists(beach["organized_path"])
    assert [e["event"] for e in cat.get(beach["digest"]).first()["processing_history"]] == ["processed", "duplicate_detected", "duplicate_detected", "duplicate_detected"]
    assert os.path.exists(os.path.splitext(beach["organized_path"])[0] + ".json") and len(os.listdir(tmp_path / "dup")) == 5
    count = lambda: {r["verdict"]: r["count"] for r in verify_tree(spark, str(out)).groupBy("verdict").count().collect()}
    assert count() == {"OK": 4, "SKIP": 4}
    with open(beach["organized_path"], "ab") as f:
        f.write(b"!")
    assert count() == {"OK": 3, "FAIL": 1, "SKIP": 4}
    assert cli.main(["verify", str(out)], spark) == 1
    assert cli.main(["catalog", "get", "--catalog", str(tmp_path / "cat"), beach["digest"]], spark) == 0
    assert cli.main(["catalog", "get", "--catalog", str(tmp_path / "cat"), "nope"], spark) == 1


def test_cli_process_and_list(spark, tree, tmp_path, capsys):
    args = ["process", str(tree), "--organized-dir", str(tmp_path / "o"), "--catalog", str(tmp_path / "c")]
    assert cli.main(args, spark) == 0 and "copied 4, duplicates 1" in capsys.readouterr().out
    assert cli.main(["catalog", "list", "--catalog", str(tmp_path / "c"), "--limit", "2"], spark) == 0
    assert len(capsys.readouterr().out.strip().split("\n")) == 2


def test_failures_do_not_stop_a_batch_and_pass_bytes_on(spark, tmp_path):
    src = tmp_path / "s"
    picture(src / "bad_1.jpg", b"x")
    picture(src / "good_2.jpg", b"x")
    picture(src / "zebra_3.jpg", b"z")
    cat = Catalog(spark, str(tmp_path / "c"))
    got = {os.path.basename(r["source_path"]): r for r in Organizer(cat, str(tmp_path / "o"), Picky()).run(files.scan(spark, str(src))).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"bad_1.jpg": "error", "good_2.jpg": "copied", "zebra_3.jpg": "copied"}
    assert got["bad_1.jpg"]["error"] == "backend down" and "400-transportation/" in got["zebra_3.jpg"]["organized_path"]
    learned = {r["subject"]: r for r in cat.read("learned_concepts").collect()}
    assert {s: r["class_code"] for s, r in learned.items()} == {"good": "400", "zebra": "400"} and all(r["created_at"] and r["updated_at"] >= r["created_at"] for r in learned.values())
    nodes = {r["code"]: r["created_at"] for r in cat.read("taxonomy").collect()}
    picture(src / "again_4.jpg", b"a")
    Organizer(cat, str(tmp_path / "o"), Picky()).run(files.scan(spark, str(src / "again_4.jpg"))).count()
    assert {s: (r["created_at"], r["updated_at"]) for s, r in learned.items()}.items() <= {r["subject"]: (r["created_at"], r["updated_at"]) for r in cat.read("learned_concepts").collect()}.items()
    later = {r["code"]: r["created_at"] for r in cat.read("taxonomy").collect()}
    assert nodes.items() <= later.items() and len(later) == len(nodes) + 1 and all(later.values())


def test_watch_skips_retries_and_quarantines(spark, tmp_path):
    src = tmp_path / "s"
    for name in ("a_1.jpg", "bad_2.jpg"):
        picture(src / name, name.encode())
    job = Organizer(Catalog(spark, str(tmp_path / "c")), str(tmp_path / "o"), Picky())
    breaker = Breaker(3)
    one = run_pass(job, str(src), breaker=breaker, poison_limit=2)
    assert (one.processed, one.errors, one.skipped_unchanged, one.quarantined) == (1, 1, 0, 0)
    picture(src / "b_3.jpg", b"b")
    two = run_pass(job, str(src), breaker=breaker, poison_limit=2, quarantine_dir=str(tmp_path / "q"))
    assert (two.processed, two.errors, two.skipped_unchanged, two.quarantined) == (1, 1, 1, 1) and len(os.listdir(tmp_path / "q")) == 1
    three = run_pass(job, str(src), breaker=breaker, poison_limit=2)
    assert (three.processed, three.errors, three.skipped_unchanged) == (0, 0, 3)
    picture(src / "a_1.jpg", b"changed")
    assert run_pass(job, str(src), breaker=breaker).processed == 1
    assert run_pass(job, str(tmp_path / "gone")).errors == 1


def test_outage_trips_the_breaker_and_counts_nothing(spark, tmp_path):
    src = tmp_path / "s"
    for i in range(5):
        picture(src / f"bad_{i}.jpg", bytes([i]))
    job, now = Organizer(Catalog(spark, str(tmp_path / "c")), str(tmp_path / "o"), Picky()), [0.0]
    breaker = Breaker(2, clock=lambda: now[0])
    stats = run_pass(job, str(src), breaker=breaker, poison_limit=1)
    assert stats.errors == 2 and breaker.state is State.OPEN and job.catalog.read("failed_files").count() == 0
    waits = []

    class Stop:
        def is_set(self):
            return len(waits) > 1

        def wait(self, s):
            waits.append(s)
            now[0] += s

    total = watch(job, str(src), stop=Stop(), breaker=breaker)
    assert waits == [60.0, 120.0] and total.errors == 1  # one probe, which fails


def test_process_stops_when_the_backend_is_down(spark, tmp_path, monkeypatch, capsys):
    src = tmp_path / "s"
    for i in range(6):
        picture(src / f"bad_{i}.jpg", bytes([i]))
    monkeypatch.setattr(cli, "StubClassifier", Picky)
    args = ["process", str(src), "--organized-dir", str(tmp_path / "o"), "--catalog", str(tmp_path / "c"), "--trip-threshold"]
    assert cli.main([*args, "2"], spark) == 1
    said = capsys.readouterr()
    assert "backend appears down: stopped after 2" in said.err and "errors 2" in said.out and said.err.count("FAIL") == 2
    assert cli.main([*args, "0"], spark) == 1 and "errors 6" in capsys.readouterr().out
    assert cli.main([*args, "2", "--dry-run"], spark) == 0 and "nothing was written" in capsys.readouterr().out


def test_chunks_grow_while_the_backend_is_well(spark, tmp_path):
    src = tmp_path / "s"
    for i in range(20):
        picture(src / f"{'bad' if i in (8, 13) else 'zgood'}_{i:02}.jpg" if i > 5 else src / f"a_{i:02}.jpg", bytes([i]))
    job, ran = Organizer(Catalog(spark, str(tmp_path / "c")), str(tmp_path / "o"), Picky()), []
    run = job.run
    job.run = lambda batch, give_up=0: ran.append(batch.count()) or run(batch, give_up)
    stats = run_pass(job, str(src), breaker=Breaker(3))
    assert (stats.processed, stats.errors) == (18, 2) and sum(ran) == 20 and len(ran) <= 4


def test_many_failing_copies_take_few_rounds(spark, tmp_path):
    src = tmp_path / "s"
    for i in range(12):
        picture(src / f"bad_{i:02}.jpg", b"same")
    picture(src / "good.jpg", b"same")
    picture(src / "zlast.jpg", b"same")
    job, rounds = Organizer(Catalog(spark, str(tmp_path / "c")), str(tmp_path / "o"), Picky()), []
    attempt = job._attempt
    job._attempt = lambda tried, give_up=0: rounds.append(1) or attempt(tried, give_up)
    got = {os.path.basename(r["source_path"]): r["status"] for r in job.run(files.scan(spark, str(src))).collect()}
    assert len(rounds) == 4 and got.pop("good.jpg") == "copied" and got.pop("zlast.jpg") == "duplicate" and set(got.values()) == {"error"}


def test_a_file_that_goes_away_is_an_error_of_the_pass(spark, tmp_path, monkeypatch):
    from stowage.streaming import watch as W

    src = tmp_path / "s"
    picture(src / "a.jpg", b"a")
    os.symlink(str(tmp_path / "nowhere.jpg"), src / "link.jpg")  # no file, so not listed
    assert files._size_and_time(str(src / "nowhere.jpg")) == (None, None)
    job = Organizer(Catalog(spark, str(tmp_path / "c")), str(tmp_path / "o"))
    scan = files.scan
    gone = spark.createDataFrame([(str(src / "b.jpg"), None, None)], files.SCHEMA)
    monkeypatch.setattr(W.files, "scan", lambda *a: scan(*a).unionByName(gone))
    stats = run_pass(job, str(src), breaker=Breaker(3))
    assert (stats.processed, stats.errors) == (1, 1)
    stop = type("Stop", (), {"n": 0, "is_set": lambda self: self.n > 1, "wait": lambda self, s: setattr(self, "n", self.n + 1)})()
    watch(job, str(src), stop=stop, breaker=Breaker(3))
    pointer = json.loads((tmp_path / "c" / "CURRENT.json").read_text())["segments"]
    for name in ("photos", "source_seen"):  # segments that were merged are gone
        live = {(f"v{v}", f"bucket={n}") for n, own in pointer[name].items() for v, _ in own}
        assert live == {(v, b) for v in os.listdir(tmp_path / "c" / name) for b in os.listdir(tmp_path / "c" / name / v) if b.startswith("bucket=")}


def test_breaker_states():
    now = [0.0]
    b = Breaker(2, 60, 2, 100, clock=lambda: now[0])
    b.failure()
    b.success()
    b.failure()
    assert not b.is_open and b.room == 1
    b.failure()
    assert b.is_open and b.wait() == 60
    b.failure()
    b.probe()
    assert b.is_open and b.backoff == 60
    now[0] = 60
    b.probe()
    assert b.state is State.HALF_OPEN and b.room == 1
    b.failure()
    assert b.is_open and b.backoff == 100
    now[0] = 200
    b.probe()
    b.success()
    assert b.state is State.CLOSED and b.backoff == 60
    off = Breaker(0)
    off.failure()
    assert not off.is_open and off.room is None


def tiff(order, fields, gps=None, sub=None):
    """A TIFF block. fields: tag -> (type, values), a rational being a pair."""
    import struct

    code = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 7: "s", 10: "ii", 11: "f"}
    body, place = b"", 8

    def directory(entries, at):
        head, tail = struct.pack(f"{order}H", len(entries)), b""
        over = at + 2 + 12 * len(entries) + 4
        for tag, (kind, values) in sorted(entries.items()):
            if code[kind] == "s":
                raw, n = values, len(values)
            else:
                flat = [x for v in values for x in (v if isinstance(v, tuple) else (v,))]
                raw, n = struct.pack(f"{order}{len(flat)}{code[kind][0]}", *flat), len(values)
            if len(raw) > 4:
                head += struct.pack(f"{order}HHII", tag, kind, n, over + len(tail))
                tail += raw
            else:
                head += struct.pack(f"{order}HHI", tag, kind, n) + raw.ljust(4, b"\0")
        return head + bytes(4) + tail

    fields = dict(fields)
    for tag, entries in ((34665, sub), (34853, gps)):
        if entries:
            fields[tag] = (4, [0])
    body = directory(fields, place)
    for tag, entries in ((34665, sub), (34853, gps)):
        if entries:
            fields[tag] = (4, [place + len(body)])
            body = directory(fields, place) + body[len(directory(fields, place)) :] + directory(entries, place + len(body))
    return {"<": b"II*\0", ">": b"MM\0*"}[order] + struct.pack(f"{order}I", 8) + body


def jpeg(block=b"", width=8, height=6):
    import struct

    app = b"\xff\xe1" + struct.pack(">H", len(block) + 8) + b"Exif\0\0" + block if block else b""
    return b"\xff\xd8" + app + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, height, width, 3) + bytes(9) + b"\xff\xda\0\2\xff\xd9"


@pytest.mark.parametrize("order", ["<", ">"])
def test_exif_of_real_bytes(tmp_path, order):
    gps = {1: (2, b"S\0"), 2: (5, [(10, 1), (30, 1), (36, 10)]), 3: (2, b"W\0"), 4: (5, [(5, 1), (3, 1)]), 99: (2, b"odd\0")}
    sub = {33434: (5, [(1, 250)]), 33437: (5, [(4, 0)]), 36864: (7, b"0230"), 34855: (3, [400]), 37386: (11, [float("nan")]), 37500: (7, b"private")}
    block = tiff(order, {271: (2, b"Maker\0"), 274: (3, [6]), 305: (2, b"\xff soft\0rest"), 999: (3, [1])}, gps, sub)
    path = tmp_path / "a.jpg"
    path.write_bytes(jpeg(block))
    got = exif.read_exif(str(path))
    assert got == {
        "format": "JPEG", "mode": "RGB", "width": 8, "height": 6, "Make": "Maker", "Orientation": 6, "Software": "\ufffd soft", "ExposureTime": 0.004, "FNumber": 0.0, "ExifVersion": "0230", "ISOSpeedRatings": 400, "FocalLength": None,
        "GPS": {"GPSLatitudeRef": "S", "GPSLatitude": [10.0, 30.0, 3.6], "GPSLongitudeRef": "W", "GPSLongitude": [5.0, 3.0], "GPS_99": "odd", "latitude_decimal": -10.501},
    }
    path.write_bytes(tiff(order, {256: (3, [7]), 257: (4, [9]), 272: (2, b"M2\0")}))
    assert exif.read_exif(str(path)) == {"format": "TIFF", "width": 7, "height": 9, "Model": "M2"}
    whole = jpeg(block)
    for cut in range(0, len(whole), 7):  # whatever is cut or broken, nothing is raised
        path.write_bytes(whole[:cut])
        assert isinstance(exif.read_exif(str(path)), dict)
        path.write_bytes(whole[:cut] + b"\xff" * 9 + whole[cut + 9 :])
        assert isinstance(exif.read_exif(str(path)), dict)


def test_exif_of_other_formats_and_tables(spark, tmp_path):
    import struct
    import zlib

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 6, 0, 0, 0)) + chunk(b"eXIf", tiff(">", {271: (2, b"P\0")})) + chunk(b"IEND", b"")
    for name, data in {"p.png": png, "g.gif": b"GIF89a" + struct.pack("<HH", 5, 4), "plain.jpg": jpeg(), "bad.jpg": b"\0\1not a picture"}.items():
        (tmp_path / name).write_bytes(data)
    rows = {os.path.basename(r["source_path"]): json.loads(r["exif"]) for r in exif.with_exif(files.scan(spark, str(tmp_path))).collect()}
    assert rows["p.png"] == {"format": "PNG", "mode": "RGBA", "width": 3, "height": 2, "Make": "P"}
    assert rows["g.gif"] == {"format": "GIF", "mode": "P", "width": 5, "height": 4} and rows["bad.jpg"] == {}
    assert rows["plain.jpg"] == {"format": "JPEG", "mode": "RGB", "width": 8, "height": 6} and exif.read_exif("/nowhere.jpg") == {}


class Fake:
    """A client that answers what it is told to and keeps what it was asked."""

    def __init__(self, said):
        self.said, self.asked, self.chat = said, [], self
        self.completions = self

    def create(self, **asked):
        self.asked.append(asked)
        message = type("M", (), {"content": self.said})
        return type("R", (), {"choices": [type("C", (), {"message": message})]})


def test_vision_backend(tmp_path, monkeypatch):
    from stowage.plans.classifiers import VisionClassifier, coerced

    path = tmp_path / "a.png"
    path.write_bytes(b"picture")
    backend = VisionClassifier("model-x", "http://localhost:1/v1", None, 7.0)
    assert backend.api_key and backend.timeout == 7.0
    backend._made = Fake('{"primary_subject": "", "objects": "oops", "tags": ["a", 1], "scene": "beach"}')
    assert coerced(backend.describe(str(path), {"Make": "Maker"})) == ("photo", "beach", [], "", ["a", "1"], "", "model-x")
    assert "Maker" in backend._made.asked[0]["messages"][0]["content"][0]["text"]
    asked = backend._made.asked[0]
    assert asked["response_format"] == {"type": "json_object"} and asked["messages"][0]["content"][1]["image_url"]["url"].startswith("data:image/png;base64,")
    for said in ("no json", "[1, 2]", "", None):
        backend._made = Fake(said)
        assert coerced(backend.describe(str(path), {})) == ("photo", "", [], "", [], "", "model-x")
    backend._made = Fake(" Birthdays ")
    assert backend.adjudicate("bdays", ["holidays", "birthdays"]) == "birthdays" and backend.adjudicate("x", ["holidays"]) is None
    backend._made = Fake("about 12, rather 500 or 400")
    assert backend.pick_class({"primary_subject": "x", "scene": "by the sea", "objects": ["boat"], "caption": "c"}) == "500"
    assert all(w in backend._made.asked[-1]["messages"][0]["content"] for w in ("by the sea", "boat"))
    backend._made = Fake("none")
    assert backend.pick_class({}) == "900"
    assert VisionClassifier("m").__getstate__()["_made"] is None
    monkeypatch.setitem(sys.modules, "openai", None)
    monkeypatch.setattr("importlib.util.find_spec", lambda name: None)
    with pytest.raises(RuntimeError, match="openai package"):
        VisionClassifier("m").client
