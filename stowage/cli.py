"""Command line: process, watch, verify, catalog list, catalog get."""

from __future__ import annotations

import argparse
import logging
import os
import signal
import sys
import threading
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage import __version__
from stowage.functions import constants as C
from stowage.operators import catalog as K
from stowage.operators import dedup
from stowage.plans.classifiers import StubClassifier, VisionClassifier
from stowage.plans.organize import Organizer, verify_tree
from stowage.session import stored, tallied, temporary_tables
from stowage.sources import files
from stowage.streaming.breaker import Breaker
from stowage.streaming.watch import PassStats, guarded, watch, watch_stream


def _env(name: str, default):
    return type(default)(os.environ.get(f"STOWAGE_{name}", default))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stowage")
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("--log-level", default="WARNING")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("process", "watch"):
        q = sub.add_parser(name)
        q.add_argument("source")
        q.add_argument("--organized-dir", required=True)
        q.add_argument("--catalog", required=name == "watch")
        q.add_argument("--duplicates-dir")
        q.add_argument("--sidecars", action="store_true")
        q.add_argument("--no-recursive", dest="recursive", action="store_false")
        q.add_argument("--backend", choices=("stub", "vision"), default=_env("BACKEND", "stub"))
        q.add_argument("--model", default=_env("MODEL", ""))
        q.add_argument("--base-url", default=os.environ.get("STOWAGE_BASE_URL"))
        q.add_argument("--ai-timeout", type=float, default=_env("AI_TIMEOUT", 60.0))
        q.add_argument("--trip-threshold", type=int, default=_env("TRIP_THRESHOLD", C.TRIP_THRESHOLD), help="failures in a row that stop the run (0: none)")
        if name == "process":
            q.add_argument("--dry-run", action="store_true")
        else:
            q.add_argument("--interval", type=float, default=_env("INTERVAL", C.POLL_SECONDS))
            q.add_argument("--breaker-backoff", type=float, default=_env("BREAKER_BACKOFF", C.BACKOFF_BASE))
            q.add_argument("--breaker-backoff-cap", type=float, default=_env("BREAKER_BACKOFF_CAP", C.BACKOFF_CAP))
            q.add_argument("--checkpoint", default=os.environ.get("STOWAGE_CHECKPOINT"), help="a folder: watch as a stream, which goes on from there after a restart")
            q.add_argument("--poison-limit", type=int, default=_env("POISON_LIMIT", C.POISON_LIMIT))
            q.add_argument("--quarantine-dir", default=os.environ.get("STOWAGE_QUARANTINE_DIR"))
    q = sub.add_parser("verify")
    q.add_argument("path")
    kinds = sub.add_parser("catalog").add_subparsers(dest="what", required=True)
    q = kinds.add_parser("list")
    q.add_argument("--catalog", required=True)
    q.add_argument("--limit", type=int, default=C.LIST_LIMIT)
    q = kinds.add_parser("get")
    q.add_argument("--catalog", required=True)
    q.add_argument("digest")
    return p


def _organizer(spark: SparkSession, a) -> Organizer:
    if a.backend == "vision":
        VisionClassifier.available()
    backend = VisionClassifier(a.model, a.base_url, os.environ.get("STOWAGE_API_KEY"), a.ai_timeout) if a.backend == "vision" else StubClassifier()
    dry = getattr(a, "dry_run", False)
    return Organizer(K.Catalog(spark, a.catalog or f"{a.organized_dir}/.catalog"), a.organized_dir, backend, a.duplicates_dir, a.sidecars, dry)


def process(spark: SparkSession, a) -> int:
    try:
        organizer, breaker = _organizer(spark, a), Breaker(a.trip_threshold)
    except RuntimeError as error:
        print(error, file=sys.stderr)
        return 1
    with temporary_tables(spark):
        listed, found = tallied(files.scan(spark, a.source, a.recursive), F.count("*").alias("n"))
        parts = [part for part, _ in guarded(organizer, listed, breaker, found["n"])]
        results = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "source_path string, status string, error string")
        results = results.where("status <> 'untried'")
        s = dedup.run_stats(results).first()
        for row in results.where("status = 'error'").orderBy("source_path").toLocalIterator():
            print(f"FAIL {row['source_path']}: {row['error']}", file=sys.stderr)
    organizer.catalog.vacuum()
    if a.dry_run:
        print("dry run: nothing was written")
    print(f"total {s['total']}, copied {s['copied']}, duplicates {s['duplicates']}, skipped {s['skipped']}, errors {s['errors']}")
    if breaker.is_open:
        print(f"the backend appears down: stopped after {breaker.threshold} failures in a row ({s['copied'] + s['duplicates']} processed)", file=sys.stderr)
    return int(s["errors"] > 0 or breaker.is_open)


def verify(spark: SparkSession, a) -> int:
    verdicts = stored(verify_tree(spark, a.path))
    n = {r["verdict"]: r["n"] for r in verdicts.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    for row in verdicts.where("verdict <> 'SKIP'").orderBy("source_path").toLocalIterator():
        print(f"{row['verdict']:4} {row['source_path']}", file=sys.stderr if row["verdict"] == "FAIL" else sys.stdout)
    ok, bad = n.get("OK", 0), n.get("FAIL", 0)
    print(f"verified {ok + bad} ({n.get('SKIP', 0)} skipped): {ok} OK, {bad} FAILED")
    return int(bad > 0 or ok + bad == 0)


def catalog_list(spark: SparkSession, a) -> int:
    lines = [r["line"] for r in K.listing(K.Catalog(spark, a.catalog).read("photos"), a.limit).orderBy("id").collect()]
    print("\n".join(lines) or "(empty catalog)")
    return 0


def catalog_get(spark: SparkSession, a) -> int:
    row = K.Catalog(spark, a.catalog).get(a.digest).withColumn("exif", F.try_parse_json("exif")).select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("json")).first()
    print(row["json"] if row else f"Not found: {a.digest}", file=sys.stdout if row else sys.stderr)
    return int(row is None)


def watching(spark: SparkSession, a) -> int:
    stop = threading.Event()
    for s in (signal.SIGINT, signal.SIGTERM):
        signal.signal(s, lambda *_: stop.set())
    organizer, breaker = _organizer(spark, a), Breaker(a.trip_threshold, a.breaker_backoff, cap=a.breaker_backoff_cap)
    options = {"breaker": breaker, "recursive": a.recursive, "poison_limit": a.poison_limit, "quarantine_dir": a.quarantine_dir}
    if not a.checkpoint:
        print(watch(organizer, a.source, a.interval, stop, **options))
        return 0
    passes: list[PassStats] = []
    run = watch_stream(organizer, a.source, a.checkpoint, a.interval, report=passes.append, **options)
    while run.isActive and not stop.wait(1):
        pass
    run.stop()
    print(sum(passes, PassStats()))
    return int(run.exception() is not None)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    logging.basicConfig(level=a.log_level)
    spark = spark or SparkSession.builder.appName("stowage").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    run = {"process": process, "watch": watching, "verify": verify, "list": catalog_list, "get": catalog_get}
    return run[getattr(a, "what", a.command)](spark, a)


if __name__ == "__main__":
    sys.exit(main())
