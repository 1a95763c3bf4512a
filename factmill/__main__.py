"""Command line: ``python -m factmill --manifest FILE`` or ``--request FILE`` (``-`` is stdin)."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from factmill.sources import manifest as M
from factmill.sources.factstore import refresh, stored_classes
from factmill.sources.scan import scan_project

log = logging.getLogger("factmill")


def _session() -> SparkSession:
    return SparkSession.builder.appName("factmill").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _scan(spark: SparkSession, m: M.Manifest, cache_dir: str | None):
    files = scan_project(spark, m.root, m.targets, m.vendor_whitelist, m.max_files, m.max_depth, project_id=m.root)
    classes = None
    if m.cache_enabled:
        at = cache_dir or f"{m.root}/.factmill/cache/v3"
        r = refresh(spark, at, files.drop("partial"), m.features, m.cache_kind)
        log.info("cache=%d hit(s), %d miss(es)", r.hits, r.misses)
        classes = stored_classes(r.facts)
    return files.drop("partial"), files.groupBy("project_id").agg(F.max("partial").alias("partial")), classes


def _project(spark: SparkSession, m: M.Manifest):
    """The project, which has a document even without files or routes."""
    return spark.createDataFrame([(m.root,)], "project_id string")


def run(m: M.Manifest, spark: SparkSession | None = None, cache_dir: str | None = None, stamp: bool = False) -> tuple[str, str]:
    """(pretty JSON, digest) of a manifest's project."""
    from factmill.plans.summary import summary

    spark = spark or _session()
    files, partial, classes = _scan(spark, m, cache_dir)
    when = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'") if stamp else None
    row = summary(files, m.features, partial, when, pretty=True, classes=classes, projects=_project(spark, m)).first()
    return row.document, row.sha256


def respond(r: M.Request, spark: SparkSession | None = None, cache_dir: str | None = None) -> tuple[str, str]:
    """(compact JSON, digest) of a request's response."""
    from factmill.plans.contract import answer

    spark = spark or _session()
    files, partial, classes = _scan(spark, r.manifest, cache_dir)
    routes = M.routes_table(spark, r, r.manifest.root)
    row = answer(files, routes, F.lit(r.request_id), F.lit(r.fingerprint), r.manifest.features, partial, classes, _project(spark, r.manifest), r.version).first()
    return row.document, row.sha256


def _read(at: str) -> tuple[str, str | None]:
    try:
        return (sys.stdin.read(), None) if at == "-" else (Path(at).read_text(), at)
    except OSError as e:
        raise M.InvalidInput("failed to read input", str(e)) from None


def main(argv: list[str] | None = None) -> int:
    """0 on success; 1 for invalid input, 2 for anything else, with one line of JSON on stderr."""
    p = argparse.ArgumentParser("factmill")
    which = p.add_mutually_exclusive_group()
    which.add_argument("--manifest")
    which.add_argument("--request")
    p.add_argument("--out", default="-")
    p.add_argument("--cache-dir")
    p.add_argument("--log-level", choices=("error", "warn", "info", "debug"), default="warn")
    p.add_argument("--quiet", action="store_true")
    p.add_argument("--no-color", action="store_true")
    p.add_argument("--print-hash", action="store_true")
    p.add_argument("--stamp", action="store_true")
    args = p.parse_args(argv)
    level = "error" if args.quiet else args.log_level
    logging.basicConfig(level={"warn": "WARNING"}.get(level, level.upper()), stream=sys.stderr, format="%(levelname)s %(message)s")
    try:
        at = args.manifest or args.request
        if at is None:
            if sys.stdin.isatty():
                raise M.InvalidInput("either --manifest or --request is required")
            at = "-"
        text, source = _read(at)
        if args.request:
            document, digest = respond(M.load_request(text, source), cache_dir=args.cache_dir)
        else:
            document, digest = run(M.load_manifest(text, source), cache_dir=args.cache_dir, stamp=args.stamp)
        if args.out == "-":
            print(document)
        else:
            Path(args.out).parent.mkdir(parents=True, exist_ok=True)
            Path(args.out).write_text(document)
        if args.print_hash:
            print(f"canonical_sha256={digest}", file=sys.stderr)
        return 0
    except M.InvalidInput as e:
        error = {"type": "validation", "message": str(e)} | ({"details": {"underlying_error": e.cause}} if e.cause else {}) | {"exit_code": 1}
    except Exception as e:
        error = {"type": "internal", "message": "analysis failed", "details": {"underlying_error": str(e)[:2000]}, "exit_code": 2}
    print(json.dumps(error), file=sys.stderr)
    return error["exit_code"]


if __name__ == "__main__":
    sys.exit(main())
