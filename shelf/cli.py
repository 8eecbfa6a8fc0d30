"""Command line: scan, plan, check, apply, report."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelf.functions.template import TemplateError, parse, uses_location
from shelf.operators.geo import countries
from shelf.options import CONFLICTS, DEDUP, GRANULARITIES, LOCATION_SUFFIX, MODES, Options
from shelf.plans import execute, report, safety
from shelf.plans.planner import build, stats
from shelf.sources import gazetteer as places
from shelf.sources import journal as journals
from shelf.sources import tree
from shelf.storage import keep


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("shelf", description="Sort media files into dated folders.")
    p.add_argument("source")
    p.add_argument("dest")
    p.add_argument("--group", choices=GRANULARITIES, default="month")
    p.add_argument("--location", choices=tuple(LOCATION_SUFFIX))
    p.add_argument("--template")
    p.add_argument("--mode", choices=MODES, default="copy")
    p.add_argument("--on-conflict", choices=CONFLICTS, default="rename")
    p.add_argument("--dedup", choices=DEDUP, default="size-hash")
    p.add_argument("--copy-workers", type=int, default=4)
    p.add_argument("--adaptive-threshold", type=int, default=400)
    p.add_argument("--resume")
    p.add_argument("--journal")
    p.add_argument("--gazetteer", help="Parquet, tab-separated .txt, or .csv table of places")
    p.add_argument("--format", choices=("human", "jsonl"), default="human")
    for flag in ("dry-run", "force", "include-video", "follow-symlinks", "no-sidecars", "no-filename-dates", "quiet"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("-v", "--verbose", action="count", default=0)
    return p


def log_level(quiet: bool, verbose: int) -> str:
    return "ERROR" if quiet else ("WARNING", "INFO", "DEBUG")[min(verbose, 2)]


def options(args: argparse.Namespace) -> Options:
    return Options(
        source=args.source, dest=args.dest, group=args.group, location=args.location, template=args.template, mode=args.mode,
        dry_run=args.dry_run, on_conflict=args.on_conflict, force=args.force, dedup=args.dedup, copy_workers=args.copy_workers,
        adaptive_threshold=args.adaptive_threshold, include_sidecars=not args.no_sidecars, include_video=args.include_video,
        filename_dates=not args.no_filename_dates, follow_symlinks=args.follow_symlinks, resume=args.resume, journal=args.journal,
    ).normal()


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".txt"):
        return places.read_dump(spark, path)
    return places.read_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path)


def run(spark: SparkSession, opts: Options, gazetteer: DataFrame | None = None, form: str = "human", quiet: bool = False, out=None) -> tuple[int, dict]:
    """One whole run; the exit code and the summary."""
    out = out or sys.stdout
    opts = safety.prepare(opts.normal())
    for level in ("year", "month", "week") if opts.adaptive else (None,):
        parse(opts.template_for(level))
    records, failures = tree.scan(spark, opts)
    done = journals.read(spark, opts.resume) if opts.resume else None
    at_dest = tree.listing(spark, opts.dest, digests=opts.dedup != "off")
    names = countries(spark) if gazetteer is not None and uses_location(opts.template_for()) else None
    plan = keep(build(records, opts, done, at_dest, gazetteer, names))
    counted = stats(plan, records, opts.include_video).first().asDict()
    safety.check_space(opts, counted["pending_bytes"])
    outcomes = execute.run(plan, opts)
    did = execute.counters(outcomes).first().asDict()
    if not opts.dry_run:
        execute.sweep(opts.dest)
    bad = failures.select(F.concat_ws(": ", "rel_path", "error").alias("m")).unionByName(
        outcomes.where("error is not null").select(F.concat_ws(": ", "source_rel", "error").alias("m"))
    )
    messages = [r["m"] for r in bad.orderBy("m").toLocalIterator()]
    done_all = report.summary(opts, records.count() + failures.count(), counted, did, messages, cancelled=did["unattempted"] > 0)
    if form == "jsonl" or not quiet:
        lines = report.records(outcomes) if form == "jsonl" else report.human_lines(outcomes)
        for r in lines.orderBy("pos").toLocalIterator():
            print(r["value"], file=out)
    if form == "jsonl":
        print(report.as_json(done_all), file=out)
    elif not quiet:
        print(report.summary_text(done_all, counted), file=sys.stderr)
    return report.exit_code(done_all, failures.count()), done_all


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=log_level(args.quiet, args.verbose))
    spark = SparkSession.builder.appName("shelf").config("spark.speculation", "false").getOrCreate()
    try:
        table = read_gazetteer(spark, args.gazetteer) if args.gazetteer else None
        return run(spark, options(args), table, args.format, args.quiet)[0]
    except (safety.Fatal, TemplateError, ValueError) as err:
        print(f"error: {err}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
