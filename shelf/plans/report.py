"""Reports: a JSON record for each file, a summary object, and lines for people."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelf.options import Options


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def records(outcomes: DataFrame) -> DataFrame:
    """``pos, value``: one JSON line for each operation; absent fields are left out."""
    fields = F.struct(
        slashes(F.col("source_rel")).alias("source"), slashes(F.col("dest_rel")).alias("destination"), "action", "reason", "bytes",
        slashes(F.col("duplicate_of")).alias("duplicate_of"), "error",
    )
    return outcomes.select("pos", F.to_json(fields).alias("value"))


def human_lines(outcomes: DataFrame) -> DataFrame:
    """``pos, value``: one readable line for each operation."""
    source, dest = slashes(F.col("source_rel")), F.coalesce(slashes(F.col("dest_rel")), F.lit("-"))
    say = lambda *parts: F.concat(source, F.lit(" -> "), *parts)
    line = (
        F.when(F.col("error").isNotNull(), say(F.lit("FAILED: "), F.col("error")))
        .when(F.col("reason").startswith("duplicate-of-"), say(F.lit("SKIP: duplicate of "), F.coalesce(slashes(F.col("duplicate_of")), dest)))
        .when((F.col("reason") == "existing-file") & (F.col("action") == "skip"), say(F.lit("SKIP: exists "), dest))
        .when(F.col("reason") == "already-done", say(F.lit("SKIP: already done")))
        .otherwise(say(dest))
    )
    return outcomes.select("pos", line.alias("value"))


def human_bytes(n: int) -> str:
    """Whole bytes, or one decimal in binary units up to TiB."""
    value, unit = float(n), 0
    units = ("B", "KiB", "MiB", "GiB", "TiB")
    while value >= 1024 and unit < len(units) - 1:
        value, unit = value / 1024, unit + 1
    return f"{n} B" if unit == 0 else f"{value:.1f} {units[unit]}"


def summary(opts: Options, scanned: int, stats: dict, done: dict, failures: list[str], cancelled: bool = False) -> dict:
    """The summary object; ``failures`` is left out when there are none."""
    out = {
        "type": "summary", "source_root": opts.source.replace("\\", "/"), "dest_root": opts.dest.replace("\\", "/"), "dry_run": opts.dry_run,
        "scanned": scanned, "planned": stats["pending"], "copied": done["copied"], "moved": done["moved"], "overwritten": done["overwritten"],
        "skipped": done["skipped"], "duplicates": stats["duplicates"], "renamed": stats["renamed"], "resumed": stats["resumed"],
        "unshippable": stats["unshippable"], "failed": done["failed"], "bytes": done["bytes"], "cancelled": cancelled, "unattempted": done["unattempted"],
    }
    return out | ({"failures": failures} if failures else {})


def summary_text(s: dict, stats: dict) -> str:
    verb = "would process" if s["dry_run"] else "processed"
    lines = [
        f"{verb} {s['copied'] + s['moved'] + s['overwritten']} of {s['scanned']} files ({human_bytes(s['bytes'])})",
        f"  duplicates {stats['duplicates']}  renamed {stats['renamed']}  existing {stats['skipped_existing']}  resumed {stats['resumed']}  unshippable {stats['unshippable']}",
    ]
    if s["failed"]:
        lines.append(f"  {s['failed']} files failed")
    if s["cancelled"]:
        lines.append(f"  interrupted: {s['unattempted']} operations were not started")
    return "\n".join(lines)


def exit_code(s: dict, scan_failures: int = 0) -> int:
    """0 if all went well, 1 after any failure or interruption."""
    return int(bool(s["failed"] or scan_failures or s["cancelled"]))


def as_json(s: dict) -> str:
    return json.dumps(s, separators=(",", ":"), ensure_ascii=False)
