"""Apply a plan: copy, move or overwrite files from Spark tasks, with a resumable journal.

Every step can be repeated: bytes go to a temporary file that is renamed into place, a
retried move finds its work done, and each task appends to a journal part of its own.
Outcomes are kept before anything counts them, so no action runs the sink twice.
Speculative execution must be off while a sink runs.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelf.options import Options
from shelf.schema import OUTCOME
from shelf.sources.tree import TEMP_PREFIX
from shelf.storage import keep

#: A file below the destination that stops operations which have not begun.
CANCEL = ".shelf-cancel"


def copy_file(source: str, dest: str) -> None:
    """Copy by way of a temporary file in the same folder; times and permissions follow."""
    folder = os.path.dirname(dest)
    temp = os.path.join(folder, f"{TEMP_PREFIX}{uuid.uuid4().hex}")
    try:
        with open(source, "rb") as a, open(temp, "wb") as b:
            shutil.copyfileobj(a, b, 1 << 20)
            b.flush()
            os.fsync(b.fileno())
        shutil.copystat(source, temp)
        os.replace(temp, dest)
    except BaseException:
        if os.path.exists(temp):
            os.unlink(temp)
        raise


def move_file(source: str, dest: str, size: int) -> None:
    """Rename, or across devices copy and only then remove the source."""
    if not os.path.exists(source) and os.path.exists(dest) and os.path.getsize(dest) == size:
        return  # an earlier attempt got this far
    try:
        os.replace(source, dest)
    except OSError as err:
        import errno

        if err.errno != errno.EXDEV:
            raise
        copy_file(source, dest)
        os.unlink(source)


def perform(op, source_root: str, dest_root: str) -> str | None:
    """Apply one operation; the text of the error, or None."""
    try:
        source, dest = os.path.join(source_root, op.source_rel), os.path.join(dest_root, op.dest_rel)
        os.makedirs(os.path.dirname(dest), exist_ok=True)
        if op.action == "move":
            move_file(source, dest, op.bytes)
        else:
            copy_file(source, dest)
    except PermissionError:
        return "permission denied"
    except FileNotFoundError:
        return "source vanished"
    except OSError as err:
        return f"{op.action} failed: {err.strerror or err}"
    return None


def run(operations: DataFrame, opts: Options) -> DataFrame:
    """Outcome rows: the operations with ``error`` and ``attempted``.

    Skips are reported without touching a file, and so is everything in a dry run. The
    pending operations are dealt to ``copy_workers`` tasks.
    """
    opts = opts.normal()
    source_root, dest_root, dry = opts.source, opts.dest, opts.dry_run
    journal = opts.journal

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log = None
        try:
            for frame in frames:
                errors, tried = [], []
                for op in frame.itertuples(index=False):
                    stop = not dry and os.path.exists(os.path.join(dest_root, CANCEL))
                    tried.append(op.action == "skip" or not stop)
                    if op.action == "skip" or dry or stop:
                        errors.append(None)
                        continue
                    errors.append(perform(op, source_root, dest_root))
                    if errors[-1] is None and journal:
                        if log is None:
                            part = Path(journal)
                            if not part.is_file():  # a file to resume from is appended to
                                part.mkdir(parents=True, exist_ok=True)
                                part /= f"part-{uuid.uuid4().hex}.jsonl"
                            log = part.open("a")
                        log.write(json.dumps({"source": op.source_rel, "destination": op.dest_rel}) + "\n")
                        log.flush()
                yield frame.assign(error=pd.Series(errors, dtype=object, index=frame.index), attempted=tried)
        finally:
            if log is not None:
                log.close()

    return keep(operations.repartition(opts.copy_workers).mapInPandas(apply, OUTCOME))


def sweep(dest_root: str) -> int:
    """Remove temporary files that killed tasks have left; how many there were."""
    found = [p for p in Path(dest_root).rglob(f"{TEMP_PREFIX}*") if p.is_file()]
    for p in found:
        p.unlink(missing_ok=True)
    return len(found)


def counters(outcomes: DataFrame) -> DataFrame:
    """One row of what was done, from kept outcomes rather than accumulators."""
    ok, done = F.col("error").isNull(), F.col("attempted") & F.col("error").isNull()
    pending = F.col("action") != "skip"
    return outcomes.agg(
        *[F.count_if(done & (F.col("action") == a)).alias(n) for a, n in (("copy", "copied"), ("move", "moved"), ("overwrite", "overwritten"), ("skip", "skipped"))],
        F.count_if(~ok).alias("failed"),
        F.coalesce(F.sum(F.when(done & pending, F.col("bytes"))), F.lit(0)).alias("bytes"),
        F.count_if(~F.col("attempted")).alias("unattempted"),
    )
