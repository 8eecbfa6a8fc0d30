"""Checks before a run: what would be unsafe is refused before anything is written."""

from __future__ import annotations

import os
import shutil
import uuid
from pathlib import Path

from shelf.options import Options
from shelf.sources.tree import TEMP_PREFIX


class Fatal(Exception):
    """An error that ends the run with exit code 2; ``code`` names it."""

    def __init__(self, code: str, detail: str):
        super().__init__(detail)
        self.code = code


def overlap(a: str, b: str) -> bool:
    """Whether one path is the other or lies below it, component by component."""
    x, y = Path(a).parts, Path(b).parts
    n = min(len(x), len(y))
    return x[:n] == y[:n]


def prepare(opts: Options) -> Options:
    """Options with both roots made absolute; raises ``Fatal``.

    The destination is made only after the first overlap test and not in a dry run.
    """
    from dataclasses import replace

    if opts.on_conflict == "overwrite" and not opts.force:
        raise Fatal("overwrite-needs-force", "overwriting existing files needs force")
    if not os.path.isdir(opts.source):
        raise Fatal("source", f"not a folder: {opts.source}")
    source, dest = os.path.abspath(opts.source), os.path.abspath(opts.dest)
    if overlap(source, dest) or overlap(os.path.realpath(source), os.path.realpath(dest)):
        raise Fatal("overlap", "source and destination overlap")
    if not opts.dry_run:
        try:
            os.makedirs(dest, exist_ok=True)
            probe = Path(dest) / f"{TEMP_PREFIX}{uuid.uuid4().hex}"
            probe.touch()
            probe.unlink()
        except OSError as err:
            raise Fatal("destination", f"cannot write to {dest}: {err.strerror}") from err
    return replace(opts, source=os.path.realpath(source), dest=os.path.realpath(dest))


def check_space(opts: Options, pending_bytes: int) -> None:
    """Copies must fit; where free space is unknown, they are let through."""
    if opts.mode != "copy":
        return
    at = Path(opts.dest)
    while not at.exists() and at != at.parent:
        at = at.parent
    try:
        free = shutil.disk_usage(at).free
    except OSError:
        return
    if free < pending_bytes:
        raise Fatal("disk-full", f"{pending_bytes} bytes needed, {free} free")
