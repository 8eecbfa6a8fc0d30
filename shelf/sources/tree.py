"""File trees as a Spark data source: listing, classification, and one-open extraction.

``spark.read.format("shelf_tree").option("root", ...).option("mode", "extract" | "list")``.
The driver lists folders only; each partition walks its share and opens each file once.
"""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from shelf.functions.dates import date_chain, exif_timestamp, filename_timestamp, local_timestamp
from shelf.functions.names import EXTENSIONS, base_name, signature_matches
from shelf.options import Options
from shelf.schema import LISTING
from shelf.sources import exif

TEMP_PREFIX = ".shelf-tmp-"
HEAD, CHUNK = 16, 1 << 20
RAW = (
    "rel_path string, size long, kind string, head binary, original string, create string, modify string, "
    "offset_time string, camera_make string, camera_model string, gps struct<lat:float,lon:float>, "
    "mtime timestamp, birth timestamp, digest string, error string"
)
_KIND_OF = {ext: kind for kind, exts in EXTENSIONS.items() for ext in exts}


def kind_of(name: str) -> str | None:
    head, dot, ext = name.rpartition(".")
    return _KIND_OF.get(ext.lower() if ext.isascii() else ext) if dot and head else None


@dataclass
class Folders(InputPartition):
    root: str
    folders: tuple[str, ...]


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _instant(seconds: float | None):
    import datetime as dt

    return None if seconds is None else dt.datetime.fromtimestamp(seconds, dt.timezone.utc)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options.get("root") or ""
        self.mode = options.get("mode", "extract")
        self.follow = options.get("followsymlinks", "false") == "true"
        self.sidecars = options.get("includesidecars", "true") == "true"
        self.parts = int(options.get("partitions", "16"))
        self.digests = options.get("digests", "true") == "true"

    def partitions(self) -> list[Folders]:
        """Folders dealt out in turn; a missing root has none. Loops are entered once."""
        found, seen = [], set()
        todo = [""] if os.path.isdir(self.root) else []
        while todo:
            rel = todo.pop()
            path = os.path.join(self.root, rel)
            try:
                mark = os.stat(path)
                if (mark.st_dev, mark.st_ino) in seen:
                    continue
                seen.add((mark.st_dev, mark.st_ino))
                found.append(rel)
                with os.scandir(path) as entries:
                    todo += [os.path.join(rel, e.name) for e in entries if e.is_dir(follow_symlinks=self.follow and self.mode == "extract")]
            except OSError:
                continue  # an unreadable folder is passed over, like any walk error
        n = max(1, min(self.parts, len(found)))
        return [Folders(self.root, tuple(found[i::n])) for i in range(n)]

    def read(self, partition: Folders) -> Iterator[tuple]:
        for rel in partition.folders:
            try:
                entries = sorted(os.scandir(os.path.join(partition.root, rel)), key=lambda e: e.name)
            except OSError:
                continue
            for e in entries:
                if not e.name.isprintable() and any(0xD800 <= ord(c) <= 0xDFFF for c in e.name):
                    continue  # not valid Unicode
                path = os.path.join(rel, e.name)
                if self.mode == "list":
                    yield from self._listed(e, path)
                elif e.is_file(follow_symlinks=self.follow) and not e.name.startswith(TEMP_PREFIX):
                    kind = kind_of(e.name)
                    if kind and (self.sidecars or kind != "sidecar"):
                        yield self._extracted(e, path, kind)

    def _listed(self, e: os.DirEntry, path: str) -> Iterator[tuple]:
        if e.is_dir(follow_symlinks=False):
            yield path, None, True, None
            return
        try:
            size = e.stat(follow_symlinks=False).st_size
            regular = stat.S_ISREG(e.stat(follow_symlinks=False).st_mode)
            yield path, size, False, file_digest(e.path) if regular and self.digests else None
        except OSError:
            yield path, None, False, None

    def _extracted(self, e: os.DirEntry, path: str, kind: str) -> tuple:
        none = (None,) * 8
        try:
            with open(e.path, "rb") as f:
                facts, mark = exif.Facts(), os.fstat(f.fileno())
                start = f.read(HEAD)
                digest = hashlib.sha256(start) if self.digests else None
                while digest and (block := f.read(CHUNK)):
                    digest.update(block)
                if kind in ("image", "raw"):
                    facts = exif.read(exif.View(f))
        except PermissionError:
            return (path, None, kind, *none, None, None, None, "permission denied")
        except OSError as err:
            return (path, None, kind, *none, None, None, None, f"unreadable: {err.strerror or err}")
        birth = getattr(mark, "st_birthtime", None)
        given = (facts.original, facts.create, facts.modify, facts.offset, facts.make, facts.model, facts.gps)
        return (path, mark.st_size, kind, start[:HEAD], *given, _instant(mark.st_mtime), _instant(birth), digest.hexdigest() if digest else None, None)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shelf_tree"

    def schema(self) -> str:
        return LISTING if self.options.get("mode") == "list" else RAW

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TreeSource)


def scan(spark: SparkSession, opts: Options) -> tuple[DataFrame, DataFrame]:
    """``(records, failures)`` of the source tree.

    A file whose signature does not fit its extension keeps its place but loses its EXIF.
    The tree is read once and kept, so later steps see one state of it.
    """
    from shelf.storage import keep

    register(spark)
    read = _reader(spark, opts.source, "extract", opts.dedup != "off")
    raw = read.option("followsymlinks", str(opts.follow_symlinks).lower()).option("includesidecars", str(opts.include_sidecars).lower()).load()
    now = opts.now_year
    ok = signature_matches(F.col("kind"), F.col("head"))
    trusted = lambda c: F.when(ok, F.col(c))
    named = filename_timestamp(base_name(F.col("rel_path")), now) if opts.filename_dates else F.lit(None).cast("timestamp_ntz")
    chain = date_chain(
        exif_timestamp(trusted("original"), now),
        exif_timestamp(trusted("create"), now),
        named,
        local_timestamp(F.col("mtime"), now),
        local_timestamp(F.col("birth"), now),
        exif_timestamp(trusted("modify"), now),
    )
    rows = raw.withColumn("_date", chain).select(
        "rel_path", "size", "kind", "_date.taken", "_date.date_source", trusted("gps").alias("gps"), trusted("offset_time").alias("offset_time"),
        trusted("camera_make").alias("camera_make"), trusted("camera_model").alias("camera_model"), ok.alias("signature_ok"), "digest", "error",
    )
    rows = keep(rows)
    return rows.where("error is null").drop("error"), rows.where("error is not null").select("rel_path", "error")


def _reader(spark: SparkSession, root: str, mode: str, digests: bool) -> DataFrameReader:
    """A reader of a tree in four tasks for each core; files are read whole for digests only."""
    parts = max(16, 4 * spark.sparkContext.defaultParallelism)
    read = spark.read.format("shelf_tree").option("root", root).option("mode", mode)
    return read.option("partitions", parts).option("digests", str(digests).lower())


def listing(spark: SparkSession, root: str, digests: bool = True) -> DataFrame:
    """Everything below the destination, folders too; a missing root is empty.

    Without ``digests`` no file is opened.
    """
    from shelf.storage import keep

    register(spark)
    return keep(_reader(spark, str(Path(root)), "list", digests).load())
