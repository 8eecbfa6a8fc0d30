"""Helpers shared by the corpus operators: tables, shared storage, words and shingles."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch; keeps a batch of very long texts within a worker's memory.
ARROW_ROWS = 500

#: White space that separates words: space and bytes 9 to 13.
SPACE_CLASS = r"[\x20\x09-\x0D]"

_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


#: A key with more than one row in so many counts as hot. There are fewer hot keys than this
#: in any table, which bounds what is broadcast to treat them apart.
HEAVY = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in local mode, where all is one machine, a temporary folder stands in for a setting
    that is missing; a cluster without one is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    import tempfile

    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shelf-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


@contextmanager
def setting(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots as double underscores) for a while; the caller's come back."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Workspace:
    """Tables written below the shared folder; they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        """Write a table and read it; the shuffle files behind it are of no more use and go."""
        path = f"{self.path}/{name}"
        with setting(self.spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
            df.write.option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(conf).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the caller's table does not have, in any case of its letters."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def join_spread(rows: DataFrame, found: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """Inner join with ``found``, one row for each key, whose ``count`` bounds a key's rows.

    Keys with over one in ``HEAVY`` of ``total`` rows are joined where their rows lie, by a
    broadcast of fewer than ``HEAVY`` keys for each ``total`` rows that the counts add up to;
    the others by Spark's usual join. So no key's rows meet in one task.
    """
    hot = F.col(count) * HEAVY > total
    heavy = F.broadcast(found.where(hot).drop(count))
    rest = rows.join(heavy.select(*on), on, "left_anti").join(found.where(~hot).drop(count), on)
    return rows.join(heavy, on).unionByName(rest)


def word_count(text: Column) -> Column:
    """Number of maximal runs without white space; null and blank texts have none."""
    pieces = F.size(F.split(text, SPACE_CLASS + "+", -1))
    ends = F.lit(" \t\n\u000b\f\r")
    first, last = F.substring(text, 1, 1), F.substring(text, -1, 1)
    edge = F.instr(ends, first).cast("boolean").cast("int") + F.instr(ends, last).cast("boolean").cast("int")
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(pieces - edge).cast("long")


def words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text with A-Z lower-cased (``bytes`` methods touch ASCII only)."""
    return text.lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words in order; fewer words make one shingle, no words none."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(k, n)
    acc = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n - width + 1 + i]
        acc ^= acc >> np.uint64(29)
    return mix(acc)


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    return np.unique(shingle_hashes(word_hashes(words(text)), k))


def bounded(batches: Iterable) -> Iterator:
    """Arrow batches cut to ``ARROW_ROWS`` rows, so that what is made of one fits in memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, ARROW_ROWS):
            yield batch.slice(at, ARROW_ROWS)


def texts_of(column) -> list:
    """UTF-8 bytes (or None) of an Arrow string column, without decoding."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
