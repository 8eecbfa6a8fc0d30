"""Sharding by histogram sort: exact byte counts below candidate key boundaries.

The sort key is a hash of the text, then a hash of the id, so equal texts lie together. A
round counts the exact bytes of every child of the key intervals that still hold an unmet
splitter and probes the children's boundaries; it ends when each splitter's bytes are
within tolerance of its share. Only then are the rows exchanged, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelf.llm.common import Workspace

SHARDS = 8
#: Tolerated departure of a splitter, as a share of the mean shard.
TOLERANCE = 0.002
#: Key bits probed in a round: at most 2 ** BITS counts for each unmet splitter reach the driver.
BITS = 12
KEY_BITS = 63
#: Rows that one task numbers, about, and the most pieces that a shard is numbered in.
PIECE_ROWS, LEAST_PIECES, MOST_PIECES = 500_000, 32, 4096


def keyed(docs: DataFrame) -> DataFrame:
    """Narrow rows ``doc_id, k1, k2, size, text_crc32``; null texts count one byte."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    return docs.select(
        "doc_id",
        F.shiftrightunsigned(F.xxhash64("text"), 1).alias("k1"),
        F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(7)), 1).alias("k2"),
        size.alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
    )


def splitters(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """Lower ends ``(k1, k2)`` of shards 1 to ``shards - 1``.

    A splitter falls between two texts if that meets the tolerance; only a text whose copies
    outweigh it is cut, by the hash of the id. Rows equal in text and id cannot be told
    apart and stay together.
    """
    total = rows.agg(F.sum("size").alias("n")).first()["n"] or 0
    slack = tolerance * total / shards
    # An open interval: splitter number, its k1 if settled, known prefix and its bits, bytes below it.
    unmet = [(i, None, 0, 0, 0) for i in range(1, shards)]
    found: dict[int, tuple[int, int]] = {}
    while unmet:
        wanted = sorted({(k1, prefix, bits) for _, k1, prefix, bits, _ in unmet}, key=str)
        counts = {w: _children(rows, *w) for w in wanted}
        nxt = []
        for i, k1, prefix, bits, below in unmet:
            goal, step = total * i / shards, min(BITS, KEY_BITS - bits)
            deep = bits + step
            at, best, inside = below, None, None
            for child, (size, low, high) in counts[(k1, prefix, bits)]:
                best = min(best or (abs(at - goal), child), (abs(at - goal), child))
                if at < goal < at + size:
                    inside = (child, at, low, high)
                at += size
            last = (prefix + 1) << step
            best = min(best or (abs(at - goal), last), (abs(at - goal), last))
            if best[0] <= slack or inside is None:
                found[i] = _boundary(k1, best[1], KEY_BITS - deep)
            elif k1 is None and inside[2] == inside[3]:
                nxt.append((i, inside[2], 0, 0, inside[1]))
            elif deep < KEY_BITS:
                nxt.append((i, k1, inside[0], deep, inside[1]))
            else:
                found[i] = _boundary(k1, best[1], 0)
        unmet = nxt
    return [found[i] for i in range(1, shards)]


def _boundary(k1: int | None, value: int, shift: int) -> tuple[int, int]:
    key = min(value << shift, (1 << KEY_BITS) - 1)
    return (key, 0) if k1 is None else (k1, key)


def _children(rows: DataFrame, k1: int | None, prefix: int, bits: int) -> list[tuple[int, tuple[int, int, int]]]:
    """Exact bytes, least and greatest key of each child of one key interval, in order."""
    key = "k1" if k1 is None else "k2"
    step = min(BITS, KEY_BITS - bits)
    within = rows if k1 is None else rows.where(F.col("k1") == k1)
    if bits:
        low, width = prefix << (KEY_BITS - bits), 1 << (KEY_BITS - bits)
        within = within.where(F.col(key).between(low, low + (width - 1)))
    child = F.shiftrightunsigned(key, KEY_BITS - bits - step).alias("child")
    got = within.groupBy(child).agg(F.sum("size").alias("n"), F.min(key).alias("a"), F.max(key).alias("b")).collect()
    return sorted((r["child"], (r["n"], r["a"], r["b"])) for r in got)


def shard_of(bounds: list[tuple[int, int]]) -> Column:
    passed = [((F.col("k1") > a) | ((F.col("k1") == a) & (F.col("k2") >= b))).cast("int") for a, b in bounds]
    return sum(passed, F.lit(0)).cast("int")


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Place every row of ``docs`` (``doc_id, text``): ``doc_id, size, text_crc32, shard, slot``.

    Law ``bytes``: shards' sizes are equal within the tolerance (and the largest row). Slots
    count from 0 without gaps. Null texts are placed as a text of their own with size 1;
    rows repeated in full get slots of their own. Other columns are not read. An empty table
    gives an empty result.
    """
    ws = Workspace(docs.sparkSession, "sharding")
    rows = ws.save(keyed(docs), "rows")
    bounds = splitters(rows, shards, tolerance)
    n = rows.count()
    pieces = max(LEAST_PIECES, min(MOST_PIECES, -(-n // (shards * PIECE_ROWS))))
    placed = rows.select("doc_id", "size", "text_crc32", "k1", "k2", shard_of(bounds).alias("shard")).withColumn("piece", F.col("shard") * pieces + (F.col("k2") % pieces).cast("int"))
    counts = placed.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    # at most shards * MOST_PIECES rows
    base = counts.select("piece", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    order = Window.partitionBy("piece").orderBy("k1", "k2", "doc_id")
    return (
        placed.join(F.broadcast(base), "piece")
        .withColumn("slot", F.col("base") + F.row_number().over(order) - 1)
        .select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
