"""Duplicates by bytes: within the source, against the destination, and staged digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes hashed at either end before a whole file is read.
EDGE = 65_536


def edge_digest(content: Column) -> Column:
    """Digest of size, first 64 KiB, and last 64 KiB of contents over 128 KiB."""
    size = F.octet_length(content)
    tail = F.when(size > 2 * EDGE, F.substring(content, -EDGE, EDGE)).otherwise(F.lit("").cast("binary"))
    return F.sha2(F.concat(size.cast("string").cast("binary"), F.lit(":").cast("binary"), F.substring(content, 1, EDGE), tail), 256)


def full_digest(content: Column) -> Column:
    return F.sha2(content, 256)


def staged_classes(rows: DataFrame, key: str, content: str) -> DataFrame:
    """``key, class``: rows of equal bytes share a class, the smallest key among them.

    Three stages, cheapest first: sizes that occur once settle their row; then edges; whole
    contents are hashed only where size and edges collide. Null contents are unreadable and
    equal nothing.
    """
    sized = rows.select(F.col(key).alias("key"), F.octet_length(content).alias("size"))
    twice = sized.where("size is not null").groupBy("size").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("size")
    edges = rows.withColumn("_size", F.octet_length(content)).join(twice, F.col("_size") == F.col("size"), "left_semi")
    edges = edges.select(F.col(key).alias("key"), F.col("_size").alias("size"), edge_digest(F.col(content)).alias("edge"), F.col(content).alias("content"))
    met = edges.groupBy("size", "edge").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("size", "edge")
    full = edges.join(met, ["size", "edge"], "left_semi").select(
        "key", "size", F.when(F.col("size") > EDGE, full_digest(F.col("content"))).otherwise(F.col("edge")).alias("digest")
    )
    first = full.groupBy("size", "digest").agg(F.min("key").alias("class"))
    classed = full.join(first, ["size", "digest"]).select("key", "class")
    return sized.select("key").join(classed, "key", "left").select(F.col("key").alias(key), F.coalesce("class", "key").alias("class"))


def destination_match(rows: DataFrame, listing: DataFrame) -> DataFrame:
    """Append ``dest_match``: the first path at the destination with equal size and digest.

    Rows without a digest match nothing. Destination copies are aggregated to one path
    before the join.
    """
    held = listing.where("not is_dir and digest is not null").groupBy("size", "digest").agg(F.min("path").alias("dest_match"))
    return rows.join(held, ["size", "digest"], "left")


def source_twins(rows: DataFrame, resumed: str = "resumed", match: str = "dest_match") -> DataFrame:
    """Append ``twin_pos``: position of the first earlier twin that is remembered.

    Remembered are rows resumed from a journal and rows without a copy at the destination.
    A row with ``twin_pos`` below its own ``pos`` that is not resumed duplicates that row.
    The first position of a digest class is aggregated, then joined, so a class of any size
    is pre-aggregated.
    """
    remembered = F.col(resumed) | F.col(match).isNull()
    first = rows.where("digest is not null").where(remembered).groupBy("size", "digest").agg(F.min("pos").alias("twin_pos"))
    return rows.join(first, ["size", "digest"], "left")
