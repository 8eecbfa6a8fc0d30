"""Companion groups, their primary member, and adaptive levels, all as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelf.functions.names import ascii_lower, base_name, folder, path_order, stem
from shelf.options import DATE_SOURCES, KINDS


def rank_of(value: Column, order: tuple[str, ...]) -> Column:
    """Position in a fixed order; values outside it come last."""
    return F.coalesce(*[F.when(value == v, F.lit(i)) for i, v in enumerate(order)], F.lit(len(order)))


def companion_key(records: DataFrame) -> DataFrame:
    """Append ``dir`` and ``stem`` (ASCII-folded): files alike in both belong together."""
    name = base_name(F.col("rel_path"))
    return records.withColumn("dir", folder(F.col("rel_path"))).withColumn("stem", ascii_lower(stem(name)))


def with_primary(records: DataFrame, include_video: bool = False) -> DataFrame:
    """Append ``primary`` (struct) and ``shippable`` of each record's group.

    The primary is the least by date source, then kind, then path. A group ships if it has
    an image or raw file, or a video where videos are included. One exchange on the key;
    groups are a handful of files.
    """
    group = Window.partitionBy("dir", "stem")
    order = F.struct(rank_of(F.col("date_source"), DATE_SOURCES), rank_of(F.col("kind"), KINDS), path_order(F.col("rel_path")))
    member = F.struct("rel_path", "taken", "date_source", "kind", "gps", "camera_make", "camera_model")
    ships = F.col("kind").isin("image", "raw", *(["video"] if include_video else []))
    keyed = companion_key(records)
    return keyed.withColumn("primary", F.min_by(member, order).over(group)).withColumn("shippable", F.max(F.coalesce(ships, F.lit(False))).over(group))


def primaries(records: DataFrame, include_video: bool = False) -> DataFrame:
    """One row for each group: ``dir, stem, members, primary, shippable``."""
    order = F.struct(rank_of(F.col("date_source"), DATE_SOURCES), rank_of(F.col("kind"), KINDS), path_order(F.col("rel_path")))
    ships = F.col("kind").isin("image", "raw", *(["video"] if include_video else []))
    return (
        companion_key(records)
        .groupBy("dir", "stem")
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.min_by("rel_path", order).alias("primary"),
            F.max(F.coalesce(ships, F.lit(False))).alias("shippable"),
        )
    )


def levels(rows: DataFrame, date: str, threshold: int) -> DataFrame:
    """Append ``level``: a year with more rows than the threshold splits into months, and
    such a month into weeks. Rows without a date are not counted and stay at year.

    The counts are aggregated before they are joined, so a month that holds most rows costs
    one row, not one task; there are as many counts as months, which bounds the broadcast.
    """
    months = rows.where(F.col(date).isNotNull()).groupBy(F.year(date).alias("_y"), F.month(date).alias("_m")).agg(F.count(F.lit(1)).alias("_in_month"))
    years = Window.partitionBy("_y")
    counted = months.withColumn("_in_year", F.sum("_in_month").over(years))
    on = (F.year(rows[date]) == counted["_y"]) & (F.month(rows[date]) == counted["_m"])
    split, again = F.col("_in_year") > threshold, F.col("_in_month") > threshold
    level = F.when(split & again, "week").when(split, "month").otherwise("year")
    return rows.join(F.broadcast(counted), on, "left").withColumn("level", level).drop("_y", "_m", "_in_month", "_in_year")
