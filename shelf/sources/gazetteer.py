"""Gazetteers: a pluggable table of places from text dumps or Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_NAME_BYTES = 255


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated dump: name in column 2, degrees in 5 and 6, country in 9, region in 11."""
    rows = spark.read.option("sep", "\t").option("quote", "").csv(path)
    return shaped(rows.select(F.col("_c4").alias("lat"), F.col("_c5").alias("lon"), F.col("_c1").alias("name"), F.col("_c10").alias("region"), F.col("_c8").alias("cc")))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated with the header ``lat,lon,name,admin1,cc``."""
    rows = spark.read.option("header", True).csv(path)
    return shaped(rows.select("lat", "lon", "name", F.col("admin1").alias("region"), "cc"))


def shaped(rows: DataFrame) -> DataFrame:
    """GAZETTEER columns: codes padded to two capitals, names over 255 bytes left out."""
    kept = rows.select(
        F.expr("try_cast(lat as float)").alias("lat"),
        F.expr("try_cast(lon as float)").alias("lon"),
        F.upper(F.rpad(F.substring(F.trim(F.coalesce("cc", F.lit(""))), 1, 2), 2, " ")).alias("cc"),
        F.trim(F.coalesce("region", F.lit(""))).alias("region"),
        F.trim(F.coalesce("name", F.lit(""))).alias("name"),
    ).where((F.octet_length("name") <= MAX_NAME_BYTES) & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return kept.select(F.monotonically_increasing_id().alias("ord"), "lat", "lon", "cc", "region", "name")


def write(places: DataFrame, path: str) -> None:
    """Store a gazetteer as Parquet, sorted by latitude so that scans can skip row groups."""
    places.sortWithinPartitions("lat", "lon").write.mode("overwrite").parquet(path)
