"""Generated records for benchmarks: many dated files, 500 to a folder, over twelve years."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PER_FOLDER = 500


def records(spark: SparkSession, n: int, bytes_each: int = 1024) -> DataFrame:
    """``n`` image records with EXIF dates and distinct digests; nothing is written to disk."""
    i = F.col("id")
    day = F.make_date((2014 + i % 12).cast("int"), (1 + i % 12).cast("int"), (1 + i % 28).cast("int"))
    clock = F.make_dt_interval(hours=(i % 24).cast("int"), mins=(i % 60).cast("int"), secs=(i % 60).cast("decimal(18,6)"))
    return spark.range(n).select(
        F.format_string("dir_%05d/IMG_%07d.jpg", (i / PER_FOLDER).cast("long"), i).alias("rel_path"),
        F.lit(bytes_each).cast("long").alias("size"),
        F.lit("image").alias("kind"),
        (day.cast("timestamp_ntz") + clock).alias("taken"),
        F.lit("exif-datetime-original").alias("date_source"),
        F.lit(None).cast("struct<lat:float,lon:float>").alias("gps"),
        F.lit(None).cast("string").alias("offset_time"),
        F.lit(None).cast("string").alias("camera_make"),
        F.lit(None).cast("string").alias("camera_model"),
        F.lit(True).alias("signature_ok"),
        F.sha2(i.cast("string"), 256).alias("digest"),
    )
