"""Journals: JSON lines of finished operations, in one file or a folder of parts."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelf.schema import JOURNAL


def read(spark: SparkSession, path: str) -> DataFrame:
    """``source, destination``, the last entry of each source; a journal not yet begun has none.

    Blank lines, broken lines, and objects that lack a field are passed over. Order is by
    file name, then by place in the file, which Spark's line reader keeps within a file
    read whole; journals are small beside the trees they record.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        logging.getLogger(__name__).warning("no journal at %s yet: nothing is resumed", path)
        return spark.createDataFrame([], JOURNAL)
    lines = spark.read.option("wholetext", True).text(path).select("value", F.input_file_name().alias("file"))
    each = lines.select("file", F.posexplode(F.split("value", "\n")).alias("at", "line"))
    entry = F.from_json("line", JOURNAL)
    rows = each.select(entry.alias("e"), F.struct("file", "at").alias("turn")).select("e.source", "e.destination", "turn")
    whole = rows.where("source is not null and destination is not null")
    return whole.groupBy("source").agg(F.max_by("destination", "turn").alias("destination"))
