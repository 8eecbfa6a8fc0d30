"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame


def keep(df: DataFrame) -> DataFrame:
    """Checkpoint to ``spark.checkpoint.dir``.

    Only in local mode, where all is one machine, a temporary folder stands in for a setting
    that is missing; a cluster without one is refused.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="shelf-")
        context.setCheckpointDir(named)
    return df.checkpoint()
