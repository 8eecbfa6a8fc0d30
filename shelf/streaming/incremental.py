"""Micro-batches of records planned against what earlier batches have placed.

Only fixed groupings: adaptive levels need all of the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from shelf.options import Options
from shelf.plans.planner import build
from shelf.schema import LISTING


def plan_stream(records: DataFrame, opts: Options, plan_path: str, checkpoint: str) -> StreamingQuery:
    """Plan each micro-batch into ``plan_path/batch=<n>``; a batch that is retried is replaced.

    Names and bytes planned by earlier batches count as the destination's, so later copies
    of them are duplicates and later collisions are renamed.
    """
    if opts.normal().adaptive:
        raise ValueError("adaptive grouping needs the whole input")

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(plan_path)
        held = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        earlier = None
        if held:
            earlier = spark.read.parquet(plan_path).where(f"batch < {number} and action <> 'skip'").selectExpr("dest_rel as path", "bytes as size", "false as is_dir", "digest")
        plan = build(batch, opts, destination=earlier if earlier is not None else spark.createDataFrame([], LISTING))
        placed = plan.join(batch.selectExpr("rel_path as source_rel", "digest"), "source_rel", "left")
        placed.write.mode("overwrite").parquet(f"{plan_path}/batch={number}")

    return records.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
