"""Mixing sources to target weights by weighted sampling with exponential keys.

A document's key is an exponential variate divided by its quality weight (Efraimidis and
Spirakis), drawn from a hash of the document, so reruns agree. Within a source the smallest
keys come first; prefix sums of sizes fill the source's word budget. A budget of at least
the source's size takes complete epochs of it before the fractional selection.

DataFrame functions only. Prefix sums are split: a source is dealt into buckets of keys,
bucket totals are summed over buckets, and sorting happens within a bucket, so a source
with a third of all rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelf.llm.common import Workspace, word_count

#: A source's target stops at so many times its size.
EPOCHS = 3
#: Weights given to sources in code-point order, over and over.
WEIGHTS = (1, 2, 3)
SEED = 20_240_517
#: Documents that share one bucket of keys, on average, and the most buckets of a source.
BUCKET_DOCS, MAX_BUCKETS = 1000, 65_536


def quality_weight(text: Column, size: Column) -> Column:
    """In [0.05, 1]: falls as the mean word length departs from six characters."""
    per_word = (F.length(text) + 1.0) / (size + 1.0)
    return F.when(size == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.05), F.exp(-F.abs(F.log(per_word / 6.0)))))


def _unit(mark: Column) -> Column:
    """Uniform variate between 0 and 1 of a document, from its id and text."""
    return (F.shiftrightunsigned(F.xxhash64("doc_id", mark, F.lit(SEED)), 12).cast("double") + 0.5) / float(1 << 52)


def _keyed(docs: DataFrame) -> DataFrame:
    size = word_count(F.col("text"))
    mark = F.xxhash64("text")
    rows = docs.select("doc_id", "source", size.alias("size"), mark.alias("mark"), "text", _unit(mark).alias("unit"))
    rows = rows.withColumn("weight", quality_weight(F.col("text"), F.col("size")))
    return rows.select("doc_id", "source", "size", "mark", "weight", (-F.log("unit") / F.col("weight")).alias("key"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """One row for each source: ``sid, source, source_size, target, docs, mean_weight``.

    The level at which every source gets ``min(cap, level * weight)`` and the targets add up
    to all sizes is found by one pass over the sources in the order in which they reach
    their caps; that is where resharing of the excess ends. Windows here run over the list
    of sources, never over documents.
    """
    each = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"), F.avg("weight").alias("mean_weight")
    )
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    each = each.withColumn("sid", F.row_number().over(by_name))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") - 1) % len(weights) + 1)
    each = each.withColumn("w", weight).withColumn("cap", F.col("source_size").cast("double") * epochs)
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    everything = Window.partitionBy()
    below = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    above = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    each = (
        each.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(below), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.sum("w").over(above))
        .withColumn("free", F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("capped", "level")))
        .withColumn("level", F.min("free").over(everything)["level"])
    )
    target = F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("w")), F.col("cap"))
    return each.select("sid", "source", "source_size", target.alias("target"), "docs", "mean_weight")


def _shares(docs: DataFrame, weights: tuple[int, ...], epochs: int) -> tuple[DataFrame, DataFrame]:
    """Rows with what the mix takes of each, and the table of sources."""
    ws = Workspace(docs.sparkSession, "mixing")
    rows = ws.save(_keyed(docs), "rows")
    sources = ws.save(targets(rows, weights, epochs), "sources")
    return _taken(rows, sources), sources


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The mix itself: every row of ``docs`` as many times as the mix takes it.

    A source's epochs and the largest key that it takes once more decide for each row by
    itself, so texts are neither joined by id nor shuffled. The document at the edge of a
    budget is taken if at least half of it fits. Columns stay as they are.
    """
    taken, sources = _shares(docs, weights, epochs)
    more = (F.col("part") > 0) & (2 * F.col("part") >= F.col("size"))
    edge = taken.groupBy("sid").agg(F.max("whole").alias("_whole"), F.max(F.when(more, F.col("key"))).alias("_edge"))
    table = Workspace(docs.sparkSession, "mixing").save(sources.select("sid", F.col("source").alias("_source")).join(edge, "sid").drop("sid"), "edges")
    size = word_count(F.col("text"))
    mark = F.xxhash64("text")
    rows = docs.withColumn("_key", -F.log(_unit(mark)) / quality_weight(F.col("text"), size))
    rows = rows.join(table, F.col("source").eqNullSafe(F.col("_source")))
    copies = F.col("_whole") + F.coalesce(F.col("_key") <= F.col("_edge"), F.lit(False)).cast("long")
    repeated = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))
    return rows.withColumn("_copies", copies).where("_copies > 0").withColumn("_copy", repeated).select(*docs.columns)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """How much of each document the mix takes.

    Returns, for every row of ``docs`` (which needs ``doc_id, text, source``), ``doc_id,
    mark`` (a hash of the text), ``size, source_size, target, taken, copies``: ``taken``
    counts words, repeats included; the document at the edge of the budget gives as many
    words as still fit, and ``copies`` rounds ``taken`` to whole documents, halves up.
    Null and blank texts have size 0 and give nothing beyond the epochs' empty copies. A
    null source is a source of its own, last in order. Rows repeated in full share a key;
    which of them is cut at the edge makes no difference. Columns besides the three are not
    read. An empty table gives an empty result.
    """
    taken, _ = _shares(docs, weights, epochs)
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(F.col("whole")).cast("int")
    return taken.select("doc_id", "mark", "size", "source_size", "target", "taken", copies.alias("copies"))


def _taken(rows: DataFrame, sources: DataFrame) -> DataFrame:
    n_buckets = F.least(F.lit(MAX_BUCKETS), F.ceil(F.col("docs") / BUCKET_DOCS))
    bucket = F.floor((1 - F.exp(-F.col("key") * F.col("mean_weight"))) * n_buckets)
    placed = rows.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "mark", "size", "key", "sid", "source_size", "target", bucket.alias("bucket")
    )
    sums = placed.groupBy("sid", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("base"))
    order = Window.partitionBy("sid", "bucket").orderBy("key", "doc_id", "mark", "size").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.join(sums, ["sid", "bucket"]).withColumn("before", F.col("base") + F.sum("size").over(order) - F.col("size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    summed = summed.withColumn("whole", whole).withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return summed.withColumn("part", part).withColumn("taken", F.col("whole") * F.col("size") + F.col("part"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
