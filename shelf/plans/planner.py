"""The plan: records in, one operation for each shippable record out, and statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelf.functions.names import base_name, path_order, sanitize_file_name
from shelf.functions.template import render, uses_location
from shelf.operators.dedup import destination_match, source_twins
from shelf.operators.geo import cell, cell_points, located
from shelf.operators.grouping import levels, with_primary
from shelf.operators.naming import assign, assign_by_component
from shelf.options import Options
from shelf.schema import JOURNAL, LISTING
from shelf.storage import keep


def positions(rows: DataFrame, path: str = "rel_path", into: str = "pos") -> DataFrame:
    """Append the row's place in path order, counted from 0.

    One range exchange and a sort within partitions; only a count for each partition is
    summed, so no partition holds all rows. Equal paths are ordered arbitrarily.
    """
    ordered = rows.withColumn("_order", path_order(F.col(path)))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ordered.repartitionByRange(n, "_order").sortWithinPartitions("_order").drop("_order")
    numbered = keep(ordered.withColumn("_id", F.monotonically_increasing_id()))
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # one row for each partition
    starts = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_start"))
    joined = numbered.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return joined.withColumn(into, F.col("_start") + place).drop("_id", "_part", "_start")


def layout(records: DataFrame, opts: Options, gazetteer: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """Append ``primary, shippable, level, place, dest_dir`` to records.

    Every member of a group goes where its primary goes. Places are looked up only for the
    cells of primaries of shippable groups, and only if a template asks for them; the first
    group of a cell, in order, answers for all of it.
    """
    rows = with_primary(records, opts.include_video).withColumn("day", F.to_date("primary.taken"))
    rows = levels(rows, "day", opts.adaptive_threshold) if opts.adaptive else rows.withColumn("level", F.lit(None).cast("string"))
    wanted = {level: opts.template_for(level) for level in ("year", "month", "week")} if opts.adaptive else {None: opts.template_for()}
    if gazetteer is not None and any(map(uses_location, wanted.values())):
        heads = rows.where("shippable and rel_path = primary.rel_path and primary.gps is not null")
        points = cell_points(heads.select("primary.gps", "dir", "stem"), F.struct(path_order(F.col("dir")), F.col("stem")))
        places = located(points, gazetteer, names, opts.location or "city")
        rows = rows.withColumn("cell", F.when(F.col("primary.gps").isNotNull(), cell(F.col("primary.gps"))))
        rows = rows.join(places, "cell", "left").drop("cell")
    else:
        from shelf.schema import PLACE

        rows = rows.withColumn("place", F.lit(None).cast(PLACE))
    shown = {
        level: render(text, F.col("day"), F.col("place"), F.col("primary.camera_make"), F.col("primary.camera_model"))
        for level, text in wanted.items()
    }
    if not opts.adaptive:
        return rows.withColumn("dest_dir", shown[None])
    cases = [(F.col("level") == level, text) for level, text in shown.items()]
    return rows.withColumn("dest_dir", reduce(lambda acc, c: acc.when(*c), cases[1:], F.when(*cases[0])))


def build(
    records: DataFrame,
    opts: Options,
    journal: DataFrame | None = None,
    destination: DataFrame | None = None,
    gazetteer: DataFrame | None = None,
    names: DataFrame | None = None,
) -> DataFrame:
    """The operation relation of ``records`` (RECORD columns, and ``digest`` for dedup).

    Columns ``pos, source_rel, dest_rel, action, reason, bytes, duplicate_of``. A record of
    an unshippable group has no operation. Decisions, in order: already in the journal; a
    twin earlier in path order; the same bytes at the destination; a name that is free or
    resolved as ``on_conflict`` asks. Two records of one run are always told apart by
    renaming. Null digests equal nothing; nothing is assumed about row order.
    """
    spark: SparkSession = records.sparkSession
    opts = opts.normal()
    if "digest" not in records.columns:
        records = records.withColumn("digest", F.lit(None).cast("string"))
    listing = destination if destination is not None else spark.createDataFrame([], LISTING)
    done = journal if journal is not None else spark.createDataFrame([], JOURNAL)
    rows = positions(records).join(done.select(F.col("source").alias("rel_path"), F.col("destination").alias("journal_dest")), "rel_path", "left")
    rows = layout(rows, opts, gazetteer, names).where("shippable")
    name = sanitize_file_name(base_name(F.col("rel_path")))
    rows = rows.select(
        "pos", F.col("rel_path").alias("source_rel"), "size", "digest", "journal_dest", F.concat_ws("/", "dest_dir", name).alias("wanted")
    )
    dedup = opts.dedup == "size-hash"
    if dedup:
        rows = destination_match(rows, listing)
    else:
        rows = rows.withColumn("dest_match", F.lit(None).cast("string"))
    rows = keep(rows)
    if opts.on_conflict == "skip":
        decided = assign_by_component(rows, listing, opts.mode, opts.on_conflict, dedup)
    else:
        decided = _assign_after_dedup(rows, listing, opts, dedup)
    return rows.select("pos", "source_rel", F.col("size").alias("bytes")).join(decided, "pos").select(
        "pos", "source_rel", "dest_rel", "action", "reason", "bytes", "duplicate_of"
    )


def _assign_after_dedup(rows: DataFrame, listing: DataFrame, opts: Options, dedup: bool) -> DataFrame:
    if not dedup:
        return assign(rows, listing, opts.mode, opts.on_conflict)
    rows = keep(source_twins(rows.withColumn("resumed", F.col("journal_dest").isNotNull())))
    twin = F.col("twin_pos").isNotNull() & (F.col("pos") > F.col("twin_pos")) & ~F.col("resumed")
    fresh = rows.where(~F.coalesce(twin, F.lit(False)))
    held = fresh.where("not resumed and dest_match is not null").select(
        "pos", F.col("dest_match").alias("dest_rel"), F.lit("skip").alias("action"), F.lit("duplicate-of-destination").alias("reason"), F.col("dest_match").alias("duplicate_of")
    )
    placed = keep(assign(fresh.where("resumed or dest_match is null"), listing, opts.mode, opts.on_conflict))
    first = placed.join(rows.select("pos", "source_rel"), "pos").select(F.col("pos").alias("twin_pos"), F.col("dest_rel"), F.col("source_rel").alias("duplicate_of"))
    copies = rows.where(twin).select("pos", "twin_pos").join(first, "twin_pos").select(
        "pos", "dest_rel", F.lit("skip").alias("action"), F.lit("duplicate-of-source").alias("reason"), "duplicate_of"
    )
    return placed.unionByName(held).unionByName(copies)


def stats(operations: DataFrame, records: DataFrame, include_video: bool = False) -> DataFrame:
    """One row of plan statistics."""
    from shelf.operators.grouping import primaries

    is_ = lambda reason: F.count_if(F.col("reason") == reason)
    pending = F.col("action") != "skip"
    ops = operations.agg(
        F.count_if(pending).alias("pending"),
        F.count_if(F.col("reason").startswith("duplicate-of-")).alias("duplicates"),
        F.count_if((F.col("reason") == "existing-file") & ~pending).alias("skipped_existing"),
        is_("renamed").alias("renamed"),
        is_("already-done").alias("resumed"),
        F.coalesce(F.sum(F.when(pending, F.col("bytes"))), F.lit(0)).alias("pending_bytes"),
    )
    groups = primaries(records, include_video).agg(
        F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.when(~F.col("shippable"), F.col("members"))), F.lit(0)).alias("unshippable")
    )
    return groups.crossJoin(ops)  # one row by one row


