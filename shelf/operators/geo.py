"""Places: grid cells, nearest known place, country names, and location depth."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Cells of a thousandth of a degree share one lookup.
CELL_SCALE = 1000.0
#: Places that are sent to the workers at a time; the table of all towns has some 150,000.
BROADCAST_PLACES = 2_000_000


def signed_degrees(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Degrees of three rationals ``struct<num, den>``; null if a denominator is zero."""
    value = lambda r: F.when(r["den"] != 0, r["num"].cast("double") / r["den"])
    total = value(degrees) + value(minutes) / 60.0 + value(seconds) / 3600.0
    return F.when(F.upper(ref).isin("S", "W"), -total).otherwise(total)


def valid_point(lat: Column, lon: Column) -> Column:
    """``struct<lat, lon>`` of floats, or null out of range or at exactly (0, 0)."""
    good = lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))
    return F.when(good, F.struct(lat.cast("float").alias("lat"), lon.cast("float").alias("lon")))


def cell(gps: Column) -> Column:
    """Cell of a point: both degrees in thousandths, halves away from zero, in floats."""
    return F.struct(*[F.round(gps[c] * F.lit(CELL_SCALE).cast("float")).cast("int").alias(c) for c in ("lat", "lon")])


def cell_points(points: DataFrame, order: Column) -> DataFrame:
    """``cell, gps``: the point that answers for each cell, the first in the given order."""
    first = Window.partitionBy("cell").orderBy(order)
    rows = points.where("gps is not null").withColumn("cell", cell(F.col("gps")))
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("cell", "gps")


def nearest(points: DataFrame, gazetteer: DataFrame, key: str = "cell") -> DataFrame:
    """``key, ord`` of the place nearest each point, in squared degrees of float arithmetic.

    No wrap at the antimeridian; ties go to the smallest ``ord``. Distances are taken in
    blocks against latitude-sorted arrays of the places and widen outwards until no nearer
    place can follow. A gazetteer too large to send whole is dealt into parts by a hash of
    ``ord``; the points meet each part, and the nearest answer of all parts is taken.
    """
    places = gazetteer.where("lat is not null and lon is not null").select("lat", "lon", "ord")
    parts = -(-places.count() // BROADCAST_PLACES)
    if parts <= 1:
        return _nearest_of(points, places, key).drop("apart")
    # half of a part's size is kept free, so that uneven parts stay within the bound
    parts = 2 * parts
    found = [_nearest_of(points, places.where(F.pmod(F.xxhash64("ord"), F.lit(parts)) == k), key) for k in range(parts)]
    answers = reduce(DataFrame.unionByName, found).where("ord is not null").groupBy(key).agg(F.min_by("ord", F.struct("apart", "ord")).alias("ord"))
    return points.select(key).join(answers, key, "left")


def _nearest_of(points: DataFrame, gazetteer: DataFrame, key: str) -> DataFrame:
    """``key, ord, apart`` of the nearest of some places, which the driver reads."""
    places = gazetteer.toPandas().sort_values(["lat", "ord"], kind="stable")
    lat, lon, num = (places[c].to_numpy() for c in ("lat", "lon", "ord"))
    lat, lon = lat.astype(np.float32), lon.astype(np.float32)

    def one(y: np.float32, x: np.float32) -> tuple[int | None, float | None]:
        if not len(lat):
            return None, None
        mid, width = int(np.searchsorted(lat, y)), 64
        while True:
            a, b = max(0, mid - width), min(len(lat), mid + width)
            d = (lat[a:b] - y) ** 2 + (lon[a:b] - x) ** 2
            best = d.min()
            done = (a == 0 or (y - lat[a - 1]) ** 2 > best) and (b == len(lat) or (lat[b] - y) ** 2 > best)
            if done or (a == 0 and b == len(lat)):
                return int(num[a:b][d == best].min()), float(best)
            width *= 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys, xs = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            found = [one(np.float32(y), np.float32(x)) for y, x in zip(ys, xs, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64())], names=[key, "ord", "apart"])

    kind = points.schema[key].dataType.simpleString()
    return points.select(key, "gps.lat", "gps.lon").mapInArrow(run, f"{key} {kind}, ord long, apart double")


def countries(spark: SparkSession) -> DataFrame:
    """``cc, country`` of the ISO 3166-1 codes, from the JVM's own tables, and Kosovo's."""
    locale = spark.sparkContext._jvm.java.util.Locale
    english = locale.ENGLISH
    named = [(cc, locale("", cc).getDisplayCountry(english)) for cc in [*locale.getISOCountries(), "XK"]]
    return spark.createDataFrame(named, "cc string, country string")


def country_name(rows: DataFrame, code: str, names: DataFrame, into: str = "country") -> DataFrame:
    """Append the name of a country code: blank is null, an unknown code passes in capitals.

    ``names`` has some 250 rows.
    """
    folded = F.upper(F.trim(F.col(code)))
    table = names.select(F.upper("cc").alias("_cc"), F.col("country").alias("_name"))
    joined = rows.drop(into).withColumn("_code", F.nullif(folded, F.lit(""))).join(F.broadcast(table), F.col("_code") == F.col("_cc"), "left")
    return joined.withColumn(into, F.coalesce("_name", "_code")).drop("_code", "_cc", "_name")


def located(points: DataFrame, gazetteer: DataFrame, names: DataFrame, depth: str = "city", key: str = "cell") -> DataFrame:
    """``key, place``: country, region and city of the nearest place, down to ``depth``."""
    found = nearest(points, gazetteer, key).join(gazetteer.select("ord", "cc", "region", "name"), "ord", "left")
    found = country_name(found, "cc", names)
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    none = F.lit(None).cast("string")
    region = blank("region") if depth in ("region", "city") else none
    city = blank("name") if depth == "city" else none
    return found.select(key, F.struct(F.col("country"), region.alias("region"), city.alias("city")).alias("place"))
