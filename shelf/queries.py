"""Queries over the driver's tables, one or more for each operator, with their SQL.

Tables are dressed as file records by expressions that mean the same in both engines; then
the operator runs. ``QUERIES`` and ``ORACLE_SQL`` share keys and column names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelf.functions import dates, names, template
from shelf.operators import dedup, geo, grouping
from shelf.options import Options
from shelf.plans import planner, report

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = 2030


def query(name: str, sql: str):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return register


def _t(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


# Layouts ------------------------------------------------------------------------------


def _layout(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = _t(spark, d, "orders").select(template.render(text, F.to_date("o_orderdate")).alias("folder"))
        return rows.groupBy("folder").agg(F.count(F.lit(1)).alias("files"))

    return run


for _name, _format in (("year", "%Y"), ("month", "%Y/%m-%B"), ("week", "%G/%G-W%V"), ("day", "%Y/%m/%d")):
    query(f"layout_{_name}", f"SELECT strftime(o_orderdate, '{_format}') AS folder, count(*) AS files FROM orders GROUP BY 1")(
        _layout(Options(group=_name).template_for())
    )

query(
    "layout_custom_template",
    "SELECT 'shots-' || strftime(o_orderdate, '%B') || '/' || CAST(day(o_orderdate) AS STRING) || ' of ' || CAST(month(o_orderdate) AS STRING)"
    " AS folder, count(*) AS files FROM orders GROUP BY 1",
)(_layout("shots-{month_name}/{day} of {month}"))

_NULLED = "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END"
_COUNTRY = "CASE WHEN o_orderkey % 3 = 0 THEN 'Land' || CAST(o_custkey % 5 AS STRING) END"


@query(
    "unknown_date_collapse",
    f"""WITH r AS (SELECT {_NULLED} AS d, {_COUNTRY} AS c FROM orders)
    SELECT CASE WHEN d IS NULL AND c IS NULL THEN 'unknown-date'
      WHEN d IS NULL THEN 'unknown-date/' || c || '/unknown-date'
      WHEN c IS NULL THEN strftime(d, '%Y') || '/' || CAST(month(d) AS STRING)
      ELSE strftime(d, '%Y') || '/' || c || '/' || CAST(month(d) AS STRING) END AS folder, count(*) AS files FROM r GROUP BY 1""",
)
def unknown_date_collapse(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "orders").selectExpr(f"{_NULLED} AS d", f"{_COUNTRY} AS c")
    none = F.lit(None).cast("string")
    place = F.struct(F.col("c").alias("country"), none.alias("region"), none.alias("city"))
    shown = template.render("{year}/{country}/{month}", F.to_date("d"), place)
    return rows.select(shown.alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("files"))


_LEVEL_SQL = """WITH c AS (SELECT o_orderkey, o_orderdate, count(*) OVER (PARTITION BY year(o_orderdate)) AS y,
      count(*) OVER (PARTITION BY year(o_orderdate), month(o_orderdate)) AS m FROM orders),
    l AS (SELECT *, CASE WHEN y > {t} AND m > {t} THEN 'week' WHEN y > {t} THEN 'month' ELSE 'year' END AS level FROM c)"""
_THRESHOLD = 190


@query("adaptive_levels", _LEVEL_SQL.format(t=_THRESHOLD) + " SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, level, count(*) AS files FROM l GROUP BY 1, 2, 3")
def adaptive_levels(spark: SparkSession, d: str) -> DataFrame:
    rows = grouping.levels(_t(spark, d, "orders"), "o_orderdate", _THRESHOLD)
    return rows.groupBy(F.year("o_orderdate").cast("long").alias("y"), F.month("o_orderdate").cast("long").alias("m"), "level").agg(F.count(F.lit(1)).alias("files"))


@query(
    "adaptive_layout",
    _LEVEL_SQL.format(t=_THRESHOLD)
    + """ SELECT CASE level WHEN 'week' THEN strftime(o_orderdate, '%G/%G-W%V') WHEN 'month' THEN strftime(o_orderdate, '%Y/%m-%B') ELSE strftime(o_orderdate, '%Y') END AS folder, count(*) AS files FROM l GROUP BY 1""",
)
def adaptive_layout(spark: SparkSession, d: str) -> DataFrame:
    records = _t(spark, d, "orders").selectExpr(
        "concat(cast(o_orderkey as string), '.jpg') rel_path", "'image' kind", "o_orderdate taken", "'mtime' date_source",
        "cast(null as struct<lat:float,lon:float>) gps", "cast(null as string) camera_make", "cast(null as string) camera_model",
    )
    rows = planner.layout(records, Options(group="adaptive", adaptive_threshold=_THRESHOLD))
    return rows.groupBy(F.col("dest_dir").alias("folder")).agg(F.count(F.lit(1)).alias("files"))


# Names and signatures -----------------------------------------------------------------

_FILE = "concat('P', CAST(o_orderkey AS STRING), CASE o_orderkey % 8 WHEN 0 THEN '.JPG' WHEN 1 THEN '.heic' WHEN 2 THEN '.Nef' WHEN 3 THEN '.mov' WHEN 4 THEN '.xmp' WHEN 5 THEN '.txt' WHEN 6 THEN '' ELSE '.tar.PNG' END)"


@query(
    "classify_extension",
    f"""SELECT CASE o_orderkey % 8 WHEN 2 THEN 'raw' WHEN 3 THEN 'video' WHEN 4 THEN 'sidecar' WHEN 5 THEN 'none' WHEN 6 THEN 'none' ELSE 'image' END AS kind,
    min({_FILE}) AS first_name, count(*) AS files FROM orders GROUP BY 1""",
)
def classify_extension(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "orders").selectExpr(f"{_FILE} AS name")
    kind = F.coalesce(names.classify(names.extension(F.col("name"))), F.lit("none"))
    return rows.groupBy(kind.alias("kind")).agg(F.min("name").alias("first_name"), F.count(F.lit(1)).alias("files"))


_HEADS = ("FFD8FFE000104A4649460001", "89504E470D0A1A0A0000000D", "49492A000800000000000000", "524946460000000057454250", "52494646000000004156492", "000000186674797068656963", "000001BA4400040004000000", "FFD8FF", "000102030405060708090A0B")
_HEAD = "CASE p_partkey % 9 " + " ".join(f"WHEN {i} THEN '{h if len(h) % 2 == 0 else h + '0'}'" for i, h in enumerate(_HEADS)) + " END"
_HEAD_KIND = "CASE p_partkey % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'raw' WHEN 2 THEN 'video' ELSE 'sidecar' END"


@query(
    "signature_match",
    f"""WITH r AS (SELECT p_partkey % 9 AS h, {_HEAD_KIND} AS kind FROM part)
    SELECT kind, CASE WHEN kind = 'sidecar' THEN true WHEN kind = 'video' THEN h IN (3, 4, 5, 6) ELSE h IN (0, 1, 2, 3, 5) END AS ok, count(*) AS files FROM r GROUP BY 1, 2""",
)
def signature_match(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "part").selectExpr(f"{_HEAD_KIND} AS kind", f"unhex({_HEAD}) AS head")
    return rows.groupBy("kind", names.signature_matches(F.col("kind"), F.col("head")).alias("ok")).agg(F.count(F.lit(1)).alias("files"))


_RAW_NAME = "concat(CASE p_partkey % 5 WHEN 0 THEN ' .' WHEN 1 THEN 'con' WHEN 2 THEN 'a<b>:' WHEN 3 THEN '' ELSE 'x|?*' END, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '. ' ELSE p_name END)"
_COMPONENT = r"""
    WITH r AS (SELECT {raw} AS raw FROM part), a AS (SELECT raw, regexp_replace(raw, '[<>:"/\\|?*]', '-', 'g') AS s FROM r),
    b AS (SELECT raw, ltrim(rtrim(left(s, 100), '. '), '. ') AS s FROM a)
    SELECT raw, CASE WHEN s = '' THEN 'unnamed' WHEN upper(split_part(s, '.', 1)) IN ('CON', 'PRN', 'AUX', 'NUL') THEN '_' || s ELSE s END AS clean, count(*) AS n FROM b GROUP BY 1, 2"""


@query("sanitize_component", _COMPONENT.format(raw=_RAW_NAME))
def sanitize_component(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "part").selectExpr(f"{_RAW_NAME} AS raw")
    return rows.groupBy("raw", names.sanitize_component(F.col("raw")).alias("clean")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "sanitize_url",
    r"""WITH a AS (SELECT page_id, regexp_replace(url, '[<>:"/\\|?*]', '-', 'g') AS s FROM pages)
    SELECT page_id, ltrim(rtrim(left(s, 100), '. '), '. ') AS clean FROM a""",
)
def sanitize_url(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", names.sanitize_component(F.col("url")).alias("clean"))


_LONG = "concat(repeat('n', CAST(80 + p_partkey % 40 AS INT)), CASE p_partkey % 3 WHEN 0 THEN '.jpeg' WHEN 1 THEN '.' ELSE '.a b' END)"


@query(
    "sanitize_filename",
    f"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN repeat('n', CAST(least(80 + p_partkey % 40, 95) AS INT)) || '.jpeg'
      WHEN 1 THEN repeat('n', CAST(least(80 + p_partkey % 40, 92) AS INT)) || '.unnamed' ELSE rtrim(left({_LONG}, 100), '. ') END AS clean FROM part""",
)
def sanitize_filename(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", names.sanitize_file_name(F.expr(_LONG)).alias("clean"))


@query(
    "reserved_names",
    "SELECT p_partkey, p_partkey % 4 = 0 OR p_partkey % 4 = 2 AS reserved FROM part",
)
def reserved_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'com1.txt' WHEN 1 THEN concat('com', p_name) WHEN 2 THEN 'NuL' ELSE 'lpt10.x' END")
    return _t(spark, d, "part").select("p_partkey", names.is_reserved(name).alias("reserved"))


# Dates --------------------------------------------------------------------------------

_SHOW = "yyyy-MM-dd HH:mm:ss"


@query(
    "exif_datetime_parse",
    """SELECT event_id, strftime(CASE event_id % 6 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('minute', ts)
      WHEN 4 THEN date_trunc('day', ts) END, '%Y-%m-%d %H:%M:%S') AS taken FROM events""",
)
def exif_datetime_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "events")
    forms = {0: "yyyy:MM:dd HH:mm:ss", 1: "yyyy-MM-dd'T'HH:mm:ss", 2: "yyyy/MM/dd HH:mm", 4: "yyyy:MM:dd HH:mm:ss'+02:00'"}
    text = F.coalesce(*[F.when(F.col("event_id") % 6 == k, F.date_format("ts", f)) for k, f in forms.items()], F.when(F.col("event_id") % 6 == 3, F.lit("0000:00:00 00:00:00")), F.lit("garbage"))
    return rows.select("event_id", F.date_format(dates.exif_timestamp(text, NOW), _SHOW).alias("taken"))


@query(
    "filename_date_parse",
    """SELECT event_id, strftime(CASE WHEN event_id % 6 IN (0, 1, 2, 4) THEN date_trunc('second', ts) WHEN event_id % 6 = 3 THEN date_trunc('day', ts) END, '%Y-%m-%d %H:%M:%S') AS taken FROM events""",
)
def filename_date_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "events")
    forms = {0: "'IMG_'yyyyMMdd_HHmmss'.jpg'", 1: "yyyyMMdd_HHmmss'.jpg'", 2: "'PXL_'yyyyMMdd_HHmmss'000.jpg'", 3: "'IMG-'yyyyMMdd'-WA0001.jpg'", 4: "'Screenshot 'yyyy-MM-dd' at 'HH.mm.ss'.png'"}
    name = F.coalesce(*[F.when(F.col("event_id") % 6 == k, F.date_format("ts", f)) for k, f in forms.items()], F.lit("DSC00001.jpg"))
    named = rows.select("event_id", name.alias("name")).withColumn("t", dates.filename_timestamp(F.col("name"), NOW))
    return named.select("event_id", F.date_format("t", _SHOW).alias("taken"))


@query(
    "sane_range_filter",
    "SELECT year(d) AS y, count(*) AS n FROM (SELECT o_orderdate + to_years(CAST(o_orderkey % 60 - 20 AS INT)) AS d FROM orders) WHERE year(d) BETWEEN 1990 AND 2031 GROUP BY 1",
)
def sane_range_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "orders").selectExpr("o_orderdate + make_ym_interval(cast(o_orderkey % 60 - 20 as int), 0) as d")
    return rows.where(dates.sane(F.col("d"), NOW)).groupBy(F.year("d").cast("long").alias("y")).agg(F.count(F.lit(1)).alias("n"))


_CHAIN = [("exif-datetime-original", 7), ("exif-create-date", 5), ("filename", 3), ("mtime", 2), ("creation-time", 11), ("exif-modify-date", 13)]


@query(
    "date_chain",
    "SELECT o_orderkey, CASE " + " ".join(f"WHEN o_orderkey % {m} = 0 THEN '{n}'" for n, m in _CHAIN) + " ELSE 'unknown' END AS date_source,"
    " strftime(CASE " + " ".join(f"WHEN o_orderkey % {m} = 0 THEN o_orderdate + to_days({i})" for i, (_, m) in enumerate(_CHAIN)) + " END, '%Y-%m-%d') AS taken FROM orders",
)
def date_chain(spark: SparkSession, d: str) -> DataFrame:
    given = [F.when(F.col("o_orderkey") % m == 0, F.col("o_orderdate") + F.make_dt_interval(days=F.lit(i))) for i, (_, m) in enumerate(_CHAIN)]
    rows = _t(spark, d, "orders").select("o_orderkey", dates.date_chain(*given).alias("c"))
    return rows.select("o_orderkey", "c.date_source", F.date_format("c.taken", "yyyy-MM-dd").alias("taken"))


# Groups -------------------------------------------------------------------------------

_K3 = "CAST(floor(o_orderkey / 3) AS BIGINT)"
#: Every fourth customer's orders are groups of their own, some of them sidecars alone.
_STEM = f"CASE WHEN o_custkey % 4 = 1 THEN concat(CAST(o_orderkey AS STRING), 'l') ELSE CAST({_K3} AS STRING) END"
_RECORDS = f"""SELECT o_orderkey AS k, concat('d', CAST({_K3} % 60 AS STRING), '/IMG', {_STEM},
      CASE o_orderkey % 3 WHEN 0 THEN '.JPG' WHEN 1 THEN '.nef' ELSE '.xmp' END) AS rel_path,
    concat('d', CAST({_K3} % 60 AS STRING)) AS dir, concat('img', {_STEM}) AS stem,
    CASE o_orderkey % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'raw' ELSE 'sidecar' END AS kind,
    CASE o_orderkey % 4 WHEN 0 THEN 'filename' WHEN 1 THEN 'mtime' ELSE 'exif-datetime-original' END AS date_source,
    CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END AS ds_rank, o_orderkey % 3 AS kind_rank,
    CAST(1000 + o_orderkey % 1500 AS BIGINT) AS size, CAST(o_orderkey % 1500 AS STRING) AS content, o_orderdate AS taken
    FROM orders"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    spark_sql = _RECORDS.replace("FROM orders", "FROM {o}").replace("o_orderdate AS taken", "o_orderdate AS taken")
    rows = spark.sql(spark_sql, o=_t(spark, d, "orders"))
    return rows.drop("dir", "stem").withColumn("gps", F.lit(None).cast("struct<lat:float,lon:float>")).withColumns(
        {"camera_make": F.lit(None).cast("string"), "camera_model": F.lit(None).cast("string"), "digest": F.sha2(F.col("content"), 256)}
    )


_SHIPS = "max(CASE WHEN kind IN ('image', 'raw') THEN 1 ELSE 0 END)"
_PRIMARY = "arg_min(rel_path, row(ds_rank, kind_rank, string_split(rel_path, '/')))"


@query("companion_groups", f"WITH r AS ({_RECORDS}) SELECT dir, stem, count(*) AS members FROM r GROUP BY 1, 2")
def companion_groups(spark: SparkSession, d: str) -> DataFrame:
    return grouping.primaries(_records(spark, d)).select("dir", "stem", "members")


@query("primary_member", f"WITH r AS ({_RECORDS}) SELECT dir, stem, {_PRIMARY} AS \"primary\" FROM r GROUP BY 1, 2")
def primary_member(spark: SparkSession, d: str) -> DataFrame:
    return grouping.primaries(_records(spark, d)).select("dir", "stem", "primary")


@query(
    "shippable_filter",
    f"WITH r AS ({_RECORDS}), g AS (SELECT dir, stem, {_SHIPS} = 1 AS shippable, count(*) AS n FROM r GROUP BY 1, 2) SELECT shippable, count(*) AS \"groups\", CAST(sum(n) AS BIGINT) AS files FROM g GROUP BY 1",
)
def shippable_filter(spark: SparkSession, d: str) -> DataFrame:
    return grouping.primaries(_records(spark, d)).groupBy("shippable").agg(F.count(F.lit(1)).alias("groups"), F.sum("members").alias("files"))


# Places -------------------------------------------------------------------------------


@query(
    "gps_dms_decode",
    """WITH r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE
        (CASE WHEN c_custkey % 2 = 0 THEN -1.0 ELSE 1.0 END)::DOUBLE * ((c_custkey % 100)::DOUBLE + (c_custkey % 60)::DOUBLE / 60.0::DOUBLE + ((c_custkey * 37 % 6000)::DOUBLE / 100) / 3600.0::DOUBLE) END AS lat FROM customer)
    SELECT k, CASE WHEN lat BETWEEN -90 AND 90 AND NOT (lat = 0) THEN CAST(round(lat * 1000) AS BIGINT) END AS lat_milli FROM r""",
)
def gps_dms_decode(spark: SparkSession, d: str) -> DataFrame:
    part = lambda num, den: F.struct(F.expr(num).alias("num"), F.expr(den).alias("den"))
    ref = F.expr("CASE WHEN c_custkey % 2 = 0 THEN 's' ELSE 'N' END")
    lat = geo.signed_degrees(part("c_custkey % 100", "1"), part("c_custkey % 60", "1"), part("c_custkey * 37 % 6000", "CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE 100 END"), ref)
    rows = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), lat.alias("lat"))
    point = geo.valid_point(F.col("lat"), F.lit(0.0))
    return rows.select("k", F.when(point.isNotNull(), F.round(F.col("lat") * 1000).cast("long")).alias("lat_milli"))


_LAT, _LON = "CAST((c_custkey * 7919 % 160000) / 1000.0 - 80 AS FLOAT)", "CAST((c_custkey * 104729 % 350000) / 1000.0 - 175 AS FLOAT)"
_PLACES = "SELECT CAST(n_nationkey AS BIGINT) AS ord, CAST(n_nationkey * 37 % 140 - 70 AS FLOAT) AS lat, CAST(n_nationkey * 113 % 340 - 170 AS FLOAT) AS lon, CASE n_nationkey % 4 WHEN 0 THEN 'hr' WHEN 1 THEN 'de' WHEN 2 THEN '  ' ELSE 'zz' END AS cc, CAST(n_regionkey AS STRING) AS region, n_name AS name FROM nation"


def _points(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").selectExpr("c_custkey AS k", f"struct({_LAT} AS lat, {_LON} AS lon) AS gps")


def _places(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_PLACES.replace("FROM nation", "FROM {n}"), n=_t(spark, d, "nation"))


_NEAREST = f"""p AS (SELECT c_custkey AS k, {_LAT} AS lat, {_LON} AS lon FROM customer), g AS ({_PLACES}),
    j AS (SELECT k, ord, row_number() OVER (PARTITION BY k ORDER BY (g.lat - p.lat) * (g.lat - p.lat) + (g.lon - p.lon) * (g.lon - p.lon), ord) AS n FROM p, g),
    f AS (SELECT k, ord FROM j WHERE n = 1)"""


@query("nearest_place", f"WITH {_NEAREST} SELECT k, ord FROM f")
def nearest_place(spark: SparkSession, d: str) -> DataFrame:
    return geo.nearest(_points(spark, d), _places(spark, d), "k")


@query(
    "geo_cell_cache",
    f"""WITH p AS (SELECT c_custkey AS k, {_LAT} AS lat, CAST(c_custkey % 3 AS FLOAT) AS lon FROM customer),
    c AS (SELECT *, CAST(round(lat * CAST(1000 AS FLOAT)) AS INT) AS y, CAST(round(lon * CAST(1000 AS FLOAT)) AS INT) AS x FROM p)
    SELECT y, x, min(k) AS k FROM c GROUP BY 1, 2""",
)
def geo_cell_cache(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "customer").selectExpr("c_custkey AS k", f"struct({_LAT} AS lat, CAST(c_custkey % 3 AS FLOAT) AS lon) AS gps")
    found = geo.cell_points(rows, F.col("k"))
    at = geo.cell(F.col("gps"))
    return found.join(rows.select("k", at.alias("cell")), "cell").groupBy("cell").agg(F.min("k").alias("k")).select(F.col("cell.lat").alias("y"), F.col("cell.lon").alias("x"), "k")


_NAMED = "CASE cc WHEN 'hr' THEN 'Croatia' WHEN 'de' THEN 'Germany' WHEN 'zz' THEN 'ZZ' END"


@query("country_lookup", f"WITH g AS ({_PLACES}) SELECT ord, {_NAMED} AS country FROM g")
def country_lookup(spark: SparkSession, d: str) -> DataFrame:
    return geo.country_name(_places(spark, d), "cc", geo.countries(spark)).select("ord", "country")


@query(
    "location_layout",
    f"""WITH {_NEAREST}, n AS (SELECT ord, {_NAMED} AS country, region, name FROM g)
    SELECT '2024/' || coalesce(country || '/', '') || region || '/' || name AS folder, count(*) AS files FROM f JOIN n USING (ord) GROUP BY 1""",
)
def location_layout(spark: SparkSession, d: str) -> DataFrame:
    found = geo.located(_points(spark, d), _places(spark, d), geo.countries(spark), "city", "k")
    shown = template.render("{year}/{country}/{region}/{city}", F.lit("2024-05-06").cast("date"), F.col("place"))
    return found.groupBy(shown.alias("folder")).agg(F.count(F.lit(1)).alias("files"))


# Duplicates ---------------------------------------------------------------------------


@query("size_buckets", "SELECT octet_length(encode(text)) AS size, count(*) AS files FROM documents GROUP BY 1")
def size_buckets(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").groupBy(F.octet_length("text").cast("long").alias("size")).agg(F.count(F.lit(1)).alias("files"))


@query("size_collisions", "SELECT octet_length(encode(text)) AS size, count(*) AS files FROM documents GROUP BY 1 HAVING count(*) > 1")
def size_collisions(spark: SparkSession, d: str) -> DataFrame:
    return size_buckets(spark, d).where("files > 1")


_CLASS = "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class FROM documents"


@query("staged_hash_pipeline", _CLASS)
def staged_hash_pipeline(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return dedup.staged_classes(rows, "doc_id", "content")


def _digested(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", F.col("doc_id").alias("pos"), F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("digest"))


@query("dedup_source", "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_doc, doc_id > min(doc_id) OVER (PARTITION BY text) AS duplicate FROM documents")
def dedup_source(spark: SparkSession, d: str) -> DataFrame:
    rows = _digested(spark, d).withColumns({"resumed": F.lit(False), "dest_match": F.lit(None).cast("string")})
    return dedup.source_twins(rows).select("doc_id", F.col("twin_pos").alias("first_doc"), (F.col("pos") > F.col("twin_pos")).alias("duplicate"))


@query(
    "dedup_destination",
    "SELECT s.doc_id, min('kept/' || lpad(CAST(t.doc_id AS STRING), 9, '0')) AS dest_match FROM documents s JOIN documents t ON s.text = t.text GROUP BY 1",
)
def dedup_destination(spark: SparkSession, d: str) -> DataFrame:
    rows = _digested(spark, d)
    held = rows.select(F.concat(F.lit("kept/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), "size", F.lit(False).alias("is_dir"), "digest")
    return dedup.destination_match(rows, held).where("dest_match is not null").select("doc_id", "dest_match")


# Naming -------------------------------------------------------------------------------



def _named_parts(spark: SparkSession, d: str, name: str = "replace(p_name, ' ', '')") -> DataFrame:
    """Parts as files that all go to one folder: equal names collide."""
    path = f"concat('b', lpad(cast(p_partkey as string), 9, '0'), '/', {name}, '.jpg')"
    rows = _t(spark, d, "part").selectExpr(f"{path} rel_path", "cast(p_size as long) size", "'image' kind", "timestamp_ntz'2024-05-06 00:00:00' taken", "'mtime' date_source")
    none = F.lit(None)
    return rows.withColumns({"gps": none.cast("struct<lat:float,lon:float>"), "camera_make": none.cast("string"), "camera_model": none.cast("string"), "digest": none.cast("string")})


def _part_plan(spark: SparkSession, d: str, on_conflict: str, held: bool, name: str = "replace(p_name, ' ', '')") -> DataFrame:
    listing = None
    if held:
        shown = _t(spark, d, "part").selectExpr("replace(p_name, ' ', '') as n").distinct().where("length(n) % 2 = 0")
        listing = shown.selectExpr("concat('2024/', n, '.jpg') as path", "1L as size", "false as is_dir", "cast(null as string) as digest")
    plan = planner.build(_named_parts(spark, d, name), Options(template="{year}", on_conflict=on_conflict, now_year=NOW), destination=listing)
    return plan.select("source_rel", "dest_rel", "action", "reason")


_PART_SQL = """WITH p AS (SELECT p_partkey, {name} AS n FROM part),
    r AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY p_partkey) - 1 AS i, {held} AS held FROM p),
    q AS (SELECT 'b' || lpad(CAST(p_partkey AS STRING), 9, '0') || '/' || n || '.jpg' AS source_rel, '2024/' || n AS w, i, held FROM r)
    SELECT source_rel, {dest} AS dest_rel, {action} AS action, {reason} AS reason FROM q"""
_PLAIN = "replace(p_name, ' ', '')"
_IF = "w || CASE WHEN i = 0 THEN '' ELSE '_' || CAST(i AS STRING) END || '.jpg'"
_WHY = "CASE WHEN i = 0 THEN 'planned' ELSE 'renamed' END"


@query("suffix_rename", _PART_SQL.format(name=_PLAIN, key="n", held="false", dest=_IF, action="'copy'", reason=_WHY))
def suffix_rename(spark: SparkSession, d: str) -> DataFrame:
    return _part_plan(spark, d, "rename", held=False)


_HELD = "length(n) % 2 = 0"


@query("conflict_skip", _PART_SQL.format(name=_PLAIN, key="n", held=_HELD, dest=_IF, action="CASE WHEN i = 0 AND held THEN 'skip' ELSE 'copy' END", reason="CASE WHEN i = 0 AND held THEN 'existing-file' WHEN i = 0 THEN 'planned' ELSE 'renamed' END"))
def conflict_skip(spark: SparkSession, d: str) -> DataFrame:
    return _part_plan(spark, d, "skip", held=True)


@query("conflict_overwrite", _PART_SQL.format(name=_PLAIN, key="n", held=_HELD, dest=_IF, action="CASE WHEN i = 0 AND held THEN 'overwrite' ELSE 'copy' END", reason="CASE WHEN i = 0 AND held THEN 'existing-file' WHEN i = 0 THEN 'planned' ELSE 'renamed' END"))
def conflict_overwrite(spark: SparkSession, d: str) -> DataFrame:
    return _part_plan(spark, d, "overwrite", held=True)


@query(
    "conflict_rename",
    _PART_SQL.format(name=_PLAIN, key="n", held=_HELD, dest="w || CASE WHEN i = 0 AND NOT held THEN '' ELSE '_' || CAST(i + CASE WHEN held THEN 1 ELSE 0 END AS STRING) END || '.jpg'", action="'copy'", reason="CASE WHEN i = 0 AND NOT held THEN 'planned' ELSE 'renamed' END"),
)
def conflict_rename(spark: SparkSession, d: str) -> DataFrame:
    return _part_plan(spark, d, "rename", held=True)


_MIXED = "CASE WHEN p_partkey % 2 = 0 THEN upper(replace(p_name, ' ', '')) ELSE replace(p_name, ' ', '') END"


@query("case_insensitive_reserve", _PART_SQL.format(name=_MIXED, key="lower(n)", held="false", dest=_IF, action="'copy'", reason=_WHY))
def case_insensitive_reserve(spark: SparkSession, d: str) -> DataFrame:
    return _part_plan(spark, d, "rename", held=False, name=_MIXED)


# Whole plans --------------------------------------------------------------------------

_PLAN = f"""WITH r AS ({_RECORDS}),
    g AS (SELECT dir, stem, arg_min(taken, row(ds_rank, kind_rank, string_split(rel_path, '/'))) AS day, {_SHIPS} = 1 AS ships FROM r GROUP BY 1, 2),
    s AS (SELECT r.*, strftime(g.day, '%Y/%m-%B') AS folder, row_number() OVER (ORDER BY string_split(rel_path, '/')) - 1 AS pos,
      CASE WHEN k % 10 = 0 THEN 'old/' || CAST(k AS STRING) || '.jpg' END AS done FROM r JOIN g USING (dir, stem) WHERE g.ships),
    t AS (SELECT *, min(pos) OVER (PARTITION BY content) AS first FROM s),
    u AS (SELECT *, done IS NULL AND pos > first AS twin FROM t),
    v AS (SELECT *, row_number() OVER (PARTITION BY folder, lower(string_split(rel_path, '/')[2]), twin, done IS NULL ORDER BY pos) - 1 AS i FROM u),
    w AS (SELECT *, coalesce(done, folder || '/' || CASE WHEN i = 0 THEN string_split(rel_path, '/')[2]
      ELSE regexp_replace(string_split(rel_path, '/')[2], '\\.([^.]*)$', '_' || CAST(i AS STRING) || '.\\1') END) AS dest FROM v),
    plan AS (SELECT w.pos, w.rel_path AS source_rel, CASE WHEN w.twin THEN o.dest ELSE w.dest END AS dest_rel,
      CASE WHEN w.twin OR w.done IS NOT NULL THEN 'skip' ELSE 'copy' END AS action,
      CASE WHEN w.done IS NOT NULL THEN 'already-done' WHEN w.twin THEN 'duplicate-of-source' WHEN w.i = 0 THEN 'planned' ELSE 'renamed' END AS reason,
      w.size AS bytes, CASE WHEN w.twin THEN o.rel_path END AS duplicate_of FROM w LEFT JOIN w o ON w.twin AND o.pos = w.first)"""


def _plan(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    records = _records(spark, d)
    done = records.where("k % 10 = 0").select(F.col("rel_path").alias("source"), F.concat(F.lit("old/"), F.col("k").cast("string"), F.lit(".jpg")).alias("destination"))
    return planner.build(records, Options(now_year=NOW), journal=done), records


@query("full_plan", _PLAN + " SELECT source_rel, dest_rel, action, reason, bytes, duplicate_of FROM plan")
def full_plan(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d)[0].drop("pos")


@query("resume_join", _PLAN + " SELECT source_rel, dest_rel FROM plan WHERE reason = 'already-done'")
def resume_join(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d)[0].where("reason = 'already-done'").select("source_rel", "dest_rel")


@query("pending_filter", _PLAN + " SELECT source_rel, dest_rel, bytes FROM plan WHERE action <> 'skip'")
def pending_filter(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d)[0].where("action <> 'skip'").select("source_rel", "dest_rel", "bytes")


@query("stats_by_reason", _PLAN + " SELECT action, reason, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM plan GROUP BY 1, 2")
def stats_by_reason(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d)[0].groupBy("action", "reason").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


@query(
    "plan_stats",
    _PLAN + f""", c AS (SELECT {_SHIPS} = 1 AS ships, count(*) AS n FROM r GROUP BY dir, stem)
    SELECT (SELECT count(*) FROM c) AS "groups", (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM c WHERE NOT ships) AS unshippable,
      count(*) FILTER (action <> 'skip') AS pending, count(*) FILTER (reason LIKE 'duplicate-of-%') AS duplicates,
      count(*) FILTER (reason = 'existing-file' AND action = 'skip') AS skipped_existing, count(*) FILTER (reason = 'renamed') AS renamed,
      count(*) FILTER (reason = 'already-done') AS resumed, CAST(coalesce(sum(bytes) FILTER (action <> 'skip'), 0) AS BIGINT) AS pending_bytes FROM plan""",
)
def plan_stats(spark: SparkSession, d: str) -> DataFrame:
    return planner.stats(*_plan(spark, d))


@query("records_jsonl", _PLAN + " SELECT source_rel AS source, dest_rel AS destination, action, reason, bytes, duplicate_of FROM plan")
def records_jsonl(spark: SparkSession, d: str) -> DataFrame:
    outcomes = _plan(spark, d)[0].withColumns({"error": F.lit(None).cast("string"), "attempted": F.lit(True)})
    shape = "source string, destination string, action string, reason string, bytes long, duplicate_of string"
    return report.records(outcomes).select(F.from_json("value", shape).alias("r")).select("r.*")


@query(
    "human_lines",
    _PLAN + """ SELECT CASE WHEN reason = 'already-done' THEN source_rel || ' -> SKIP: already done' WHEN duplicate_of IS NOT NULL THEN source_rel || ' -> SKIP: duplicate of ' || duplicate_of
      ELSE source_rel || ' -> ' || dest_rel END AS line FROM plan""",
)
def human_lines(spark: SparkSession, d: str) -> DataFrame:
    outcomes = _plan(spark, d)[0].withColumns({"error": F.lit(None).cast("string"), "attempted": F.lit(True)})
    return report.human_lines(outcomes).select(F.col("value").alias("line"))


@query("component_path_order", f"WITH r AS (SELECT 'a' || CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE '/' END || CAST(o_orderkey AS STRING) AS p FROM orders) SELECT p, row_number() OVER (ORDER BY string_split(p, '/')) - 1 AS pos FROM r")
def component_path_order(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "orders").selectExpr("concat('a', CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE '/' END, cast(o_orderkey as string)) AS p")
    return planner.positions(rows, "p")
