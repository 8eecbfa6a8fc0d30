import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelf.functions import dates, names, template

D = dt.datetime


@pytest.mark.parametrize(
    "name, want",
    [
        # a compact date, with a time of six digits, of nine, and with none
        ("harbour_20070330_214005.tif", D(2007, 3, 30, 21, 40, 5)),
        ("clip20160229_060708901.mp4", D(2016, 2, 29, 6, 7, 8)),
        ("scan-19980704-page3.png", D(1998, 7, 4)),
        ("20121101235958.heic", D(2012, 11, 1, 23, 59, 58)),
        # separated dates use one separator twice
        ("Lake 2011-09-17 at 05.06.07.webp", D(2011, 9, 17, 5, 6, 7)),
        ("2015-06_07.jpg", None),
        # an impossible time is midnight, an impossible or early day is no date
        ("2003-04-05T276001.gif", D(2003, 4, 5)),
        ("roll_20110231_101010.jpg", None),
        ("18991231_235959.jpg", None),
        ("18991231 and 2001-02-03.jpg", D(2001, 2, 3)),
        # digits around a date, and names without one
        ("98765201105061234567.jpg", None),
        ("P1070421.rw2", None),
        ("", None),
        (None, None),
    ],
)
def test_filename_date(name, want):
    assert dates.filename_date(name, 2031) == want


def test_exif_timestamp(spark):
    cases = [
        ("2009:10:11 21:22:23", D(2009, 10, 11, 21, 22, 23)),
        ("2009-10-11T21:22:23", D(2009, 10, 11, 21, 22, 23)),
        ("\t2009/1/2 3:04 ", D(2009, 1, 2, 3, 4)),
        ("2009:10:11 21:22:23+05:30", D(2009, 10, 11)),
        ("2009:10:11 24:01:00", D(2009, 10, 11)),
        ("2009:10:11", D(2009, 10, 11)),
        ("0000:00:00 00:00:00", None),
        ("2009:11:31 10:00:00", None),
        ("2009:10 21:22:23", None),
        ("1875:05:06 07:08:09", None),
        ("no date here", None),
        (" ", None),
        (None, None),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r["i"]: r["x"] for r in rows.select("i", dates.exif_timestamp(F.col("t"), 2030).alias("x")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


@pytest.mark.parametrize(
    "text, want",
    [
        ("<one>|two\"three", "-one--two-three"),
        ("summer. .", "summer"),
        (". . rc", "rc"),
        ("lpt1.backup.tar", "_lpt1.backup.tar"),
        ("aux", "_aux"),
        ("auxiliary", "auxiliary"),
        ("", "unnamed"),
        (" .. ", "unnamed"),
        ("ŵ", "ŵ"),
        ("ŵ" * 70, "ŵ" * 50),
        ("k" * 130, "k" * 100),
    ],
)
def test_component(text, want):
    assert names.component(text) == want


def test_file_name_keeps_extension():
    assert names.file_name("n" * 200 + ".jpeg") == "n" * 95 + ".jpeg"
    assert names.file_name("a.") == "a.unnamed"
    assert names.file_name(".jpg") == "jpg"
    assert names.file_name("x.a b") == "x.a b"
    assert names.file_name("con.jpg") == "_con.jpg"


def test_ascii_path_matches_python(spark):
    texts = ["a/b:c", "...", "x" * 150, "nul.a", "  y. ", "", "COM1", "a\tb", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", names.sanitize_ascii(F.col("t")).alias("s"), names.sanitize_component("t").alias("p"))
    for r in rows.collect():
        assert r["s"] == r["p"] == (None if r["t"] is None else names.component(r["t"]))


def test_fold_and_family():
    assert names.fold("A\\B/ÉaΣ") == "a/b/éaσ"
    assert names.family("x/IMG_1_2.JPG") == names.family("x/img.jpg") == names.family("x/img_7.jpg")
    assert names.family("x/img.png") != names.family("x/img.jpg")


@pytest.mark.parametrize(
    "text, code",
    [
        ("", "empty"), (" ", "empty"), ("//", "absolute"), ("/a", "absolute"), ("c:a", "absolute"), ("{year", "unclosed-brace"), ("a}", "stray-brace"),
        ("{nope}", "unknown-variable"), ("{year:2}", "bad-padding"), ("{year:010}", "bad-padding"), ("{city:02}", "bad-padding"), ("a/../b", "parent-escape"), ("{year}..", "parent-escape"),
    ],
)
def test_template_errors(text, code):
    with pytest.raises(template.TemplateError) as e:
        template.parse(text)
    assert e.value.code == code


def test_template_render(spark):
    place = "struct<country:string,region:string,city:string>"
    rows = [
        (1, dt.date(2026, 8, 19), ("Croatia", None, "Split"), "Canon"),
        (2, dt.date(2024, 12, 30), None, None),
        (3, None, ("Croatia", None, None), None),
        (4, dt.date(2026, 12, 31), None, "a/b"),
        (5, None, None, None),
    ]
    df = spark.createDataFrame(rows, f"k int, d date, p {place}, m string")

    def show(text):
        out = df.select("k", template.render(text, F.col("d"), F.col("p"), F.col("m")).alias("x")).collect()
        return {r["k"]: r["x"] for r in out}

    week = show("{iso_year}/{iso_year}-W{iso_week:02}")
    assert (week[2], week[4], week[5]) == ("2025/2025-W01", "2026/2026-W53", "unknown-date")
    assert show("{year}/{month:02}-{month_name}")[1] == "2026/08-August"
    nested = show("{year}/{country}/{month}")
    assert (nested[1], nested[2], nested[3], nested[5]) == ("2026/Croatia/8", "2024/12", "unknown-date/Croatia/unknown-date", "unknown-date")
    assert show("{country}/{region}")[5] == "unknown-date"
    mixed = show("{camera_make} in {city}")
    assert (mixed[1], mixed[2], mixed[4]) == ("Canon in Split", "unknown-camera in unknown-location", "a-b in unknown-location")
    assert show("{year:05}")[1] == "02026"
