import os

from tests.mediafiles import heic, jpeg, png, tiff, webp

from shelf.options import Options
from shelf.sources import exif, gazetteer, generate, journal, tree

WHEN = "2021:06:07 10:11:12"


def test_exif_containers():
    for data in (jpeg(original=WHEN, make="Canon", model="EOS R5"), webp(original=WHEN, make="Canon"), png(original=WHEN, make="Canon"), heic(original=WHEN, make="Canon"), heic(b"avif", original=WHEN, make="Canon"), tiff(original=WHEN, make="Canon")):
        facts = exif.read(data)
        assert (facts.original, facts.make) == (WHEN, "Canon")


def test_exif_gps_and_damage():
    lat, lon = exif.read(jpeg(original=WHEN, gps=(-33.9249, -18.4241))).gps
    assert abs(lat + 33.9249) < 1e-4 and abs(lon + 18.4241) < 1e-4
    assert exif.read(jpeg(original=WHEN, gps=(0.0, 0.0))).gps is None
    assert exif.degrees([(45, 1), (48, 1), (0, 0)], "N") is None
    whole = jpeg(original=WHEN, make="Canon")
    for cut in range(0, len(whole), 7):
        exif.read(whole[:cut])
    assert exif.read(b"\0\0\0\x18ftypheic" + b"\0" * 40) == exif.Facts()


def test_scan_and_listing(spark, tmp_path):
    (tmp_path / "cam").mkdir()
    (tmp_path / "cam" / "dated.JPG").write_bytes(jpeg(original=WHEN, make="Canon"))
    (tmp_path / "cam" / "fake.jpg").write_text("not a picture, dated 2020")
    (tmp_path / ".hidden.png").write_bytes(png(original=WHEN))
    (tmp_path / "20200102.xmp").write_text("<x/>")
    (tmp_path / "notes.txt").write_text("no")
    (tmp_path / ".shelf-tmp-1.jpg").write_text("left over")
    os.symlink(tmp_path, tmp_path / "loop")
    os.utime(tmp_path / "cam" / "fake.jpg", (1392249600, 1392249600))
    for follow in (False, True):
        records, failures = tree.scan(spark, Options(source=str(tmp_path), follow_symlinks=follow, now_year=2030))
        got = {r["rel_path"]: r for r in records.collect()}
        assert set(got) == {"cam/dated.JPG", "cam/fake.jpg", ".hidden.png", "20200102.xmp"}
        assert failures.count() == 0
    assert got["cam/dated.JPG"]["date_source"] == "exif-datetime-original" and got["cam/dated.JPG"]["camera_make"] == "Canon"
    assert got["cam/fake.jpg"]["date_source"] == "mtime" and not got["cam/fake.jpg"]["signature_ok"]
    assert got["20200102.xmp"]["date_source"] == "filename"
    records, _ = tree.scan(spark, Options(source=str(tmp_path), include_sidecars=False, now_year=2030))
    assert records.where("kind = 'sidecar'").count() == 0
    listed = {r["path"]: r["is_dir"] for r in tree.listing(spark, str(tmp_path)).collect()}
    assert listed["cam"] and not listed["notes.txt"] and "loop/cam" not in listed
    assert tree.listing(spark, str(tmp_path / "none")).count() == 0


def test_journal(spark, tmp_path):
    file = tmp_path / "j.jsonl"
    file.write_text('{"source":"a","destination":"x"}\n\n{"source":"a","destination":"y"}\n{"source":"b"}\n{"source":"c","dest')
    assert [tuple(r) for r in journal.read(spark, str(file)).collect()] == [("a", "y")]


def test_gazetteer(spark, tmp_path):
    file = tmp_path / "p.csv"
    file.write_text("lat,lon,name,admin1,cc\n45.8,15.9,Zagreb,Grad Zagreb,hr\nx,1,Bad,,de\n1,2," + "n" * 256 + ",,de\n")
    rows = gazetteer.read_csv(spark, str(file)).collect()
    assert [(r["cc"], r["region"], r["name"]) for r in rows] == [("HR", "Grad Zagreb", "Zagreb")]
    gazetteer.write(gazetteer.read_csv(spark, str(file)), str(tmp_path / "p.parquet"))
    assert spark.read.parquet(str(tmp_path / "p.parquet")).count() == 1


def test_generated_records(spark):
    rows = generate.records(spark, 1001).orderBy("rel_path").collect()
    assert len(rows) == 1001 and rows[-1]["rel_path"] == "dir_00002/IMG_0001000.jpg"
    assert (rows[0]["taken"].year, rows[0]["taken"].month) == (2014, 1)
