"""Trees without digests, a journal not yet begun, gazetteers beyond the broadcast bound."""

import numpy as np
import pytest

from shelf.operators import geo
from shelf.options import Options
from shelf.sources import journal, tree


def test_no_file_is_hashed_without_dedup(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.jpg").write_bytes(b"\xff\xd8\xff" + bytes(3_000_000))
    rows, failures = tree.scan(spark, Options(source=str(tmp_path), dedup="off", now_year=2030))
    assert [(r["rel_path"], r["size"], r["digest"]) for r in rows.collect()] == [("a/x.jpg", 3_000_003, None)] and failures.isEmpty()
    held = tree.listing(spark, str(tmp_path), digests=False).where("not is_dir").collect()
    assert [(r["path"], r["digest"]) for r in held] == [("a/x.jpg", None)]


def test_journal_not_yet_begun(spark, tmp_path):
    assert journal.read(spark, str(tmp_path / "none")).isEmpty()


@pytest.mark.parametrize("bound", [3, 1000])
def test_places_in_parts(spark, monkeypatch, bound):
    monkeypatch.setattr(geo, "BROADCAST_PLACES", bound)
    rng = np.random.default_rng(4)
    places = [(i, float(np.float32(y)), float(np.float32(x))) for i, (y, x) in enumerate(rng.integers(-9, 9, (40, 2)))]
    points = [(i, (float(np.float32(y)), float(np.float32(x)))) for i, (y, x) in enumerate(rng.integers(-9, 9, (60, 2)))]
    got = geo.nearest(spark.createDataFrame(points, "k long, gps struct<lat:float,lon:float>"), spark.createDataFrame(places, "ord long, lat float, lon float"), "k")
    want = {k: min(places, key=lambda p: ((p[1] - y) ** 2 + (p[2] - x) ** 2, p[0]))[0] for k, (y, x) in points}
    assert {r["k"]: r["ord"] for r in got.collect()} == want
