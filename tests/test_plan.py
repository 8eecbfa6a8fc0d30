import io
import json
import os
import random

import pandas as pd
import pytest
from tests.mediafiles import jpeg
from pyspark.sql import functions as F

from shelf import cli
from shelf.operators.naming import decide
from shelf.options import Options
from shelf.plans import execute, planner, report, safety
from shelf.schema import JOURNAL, LISTING, RECORD


def _frame(spark, rows):
    return spark.createDataFrame(rows, RECORD + ", digest string")


def _record(path, size, digest):
    return (path, size, "image", None, "unknown", None, None, None, None, True, digest)


@pytest.mark.parametrize("mode", ["rename", "overwrite", "skip"])
def test_plan_agrees_with_serial_rule(spark, mode):
    """Random trees: the parallel plan equals the rule run over all rows in order."""
    rng = random.Random(mode)
    stems = ["a", "A", "a_1", "a_1_1", "b", "B_2"]
    for turn in range(4):
        n = rng.randint(6, 14)
        rows = [_record(f"d{i:02}/{rng.choice(stems)}.jpg", rng.choice([1, 2]), rng.choice(["x", "y", "z", None])) for i in range(n)]
        held = [("unknown-date/" + s + ".jpg", 1, False, rng.choice(["x", "q"])) for s in rng.sample(stems, 2)]
        done = [(rows[i][0], f"unknown-date/{rng.choice(stems)}.jpg") for i in rng.sample(range(n), 2)] if turn % 2 else []
        plan = planner.build(_frame(spark, rows), Options(on_conflict=mode, now_year=2030), spark.createDataFrame(done, JOURNAL), spark.createDataFrame(held, LISTING))
        got = {r["source_rel"]: (r["dest_rel"], r["action"], r["reason"], r["duplicate_of"]) for r in plan.collect()}
        match = {(s, d): p for p, s, _, d in sorted(held, reverse=True)}
        journal = dict(done)
        frame = pd.DataFrame(
            [(i, r[0], r[1], r[-1], "unknown-date/" + r[0].split("/")[1], journal.get(r[0]), match.get((r[1], r[-1]))) for i, r in enumerate(rows)],
            columns=["pos", "source_rel", "size", "digest", "wanted", "journal_dest", "dest_match"],
        )
        want = {rows[d[0]][0]: d[1:] for d in decide(frame, {h[0] for h in held}, "copy", mode, True)}
        assert got == want
        shipped = [d for d, a, _, _ in got.values() if a in ("copy", "overwrite")]
        assert len({d.lower() for d in shipped}) == len(shipped)


def test_stats_of_empty_input(spark):
    empty = spark.createDataFrame([], RECORD + ", digest string")
    plan = planner.build(empty, Options(now_year=2030))
    assert plan.count() == 0
    assert set(planner.stats(plan, empty).first().asDict().values()) == {0}


def _tree(root):
    files = {
        "phone/2/lake.jpg": jpeg(original="2008:02:29 06:30:00"),
        "phone/2/lake again.jpg": jpeg(original="2008:02:29 06:30:00"),
        "phone/eve.jpg": jpeg(original="2015:12:24 18:00:01"),
        "walk/fjord.jpg": jpeg(original="2012:09:03 11:45:10", gps=(60.393, 5.3242)),
        "walk/fjord.xmp": b"<x/>",
        "films/boat.mov": b"\0\0\0\x18ftypqt  ",
    }
    for path, data in files.items():
        os.makedirs(os.path.dirname(root / path), exist_ok=True)
        (root / path).write_bytes(data)


def test_end_to_end(spark, tmp_path):
    source, dest = tmp_path / "in", tmp_path / "out"
    _tree(source)
    opts = Options(source=str(source), dest=str(dest), now_year=2030, journal=str(tmp_path / "journal"))
    out = io.StringIO()
    code, s = cli.run(spark, Options(**{**opts.__dict__, "dry_run": True}), form="jsonl", out=out)
    assert code == 0 and not dest.exists() and s["planned"] == 4
    code, s = cli.run(spark, opts, form="jsonl", out=out)
    assert code == 0 and (s["copied"], s["duplicates"], s["unshippable"], s["failed"]) == (4, 1, 1, 0)
    found = {str(p.relative_to(dest)) for p in dest.rglob("*") if p.is_file()}
    assert found == {"2008/02-February/lake again.jpg", "2015/12-December/eve.jpg", "2012/09-September/fjord.jpg", "2012/09-September/fjord.xmp"}
    lines = [json.loads(x) for x in out.getvalue().splitlines()]
    twin = [x for x in lines if x.get("reason") == "duplicate-of-source"][0]
    assert twin["duplicate_of"] == "phone/2/lake again.jpg" and "error" not in twin
    code, s = cli.run(spark, opts, quiet=True)
    assert code == 0 and s["copied"] == 0 and s["skipped"] == 5  # a second run has nothing to do
    code, s = cli.run(spark, Options(**{**opts.__dict__, "resume": str(tmp_path / "journal")}), quiet=True)
    assert s["resumed"] == 4
    places = spark.createDataFrame([(0, 60.4, 5.32, "NO", "Vestland", "Bergen")], "ord long, lat float, lon float, cc string, region string, name string")
    moved = Options(source=str(source), dest=str(tmp_path / "two"), location="city", mode="move", now_year=2030)
    code, s = cli.run(spark, moved, places, quiet=True)
    assert s["moved"] == 4 and (tmp_path / "two/2012/09-September/Norway/Vestland/Bergen/fjord.xmp").exists() and not (source / "walk/fjord.jpg").exists()


def test_failures_are_reported(spark, tmp_path):
    source, dest = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    dest.mkdir()
    ops = spark.createDataFrame([(0, "gone.jpg", "a/gone.jpg", "copy", "planned", 3, None)], "pos long, source_rel string, dest_rel string, action string, reason string, bytes long, duplicate_of string")
    done = execute.run(ops, Options(source=str(source), dest=str(dest)))
    assert done.first()["error"] == "source vanished" and execute.counters(done).first()["failed"] == 1
    assert report.human_lines(done).first()["value"] == "gone.jpg -> FAILED: source vanished"
    (dest / ".shelf-cancel").touch()
    stopped = execute.counters(execute.run(ops, Options(source=str(source), dest=str(dest)))).first()
    assert (stopped["unattempted"], stopped["failed"]) == (1, 0)


def test_preflight(tmp_path):
    (tmp_path / "a").mkdir()
    bad = [
        (Options(source=str(tmp_path / "none"), dest=str(tmp_path / "b")), "source"),
        (Options(source=str(tmp_path / "a"), dest=str(tmp_path / "a" / "b")), "overlap"),
        (Options(source=str(tmp_path / "a"), dest=str(tmp_path / "b"), on_conflict="overwrite"), "overwrite-needs-force"),
    ]
    for opts, code in bad:
        with pytest.raises(safety.Fatal) as e:
            safety.prepare(opts)
        assert e.value.code == code
    assert not (tmp_path / "a" / "b").exists()
    safety.prepare(Options(source=str(tmp_path / "a"), dest=str(tmp_path / "a2")))  # not below: only a longer name


def test_human_bytes():
    assert [report.human_bytes(n) for n in (0, 1023, 1536, 1 << 40)] == ["0 B", "1023 B", "1.5 KiB", "1.0 TiB"]


def test_streaming_plan(spark, tmp_path):
    from shelf.streaming.incremental import plan_stream

    rows = [_record("a/x.jpg", 1, "p"), _record("b/x.jpg", 1, "q")]
    for n, row in enumerate(rows):
        _frame(spark, [row]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(_frame(spark, []).schema).parquet(str(tmp_path / "in"))
        plan_stream(stream, Options(now_year=2030), str(tmp_path / "plan"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "plan")).select("source_rel", "dest_rel").orderBy("source_rel").collect()
    assert [r["dest_rel"] for r in got] == ["unknown-date/x.jpg", "unknown-date/x_1.jpg"]


def test_adaptive_threshold_is_strict(spark):
    from shelf.operators.grouping import levels

    rows = spark.createDataFrame([("2024-01-05",)] * 10 + [(None,)] * 50, "d string").select(F.to_date("d").alias("d"))
    assert {r["level"] for r in levels(rows, "d", 10).collect()} == {"year"}
    assert {r["level"] for r in levels(rows, "d", 9).where("d is not null").collect()} == {"week"}
