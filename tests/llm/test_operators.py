"""Each corpus operator against brute force on small fixtures with awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from shelf.llm import decontam, graph, linededup, media, mixing, neardup, pii, planes, quality, secrets, sharding
from shelf.llm.common import Workspace, word_count

SCHEMA = "doc_id long, text string, lang string, source string, score int, size string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _texts() -> list[str | None]:
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["an", "the", "ié", "ou", "st", "re"]) for _ in range(rng.randint(1, 3)))
    base = [[word() for _ in range(rng.randint(30, 60))] for _ in range(6)]
    out: list[str | None] = [None, "", "  \t\n ", "one", "one two", "ONE two"]
    for b in base:
        out.append(" ".join(b))
        for edits in (0, 1, 2, 8):
            near = list(b)
            for _ in range(edits):
                near[rng.randrange(len(near))] = word()
            out.append(" ".join(near))
    out.append(" ".join(word() for _ in range(30_000)))
    return out


@pytest.fixture(scope="module")
def rows():
    texts = _texts()
    found = [(i + 10, t, "en", [None, "a", "b", "c"][i % 4], i, "x") for i, t in enumerate(texts)]
    found.append((None, "one two three four five six", None, None, None, None))
    found.append(found[8])  # a row repeated in full
    return found


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def _components(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def test_word_count(spark, docs, rows):
    got = docs.select(word_count(docs.text).alias("n")).collect()
    assert [r["n"] for r in got] == [len(WORDS.findall(r[1] or "")) for r in rows]


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(50)] + [(5, 5), (None, 3)]
    ws = Workspace(spark, "test")
    got = {r["node"]: r["component"] for r in graph.components(ws, spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == _components(real, {n for e in real for n in e})


def test_pii_base_spans():
    text = "a.b@x.example.com, 10.0.0.255 300.1.1.1, 4111 1111 1111 1111, 4111-1111-1111-1112, +1 (499) 555-6503 +12"
    kinds = [(text[s:e], pii.KINDS[k]) for s, k, e in pii.base_spans(text)]
    assert kinds == [("a.b@x.example.com", "email"), ("10.0.0.255", "ip"), ("4111 1111 1111 1111", "card"), ("+1 (499) 555-6503", "phone")]
    rng = random.Random(1)
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(2000):
        s = "".join(rng.choice("a1@.-é 0+") for _ in range(30))
        want = [(m.start(), 0, m.end()) for m in email.finditer(s)]
        want += [(m.start(), 1, m.end()) for m in ip.finditer(s) if all(int(p) <= 255 for p in m[0].split("."))]
        assert [x for x in pii.base_spans(s) if x[1] < 2] == sorted(want)


def test_pii_gradients():
    rng, draw = random.Random(3), np.random.default_rng(0)
    model = pii.Tagger.fresh(draw)
    model.p = {k: v.astype(float) for k, v in model.p.items()}
    some = [pii.labelled_text(rng, 20) for _ in range(2)]
    ids, tags = np.stack([pii.char_ids(t) for t, _ in some]), np.stack([pii.tags_of(s, 20) for _, s in some])
    _, grads = model.gradients(ids, tags)
    for name, at in (("move", (0, 1)), ("xf", (1, 2)), ("hb", (3, 4)), ("embed", (ids[0, 3], 1)), ("out", (2, 2))):
        ends = []
        for step in (1e-4, -2e-4):
            model.p[name][at] += step
            ends.append(model.gradients(ids, tags)[0])
        model.p[name][at] += 1e-4
        assert abs(grads[name][at] - (ends[0] - ends[1]) / 2e-4) < 1e-2 * max(1.0, abs(grads[name][at]))


def test_pii_tagger_and_scan(spark, docs, empty):
    model = pii.trained()
    rng, hits, wanted, wrong = random.Random(77), 0, 0, 0
    for _ in range(150):
        text, spans = pii.labelled_text(rng, 200)
        want = {(s, k, e) for s, k, e in spans if e < 190}
        got = {x for x in pii.decoded(model, [text])[0] if x[2] < 190}
        hits, wanted, wrong = hits + len(want & got), wanted + len(want), wrong + len(got - want)
    assert hits / wanted > 0.6 and wrong / max(1, hits + wrong) < 0.3
    assert pii.find(model, ["plain words only, nothing else. " * 500]) == [([], [])]
    long = "x " * 40_000 + "call (499) 555-6503 now, mail a@b.org " + "y " * 1000
    base, added = pii.find(model, [long])[0]
    assert [long[s:e] for s, _, e in base] == ["a@b.org"] and "(499) 555-6503" in [long[s:e] for s, _, e in added]
    assert pii.scan(docs, model).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    assert pii.scan(empty, model).count() == 0


def test_media(spark, docs, rows, empty):
    page = "<h1>A</h1><p>b <b>c</b></p><figure><img src='u.png' alt='x'><figcaption>Cap <i>1</i></figcaption></figure><script>no</script><img src='v.png' title='t'>tail"
    items = media.parse_html(page)
    assert [(i["kind"], i["text"] or i["ref"], i["caption"]) for i in items] == [
        ("text", "A", None), ("text", "b c", None), ("media", "u.png", "Cap 1"), ("media", "v.png", "t"), ("text", "tail", None),
    ]
    assert [i["pos"] for i in items] == list(range(5))
    assert media.parse_html(None) == media.parse_html("") == []
    for text in (b"", b"a", b"x" * 64, b"y" * 65):
        payload, stored = media.to_wave(text)
        assert media.from_wave(stored) == (payload, len(text)) and len(payload) % 64 == 0 and payload
    stored = Workspace(spark, "test").save(media.store_texts(docs), "store")
    got = media.resolve(media.sequences(stored.select("doc_id", "html")).drop("html"), media.read_store(stored)).collect()
    assert len(got) == len(rows)
    by_id = {r[0]: (r[1] or "").encode() for r in rows}
    for r in got:
        payload, whole = media.to_wave(by_id[r["doc_id"]])
        want = (len(by_id[r["doc_id"]]), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), hashlib.sha256(whole).hexdigest())
        assert (r["n_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_sha256"]) == want
    pages = spark.createDataFrame([(1, "<img src='a'><img src='b' alt='q'>", "old")], "page_id long, html string, items string")
    unresolved = media.resolve(media.sequences(pages), spark.createDataFrame([], "digest string, media binary")).collect()
    assert [(r["pos"], r["caption"], r["media"]) for r in sorted(unresolved, key=lambda r: r["pos"])] == [(0, None, None), (1, "q", None)]
    assert media.store_texts(empty).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(4)
    for n, share in ((1, 1.0), (40, 0.5), (3000, 0.8)):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = a.copy()
        changed = round(n * (1 - share) / (1 + share))
        b[:changed] = rng.integers(0, 1 << 63, changed).astype(np.uint64)
        real = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        same = (neardup.sketch(np.unique(a)) == neardup.sketch(np.unique(b))).mean()
        assert abs(same - real) < 0.17


def test_near_duplicates(spark, docs, rows, empty):
    got = neardup.near_duplicates(docs, words=3, percent=85).collect()
    sets = {r[0]: _shingles(r[1], 3) for r in rows if r[0] is not None}
    ids = sorted(sets)
    pairs = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = _components(pairs, ids)
    assert len(got) == len(rows) and pairs
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicates_without_leaders(spark, docs, rows, monkeypatch):
    """The block-by-block stage alone, with blocks of three, finds the same components."""
    want = {tuple(r) for r in neardup.near_duplicates(docs, words=3, percent=85).collect()}
    monkeypatch.setattr(neardup, "LEADERS", 0)
    monkeypatch.setattr(neardup, "BLOCK", 3)
    assert {tuple(r) for r in neardup.near_duplicates(docs, words=3, percent=85).collect()} == want


def test_deduplicated_keeps_columns(spark, docs, rows):
    out = neardup.deduplicated(docs, words=3, percent=85)
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert len(ids) == len(set(ids)) and None in ids


def test_sharding(spark, docs, rows, empty):
    got = sharding.shard(docs).collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in got) == sorted((r[0] or 0, len((r[1] or "").encode()) + 1) for r in rows)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    even = spark.range(4000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' else cast(id as string) end as text")
    sizes = [r["n"] for r in sharding.shard(even).groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "n").collect()]
    assert len(sizes) == 8 and max(sizes) < 1.02 * min(sizes)  # the hot text is cut by id
    assert sharding.shard(empty).count() == 0


def test_line_dedup(spark, empty):
    rng = random.Random(9)
    line = lambda: " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(25))
    base = [line() for _ in range(6)]
    near = [b[:60] + "zq" + b[62:] for b in base[:3]]
    texts = ["\n".join([base[0], "", "short", base[1]]), "\n".join([near[0], base[2], "short"]), "\n".join(near[1:] + [base[0]]), None, "", "\n".join(base[3:])]
    table = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(None, base[0], "k")], "doc_id long, text string, line string")
    got = {(r["doc_id"], r["line_no"]): (r["kept_doc_id"], r["kept_line_no"]) for r in linededup.duplicate_lines(table).collect()}
    lines = {(i, k): s for i, t in enumerate(texts) if t for k, s in enumerate(t.split("\n")) if s}
    grams = {k: {s[i : i + 8] for i in range(max(1, len(s) - 7))} for k, s in lines.items()}
    keys = sorted(lines)
    pairs = [(a, b) for a in keys for b in keys if a < b and 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b])]
    want = {k: v for k, v in _components(pairs, keys).items() if k != v}
    assert got == want and len(want) >= 5
    cut = {r["doc_id"]: r["text"] for r in linededup.without_duplicates(table).collect()}
    assert cut[1] == base[2] and cut[3] is None and cut[None] == base[0]
    assert linededup.duplicate_lines(empty).count() == 0


def test_quality(spark, docs, empty):
    data = "/root/testdata/sf0.01"
    got = quality.op6_quality(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.97 * len(got) > 50
    labels = spark.createDataFrame([(10, 1), (12, 0), (13, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    scored = quality.classify(docs, model)
    assert scored.count() == docs.count() and scored.where("score between 0 and 1").count() == docs.count()
    assert quality.accept(docs, model).columns == docs.columns
    untrained = quality.train(empty, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality.classify(docs, untrained).collect()} == {0.5}
    assert quality.classify(empty, model).count() == 0


def test_decontamination(spark, docs, rows, empty, monkeypatch):
    texts = [r[1] for r in rows]
    items = [texts[6], "  ".join((texts[-3] or "").split()[777:800]), "one two", None, "", "not in any of the documents at all, surely not"]
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)] + [(None, texts[6], "x")], "item_id long, text string, doc_id string")
    table = decontam._skip_table
    for full in (False, True):  # as it is, and with every bit set, as a very large benchmark has it
        monkeypatch.setattr(decontam, "_skip_table", lambda found, full=full: table(found) | np.uint8(255 * full))
        got = {(r["doc_id"], r["item_id"]): r["shared"] for r in decontam.contaminated(docs, bench).collect()}
        want = {}
        for r in rows:
            for i, t in enumerate(items):
                own = _shingles(t, 5)
                if r[0] is not None and own and len(own & _shingles(r[1], 5)) >= 0.8 * len(own):
                    want[r[0], i] = len(own & _shingles(r[1], 5))
        assert got == want and len(want) > 4
    assert decontam.contaminated(empty, bench).count() == decontam.contaminated(docs, empty.selectExpr("doc_id as item_id", "text")).count() == 0


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes_round_trip(kind):
    rng = np.random.default_rng(1)
    for n, top in ((0, 2), (1, 1 << 32), (7, 300), (65_536, 50_000), (65_537 + 9, 1 << 32)):
        ids = rng.integers(0, top, n, dtype=np.uint64).astype("<u4")
        payload, index = planes.to_planes(ids, kind)
        assert (planes.from_planes(payload, index, n, kind) == ids).all()
    with pytest.raises(ValueError):
        planes.from_planes(payload + b"x", index, n, kind)


def test_token_ids(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(planes.tokenizer_path())
    odd = ["It's ‘x’ don't, e.g. A.B. <|endoftext|> ÀÉ İstanbul ΣΑΣ 12,5 naïvé   a b", "ß… ", "日本 語"]
    table = spark.createDataFrame(rows[:12] + [(100 + i, t, None, None, None, None) for i, t in enumerate(odd)] + rows[-3:], SCHEMA)
    got = {(r["doc_id"], r["start"]): (r["n_tokens"], r["ids_crc32"]) for r in planes.write_and_read(table, planes.tokenizer_path()).collect()}
    want, at = {}, 0
    for r in sorted(table.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"], r["text"] or "")):
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want[r["doc_id"], at] = (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert got == want
    assert planes.write_and_read(empty, planes.tokenizer_path()).count() == 0


def test_secrets(spark, docs, empty):
    rng = random.Random(8)
    key = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    hexed, b62 = key("0123456789abcdef", 40), key("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 44)
    texts = [f'é Token = "{hexed}" and api_key:short, secret: password:abcdefghij', f"AKIA{'A1' * 8} {b62}!", "aaaa1aaaaaaaaaaaaaaa1aaaaaaaaaaaa 0123456789", None, "", "x" * 50_000 + " plain"]
    assign = re.compile(secrets.ASSIGN.replace("(?i:", "(?:"), re.I | re.A)
    for i, r in enumerate(sorted(secrets.scan(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect(), key=lambda r: r["doc_id"])):
        t = texts[i] or ""
        want = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[1]) >= 8]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        assert [tuple(s) for s in r["base"]] == sorted(want)
        added = [t[s["start"] : s["end"]] for s in r["added"]]
        assert added == {1: [b62]}.get(i, [])  # the hex token is a base span
    assert secrets.scan(empty).count() == 0


def test_mixing(spark, docs, rows, empty):
    got = mixing.mix(docs).collect()
    names = sorted({r[3] for r in rows if r[3]}) + [None]
    size = {n: sum(len(WORDS.findall(r[1] or "")) for r in rows if r[3] == n) for n in names}
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    target, capped = {}, set()
    while True:
        level = (sum(size.values()) - sum(3 * size[n] for n in capped)) / sum(weight[n] for n in names if n not in capped)
        over = {n for n in names if n not in capped and level * weight[n] > 3 * size[n]}
        if not over:
            break
        capped |= over
    target = {n: 3 * size[n] if n in capped else level * weight[n] for n in names}
    source = {r[0]: r[3] for r in rows}
    taken = dict.fromkeys(names, 0)
    for r in got:
        n = source[r["doc_id"]]
        assert r["source_size"] == size[n] and abs(r["target"] - target[n]) < 1e-6 * max(1, target[n]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[n] += r["taken"]
    assert len(got) == len(rows) and all(abs(taken[n] - target[n]) <= 1 for n in names)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()), key=str)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() > 0
    assert mixing.mix(empty).count() == mixing.mixed(empty).count() == 0


def test_pipeline(spark):
    """Each stage against its operator's own decisions on its own input."""
    import corpus_pipeline

    data = "/root/testdata/sf0.001"
    ws, held = Workspace(spark, "test"), spark.read.parquet(f"{data}/documents.parquet")
    names = held.columns
    for number, (stage, run) in enumerate(corpus_pipeline.STAGES):
        before, held = held, ws.save(run(spark, held, data), f"{number}")
        ids = {r["doc_id"]: r["text"] for r in before.collect()}
        if number < 4:
            assert held.columns == names
        after = [r["doc_id"] for r in held.collect()]
        if stage == "near-duplicates":
            sets = {i: _shingles(t, 5) for i, t in ids.items()}
            pairs = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            assert set(after) == set(_components(pairs, ids).values())
        elif stage == "decontamination":
            items = [_shingles(r["text"], 5) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
            leaks = {i for i, t in ids.items() if any(len(x & _shingles(t, 5)) >= 0.8 * len(x) for x in items)}
            assert set(after) == set(ids) - leaks
        elif stage == "token-ids":
            assert sorted(after) == sorted(r["doc_id"] for r in before.collect())
        else:
            assert set(after) <= set(ids) and len(set(after)) > len(ids) // 2
