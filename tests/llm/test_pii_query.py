"""Personal data: the query's columns by brute force, and the tagger beyond the patterns."""

import hashlib
import random
import re

import pyarrow.parquet as pq

from shelf.llm import pii

DATA = "/root/testdata/sf0.001"


def luhn(digits):
    doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(digits[::-1])]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def brute(text):
    """Base spans straight from the contract's patterns."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_patterns_on_random_texts():
    rng = random.Random(17)
    parts = ["4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+49.30.1234567", "a.b@c.de", "a@b", "x@y.z.", "10.0.0.1", "256.1.1.1", "1.2.3.4.5", "0", "-", " ", ".", "+", "@", "é", "999", "(", ")"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert pii.base_spans(text) == brute(text), text


def test_query_by_brute_force(spark):
    texts = dict(zip(*(pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).column(c).to_pylist() for c in ("doc_id", "text")), strict=True))
    got = pii.op1_pii(spark, DATA).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        text = texts[r["doc_id"]] or ""
        base = brute(text)
        shown = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[1] == i for b in base) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(shown).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(shown) <= set(spans)
        key = [(int(s), pii.KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in spans)]
        assert key == sorted(key) and all(0 <= s < e <= len(text) for s, _, e in key)


def test_tagger_finds_what_the_patterns_miss():
    model, rng = pii.trained(), random.Random(991)
    made = [pii.labelled_text(rng, 400) for _ in range(300)]
    meet = lambda a, b: a[0] < b[2] and b[0] < a[2]
    wanted = hits = added_all = right = 0
    for (text, spans), (base, added) in zip(made, pii.find(model, [t for t, _ in made]), strict=True):
        beyond = [s for s in spans if s[2] < len(text) and not any(meet(s, b) for b in base)]
        wanted, added_all = wanted + len(beyond), added_all + len(added)
        hits += sum(any(meet(s, a) and s[1] == a[1] for a in added) for s in beyond)
        right += sum(any(meet(s, a) and s[1] == a[1] for s in spans) for a in added)
    print(f"beyond the patterns: {wanted} spans, recall {hits / wanted:.3f}, precision {right / added_all:.3f}")
    assert hits > 0.7 * wanted and right > 0.95 * added_all


def test_long_words_and_texts():
    name = "a" * 70
    (_, added), (base, _) = pii.find(pii.trained(), [f"write to {name} [at] example [dot] org now", "1" * 300_000 + " x@y.org"])
    assert [s[:2] for s in added] == [(9, 0)] and added[0][2] >= 9 + 70 + len(" [at] example")
    assert base == [(300_001, 0, 300_008)]
