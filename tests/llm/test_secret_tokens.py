"""Every token that mixes letters and digits is tested, and its part alone is found."""

import random
import string
import uuid

from shelf.llm import secrets

LOWER, UPPER, DIGITS = string.ascii_lowercase, string.ascii_uppercase, string.digits


def test_mixed_tokens_are_found(spark):
    rng = random.Random(21)
    key = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    any_case = LOWER + UPPER + DIGITS
    want = {
        "AWS_KEY={}": key(any_case + "+/", 40),
        "xy={} next": key(any_case, 44) + "==",
        "id {}.": key(UPPER + DIGITS, 40),
        "at {},": str(uuid.UUID(int=rng.getrandbits(128), version=4)),
        "mixed {}": key(any_case, 20) + "/" + key(any_case, 20) + "_" + key(any_case, 10),
        "lower {}": key(LOWER + DIGITS, 30) + "_" + key(LOWER + DIGITS, 15),
    }
    texts = [t.format(v) for t, v in want.items()]
    wanted = list(want.values())
    texts.append("use sk-" + (body := key(LOWER + DIGITS, 40)))
    wanted.append("sk-" + body)
    texts += ["a-1" + "-" * 40, "AAAA=" + "a1" * 30, "name=short12", "=" * 60 + "a1"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["added"]] for r in secrets.scan(table, level=0.01).collect()}
    assert got == {i: [wanted[i]] if i < len(wanted) else [] for i in range(len(texts))}
