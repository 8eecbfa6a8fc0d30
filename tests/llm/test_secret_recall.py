"""Random tokens are found whatever else their stratum holds."""

import random
import string

from shelf.llm import secrets

ANY_CASE = string.ascii_letters + string.digits + "-_"


def shares(spark, random_tokens: int, slugs: int, length: int = 44, seed: int = 5) -> tuple[float, float]:
    """Shares of random base64url tokens and of slugs in words that are reported."""
    rng = random.Random(seed)
    words = ["Index", "page", "the", "list", "of", "user", "File", "archive", "report", "2024"]
    key = lambda: "a1B-" + "".join(rng.choices(ANY_CASE, k=length - 4))
    slug = lambda: ("a1B-" + "-".join(rng.choices(words, k=length)))[:length].rstrip("-").ljust(length, "x")
    rows = [(i, key() if i < random_tokens else slug()) for i in range(random_tokens + slugs)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = [r["doc_id"] for r in secrets.scan(table).where("size(added) > 0").select("doc_id").collect()]
    kept = sum(i < random_tokens for i in found)
    return kept / random_tokens, (len(found) - kept) / max(1, slugs)


def test_random_tokens_among_slugs(spark):
    kept, wrong = shares(spark, 1000, 9000)
    assert kept >= 0.99 and wrong < 0.05
