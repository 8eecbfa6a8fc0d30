"""Items of few words are found in long documents."""

import random

from shelf.llm import decontam


def missed(spark, length: int, items: int = 1500) -> int:
    """How many items of ``length`` words, each held by one document, are not found."""
    rng = random.Random(length)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    docs, bench = [], []
    for i in range(items):
        words = [word() for _ in range(60)]
        at = rng.randrange(60 - length)
        docs.append((i, " ".join(words)))
        bench.append((i, " ".join(words[at : at + length])))
    found = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    return items - found.where("doc_id = item_id").count()


def test_short_items(spark):
    # one shingle, and two
    assert [missed(spark, n) for n in (5, 6)] == [0, 0]
