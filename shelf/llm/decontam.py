"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are partitioned by size (their number of shingle positions, in classes of 1, 2,
3, 4, 6 and 8, then a factor sqrt(2) apart). For each class that the benchmark has, documents are cut into overlapping
windows of one and a half class sizes, so that a short item in a long document still has a
high Jaccard similarity with some window; item and window are candidates if one of
``HASHES`` minima agrees. Candidates are verified by the exact share of the item's shingles
that the whole document holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelf.llm.common import Workspace, bounded, mix, shingle_hashes, shingle_set, texts_of, word_hashes, words

#: At threshold 0.8 a contiguous item has a similarity of 1/3 or more with one window, and
#: is missed with a chance of (2/3) ** HASHES, about 2e-6.
HASHES = 32
WORDS, THRESHOLD = 5, 0.8
_ODD = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_TABLE_BITS = 24
#: Sizes of the classes below 8: there, windows of 12 would be too wide for an item.
_SMALL = (1, 2, 3, 4, 6)


def size_class(positions: int) -> int:
    """Class of an item: the smallest of 0, 1, 2... whose size takes its positions."""
    c = 0
    while positions > class_size(c):
        c += 1
    return c


def class_size(c: int) -> int:
    """1, 2, 3, 4 and 6, then ``8 * 2 ** (i / 2)``."""
    return _SMALL[c] if c < len(_SMALL) else int(np.ceil(8 * 2 ** ((c - len(_SMALL)) / 2)))


def _stamp(minima: np.ndarray, c: int) -> np.ndarray:
    """Minima (hash by window) marked by hash number and class, as signed 64-bit values."""
    salt = mix(np.arange(1, HASHES + 1, dtype=np.uint64) + np.uint64(c << 8))
    return mix(minima ^ salt[:, None]).view(np.int64)


def window_stamps(hashes: np.ndarray, c: int) -> np.ndarray:
    """Stamps ``(HASHES, windows)`` of a document's windows for one class."""
    half = -(-class_size(c) // 2)
    starts = np.arange(0, len(hashes), half)
    minima = np.stack([np.minimum.reduceat(hashes * a, starts) for a in _ODD])
    one = np.minimum(minima[:, :-1], minima[:, 1:]) if minima.shape[1] > 1 else minima
    three = np.minimum(one[:, :-1], minima[:, 2:]) if one.shape[1] > 1 else one
    return _stamp(three, c)


def item_table(items: DataFrame, k: int) -> DataFrame:
    """``item_id, text, class, positions, shingles, stamps`` of every item with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            rows = {n: [] for n in ("item_id", "class", "shingles", "stamps")}
            for item, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                found = shingle_hashes(word_hashes(words(text)), k)
                if item is None or not len(found):
                    continue
                c = size_class(len(found))
                rows["item_id"].append(item)
                rows["class"].append(c)
                rows["shingles"].append(np.unique(found).view(np.int64))
                rows["stamps"].append(_stamp(np.stack([(found * a).min(keepdims=True) for a in _ODD]), c)[:, 0])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(rows["item_id"], pa.int64()), pa.array(rows["class"], pa.int32()), pa.array(rows["shingles"], longs), pa.array(rows["stamps"], longs)], names=list(rows))

    read = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return read.mapInArrow(run, "item_id long, class int, shingles array<long>, stamps array<long>")


def _skip_table(found: DataFrame) -> np.ndarray:
    """Packed bits: which top bits some item's shingle has.

    The bits are aggregated to words of 64, so the driver gets no more than ``2 **
    (_TABLE_BITS - 6)`` rows and workers 2 MB, whatever the benchmark's size.
    """
    top = found.select(F.explode("shingles").alias("h")).select(F.shiftrightunsigned("h", 64 - _TABLE_BITS).cast("int").alias("b"))
    words64 = top.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, b & 63)")).alias("bits")).toArrow()
    table = np.zeros(1 << (_TABLE_BITS - 6), "<i8")
    table[words64.column("w").to_numpy()] = words64.column("bits").to_numpy()
    return table.view(np.uint8)


def candidates(docs: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Distinct ``doc_id, item_id`` pairs that agree on a minimum in some window.

    A document none of whose shingles is an item's shingle has no such minimum; a table of
    the items' shingles by their top bits skips most such documents before hashing.
    """
    classes = sorted(r["class"] for r in found.select("class").distinct().collect())
    packed = _skip_table(found)
    shift = np.uint64(64 - _TABLE_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = np.unpackbits(packed, bitorder="little").astype(bool)
        for batch in bounded(batches):
            ids, stamps = [], []
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                hashes = shingle_hashes(word_hashes(words(text)), k)
                if not len(hashes):
                    continue
                hits = some[(hashes >> shift).astype(np.int64)]
                if not hits.any():
                    continue
                seen = []
                for c in classes:
                    marks = window_stamps(hashes, c)
                    half = -(-class_size(c) // 2)
                    near = np.add.reduceat(hits, np.arange(0, len(hits), half), dtype=np.int64) > 0
                    for _ in range(2):
                        near = near[:-1] | near[1:] if len(near) > marks.shape[1] else near
                    seen.append(np.unique(marks[:, near]))
                ids.append(doc)
                stamps.append(np.concatenate(seen))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(stamps, pa.list_(pa.int64()))], names=["doc_id", "stamps"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null and doc_id is not null")
    marked = rows.mapInArrow(run, "doc_id long, stamps array<long>").select("doc_id", F.explode("stamps").alias("stamp"))
    return marked.join(found.select("item_id", F.explode("stamps").alias("stamp")), "stamp").select("doc_id", "item_id").distinct()


def contaminated(docs: DataFrame, items: DataFrame, k: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of a document and a test item that it holds: ``doc_id, item_id, shared,
    item_shingles, containment``.

    ``docs`` needs ``doc_id, text`` and ``items`` needs ``item_id, text``; other columns are
    not read. Null, empty and blank texts on either side pair with nothing; an item of fewer
    than ``k`` words is one shingle, met by a document of just those words. Rows with null
    ids are not reported. Rows that repeat an id are reported once, with the largest share.
    Either table empty gives an empty result.
    """
    ws = Workspace(docs.sparkSession, "decontam")
    found = ws.save(item_table(items, k), "items")
    pairs = ws.save(candidates(docs, found, k), "pairs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            shared, held = [], {}
            for doc, text, hashes in zip(batch.column(0).to_pylist(), texts_of(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                if held.get("doc") != (doc, text):
                    held = {"doc": (doc, text), "set": shingle_set(text, k)}
                item = np.array(hashes, np.int64).view(np.uint64)
                shared.append(int(np.isin(item, held["set"], assume_unique=True).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(pc.list_value_length(batch.column(3)), pa.int64())],
                names=["doc_id", "item_id", "shared", "item_shingles"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = pairs.join(texts, "doc_id").join(found.select("item_id", "shingles"), "item_id").select("doc_id", "item_id", "text", "shingles")
    counted = both.mapInArrow(run, "doc_id long, item_id long, shared long, item_shingles long")
    share = F.col("shared") / F.col("item_shingles")
    best = counted.withColumn("containment", share).where(F.col("containment") >= threshold)
    return best.groupBy("doc_id", "item_id").agg(
        F.max_by("shared", "containment").alias("shared"), F.max_by("item_shingles", "containment").alias("item_shingles"), F.max("containment").alias("containment")
    )


def decontaminated(docs: DataFrame, items: DataFrame, k: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that hold no test item; rows with a null doc_id stay."""
    ws = Workspace(docs.sparkSession, "decontaminated")
    found = ws.save(contaminated(docs, items, k, threshold).select("doc_id").distinct(), "found")
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return contaminated(docs, items)
