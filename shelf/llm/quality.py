"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each class gets a mean and a shrinkage covariance of transformed text statistics. A score
is the logistic of the difference of the two Mahalanobis log densities, computed with
Cholesky factors that are inverted once on the driver and travel with the function.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelf.llm.common import bounded, texts_of

#: Bound on labelled rows used for training: the rows with the smallest hash of doc_id.
TRAIN_ROWS = 20_000
#: Weight of the scaled identity in each class covariance.
SHRINKAGE = 0.2
#: Divides the log-density difference, so that scores are not all 0 or 1.
TEMPERATURE = 4.0
#: Score from which a document is predicted to be of quality 1.
THRESHOLD = 0.3

_UPPER, _LOWER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _LOWER[97:123], _DIGIT[48:58] = True, True, True
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_STOP = np.isin(np.arange(256), np.frombuffer(b".,;:?'\"-()", np.uint8))
_HIGH = np.arange(256) >= 128
_MARK = ~(_UPPER | _LOWER | _DIGIT | _SPACE | _STOP | _HIGH)

FEATURES = ("marks", "upper", "digits", "stops", "bangs", "word_len", "words", "repeats", "letter_entropy", "line_len")


def statistics(text: bytes | None) -> list[float]:
    """Transformed statistics of a whole text; null and empty texts have the same."""
    text = text or b""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256).astype(float)
    ws = text.lower().split()
    n, total = len(ws), counts.sum()
    solid = max(total - counts[_SPACE].sum(), 1.0)
    letters = counts[_LOWER] + counts[_UPPER]
    p = (letters + 0.5) / (letters.sum() + 13.0)
    lines = text.count(b"\n") + 1
    share = lambda x: float(np.sqrt(x / solid))
    return [
        share(counts[_MARK].sum()),
        share(counts[_UPPER].sum()),
        share(counts[_DIGIT].sum()),
        share(counts[_STOP].sum()),
        share(counts[33]),
        float(np.log((solid + 5.0) / (n + 1.0))),
        float(np.log1p(n)) / 4.0,
        # A text of n words drawn from running prose repeats more the longer it is.
        float(np.log((len(set(ws)) + 1.0) / (n + 1.0) ** 0.9)),
        float(-(p * np.log(p)).sum()),
        float(np.log((n + 1.0) / lines)) / 4.0,
    ]


@dataclass(frozen=True)
class Discriminant:
    """Scaling, class means, inverted Cholesky factors, and log normalisers."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    whiten: np.ndarray
    offsets: np.ndarray
    temperature: float = TEMPERATURE

    def score(self, x: np.ndarray) -> np.ndarray:
        """Score in [0, 1] for rows of statistics; higher means quality 1 is likelier."""
        z = (x - self.centre) / self.scale
        logs = [o - 0.5 * (((z - m) @ w.T) ** 2).sum(1) for m, w, o in zip(self.means, self.whiten, self.offsets, strict=True)]
        gap = np.clip((logs[1] - logs[0]) / self.temperature, -50, 50)
        return 1.0 / (1.0 + np.exp(-gap))


def fit_moments(count: np.ndarray, total: np.ndarray, square: np.ndarray, shrinkage: float = SHRINKAGE) -> Discriminant:
    """Fit from per-class counts, sums and sums of outer products.

    A class without rows takes the pooled moments, so scores stay defined (0.5 everywhere
    when no row is labelled at all).
    """
    d = total.shape[1]
    n = count.sum()
    centre = total.sum(0) / max(n, 1)
    spread = np.diag(square.sum(0)) / max(n, 1) - centre**2
    scale = np.sqrt(np.maximum(spread, 1e-6))
    means, whiten, offsets = [], [], []
    for c in (0, 1):
        if count[c] >= 2:
            mean = total[c] / count[c]
            cov = square[c] / count[c] - np.outer(mean, mean)
        else:
            mean, cov = centre, square.sum(0) / max(n, 1) - np.outer(centre, centre)
        mean, cov = (mean - centre) / scale, cov / np.outer(scale, scale)
        target = max(np.trace(cov) / d, 1e-3)
        cov = (1 - shrinkage) * cov + shrinkage * target * np.eye(d)
        factor = np.linalg.cholesky(cov)
        means.append(mean)
        whiten.append(np.linalg.inv(factor))
        offsets.append(-np.log(np.diag(factor)).sum())
    return Discriminant(centre, scale, np.array(means), np.array(whiten), np.array(offsets))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, shrinkage: float = SHRINKAGE) -> Discriminant:
    """Fit on at most ``rows`` labelled documents, the ones with the smallest hash of doc_id.

    Only class moments of each partition reach the driver. Labels other than 0 and 1, null
    labels, and null ids are passed over; a doc_id with two labels counts for each.
    """
    d = len(FEATURES)
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .select("doc_id", F.col("quality").cast("int").alias("_label"))
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "_label")
        .limit(rows)
    )
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "_label")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, square = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in bounded(batches):
            x = np.array([statistics(t) for t in texts_of(batch.column(0))]).reshape(-1, d)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for c in (0, 1):
                part = x[y == c]
                count[c] += len(part)
                total[c] += part.sum(0)
                square[c] += part.T @ part
        yield pa.RecordBatch.from_pydict({"m": pa.array([np.concatenate([count, total.ravel(), square.ravel()])], pa.list_(pa.float64()))})

    sums = (
        known.mapInArrow(moments, "m array<double>")
        .select(F.posexplode("m").alias("i", "v"))
        .groupBy("i")
        .agg(F.sum("v").alias("v"))
        .collect()
    )
    flat = np.zeros(2 + 2 * d + 2 * d * d)
    for r in sums:
        flat[r["i"]] = r["v"]
    return fit_moments(flat[:2], flat[2 : 2 + 2 * d].reshape(2, d), flat[2 + 2 * d :].reshape(2, d, d), shrinkage)


def classify(
    docs: DataFrame,
    model: Discriminant,
    keep: list[str] | None = None,
    threshold: float = THRESHOLD,
    into: tuple[str, str] = ("score", "predicted"),
) -> DataFrame:
    """Append score and prediction, named by ``into``, to the columns ``keep`` (all, by default).

    Every row stays, in one narrow pass. Null and empty texts are scored as a text without
    characters. A column that already bears one of the two names is replaced. Repeated
    rows score alike. An empty table gives an empty result.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in into]
    schema = docs.select(*keep).schema.add(into[0], "double")
    frame = docs.select(*keep, F.col("text").alias("_scored_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            x = np.array([statistics(t) for t in texts_of(batch.column(len(keep)))]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(model.score(x))], names=[*keep, into[0]])

    return frame.mapInArrow(run, schema).withColumn(into[1], (F.col(into[0]) >= threshold).cast("int"))


def accept(docs: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are predicted to be of quality 1, columns as they are."""
    marks = ("_quality_score", "_quality")
    return classify(docs, model, into=marks, threshold=threshold).where(F.col(marks[1]) == 1).select(*docs.columns)


def held_out(doc_id: str = "doc_id"):
    """Rows kept from training: crc32 of the id as text leaves remainder 0 by 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; labels of held-out ids are never read by training."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    model = train(docs, labels)
    return classify(docs, model, keep=["doc_id"]).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted"
    )
