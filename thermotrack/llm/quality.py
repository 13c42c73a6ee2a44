"""Quality by regularised quadratic discriminant analysis of document statistics."""

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermotrack.llm.common import packed, saved, unpacked
from thermotrack.llm.labels import is_held_out, learned_labels

THRESHOLD = 0.7
SHRINKAGE = 0.1
_GROUPS = (
    bytes(range(65, 91)),  # capitals
    bytes(range(97, 123)),  # small letters
    b"0123456789",
    b".,;:'\"()-",
    b"!?",
    b"#$%&*|<>{}[]=+~^@_/\\",
    b" ",
    bytes(range(128, 256)),
)
_WORD_END = re.compile(r"[.!?]\s")
N_FEATURES = len(_GROUPS) + 8


@dataclass
class QualityModel:
    """Per class: mean, inverse of the Cholesky factor of the covariance, constant of the log density."""

    means: np.ndarray
    inverse_factors: np.ndarray
    constants: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 from the difference of the Mahalanobis log densities."""
        logs = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1)
                for m, f, c in zip(self.means, self.inverse_factors, self.constants, strict=True)]
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def statistics_of(text: str | None) -> list[float]:
    """Transformed statistics of one whole text; shares are on a log scale."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    size = len(raw)
    words = raw.split()
    n = len(words)
    lines = [line for line in text.split("\n") if line]
    shares = [(size - len(raw.translate(None, group))) / (size + 1) for group in _GROUPS]
    distinct = len(set(words)) / (n + 1)
    pairs = len(set(zip(words, words[1:], strict=False))) / (n + 1)
    shares += [distinct, pairs, len(set(lines)) / (len(lines) + 1),
               len(_WORD_END.findall(text)) / (n + 1), len(lines) / (n + 1)]
    out = np.log(np.array(shares) + 0.003).tolist()
    return [*out, np.log1p(n), np.log((size + 1) / (n + 1)), np.log1p(max(map(len, words), default=0))]


def document_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Columns of docs, and features array<double> from each whole text (null: as empty)."""
    whole = packed(docs, text=F.col(text))

    def run(batches):
        for batch in batches:
            rows = [statistics_of(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("row"), pa.array(rows, pa.list_(pa.float64()))], names=["row", "features"])

    kind = whole.schema["row"].dataType.simpleString()
    return unpacked(whole.mapInArrow(run, f"row {kind}, features array<double>"), features=F.col("features"))


def fit_quality(features: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE) -> QualityModel | None:
    """Fit on the statistics (doc_id, features) of all labelled documents that aren't held out.

    Sums, squares and products per class are added up in Spark; the driver gets those numbers. Each
    class covariance is shrunk towards the pooled one and a small multiple of the identity, on
    statistics in units of their pooled deviation. Without rows of both labels there is no model.
    """
    rows = features.select(F.col("doc_id").alias("id"), "features").join(learned_labels(labels, "quality"), "id")

    def moments(batches):
        sums = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column("features").to_pylist()).reshape(batch.num_rows, -1)
            y = batch.column("label").to_numpy()
            for label in (0, 1):
                own = np.hstack([np.ones((int((y == label).sum()), 1)), x[y == label]])
                sums[label] = sums.get(label, 0) + own.T @ own
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.int32()),
                                   pa.array([s.ravel().tolist() for s in sums.values()], pa.list_(pa.float64()))],
                                  names=["label", "sums"])

    parts = rows.select("label", "features").mapInArrow(moments, "label int, sums array<double>")
    total = parts.select("label", F.posexplode("sums").alias("at", "value")).groupBy("label", "at").agg(F.sum("value").alias("value"))
    found = {}
    for r in total.collect():  # classes times squared number of statistics
        found.setdefault(r["label"], {})[r["at"]] = r["value"]
    size = N_FEATURES + 1
    sums = [np.array([found.get(y, {}).get(i, 0.0) for i in range(size * size)]).reshape(size, size) for y in (0, 1)]
    if min(s[0, 0] for s in sums) < 1:
        return None
    means = [s[0, 1:] / s[0, 0] for s in sums]
    scatter = [s[1:, 1:] - s[0, 0] * np.outer(m, m) for s, m in zip(sums, means, strict=True)]
    counts = np.array([s[0, 0] for s in sums])
    pooled = sum(scatter) / counts.sum()
    unit = np.sqrt(np.maximum(np.diag(pooled), 1e-8))
    factors, constants = [], []
    for s, n in zip(scatter, counts, strict=True):
        own = s / n / np.outer(unit, unit)
        shrunk = (1 - shrinkage) * own + shrinkage * (0.5 * pooled / np.outer(unit, unit) + 0.5 * np.eye(len(unit)))
        factor = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(factor) / unit)
        constants.append(np.log(n / counts.sum()) - np.log(np.diag(factor)).sum())
    return QualityModel(np.array(means), np.array(factors), np.array(constants))


def score_quality(features: DataFrame, model: QualityModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """Columns of features, and quality (0 to 1), is_good (quality >= threshold); no model: 0.5."""
    whole = packed(features, features=F.col("features"))

    def run(batches):
        for batch in batches:
            if model is None:
                scores = np.full(batch.num_rows, 0.5)
            else:
                scores = model.scores(np.array(batch.column("features").to_pylist()).reshape(batch.num_rows, -1))
            yield pa.record_batch([batch.column("row"), pa.array(scores, pa.float64())], names=["row", "quality"])

    kind = whole.schema["row"].dataType.simpleString()
    found = whole.mapInArrow(run, f"row {kind}, quality double")
    return unpacked(found, quality=F.col("quality"), is_good=F.col("quality") >= threshold)


def quality_of(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Fit on the labels and score every document: doc_id, held_out, quality, is_good."""
    features = saved(document_statistics(docs.select("doc_id", "text")).drop("text"))
    scored = score_quality(features, fit_quality(features, labels), threshold)
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "quality", "is_good")
