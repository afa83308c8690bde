"""Quality classification by a regularised quadratic discriminant.

Each text is reduced to a few transformed statistics of its bytes, words and lines. Each
class gets a mean and a covariance that is shrunk towards the pooled one and towards its
diagonal; the score is the logistic function of the difference of the two log densities
(Mahalanobis distances through Cholesky factors that are computed once and shipped) plus
the log odds of the classes. Sums and products for the fit are gathered over all labelled
rows and summed in the cluster; only a matrix for each class reaches the driver.

Defined results: a null text counts as empty; an empty text has the score of its (zero)
statistics; labels that are null, or of unknown ids, teach nothing; a repeated label counts
as often as it occurs; without labels of both classes every score is the share of class 1
(0.5 with none); rows with null id are scored and not held out; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import bounded_batches, cut, held, table, values

#: Weights of the pooled covariance and of a diagonal one in a class's covariance.
POOL, DIAGONAL = 0.15, 0.05
#: Added to each variance of the standardised statistics.
FLOOR = 1e-3
THRESHOLD = 0.3
FOLDS = 5

NAMES = ("log_bytes", "upper", "digits", "symbols", "rare_symbols", "pipes", "bangs", "high_bytes", "word_length", "word_spread", "distinct_words", "repeated_next", "top_word", "line_words", "distinct_lines", "stops")
_KIND = np.zeros(256, np.int64)  # other
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:'\"-()?", b"#$%&*^~@<>{}[]\\=+_/", b"|", b"!", b" \t\n\r\x0b\x0c", bytes(range(128, 256))), 1):
    _KIND[list(_chars)] = _i
_PLACE = np.zeros((256, 10))
_PLACE[np.arange(256), _KIND] = 1.0


def statistics(raw: bytes) -> list[float]:
    """The transformed statistics of a UTF-8 text, all zero for one without words."""
    words = raw.split()
    if not words:
        return [0.0] * len(NAMES)
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _PLACE
    _, upper, lower, digit, stop, symbol, pipe, bang, _, high = kinds.tolist()
    n, length = len(words), np.fromiter(map(len, words), np.float64, len(words))
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    solid = max(1.0, len(raw) - kinds[8])
    return [
        float(np.log1p(len(raw))),
        float(np.sqrt(upper / max(1.0, upper + lower))),
        float(np.sqrt(digit / solid)),
        float(np.sqrt(symbol / solid)),
        float(np.log1p(symbol)),
        float(np.sqrt(pipe / n)),
        float(np.sqrt(bang / n)),
        float(np.sqrt(high / solid)),
        float(np.log(length.mean())),
        float(np.log1p(length.std())),
        float(np.log1p(len(counts)) / np.log1p(n)),
        float(np.sqrt(sum(map(bytes.__eq__, words, words[1:])) / n)),
        float(np.sqrt(max(counts.values()) / n)),
        float(np.log1p(n / len(lines))),
        len(set(lines)) / len(lines),
        float(np.sqrt(stop / n)),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of each row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(None, lambda: None)
        for batch in batches:
            x = [statistics(t or b"") for t in values(batch.column(1).cast(pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Discriminant:
    """Class means and inverse Cholesky factors over standardised statistics; row 0 is class 0."""

    share: float
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    means: np.ndarray | None = None
    #: For each class: the inverse of its Cholesky factor, and log prior minus half the log determinant.
    roots: np.ndarray | None = None
    offsets: np.ndarray | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.share)
        z = (x - self.centre) / self.scale
        density = [o - 0.5 * (((z - m) @ r.T) ** 2).sum(axis=1) for m, r, o in zip(self.means, self.roots, self.offsets, strict=True)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(labelled: DataFrame) -> Discriminant:
    """Fit on ``labelled(x, y)``, y 0 or 1: one pass of sums, a few numbers a partition."""
    p = len(NAMES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + p + p * p))
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().reshape(-1, p)
                y = batch.column(1).to_numpy()
                for c in (0, 1):
                    own = x[y == c]
                    total[c] += np.r_[len(own), own.sum(axis=0), (own.T @ own).ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], total.shape[1]).astype(np.int32)), pa.array(np.tile(np.arange(total.shape[1], dtype=np.int32), 2)), pa.array(total.ravel())], ["y", "k", "v"])

    got = labelled.select("x", F.col("y").cast("int")).mapInArrow(sums, "y int, k int, v double").groupBy("y", "k").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((2, 1 + p + p * p))
    for y, k, v in got:  # two matrices, whatever the input
        total[y, k] = v
    n = total[:, 0]
    if n.min() < 2:
        return Discriminant(float(n[1] / n.sum()) if n.sum() else 0.5)
    both = total.sum(axis=0)
    centre = both[1 : 1 + p] / both[0]
    scale = np.sqrt(np.maximum(np.diag(both[1 + p :].reshape(p, p)) / both[0] - centre**2, 0))
    scale[scale < 1e-9] = 1.0
    means = (total[:, 1 : 1 + p] / n[:, None] - centre) / scale
    own = []
    for c in (0, 1):
        m = total[c, 1 : 1 + p] / n[c]
        own.append((total[c, 1 + p :].reshape(p, p) / n[c] - np.outer(m, m)) / np.outer(scale, scale))
    pooled = (n[0] * own[0] + n[1] * own[1]) / n.sum()
    roots, offsets = [], []
    for c in (0, 1):
        s = (1 - POOL - DIAGONAL) * own[c] + POOL * pooled + DIAGONAL * np.diag(np.diag(pooled)) + FLOOR * np.eye(p)
        chol = np.linalg.cholesky(s)
        roots.append(np.linalg.inv(chol))
        offsets.append(np.log(n[c] / n.sum()) - np.log(np.diag(chol)).sum())
    return Discriminant(float(n[1] / n.sum()), centre, scale, means, np.stack(roots), np.array(offsets))


def fold(folds: int = FOLDS):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def learn(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """Fit on the rows of ``stats(doc_id, x)`` that ``labels(doc_id, quality)`` marks, without the held-out fold."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter("y in (0, 1)").filter(fold() != 0)
    return fit(stats.join(marked, "doc_id").select("x", "y"))


def predict(stats: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score) for each row of ``stats(doc_id, x)``."""
    p = len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, p)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], ["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def accept(docs: DataFrame, labels: DataFrame, least: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold; learnt from the labelled rows of ``docs``."""
    model, i = learn(with_statistics(docs), labels), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t or b"") for t in values(batch.column(i).cast(pa.binary()))]).reshape(-1, len(NAMES))
            yield batch.filter(pa.array(model.scores(x) >= least))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    stats = cut(with_statistics(table(spark, sf_dir, "documents")), "statistics")
    found = predict(stats, learn(stats, table(spark, sf_dir, "labels")))
    return found.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
