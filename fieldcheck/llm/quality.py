"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, small_batches
from .shingles import text_buffer, word_hashes
from .tables import table

#: Names of the statistics, in the order of statistics().
STATISTICS = (
    "log_chars", "log_words", "word_length", "upper", "digits", "marks", "sentence_marks", "exclamations", "lone_marks",
    "same_as_before", "distinct", "top_word", "lines", "wide",
)
#: Share of each class's covariance that is replaced by the diagonal of the pooled one.
SHRINKAGE = 0.1
#: Statistics are held to so many pooled standard deviations; log-density differences are divided by this.
REACH, TEMPERATURE = 6.0, 4.0

_IS = np.zeros((6, 256), np.int64)
_IS[0, 65:91] = 1  # upper case
_IS[1, 48:58] = 1  # digits
_IS[2, [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,!?;:'\"-()"]] = 1  # other marks
_IS[3, [ord(c) for c in ".?;:,"]] = 1
_IS[4, ord("!")] = 1
_IS[5, ord("\n")] = 1


def statistics(column: pa.Array) -> np.ndarray:
    """(documents, statistics) of a string column; every text gives finite values, null counts as empty."""
    data, offsets = text_buffer(column)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    size = np.diff(offsets)

    def sums(per_byte: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(per_byte, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    chars = sums((data & 0xC0) != 0x80)
    upper, digits, marks, ends, calls, lines = (sums(_IS[k][data]) for k in range(6))
    capitals = (data == 0xC3) & (np.append(data[1:], 0) >= 0x80) & (np.append(data[1:], 0) <= 0x9E)
    upper = upper + sums(capitals)
    words, begin = word_hashes(column)
    n = np.diff(begin)
    same, distinct, top = (np.zeros(len(n)) for _ in range(3))
    for k in np.flatnonzero(n):
        w = words[begin[k] : begin[k + 1]]
        _, counts = np.unique(w, return_counts=True)
        same[k], distinct[k], top[k] = (w[1:] == w[:-1]).sum(), len(counts), counts.max()
    space = (data == 32) | ((data >= 9) & (data <= 13))
    bare = np.ones(len(data) + 2, bool)
    bare[1:-1] = space
    bare[offsets] |= True
    lone = sums(_IS[2][data].astype(bool) & bare[:-2] & bare[2:])
    per_char, per_word = 1 / np.maximum(chars, 1), 1 / np.maximum(n, 1)
    root = lambda x: np.sqrt(np.maximum(x, 0))
    return np.column_stack(
        [
            np.log1p(chars),
            np.log1p(n),
            np.log1p(chars * per_word),
            root(upper * per_char),
            root(digits * per_char),
            root(marks * per_char),
            root(ends * per_word),
            root(calls * per_word),
            root(lone * per_word),
            root(same * per_word),
            np.log1p(distinct) - 0.8 * np.log1p(n),
            root((top - 1) * per_word),
            root(lines * per_word),
            root((size - chars) * per_char),
        ]
    )


@dataclass(frozen=True)
class Discriminant:
    """Two Gaussian classes over standardised statistics; factors are lower Cholesky factors, count says how many documents it was fitted on."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, np.ndarray]
    factors: tuple[np.ndarray, np.ndarray]
    log_odds: float
    count: int = 1

    @cached_property
    def whitening(self) -> tuple[np.ndarray, np.ndarray]:
        """Inverses of the factors, by forward substitution; they turn a deviation into one of unit covariance."""
        out = []
        for factor in self.factors:
            inverse = np.zeros_like(factor)
            for k in range(len(factor)):
                unit = np.zeros(len(factor))
                unit[k] = 1
                inverse[k] = (unit - factor[k, :k] @ inverse[:k]) / factor[k, k]
            out.append(inverse)
        return tuple(out)

    def standardised(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -REACH, REACH)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1, higher where class 1 is likelier."""
        z, density = self.standardised(x), []
        for mean, factor, white in zip(self.means, self.factors, self.whitening, strict=True):
            y = white @ (z - mean).T
            density.append(-0.5 * (y * y).sum(0) - np.log(np.diag(factor)).sum())
        logit = (density[1] - density[0] + self.log_odds) / TEMPERATURE
        return 1 / (1 + np.exp(-np.clip(logit, -700, 700)))


def _moments(centre: np.ndarray | None, scale: np.ndarray | None):
    """Rows (stats, label) -> per batch and class: count, sums and sums of products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(STATISTICS)
        count, total, square = np.zeros(2, np.int64), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in batches:
            x = batch.column("stats").flatten().to_numpy().reshape(-1, d)
            if centre is not None:
                x = np.clip((x - centre) / scale, -REACH, REACH)
            y = batch.column("quality").to_numpy()
            for c in (0, 1):
                count[c] += (y == c).sum()
                total[c] += x[y == c].sum(0)
                square[c] += x[y == c].T @ x[y == c]
        yield pa.RecordBatch.from_arrays(
            [pa.array([0, 1], pa.int64()), pa.array(count), pa.array(list(total)), pa.array([s.ravel() for s in square])],
            names=["quality", "n", "total", "square"],
        )

    return run


def _summed(rows: DataFrame, centre=None, scale=None) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Moments of the two classes; the driver gets two rows."""
    d = len(STATISTICS)
    parts = rows.mapInArrow(_moments(centre, scale), "quality long, n long, total array<double>, square array<double>")
    entry = lambda name, size: F.array(*[F.sum(F.col(name)[k]) for k in range(size)]).alias(name)
    found = {r["quality"]: r for r in parts.groupBy("quality").agg(F.sum("n").alias("n"), entry("total", d), entry("square", d * d)).collect()}
    zero = (0, np.zeros(d), np.zeros((d, d)))
    return [(found[c]["n"], np.array(found[c]["total"]), np.array(found[c]["square"]).reshape(d, d)) if c in found else zero for c in (0, 1)]


def fit(docs: DataFrame, labels: DataFrame) -> Discriminant:
    """Fit on all documents with a label whose crc32(doc_id as text) mod 4 is not 2.

    Only counts, sums and sums of products leave the executors. A document with several labels counts
    with the smallest, labels other than 0 and 1 are left out. A class without rows takes the pooled moments, and without any
    labels every score is 0.5.
    """
    return fit_measured(measured(docs.where("doc_id is not null").where(~held_out(F.col("doc_id")))), labels)


def fit_measured(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """``fit`` on the statistics of ``measured`` documents."""
    stats = stats.where("doc_id is not null").where(~held_out(F.col("doc_id")))
    labels = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("long").alias("quality"))
    stats = stats.join(labels, "doc_id").select("stats", "quality")
    stats = stats.persist()
    try:
        raw = _summed(stats)
        n, d = max(1, sum(r[0] for r in raw)), len(STATISTICS)
        centre = sum(r[1] for r in raw) / n
        scale = np.sqrt(np.maximum(np.diag(sum(r[2] for r in raw)) / n - centre**2, 0))
        scale[scale < 1e-9] = 1.0
        own = _summed(stats, centre, scale)
    finally:
        stats.unpersist()
    all_mean = sum(r[1] for r in own) / n
    pooled = sum(r[2] for r in own) / n - np.outer(all_mean, all_mean)
    means, factors = [], []
    for count, total, square in own:
        mean = total / count if count else all_mean
        covariance = square / count - np.outer(mean, mean) if count else pooled
        floor = np.diag(np.maximum(np.diag(pooled), 1e-3))
        means.append(mean)
        factors.append(np.linalg.cholesky((1 - SHRINKAGE) * covariance + SHRINKAGE * floor + 1e-6 * np.eye(d)))
    odds = float(np.log((own[1][0] + 1) / (own[0][0] + 1)))
    return Discriminant(centre, scale, tuple(means), tuple(factors), odds, sum(r[0] for r in own))


def _with_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(list(statistics(batch.column("text"))), pa.list_(pa.float64()))], names=["doc_id", "stats"])


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of every row of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_with_statistics, "doc_id long, stats array<double>")


def scored_measured(stats: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score) of ``measured`` documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("stats").flatten().to_numpy().reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def held_out(doc_id):
    """Whether a document's label is never learnt from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def scored(docs: DataFrame, model: Discriminant) -> DataFrame:
    """``docs`` (with a string column text) plus score; a column of that name is replaced. Null texts count as empty."""
    small_batches(docs.sparkSession)
    docs = docs.drop("score").withColumn("text", F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(statistics(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, score double")


#: From this score on a document counts as good.
THRESHOLD = 0.7


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model fitted on the labels that are not held out."""
    # the statistics of a text are a few per cent of its size; they are computed once, for the fit and for the scores
    stats = Scratch(spark, "quality").table(measured(table(spark, sf_dir, "documents")), "statistics")
    model = fit_measured(stats, table(spark, sf_dir, "labels"))
    return scored_measured(stats, model).select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
