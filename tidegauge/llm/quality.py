"""Quality classifier: regularised quadratic discriminant analysis on document statistics.

Each class is a Gaussian over transformed, standardised statistics of the text.  Its covariance is shrunk towards the pooled
one and then towards a multiple of the identity.  The score is the logistic of the difference of the two log densities
(Mahalanobis distances through Cholesky factors that the model keeps), priors and a temperature included.

Training needs sums only: count, sums and products of each class come from one distributed aggregation over all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.arrays import Words, distinct_per_row, parts
from tidegauge.llm.shared import bounded

STATISTICS = (
    "words", "word_length", "word_length_spread", "long_words", "symbols", "exclamations", "bars", "stops", "capitals", "all_capitals",
    "digits", "same_as_before", "distinct", "repeated_shingles", "sentence_length", "lines", "gaps")
POOL = 0.3  # share of the pooled covariance
RIDGE = 0.02  # share of the identity
TEMPERATURE = 4.0  # the statistics are not independent of each other; densities are overconfident by about this factor
ACCEPT = 0.3
FEW = 4.0  # words added to every count that a share is taken of


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of transformed statistics per text; null and empty texts give the statistics of no words."""
    out = [np.zeros((0, len(STATISTICS)))]
    for _, _, data, offsets in parts(texts):
        w = Words(data, offsets)
        n_bytes, n = np.diff(offsets).astype(float), np.diff(w.row).astype(float)
        per_word, per_byte = 1 / (n + FEW), 1 / (n_bytes + 6 * FEW)  # a few words say little

        def bytes_in(flags: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(flags)])
            return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

        def words_in(values: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0.0], np.cumsum(values.astype(float))])
            return sums[w.row[1:]] - sums[w.row[:-1]]

        def one_of(chars: bytes) -> np.ndarray:
            table = np.zeros(256, bool)
            table[list(chars)] = True
            return table[data]

        upper = (data >= 65) & (data <= 90)
        letters = bytes_in(upper | (data >= 97) & (data <= 122) | (data >= 192))
        upper_sums = np.concatenate([[0], np.cumsum(upper)])
        size = w.end - w.start
        mean = words_in(size) / np.maximum(n, 1)
        spread = np.sqrt(np.maximum(0, words_in((size - np.repeat(mean, np.diff(w.row))) ** 2) * per_word))
        same = np.zeros(len(w.hash), bool)
        same[1:] = w.hash[1:] == w.hash[:-1]
        same[w.row[:-1][n > 0]] = False
        shingles, shingle_rows = w.shingles(5)
        n_shingles = np.diff(shingle_rows)
        different = np.diff(distinct_per_row(shingles, shingle_rows)[1])
        distinct = np.diff(distinct_per_row(w.hash, w.row)[1])
        share = lambda x, scale: np.log1p(scale * x)
        out.append(np.column_stack([
            np.log1p(n), np.log1p(mean), np.log1p(spread), share(words_in(size > 12) * per_word, 10),
            share(bytes_in(one_of(b"*$%&#@^~=<>{}[]\\_+")) * per_word, 20), share(bytes_in(one_of(b"!?")) * per_word, 20),
            share(bytes_in(one_of(b"|/")) * per_word, 20), share(bytes_in(one_of(b".,;:")) * per_word, 10),
            share(bytes_in(upper) / (letters + 6 * FEW), 10), share(words_in((upper_sums[w.end] - upper_sums[w.start] >= 2)) * per_word, 20),
            share(bytes_in((data >= 48) & (data <= 57)) * per_byte, 50), share(words_in(same) * per_word, 20),
            np.log(distinct + FEW) - np.log(n + FEW), share((n_shingles - different) / (n_shingles + FEW), 10),
            np.log1p(n / (1 + bytes_in(one_of(b".!?\n")))), share(bytes_in(data == 10) * per_word, 20),
            share(bytes_in((data <= 32) & (data != 10)) * per_byte, 10)]))
    return np.concatenate(out)


@dataclass(frozen=True)
class Discriminant:
    """Standardisation, and for each class its mean, inverse Cholesky factor and log constant."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple
    factors: tuple
    constants: tuple

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -12, 12)
        low, high = (c - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants))
        return 1 / (1 + np.exp(np.clip((low - high) / TEMPERATURE, -700, 700)))


def statistics_table(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Key columns and ``x``, the statistics of each text; texts do not leave their task."""
    d = [f for f in docs.select(*keys).schema.fields]

    def compute(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            x = statistics(batch.column("text"))
            values = pa.ListArray.from_arrays(
                pa.array(np.arange(0, x.size + 1, len(STATISTICS), dtype=np.int32)), pa.array(x.ravel()))
            yield pa.record_batch([batch.column(f"k{i}") for i in range(len(d))] + [values], [*(f.name for f in d), "x"])

    rows = bounded(docs).select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col(text).alias("text"))
    return rows.mapInArrow(compute, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d) + ", x array<double>")


def fit(examples: DataFrame, label: str = "label", x: str = "x") -> Discriminant | None:
    """Discriminant from (label 0/1, x).  None unless both classes have two rows.

    Every labelled row counts: each partition sums, then sums are added per class and position (2 x 190 numbers at the end)."""
    d = len(STATISTICS)

    def sums(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for batch in stream:
            if batch.num_rows:
                labels = batch.column("label").to_numpy(zero_copy_only=False)
                rows = batch.column("x").flatten().to_numpy().reshape(-1, d)
                for k in (0, 1):
                    v = rows[labels == k]
                    got = np.concatenate([[len(v)], v.sum(axis=0), (v.T @ v)[np.triu_indices(d)]])
                    total[k] = total[k] + got if k in total else got
        for k, v in total.items():
            yield pa.record_batch([pa.array(np.full(len(v), k)), pa.array(np.arange(len(v))), pa.array(v)], ["label", "at", "v"])

    parts_ = examples.select(F.col(label).cast("int").alias("label"), F.col(x).alias("x")).where("label in (0, 1)")
    got = parts_.mapInArrow(sums, "label long, at long, v double").groupBy("label", "at").agg(F.sum("v").alias("v")).collect()
    table = np.zeros((2, 1 + d + d * (d + 1) // 2))
    for row in got:
        table[row["label"], row["at"]] = row["v"]
    n = table[:, 0]
    if n.min() < 2:
        return None

    def moments(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        square = np.zeros((d, d))
        square[np.triu_indices(d)] = row[1 + d:]
        mean = row[1:1 + d] / row[0]
        return mean, (square + np.triu(square, 1).T) / row[0] - np.outer(mean, mean)

    centre, spread = moments(table.sum(axis=0))
    scale = np.sqrt(np.maximum(np.diag(spread), 1e-6))
    classes = [moments(row) for row in table]
    scaled = [c / np.outer(scale, scale) for _, c in classes]
    pooled = (n[0] * scaled[0] + n[1] * scaled[1]) / n.sum()
    means, factors, constants = [], [], []
    for k in (0, 1):
        cov = (1 - POOL) * scaled[k] + POOL * pooled
        cov = (1 - RIDGE) * cov + RIDGE * max(np.trace(cov) / d, 1e-3) * np.eye(d)
        lower = np.linalg.cholesky(cov)
        means.append((classes[k][0] - centre) / scale)
        factors.append(np.linalg.inv(lower))
        constants.append(float(np.log(n[k] / n.sum()) - np.log(np.diag(lower)).sum()))
    return Discriminant(centre, scale, tuple(means), tuple(factors), tuple(constants))


def scores(model: Discriminant | None, x: np.ndarray) -> np.ndarray:
    """Without a model (no labels of one class) every text scores 0.5 and is kept."""
    return model.score(x) if model is not None else np.full(len(x), 0.5)


def held_out(doc_id) -> F.Column:
    """Rows never learnt from: crc32 of the id as text is divisible by 5; so are rows without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def examples(table: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """(label, x) of the rows to learn from.  Null labels and ids with both labels are left out."""
    marks = labels.where(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").alias("__id")).agg(
        F.min(label).alias("label"), F.max(label).alias("__other")).where("label = __other")
    return table.where(~held_out(doc_id)).join(marks, F.col(doc_id) == F.col("__id")).select("label", "x")


def score_table(table: DataFrame, model: Discriminant | None, keys: list[str], x: str = "x") -> DataFrame:
    """Key columns, score and predicted for a table of statistics."""
    fields = table.select(*keys).schema.fields

    def compute(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            s = scores(model, batch.column(x).flatten().to_numpy().reshape(-1, len(STATISTICS)))
            yield pa.record_batch([batch.column(f.name) for f in fields] + [pa.array(s), pa.array((s >= ACCEPT).astype(np.int32))],
                                  [*(f.name for f in fields), "score", "predicted"])

    return table.select(*keys, x).mapInArrow(
        compute, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double, predicted int")


def accepted(docs: DataFrame, model: Discriminant | None, text: str = "text") -> DataFrame:
    """Rows whose text is predicted 1, all columns as they are; nothing is shuffled."""

    def keep(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            yield batch.filter(pa.array(scores(model, statistics(batch.column(text))) >= ACCEPT))

    return bounded(docs).mapInArrow(keep, docs.schema)


__all__ = ["accepted", "examples", "fit", "held_out", "score_table", "scores", "statistics", "statistics_table"]
