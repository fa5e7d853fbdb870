import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidegauge.llm import quality
from tidegauge.llm.queries import op6


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = op6(spark, folder).collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y, _ in held if y == 1], [s for s, y, _ in held if y == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([p == y for _, y, p in held]) > 0.95


def test_model_is_the_discriminant_of_the_moments(make):
    r = np.random.default_rng(1)
    d = len(quality.STATISTICS)
    x = np.concatenate([r.normal(0, 1, (300, d)), r.normal(0.5, 2, (200, d))])
    y = [0] * 300 + [1] * 200
    model = quality.fit(make([(k, v.tolist()) for k, v in zip(y, x)], "label int, x array<double>").repartition(5))
    assert model.centre == pytest.approx(x.mean(axis=0)) and model.scale == pytest.approx(x.std(axis=0))
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    covs = [np.cov(z[np.array(y) == k].T, bias=True) for k in (0, 1)]
    pooled = 0.6 * covs[0] + 0.4 * covs[1]
    cov = (1 - quality.POOL) * covs[1] + quality.POOL * pooled
    cov = (1 - quality.RIDGE) * cov + quality.RIDGE * np.trace(cov) / d * np.eye(d)
    assert model.factors[1].T @ model.factors[1] == pytest.approx(np.linalg.inv(cov), rel=1e-6, abs=1e-9)
    assert np.mean((model.score(x) >= 0.5) == (np.array(y) == 1)) > 0.95


def test_edges(spark, make):
    texts = pa.array([None, "", " ", "word", "x" * 500_000, "a b " * 200_000, "日本語。", "!!!"])
    x = quality.statistics(texts)
    assert x.shape == (8, len(quality.STATISTICS)) and np.isfinite(x).all() and (x[0] == x[1]).all()
    docs = make([(i, t, 1) for i, t in enumerate(texts.to_pylist())] + [(None, "no id", 1), (3, "word", 1)], "doc_id long, text string, score int")
    table = quality.statistics_table(docs, ["doc_id"])
    no_labels = make([], "doc_id long, quality int")
    assert quality.fit(quality.examples(table, no_labels)) is None
    assert {r.score for r in quality.score_table(table, None, ["doc_id"]).collect()} == {0.5}
    assert quality.accepted(docs, None).columns == docs.columns and quality.accepted(docs, None).count() == 10
    both = make([(6, 0), (6, 1), (7, None), (3, 5)], "doc_id long, quality int")  # contradicting, missing and other labels
    assert quality.examples(table, both).count() == 0
    assert quality.statistics_table(docs.limit(0), ["doc_id"]).count() == 0
