import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from annalist.llm import quality_classifier as quality
from annalist.llm.common import remainder
from tests.llm import fixtures


def corpus():
    draw, out = random.Random(0), []
    for k in range(300):
        good = draw.random() < 0.7
        text = fixtures.prose(k, 60) if good else " ".join(w + draw.choice(("###", "$$", "%%")) for w in fixtures.prose(k, 60).split())
        out.append((k, text, int(good)))
    return out


def test_held_out_accuracy(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, quality int")
    stats = quality.described(docs.select("doc_id", "text"))
    model = quality.train(stats, docs.select("doc_id", "quality"))
    scores = {r.doc_id: r.score for r in quality.scored(stats, model).collect()}
    held = [r[0] for r in docs.filter(remainder(F.col("doc_id"), 5) == 0).select("doc_id").collect()]
    truth = {i: q for i, _, q in corpus()}
    assert len(held) > 40
    assert np.mean([(scores[i] >= quality.THRESHOLD) == truth[i] for i in held]) > 0.97


def test_cosines_approximate_the_gaussian_kernel(monkeypatch):
    monkeypatch.setattr(quality, "FEATURES", 4096)
    kernel = quality.Kernel(np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS))
    x = np.random.default_rng(1).normal(size=(10, quality.STATISTICS))
    z = kernel(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * quality.STATISTICS))
    assert np.abs(z @ z.T - exact).max() < 0.08


def test_normal_equations_over_partitions(spark):
    draw = np.random.default_rng(0)
    x, y = draw.normal(size=(200, quality.STATISTICS)), draw.integers(0, 2, 200)
    frame = spark.createDataFrame([(k % 2, a.tolist(), float(b)) for k, (a, b) in enumerate(zip(x, y))], "fold int, stats array<double>, y double")
    kernel = quality.Kernel(x.mean(axis=0), x.std(axis=0))
    found = quality.normal_equations(frame.repartition(5), kernel).sum(axis=0)
    z = np.hstack([kernel(x), y[:, None]])
    assert np.allclose(found, z.T @ z)
    size = quality.FEATURES + 1
    assert np.allclose((found[:size, :size] + np.diag([quality.RIDGE * 200] * (size - 1) + [1e-9])) @ quality.solve(found), found[:size, size])


def test_isotonic_is_the_best_monotone_fit():
    draw = np.random.default_rng(0)
    n, p = draw.integers(1, 9, 40).astype(float), np.linspace(0, 1, 40)
    positives = np.minimum(n, np.round(n * np.clip(p + draw.normal(0, 0.3, 40), 0, 1)))
    fit, y = quality.isotonic(n, positives), positives / n
    assert (np.diff(fit) >= 0).all()
    # The max-min formula of isotonic regression.
    mean = lambda a, b: positives[a : b + 1].sum() / n[a : b + 1].sum()
    assert np.allclose(fit, [max(min(mean(a, b) for b in range(k, 40)) for a in range(k + 1)) for k in range(40)])
    assert len(y) == 40


def test_isotonic_fills_empty_bins():
    assert quality.isotonic(np.array([0, 2, 0, 2, 0.0]), np.array([0, 0, 0, 1, 0.0])).tolist() == [0, 0, 0.5, 0.5, 0.5]


@pytest.mark.parametrize("labels, score", [([], 0.5), ([(1, 1), (2, 1)], 1.0), ([(1, None), (None, 1), (999, 1)], 0.5)])
def test_few_labels(spark, labels, score):
    stats = quality.described(fixtures.documents(spark).select("doc_id", "text"))
    model = quality.train(stats, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert {r.score for r in quality.scored(stats, model).collect()} == {score}


def test_hard_cases_and_columns(spark):
    docs = fixtures.documents(spark)
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(20)] * 2 + [(107, 0), (104, 0)], "doc_id long, quality int")
    kept = quality.filtered(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() <= len(fixtures.rows()) and {r.score for r in kept.collect()} <= {0.5, None}
    assert quality.filtered(fixtures.nothing(spark), labels).count() == 0
    assert quality.statistics(None) == quality.statistics("") == [0.0] * quality.STATISTICS
    assert all(len(quality.statistics(t)) == quality.STATISTICS and np.isfinite(quality.statistics(t)).all() for _, t in fixtures.texts())
