"""The fitted baseline reaches the minimum that it is defined by, in few passes over the rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkveil.operators import classify

ROWS, ITERATIONS = 240, 60


def made(spark):
    r = random.Random(5)
    words = [f"w{int(r.paretovariate(0.7)) % 3000}" for _ in range(20_000)]
    rows = [(i, " ".join(r.choice(words) for _ in range(60)) + (" good" if i % 4 and r.random() < 0.6 else ""), int(i % 4 > 0)) for i in range(ROWS)]
    return spark.createDataFrame(rows, "doc_id int, text string, label int")


def slope(model, df) -> tuple[float, float]:
    """Length of the gradient at the model's coefficients, and the value there."""
    got = model.transform(classify.with_terms(df)).select("features", "label").collect()
    x, y = np.array([r[0].toArray() for r in got]), np.array([r[1] for r in got])
    w = np.where(y == 1, ROWS / (2 * y.sum()), ROWS / (2 * (1 - y).sum()))
    last = model.stages[-1]
    b, reg = last.coefficients.toArray(), 1 / ROWS
    z = x @ b + last.intercept
    rest = w * (1 / (1 + np.exp(-z)) - y) / w.sum()
    return float(np.linalg.norm(np.append(x.T @ rest + reg * b, rest.sum()))), float(w @ (np.logaddexp(0, z) - y * z) / w.sum() + reg / 2 * b @ b)


def test_fit_ends_at_the_minimum(spark):
    df = made(spark).cache()
    length, _ = slope(classify.logistic_baseline(df, iterations=ITERATIONS), df)
    assert length < 2e-5


def test_blocks_do_not_change_the_fit(spark, monkeypatch):
    df = made(spark).cache()
    want = classify.logistic_baseline(df).stages[-1]
    at = np.append(want.coefficients.toArray(), want.intercept)
    rows = classify.logistic_baseline(df).transform(classify.with_terms(df)).select("features", F.col("label").cast("double"), F.lit(1.0)).collect()
    whole = next(classify._losses(list(classify._packed(rows)), at))
    monkeypatch.setattr(classify, "BLOCK", 7)
    cut = list(classify._packed(rows))
    assert len(cut) == -(-ROWS // 7)
    total, loss, gradient = next(classify._losses(cut, at))
    assert total == whole[0] and loss == pytest.approx(whole[1]) and np.allclose(gradient, whole[2])


def test_minimise():
    a = np.diag(np.logspace(0, 4, 30))
    at, n = classify.minimise(lambda x: (float(x @ a @ x / 2 - x.sum()), a @ x - 1), np.zeros(30), 500)
    assert np.allclose(at, 1 / np.diag(a), atol=1e-3) and n < 400
