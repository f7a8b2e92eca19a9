"""Queries run the whole job of their operator."""

import inspect
import os

import pytest

from inkveil.operators import classify, stats
from inkveil.plans import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


class Called(Exception):
    """Raised in place of the operator's work."""


def given(spark, monkeypatch, module, operator, query):
    """What the query's call leaves each of the operator's parameters at."""
    real, seen = getattr(module, operator), {}

    def call(*args, **kw):
        bound = inspect.signature(real).bind(*args, **kw)
        bound.apply_defaults()
        seen.update(bound.arguments)
        raise Called

    monkeypatch.setattr(module, operator, call)
    with pytest.raises(Called):
        Q.QUERIES[query](spark, SF)
    return seen


def test_logistic_baseline(spark, monkeypatch):
    seen = given(spark, monkeypatch, classify, "logistic_baseline", "logistic_baseline")
    assert seen["max_features"] == 100_000 and seen["iterations"] == 1000


@pytest.mark.parametrize("query", ["bootstrap_intervals", "bootstrap_means"])
def test_bootstrap(spark, monkeypatch, query):
    assert given(spark, monkeypatch, stats, "bootstrap", query)["replicates"] == 2000
