"""Scoring: what a rewritten text still leaks, and what of its use it keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship
from ..functions.text import col, once
from .batch import METRICS, scores

__all__ = ["METRICS", "score"]


def score(df: DataFrame, text: str = "text", out: str = "out_text") -> DataFrame:
    """Adds the 17 metrics to rewritten rows (columns of ``rewrite.transform``)."""
    ship(df.sparkSession)
    own = df.columns
    count = lambda op: F.coalesce(F.try_element_at(F.col("operator_counts"), F.lit(op)), F.lit(0))
    told = [F.col(c).cast("int") for c in ("high_risk_span_count", "high_risk_suppress_count", "high_risk_abstract_count")]
    scored = scores(col(text), col(out), F.col("spans"), F.col("operators_applied"), count("SUPPRESS"), count("ABSTRACT"), *told)
    return df.withColumn("__scores", once(scored)).select(*own, "__scores.*")
